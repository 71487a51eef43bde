import random
import re
import zlib
from collections import Counter

from check import compare, connect
from conftest import DATA
from llm_cases import docs, nothing, rows, same_rows  # noqa: F401
from pyspark.sql import functions as F

from daypanel.llm import queries, spelling


def plain_counts(rows, least=7):
    counts = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts, factor=10):
    found = {}
    for w, n in counts.items():
        near = [v for v in counts if v != w and one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        found[w] = (best if best and counts[best] >= factor * n else None, n, len(near))
    rows = []
    for w, (form, n, near) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        rows.append((w, form, root, n, near, counts[form] if form else None))
    return rows


def words_of(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def some_words(seed, size=260, letters="abéÿß", longest=9):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))): rng.choice([2, 3, 20, 30, 300, 4000]) for _ in range(size)}


def test_neighbours_forms_and_roots_equal_brute_force(spark):
    for seed, range_words in ((1, 10_000), (2, 7), (3, 1)):  # one range, many, a word each
        counts = some_words(seed)
        same_rows(spelling.spelling_variants(words_of(spark, counts), range_words=range_words), plain_variants(counts))


def test_runs_of_one_letter_count_a_neighbour_once(spark):
    counts = {"a": 2, "aa": 3, "aaa": 40, "aaaa": 500, "aaba": 5, "b": 7000}
    same_rows(spelling.spelling_variants(words_of(spark, counts)), plain_variants(counts))


def test_chains_are_followed_to_the_end(spark):
    word = "abcdefghijklmnop"
    counts = {word[:i] + "z" * (16 - i): 2 * 10 ** (16 - i) for i in range(17)}
    found = plain_variants(counts)
    assert {r[2] for r in found} == {"z" * 16} and sum(r[1] is None for r in found) == 1
    same_rows(spelling.spelling_variants(words_of(spark, counts), range_words=3), found)


def test_long_words_and_many_neighbours(spark):
    long = "x" * 3_000
    counts = {long: 50, long + "y": 5, "y" + long: 4, long[:-1]: 900}
    counts |= {f"middle{a}{b}": 2 for a in "abcdefghijklmnopqrstuvwxyz" for b in "mnop"}
    same_rows(spelling.spelling_variants(words_of(spark, counts), range_words=20), plain_variants(counts))


def test_numbers_of_nodes_tell_prefixes_apart():
    words = sorted(some_words(9, 400))
    numbering = spelling.Numbering(sorted(words[::37]))
    number_of = {}
    for w in words:
        path = numbering.path(w, numbering.range_of(w))
        assert len(path) == len(w) + 1
        for d, node in enumerate(path):
            assert number_of.setdefault(w[:d], node) == node
    assert len(set(number_of.values())) == len(number_of)


def test_word_counts(docs, rows, nothing):
    same_rows(spelling.word_counts(docs), list(plain_counts(rows).items()))
    assert spelling.spelling_variants(spelling.word_counts(nothing)).collect() == []


def test_operator_on_odd_rows(docs, rows):
    same_rows(spelling.spelling_variants(spelling.word_counts(docs), range_words=50), plain_variants(plain_counts(rows)))


def test_a_task_hands_on_its_words_in_parts(spark, monkeypatch):
    texts = [(i, " ".join(f"word{c}{d}xyz" for c in "abcdef" for d in "abcdef")) for i in range(3)]
    monkeypatch.setattr(spelling, "HELD_WORDS", 5)
    parts = [b.num_rows for b in spelling._counting(7, 31)(iter(spark.createDataFrame(texts, "key string, text string").toArrow().to_batches()))]
    assert len(parts) == 4 and parts[-1] == 0


def test_query_equals_sql(spark):
    assert compare(queries.op11_spelling(spark, DATA), connect(DATA), queries.SQL["op11_spelling"]) is None


def test_no_join_lists_pairs(spark):
    entries = spark.createDataFrame([], "p long, s long, wid long, n long, kind byte")
    plan = spelling.neighbours(entries)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and F is not None
