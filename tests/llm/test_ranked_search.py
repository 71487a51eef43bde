import math
import random
import re
from collections import Counter

import numpy as np
from check import compare, connect
from conftest import DATA
from llm_cases import docs, nothing, rows, same_rows  # noqa: F401

from daypanel.llm import queries, ranked_search


def plain_terms(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def plain_search(docs, items, k):
    counts = [(key, Counter(plain_terms(text))) for key, text in docs]
    counts = [(key, c) for key, c in counts if c]
    n, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    ranked = []
    for item, text in items:
        scored = []
        for key, c in counts:
            m = 50 + 50 * c.total() * n // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(plain_terms(text)) & c.keys()
            )
            scored += [(-score, key is None, key)] if score > 0 else []
        scored.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        ranked += [(item, at + 1, r[2], -r[0]) for at, r in enumerate(scored[:k])]
    return ranked


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def zipf(seed, n, words=60, size=40):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(rng.choices(names, weights, k=rng.randint(1, size)))) for i in range(n)]


def test_equals_brute_force_in_many_blocks(spark):
    texts, items = zipf(1, 400), [(i, t) for i, t in zipf(2, 12, size=25)]
    expected = plain_search(texts, items, 10)
    for block, at_once in ((7, 5), (64, 100), (1_000, 12)):
        same_rows(ranked_search.ranked_search(*tables(spark, texts, items), 10, block=block, items_at_once=at_once), expected)


def test_ties_go_by_id(spark):
    texts = [(i, "same words here") for i in range(30, 0, -1)] + [(None, "same words here"), (99, "other text"), (98, "words")]
    items = [(1, "same same words"), (2, "here"), (2, "other"), (3, "absent"), (4, None), (None, "words")]
    same_rows(ranked_search.ranked_search(*tables(spark, texts, items), 4, block=3), plain_search(texts, items, 4))


def test_operator_on_odd_rows(docs, rows, nothing, spark):
    items = [(1, rows[3][1]), (2, "idiot the"), (3, "日本語の文章 WORD"), (4, "")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    plain = plain_search([(r[0], r[1]) for r in rows], items, 6)
    same_rows(ranked_search.ranked_search(docs, asked, 6, block=10), plain)
    assert ranked_search.ranked_search(nothing, asked).collect() == []
    assert ranked_search.ranked_search(docs, asked.where("false")).collect() == []


def test_names_of_columns_and_string_ids(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "three")], "name string, body string")
    items = spark.createDataFrame([("x", "one")], "q string, asked string")
    found = ranked_search.ranked_search(docs, items, 5, "name", "body", "q", "asked")
    assert [tuple(r)[:3] for r in found.orderBy("rank").collect()] == [("x", 1, "a"), ("x", 2, "b")]


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Añb 12!x " * 200 + "y" * 500 + " z"
    whole = ranked_search.term_counts(text)
    monkeypatch.setattr(ranked_search, "PIECE", 37)
    assert ranked_search.term_counts(text) == whole == Counter(t.encode() for t in plain_terms(text))


def blocks(texts, vocabulary, frequent):
    number = {t: i for i, t in enumerate(vocabulary)}
    held = [sorted((number[t], n) for t, n in Counter(plain_terms(x)).items() if t in number) for _, x in texts]
    df = np.array([sum(any(t == i for t, _ in h) for h in held) for i in range(len(vocabulary))])
    corpus = ranked_search.Corpus(len(texts), sum(len(plain_terms(x)) for _, x in texts), df)
    terms, tfs = [[t for t, _ in h] for h in held], [[n for _, n in h] for h in held]
    sizes = [len(plain_terms(x)) for _, x in texts]
    most = np.sort(np.argsort(-df, kind="stable")[:frequent].astype(np.int32))
    return ranked_search.Block(len(texts), ranked_search.block_of(terms, tfs, sizes, corpus, most)), terms


def test_pair_bounds_hold_and_skip_more_than_single_ones():
    texts = zipf(5, 300)
    block, terms = blocks(texts, [f"w{i}" for i in range(60)], 20)
    impact = {(int(t), int(d)): int(x) for i, t in enumerate(block.terms) for d, x in zip(
        block.docs[block.starts[i] : block.starts[i + 1]], block.impacts[block.starts[i] : block.starts[i + 1]], strict=True)}
    for (a, b), joint in block.joint.items():
        assert joint == max(impact[a, d] + impact[b, d] for d, t in enumerate(terms) if a in t and b in t)
    order = np.argsort(block.tops, kind="stable")
    held, tops = block.terms[order].tolist(), block.tops[order].tolist()
    paired = ranked_search.head_bounds(held, tops, block.joint, block.frequent)
    single = ranked_search.head_bounds(held, tops, block.joint, set())
    assert single[-1] == sum(tops) and all(p <= s for p, s in zip(paired, single, strict=True)) and paired[-1] < single[-1]
    for size in range(len(held) + 1):
        head = set(held[:size])
        assert paired[size] >= max(sum(impact[t, d] for t in set(own) & head) for d, own in enumerate(terms))


def test_heads_are_skipped_without_loss():
    block, _ = blocks(zipf(6, 800), [f"w{i}" for i in range(60)], 32)
    wanted = np.array([0, 1, 2, 3, 4, 40, 50], np.int32)
    wanted = wanted[np.isin(wanted, block.terms)]
    docs, scores = block.scores(wanted, 0)
    least = int(np.sort(scores)[-10])
    seen = Counter()
    few, best = block.scores(wanted, least, seen)
    assert seen["skipped"] > 0 and seen["documents"] < len(docs)
    assert sorted(zip(few, best, strict=True)) == sorted((d, s) for d, s in zip(docs, scores, strict=True) if s >= least)
    assert len(block.scores(wanted, 10**18)[0]) == 0


def test_query_equals_sql(spark):
    assert compare(queries.op12_ranked_search(spark, DATA), connect(DATA), queries.SQL["op12_ranked_search"]) is None
