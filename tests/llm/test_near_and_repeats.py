import hashlib
import random
from collections import Counter

import numpy as np
import xxhash
from conftest import DATA
from llm_cases import docs, nothing, rows, same_rows  # noqa: F401

from daypanel.llm import induced_sort, queries, simhash, suffix_dedup


def plain_fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    for c in "\t\n\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """Smallest id reachable, by comparing every pair."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(prints):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash_against_all_pairs(docs, rows, nothing, spark):
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    expected = [(k, f"{p:016x}", c) for (k, p), c in zip(prints, plain_components(prints), strict=True)]
    same_rows(simhash.near_duplicates(docs), expected)
    assert simhash.near_duplicates(nothing).collect() == []
    given = [(r["doc_id"], plain_fingerprint(r["text"])) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    expected = [(k, f"{p:016x}", c) for (k, p), c in zip(given, plain_components(given), strict=True)]
    same_rows(queries.op2_simhash(spark, DATA), expected)


def test_links_of_crowded_fingerprints(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(50)}
    for _ in range(400):  # chains and clusters that share halves
        p = rng.choice(sorted(prints))
        for _ in range(rng.randint(1, 3)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    signed = sorted(int(np.uint64(p).astype(np.int64)) for p in prints)
    roots = {r["fp"]: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()}
    got = [roots.get(p, p) for p in signed]
    least = plain_components([(p, p & (1 << 64) - 1) for p in signed])
    assert got == least


def test_one_of_each_group_stays(docs, rows):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    groups = {}
    for r, c in zip(rows, plain_components([(i, p) for i, (_, p) in enumerate(prints)]), strict=True):
        groups.setdefault(c, set()).add((r[0] is None, r[0], r[1]))
    by_group = Counter()
    of = {m: g for g, members in groups.items() for m in members}
    seen = {(r["doc_id"] is None, r["doc_id"], r["text"]) for r in kept.collect()}
    for s in seen:
        by_group[of[s]] += 1
    assert set(by_group) == set(groups) and set(by_group.values()) == {1}


def plain_repeats(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    result = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        result.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return result


def digest_rows(df):
    return [(r["doc_id"], len(r["kept"]) + (n := sum(b - a for a, b in r["removed"])), n, len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()]


def test_repeats_against_brute_force(docs, rows, nothing, spark, monkeypatch):
    expected = [(r[0], *p) for r, p in zip(rows, plain_repeats([r[1] for r in rows]), strict=True)]
    order = lambda r: (r[0] is not None, r)
    found = digest_rows(suffix_dedup.remove_repeats(docs))
    assert sorted(found, key=order) == sorted(expected, key=order)
    assert sum(e[2] > 0 for e in expected) > 8
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", 1)  # every mixed anchor takes the way for hot ones
    assert sorted(digest_rows(suffix_dedup.remove_repeats(docs)), key=order) == sorted(expected, key=order)
    assert suffix_dedup.remove_repeats(nothing).collect() == []


def test_repeats_query(spark):
    given = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    same_rows(queries.op6_suffix_dedup(spark, DATA), [(r["doc_id"], *p) for r, p in zip(given, plain_repeats([r["text"] for r in given]), strict=True)])


def test_suffix_array():
    rng = random.Random(0)
    for _ in range(300):
        t = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 60))] + [0]
        assert induced_sort.suffix_array(np.array(t, np.int16), 10**6).tolist() == sorted(range(len(t)), key=lambda i: t[i:])  # noqa: B023


def test_kept_text_has_whole_characters_only(spark):
    shared = "é" * 150
    # "è" and "ü" begin with the byte that "é" begins with, so that byte ends a repeated string and only half a character is left.
    rows = [(1, "a" + shared + "è"), (2, "bc" + shared + "ü"), (3, "é" * 99), (4, "xà" + "y" * 250 + "œ!"), (5, "zà" + "y" * 250 + "w")]
    cut = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r["kept_text"] for k, r in cut.items()} == {1: "a", 2: "bc", 3: "é" * 99, 4: "xœ!", 5: "zw"}
    assert cut[1]["kept"] == b"a" + "è".encode()[1:] and cut[5]["kept"] == b"zw"
