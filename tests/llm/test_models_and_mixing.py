import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from conftest import DATA
from llm_cases import docs, nothing, rows, same_rows  # noqa: F401
from pyspark.sql import functions as F

from daypanel.llm import fingerprints, language, mixing, queries, toxicity

LARGER = "/root/testdata/sf0.01"


def fold(key):
    return zlib.crc32(str("" if key is None else key).encode()) % 4


def test_segments_against_all_spans():
    """Maximal segments by definition: the best span, then the same left and right of it."""

    def by_definition(scores, at=0):
        spans = [(sum(scores[a:b]), -(b - a), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        if not spans or max(spans)[0] <= 0:
            return []
        total, _, a, b = max(spans)
        return by_definition(scores[:a], at) + [(at + a, at + b - 1, total)] + by_definition(scores[b:], at + b)

    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-1.5, -1.5, 1.0, 2.25, 4.125]) for _ in range(rng.randint(0, 14))]
        hits = [(i, s) for i, s in enumerate(scores) if s > 0]
        assert toxicity.maximal_segments(hits, -1.5) == by_definition(scores)


def test_toxicity(docs, rows, nothing, spark):
    labels = spark.createDataFrame([(r[0], int("idiot" in (r[1] or ""))) for r in rows] + [(10**6, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    assert {"idiot", "scum", "loser"} >= set(model.scores)
    total = math.exp(model.other)
    assert total < 1
    scored = {(r["doc_id"], r["score"], len(r["passages"])) for r in toxicity.score(docs, model).collect()}
    assert len(scored) >= len({r[0] for r in rows}) and all(0 <= s <= 1 for _, s, _ in scored)
    assert toxicity.score(nothing, model).collect() == []
    empty = toxicity.fit(toxicity.training_rows(docs, labels.where("toxic = 0")))
    assert toxicity.score(docs, empty).where("score != 0").count() == 0
    assert toxicity.drop_toxic(docs, empty).count() == len(rows)
    assert toxicity.training_rows(docs, labels, max_rows=5).count() <= 9


def test_few_toxic_texts_teach(spark):
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in ("st", "gr", "pl") for b in "aeiou" for c in ("nt", "rd", "m", "ck")]
    plain = lambda n: [rng.choice(words) for _ in range(n)]
    rows = [(i, " ".join(plain(300)), 0) for i in range(55)]
    rows += [(100 + i, " ".join([*plain(150), "idiot", *plain(3), "scum", "idiot", *plain(140)]), 1) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(toxicity.training_rows(df, df))
    assert {"idiot", "scum"} <= set(model.scores) and len(model.scores) <= 6
    found = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert all((found[i] >= 0.3) == bool(toxic) for i, _, toxic in rows)


def test_chances():
    share = 0.1
    for toxic, clean in ((5, 0), (8, 3), (40, 20)):  # the bound is no smaller than the chance itself
        n = toxic + clean
        exact = sum(math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(toxic, n + 1))
        bound = toxic * math.log(toxic / (n * share)) + (clean * math.log(clean / (n * (1 - share))) if clean else 0)
        assert math.exp(-bound) >= exact * (1 - 1e-9)
    assert toxicity.most_likely_chance([(-20.0, 2), (-9.0, 3), (0.0, 9_995)]) == -20.0
    assert toxicity.most_likely_chance([(0.0, 50)]) == -math.inf


def test_equal_texts_teach_once(spark):
    docs = spark.createDataFrame([(1, "same"), (2, "same"), (3, "same"), (4, "other"), (4, "fourth"), (5, "fifth")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 2)) for i in range(1, 6)], "doc_id long, toxic int")
    found = sorted(map(tuple, toxicity.training_rows(docs, labels).collect()))
    first = docs.where("doc_id = 4").orderBy(F.xxhash64("text")).first()["text"]
    assert found == sorted([("fifth", 0), (first, 0), ("same", 1)])


def test_passages_point_at_the_words():
    model = toxicity.ToxicModel({"idiot": 9.0, "scum": 9.0}, -0.1, 0.01, 1.0, -3.0)
    text = "Fine words. You IDIOT, scum! " + "calm " * 300 + "scum"
    spans = [text[a:b] for a, b, _, _ in toxicity.passages_of(text, model)]
    assert spans == ["IDIOT, scum", "scum"]
    assert toxicity.passages_of("", model) == []


def test_toxicity_on_held_out_rows(spark):
    found = {r["doc_id"]: r for r in queries.op5_toxicity(spark, LARGER).collect()}
    labels = [r for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect() if fold(r["doc_id"]) == 2]
    assert labels and all(found[r["doc_id"]]["held_out"] for r in labels)
    right = sum(found[r["doc_id"]]["predicted"] == r["toxic"] for r in labels)
    assert right / len(labels) > 0.97


def test_cross_parsing_against_search():
    rng = random.Random(2)
    for _ in range(200):
        sample = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 40)))
        text = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 30)))
        n, at = 0, 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in sample:
                size += 1
            n, at = n + 1, at + (size if text[at] in sample else 1)
        assert language.SuffixAutomaton(sample).phrases(text) == (n, len(text))


def test_languages_that_cannot_win_stop_early():
    rng = random.Random(7)
    automata = [(lang, language.SuffixAutomaton("".join(rng.choices(letters, k=400)))) for lang, letters in (("a", "abcd "), ("b", "bcde "), ("c", "xyz "))]
    stopped = 0
    for letters in ("abcd ", "bcde ", "xyz ", "abcdexyz "):
        text = language.normalise("".join(rng.choices(letters, k=5_000)))
        costs = sorted((a.phrases(text)[0] * a.bits, lang) for lang, a in automata)
        assert language.classify(text, automata)[0] == costs[0][1]
        for _, a in automata:
            n, read = a.phrases(text, costs[0][0] / a.bits)
            assert n * a.bits > costs[0][0] or read == len(text)
            stopped += read < len(text)
    assert stopped >= 4


def test_what_is_no_letter_has_no_language(spark):
    rows = [(1, "²½ Ⅷ", "es"), (2, "casa grande", "es"), (3, "12 !!", "de"), (4, "haus", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(df, language.learn(df)).collect()}
    assert found == {1: "und", 2: "es", 3: "und", 4: "de"}


def test_every_one_of_many_languages_is_learned(spark):
    alphabet = [chr(0x4E00 + i) for i in range(300)]
    rows = [(i, f"{c}{c}{c} {c}" * 30, f"x{i:03d}") for i, c in enumerate(alphabet) for _ in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.learn(df, total_chars=30_000)
    assert len(sample) == 300 and max(len(t) for _, t in sample) <= 110
    found = language.predict(df.where("doc_id % 50 = 0").distinct(), sample).collect()
    assert len(found) == 6 and all(r["lang_pred"] == f"x{r['doc_id']:03d}" for r in found)


def test_sample_is_spread_over_a_text(spark):
    text = "".join(chr(97 + i // 100) for i in range(2_000))
    df = spark.createDataFrame([(text, "zz"), ("short", "zz")], "text string, lang string")
    ((_, sample),) = language.learn(df, sample_rows=2, sample_chars=400)
    assert {"a", "g", "h", "t"} <= set(sample) and "short" in sample and len(sample) <= 400


def test_language(docs, rows, nothing, spark):
    sample = language.learn(docs)
    assert [lang for lang, _ in sample] == sorted({r[2] for r in rows if r[2] and any(c.isalpha() for c in r[1] or "")})
    found = language.predict(docs, sample).collect()
    assert len(found) == len(rows)
    texts = {r[0]: r[1] for r in rows[:-5]}
    for r in found:
        assert 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in texts.get(r["doc_id"]) or "a"):
            assert r["lang_pred"] == "und"
    assert language.learn(nothing) == () and language.predict(nothing, sample).collect() == []
    assert {r["lang_pred"] for r in language.predict(docs, ()).collect()} == {"und"}


def test_language_on_held_out_rows(spark):
    given = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    found = [r for r in queries.op10_language(spark, LARGER).collect() if r["held_out"]]
    assert all(fold(r["doc_id"]) == 2 for r in found)
    assert sum(r["lang_pred"] == given[r["doc_id"]] for r in found) / len(found) > 0.95


def test_flight_keeps_both_sums():
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 50, 400):
        p, size = [rng.random() for _ in range(n)], [float(rng.randint(0, 9)) for _ in range(n)]
        q = mixing.flight(p, size, random.Random(1))
        assert sum(0 < x < 1 for x in q) <= 2 and all(0 <= x <= 1 for x in q)
        assert sum(q) == pytest.approx(sum(p)) and sum(a * b for a, b in zip(q, size, strict=True)) == pytest.approx(sum(a * b for a, b in zip(p, size, strict=True)))
        assert all(x in (0.0, 1.0) for x in mixing.landing(q, size))


def plain_targets(sizes):
    """Targets by repeated sharing of the excess."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = {s: 3.0 * sizes[s] for s in free if weight[s] * level >= 3 * sizes[s]}
        if not over:
            return {s: capped.get(s, weight[s] * level) for s in order}
        capped |= over


def checked_mix(df, words, spread):
    found = df.collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for source, n in words:
        sizes[source] += n
        largest[source] = max(largest[source], n)
    targets = plain_targets(sizes)
    by_target = {}
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        by_target.setdefault((r["source_size"], round(r["target"], 4)), []).append(r)
    for s, n in sizes.items():
        mine = by_target[n, round(targets[s], 4)]
        twins = [t for t in sizes if (sizes[t], round(targets[t], 4)) == (n, round(targets[s], 4))]
        taken = sum(r["taken"] for r in mine)
        assert abs(taken - targets[s] * len(twins)) <= spread * largest[s] * len(twins)
    return found


def test_mix(docs, rows, nothing, spark):
    words = lambda t: len((t or "").replace(" ", "_").replace("　", "_").replace(" ", "_").split())
    found = checked_mix(mixing.mix_rows(docs), [(r[3], words(r[1])) for r in rows], 2)
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    again = mixing.mix_rows(docs.repartition(3))
    same_rows(again, [tuple(r) for r in found])
    assert mixing.mix_rows(nothing).collect() == []
    given = spark.read.parquet(f"{DATA}/documents.parquet")
    small = checked_mix(mixing.mix_rows(given, block=8), [(r["source"], words(r["text"])) for r in given.collect()], 2)
    assert len(small) == given.count()


def test_mixed_documents_are_the_rows_taken(docs):
    copies = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix_rows(docs).collect() if r["size"]}
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    assert sum(copies.values()) > 0


def test_targets_of_many_sources(spark):
    rng = random.Random(8)
    sizes = {f"s{i:03d}é" if i % 2 else f"S{i}": rng.choice([0, 1, 5, 400, 9000]) for i in range(60)} | {None: 77}
    units = spark.createDataFrame(list(sizes.items()), "source string, total long").repartition(7)
    found = {r["source"]: r["target"] for r in mixing.source_targets(units).collect()}
    for s, t in plain_targets(sizes).items():
        assert found[s] == pytest.approx(t)


def test_fingerprints(docs, rows, nothing):
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    found = fingerprints.fingerprint_with_successor(docs).collect()
    assert len(found) == len(rows)
    single = [i for i, r in enumerate(order) if sum(k == r[0] for k, _ in order) == 1 and sum(k == order[(i + 1) % len(order)][0] for k, _ in order) == 1]
    by_id = {r["doc_id"]: r for r in found}
    for i in single:
        key, text = order[i]
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        a, b, c = fingerprints.chunk_sets([text.encode(), new.encode(), after.encode()])
        r = by_id[key]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprints.serialised(a), fingerprints.serialised(b))
        assert (r["near_edited"], r["near_next"]) == (fingerprints.containment(a, b), fingerprints.containment(a, c))
    assert fingerprints.fingerprint_with_successor(nothing).collect() == []
    assert fingerprints.fingerprint(nothing).collect() == []


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 20)
    given = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = [r["text"] for r in given.orderBy("doc_id").collect()]
    found = fingerprints.fingerprint_with_successor(given).orderBy("doc_id").collect()
    expected = [hashlib.sha256(fingerprints.edited(t, texts[(i + 1) % len(texts)]).encode()).hexdigest() for i, t in enumerate(texts)]
    assert [r["edited_sha256"] for r in found] == expected


def test_chunks_shift_with_the_text():
    text = "".join(random.Random(6).choice("abcdefgh ") for _ in range(20_000)).encode()
    a, b = fingerprints.chunk_sets([text, b"some new start " + text])
    assert fingerprints.containment(a, b) > 0.95 and fingerprints.parsed(fingerprints.serialised(a)) == a
    ends = fingerprints.chunk_ends(text)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert sum(sizes) == len(text) and max(sizes) <= fingerprints.MAX_CHUNK and min(sizes[:-1]) >= fingerprints.MIN_CHUNK
    assert fingerprints.chunk_sets([text[:500], text])[0] == fingerprints.chunk_sets([text[:500]])[0]


def test_hashed_fold(spark):
    ids = spark.range(200).union(spark.sql("SELECT CAST(NULL AS long)"))
    from daypanel.llm.common import fold_of

    for r in ids.select("id", fold_of(F.col("id")).alias("f")).collect():
        assert r["f"] == fold(r["id"])
