"""Toxic passages as maximal-scoring segments of token log-odds.

Learning: a word stands for itself and for its stems (its first ``STEMS`` characters). They are counted in toxic and clean training texts, n
occurrences in one text as 1 + ln n, so a text that repeats a word teaches little more than one that has it once; log-odds with a
Dirichlet prior (the background rates times ``PRIOR``) and their z-scores pick the lexicon: tokens of z-score ``MIN_Z``, and, where few texts teach and
the prior keeps z-scores small, tokens near the largest one whose counts are too unlikely to be chance among all that were tested. Of each family
of words and stems the least likely one stays. A score is the log of its rate inside a toxic passage over its rate in clean text, every
other word shares one negative score; the exponentials of the scores average to 1 over clean text, so the extreme-value parameter lambda
is 1 by construction, and K is fitted to the best segments of clean training texts.

Scoring: a linear-time scan (Ruzzo and Tompa's stack) finds all maximal segments of a text; a segment of score S in n tokens is
expected ``K n exp(-S)`` times by chance and is a toxic passage if that is at most ``MAX_EXPECTED``. The evidence of a text is the sum of
``-log`` of these numbers, turned into a probability by a logistic curve fitted to the training texts.

The classifier is fitted on at most ``MAX_ROWS`` labelled rows (smallest hash of the id), a documented bound; every row is scored whole.

Defined cases: NULL or empty text has no passage and scores as a text without any; a training label that is NULL teaches nothing, a repeated id
teaches once, with one of its texts and its largest label, and equal texts teach once; without toxic or without clean training rows, or if no token
stands out, the lexicon is empty, every score is 0 and nothing is rejected; ids may be NULL or repeat; an empty table gives an empty one;
other columns are left out of the scores and kept by :func:`drop_toxic`. At most ``MAX_LEXICON`` tokens, the least likely ones, come to the
driver. A text is held whole in one task, with memory in proportion to its length. Passages are given in characters of the
lower-cased text, which is longer than the text where lower-casing lengthens a character.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.llm.common import slices, texts_of

MAX_ROWS = 50_000
MAX_LEXICON = 20_000
#: Weight of the background rates, in counted words; least z-score of a toxic token; share of the largest z-score from which unlikely tokens enter below it.
PRIOR = 10_000.0
MIN_Z = 3.0
NEAR_BEST = 0.7
#: Share of false tokens among the unlikely ones; rate of toxic tokens inside a passage.
FALSE_SHARE = 0.05
PASSAGE_RATE = 0.02
MAX_EXPECTED = 0.05

#: Lengths of the stems of a word; words that a worker remembers.
STEMS = range(3, 9)
CACHE_SIZE = 65_536

_TOKEN = re.compile(r"[^\W_]+")


def units(word: str) -> list[str]:
    """The word and its stems, which end in a star."""
    return [word, *(word[:n] + "*" for n in STEMS if n <= len(word))]


class _Units(dict):
    """Units of every word met; starts again when it is full."""

    def __missing__(self, word: str) -> list[str]:
        if len(self) >= CACHE_SIZE // 4:
            self.clear()
        self[word] = found = units(word)
        return found


class _Scores(dict):
    """Score of every word met, 0 for those outside the lexicon; starts again when it is full."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_SIZE:
            self.clear()
        self[word] = found = max((self.lexicon[u] for u in units(word) if u in self.lexicon), default=0.0)
        return found


@dataclass(frozen=True)
class ToxicModel:
    scores: dict[str, float] = field(default_factory=dict)
    other: float = -1.0
    k: float = 1.0
    slope: float = 0.0
    base: float = -math.inf

    @cached_property
    def known(self) -> _Scores:
        return _Scores(self.scores)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def probability(self, evidence: float) -> float:
        x = self.base + self.slope * evidence
        return 0.0 if x < -700 else 1 / (1 + math.exp(-x))


def maximal_segments(hits: list[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(first, last, score)`` of a sequence whose element is ``other`` except at ``hits`` (position, score > 0).

    One pass with a stack of candidates (left sum, right sum, first, last); the left sums a candidate is compared with are found by
    following, from each candidate, the last earlier one with a smaller left sum.
    """
    stack: list[list] = []  # left sum, right sum, first, last, index of the last earlier candidate with smaller left sum
    total, at = 0.0, 0
    for position, score in hits:
        total += other * (position - at)
        left, total, at = total, total + score, position + 1
        new = [left, total, position, position, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= new[0]:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= new[1]:
                new[4] = j
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3], -1]
            del stack[j:]
    return [(a, b, right - left) for left, right, a, b, _ in stack]


def _hits(tokens: list[str], scores: _Scores) -> list[tuple[int, float]]:
    return [(i, s) for i, t in enumerate(tokens) if (s := scores[t])]


def one_of_each_family(ranked: list[str]) -> list[str]:
    """The units that neither begin a better one nor are begun by one; ``ranked`` has the best first."""
    kept, begun, stems = [], set(), set()
    for unit in ranked:
        word = unit.rstrip("*")
        heads = {word[:n] for n in range(1, len(word) + 1)}
        if heads & stems or unit.endswith("*") and word in begun:
            continue
        kept.append(unit)
        begun |= heads
        if unit.endswith("*"):
            stems.add(word)
    return kept


def passages_of(text: str, model: ToxicModel, most: float = MAX_EXPECTED) -> list[tuple[int, int, float, float]]:
    """Toxic passages ``(start, end, score, expected)`` in characters of ``text``."""
    low = text.lower()
    tokens = _TOKEN.findall(low)
    found = [(a, b, s, model.k * len(tokens) * math.exp(-s)) for a, b, s in maximal_segments(_hits(tokens, model.known), model.other)]
    found = [f for f in found if f[3] <= most]
    if not found:
        return []
    spans = [m.span() for m in _TOKEN.finditer(low)]
    return [(spans[a][0], spans[b][1], s, e) for a, b, s, e in found]


def evidence(expected: list[float]) -> float:
    return sum(-math.log(max(e, 1e-300)) for e in expected)


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word and stem its occurrences in clean texts, and its damped counts in clean and in toxic texts."""
    known = _Units()
    for batch in slices(batches):
        used, damped = Counter(), (Counter(), Counter())
        for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True):
            tokens: Counter = Counter()
            for word, n in Counter(_TOKEN.findall(text.lower())).items():
                for unit in known[word]:
                    tokens[unit] += n
            for unit, n in tokens.items():
                damped[toxic][unit] += 1 + math.log(n)
            if not toxic:
                used.update(tokens)
        found = list(damped[0] | damped[1])
        counts = [pa.array([float(c[u]) for u in found], pa.float64()) for c in damped]
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.string()), pa.array([used[u] for u in found], pa.int64()), *counts], ["token", "used", "clean", "toxic"]
        )


def _best(model: ToxicModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in texts_of(batch):
                tokens = _TOKEN.findall(text.lower())
                segments = maximal_segments(_hits(tokens, model.known), model.other)
                rows.append((max(1, len(tokens)), [s for _, _, s in segments]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([n for n, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.list_(pa.float64()))],
                ["toxic", "n", "segments"],
            )

    return run


def _logistic(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope for (evidence, clean, toxic) counts, with Platt's smoothed targets and a small ridge."""
    x = np.array([p[0] for p in points])
    n = np.array([[p[1], p[2]] for p in points], float)
    low, high = 1 / (n[:, 0].sum() + 2), (n[:, 1].sum() + 1) / (n[:, 1].sum() + 2)
    weight, y = n.sum(1), n[:, 0] * low + n[:, 1] * high
    beta, design = np.zeros(2), np.stack([np.ones_like(x), x], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -35, 35)))
        hessian = design.T @ (design * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (y - weight * p) - 1e-3 * beta)
        beta = beta + np.clip(step, -3, 3)
        if abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def chance_of(toxic: Column, clean: Column, share: float) -> Column:
    """Logarithm of a bound on the chance that ``toxic`` or more of the counts fall to toxic text, whose share of all words is ``share``.

    The bound is Chernoff's; counts that lean to clean text have chance 1, and the logarithm is at least -1,000.
    """
    n = toxic + clean
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * F.lit(p)))).otherwise(0.0)
    return F.when(toxic > n * F.lit(share), F.greatest(-(part(toxic, share) + part(clean, 1 - share)), F.lit(-1000.0))).otherwise(0.0)


def most_likely_chance(levels: list[tuple[float, int]], false_share: float = FALSE_SHARE) -> float:
    """Largest logarithm of a chance at which tokens still enter (Benjamini and Hochberg); ``levels`` are logarithms and numbers of tokens."""
    tested, taken, limit = sum(n for _, n in levels), 0, -math.inf
    for level, n in sorted(levels):
        taken += n
        if level <= math.log(false_share * taken / tested):
            limit = level
    return limit


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """Text and label (0 or 1) of at most ``max_rows`` labelled documents, the smallest hashes of the id.

    An id teaches with one of its texts and a text under one of its ids, the smallest hash and the smallest id; the largest of its labels
    counts. Ids and hashes are ``max_rows`` rows at most, so they are broadcast and the texts stay where they are.
    """
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key"))
    chosen = one.agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic")).orderBy(F.xxhash64("key"), "key").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    hashed = rows.select("key", F.xxhash64("text").alias("h")).join(F.broadcast(chosen), "key")
    single = hashed.groupBy("key").agg(F.min("h").alias("h"), F.max("toxic").alias("toxic"))
    distinct = single.groupBy("h").agg(F.min("key").alias("key"), F.max("toxic").alias("toxic"))
    return rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(distinct), ["key", "h"]).select("text", "toxic")


def fit(rows: DataFrame) -> ToxicModel:
    """Fit on rows ``(text, toxic)``, see :func:`training_rows`."""
    counts = rows.mapInArrow(_token_counts, "token string, used long, clean double, toxic double").groupBy("token").agg(
        F.sum("used").alias("used"), F.round(F.sum("clean"), 6).alias("clean"), F.round(F.sum("toxic"), 6).alias("toxic")
    )
    counts = counts.persist()
    sums = counts.where(~F.col("token").endswith("*")).agg(F.sum("used"), F.sum("clean"), F.sum("toxic")).first()
    n_used, n0, n1 = (round(x or 0, 3) for x in sums)
    if not n0 or not n1:
        counts.unpersist()
        return ToxicModel()
    prior = F.lit(PRIOR / (n0 + n1)) * (F.col("clean") + F.col("toxic"))
    odds = lambda c, n: F.log((F.col(c) + prior) / (F.lit(n + PRIOR) - F.col(c) - prior))
    z = (odds("toxic", n1) - odds("clean", n0)) / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    chance = chance_of(F.col("toxic"), F.col("clean"), n1 / (n0 + n1))
    tested = counts.select("*", F.round(z, 6).alias("z"), F.round(chance, 2).alias("chance")).where("token IS NOT NULL")
    levels = tested.groupBy("chance").agg(F.count(F.lit(1)).alias("n")).collect()  # a hundredth of a natural logarithm each
    limit = most_likely_chance([(r["chance"], r["n"]) for r in levels])
    likely = F.col("chance") <= F.lit(limit)
    largest = tested.where(likely).agg(F.max("z")).first()[0] or MIN_Z
    few = likely & (F.col("z") >= F.lit(NEAR_BEST * largest))
    kept = tested.where((F.col("z") >= MIN_Z) | few).orderBy("chance", "token").limit(MAX_LEXICON)
    found = {r["token"]: (r["used"], r["toxic"], r["chance"]) for r in kept.collect()}  # MAX_LEXICON rows at most
    ranked = sorted(found, key=lambda u: (found[u][2], u.endswith("*"), -len(u), u))
    lexicon = {u: found[u][:2] for u in one_of_each_family(ranked)}
    counts.unpersist()
    while True:  # tokens that speak against a passage leave, and the rest share its rate
        inside = sum(t for _, t in lexicon.values())
        rate = {w: (c + 1) / (n_used + 1) for w, (c, _) in lexicon.items()}
        scores = {w: math.log(PASSAGE_RATE * lexicon[w][1] / inside / rate[w]) for w in lexicon}
        weak = [w for w, s in scores.items() if s <= 0]
        if not weak:
            break
        for w in weak:
            del lexicon[w]
    if not scores:
        return ToxicModel()
    draft = ToxicModel(scores, math.log((1 - PASSAGE_RATE) / max(1 - sum(rate.values()), 1e-9)) if sum(rate.values()) < PASSAGE_RATE else -1e-3)
    segments = rows.mapInArrow(_best(draft), "toxic int, n long, segments array<double>").persist()
    clean = segments.where("toxic = 0").select("n", F.coalesce(F.array_max("segments"), F.lit(0.0)).alias("x"))
    fitted = clean.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("n") * F.exp(-F.col("x"))).alias("sum")).first()
    k = fitted["rows"] / fitted["sum"] if fitted["sum"] else 1.0
    expected = F.transform("segments", lambda s: F.lit(math.log(k)) + F.log("n") - s)
    strong = F.filter(expected, lambda e: e <= math.log(MAX_EXPECTED))
    total = F.aggregate(strong, F.lit(0.0), lambda a, e: a - e)
    bins = segments.groupBy(F.round(F.least(total, F.lit(200.0)), 1).alias("x")).agg(
        F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic")
    )
    points = [(r["x"], r["clean"], r["toxic"]) for r in bins.collect()]  # 2,001 values at most
    segments.unpersist()
    base, slope = _logistic(points)
    return ToxicModel(scores, draft.other, k, slope, base)


def _scoring(model: ToxicModel, most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [passages_of(t, model, most) for t in texts_of(batch)]
            score = [model.probability(min(200.0, evidence([p[3] for p in f]))) for f in found]
            cells = [[dict(zip(("start", "end", "score", "expected"), p, strict=True)) for p in f] for f in found]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score, pa.float64()), pa.array(cells, kind)], ["id", "score", "passages"])

    return run


def score(df: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", most: float = MAX_EXPECTED) -> DataFrame:
    """Id, ``score`` (0 to 1) and ``passages`` of every row; from the text alone."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, score double, passages array<struct<start:int,end:int,score:double,expected:double>>"
    return rows.mapInArrow(_scoring(model, most), schema).withColumnRenamed("id", id_col)


def _clean_rows(model: ToxicModel, text_col: str, threshold: float, most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            found = [[p[3] for p in passages_of(t, model, most)] for t in texts_of(batch, text_col)]
            yield batch.filter(pa.array([model.probability(min(200.0, evidence(f))) < threshold for f in found]))

    return run


def drop_toxic(df: DataFrame, model: ToxicModel, threshold: float = 0.3, text_col: str = "text", most: float = MAX_EXPECTED) -> DataFrame:
    """The rows of ``df``, all columns, that score under ``threshold``."""
    return df.mapInArrow(_clean_rows(model, text_col, threshold, most), df.schema)
