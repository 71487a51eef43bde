"""Ranked lexical search by MaxScore with joint bounds of term pairs.

Index: every document with a term of the vocabulary goes into a block of at most ``BLOCK`` documents. A block holds, for each term, its documents, their
impacts (what the term adds to a document's score) and the greatest impact, and for each pair of the ``FREQUENT`` most frequent terms that meet in the
block the pair's intersection entry: the greatest joint impact of a document that holds both. A pair without an entry meets in no document.

Search: the items are matched with one block at a time. The terms of an item, least greatest impact first, are cut in two: the longest
head that cannot lift a document to the item's ``k``-th score so far is only looked up for documents found through the tail. What a head can give is
bounded by pairing its frequent terms: two paired terms give at most the larger of their joint entry and their single maxima, which is never more
than the sum of the maxima, so more is skipped than by independent bounds. While the head is looked up, from its largest maximum down,
documents leave as soon as the bound of what remains cannot lift them. Equal scores may still enter, so results are exact.

Each task hands on its best ``k`` documents of every item; the final order is a ranking over those. Items are a stated query set: they are
taken in sets of ``ITEMS``, each with its own vocabulary, and every set meets all documents. The vocabulary of a set and the frequency of
its terms are what the driver holds.

Defined cases: NULL or empty text has no term; documents without any term count nowhere; an item without terms, or with terms that no document has,
gives no row; each row of either table is a document or item of its own, also where ids repeat; equal scores go by ascending id, NULL ids
last; empty tables give an empty result; other columns are left out. Texts are counted in pieces of ``PIECE`` bytes, so a long
text costs memory for its bytes and its distinct terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daypanel.llm.common import slices, texts_of
from daypanel.session import durable

BLOCK = 4_096
FREQUENT = 32
ITEMS = 1_000
PIECE = 1 << 22


def _folding() -> bytes:
    """Bytes of terms: digits, small letters for capitals, everything beyond ASCII; all others become a space."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for b in range(128):
        if chr(b).isalnum():
            table[b] = ord(chr(b).lower())
    return bytes(table)


_FOLDED = _folding()


def term_counts(text: str) -> Counter:
    """Number of times that each term (as UTF-8 bytes) occurs."""
    raw = text.encode().translate(_FOLDED)
    if len(raw) <= PIECE:
        return Counter(raw.split())
    counts: Counter = Counter()
    start = 0
    while start < len(raw):
        stop = raw.find(b" ", start + PIECE)
        stop = len(raw) if stop < 0 else stop
        counts.update(raw[start:stop].split())
        start = stop
    return counts


def _holding(ids: dict[bytes, int]):
    names = ["id", "n", "terms", "tfs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, terms, tfs = [], [], []
            for text in texts_of(batch):
                counts = term_counts(text)
                held = sorted((ids[t], counts[t]) for t in ids.keys() & counts.keys())
                sizes.append(counts.total())
                terms.append([t for t, _ in held])
                tfs.append([n for _, n in held])
            cells = [pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *cells], names)

    return run


@dataclass(frozen=True)
class Corpus:
    """What the weights need: documents with a term, all terms with repeats, and the documents that hold each term of the vocabulary."""

    documents: int
    length: int
    frequency: np.ndarray

    def weights(self) -> np.ndarray:
        n = 2.0 * self.documents + 2.0
        return np.array([math.floor(1000 * math.log(n / (2.0 * int(df) + 1.0))) for df in self.frequency], np.int64)

    def damping(self, sizes: list[int]) -> np.ndarray:
        """How much a document of each size (terms with repeats) weakens its terms."""
        return np.array([50 + 50 * n * self.documents // self.length for n in sizes], np.int64)


def block_of(terms: list[list[int]], tfs: list[list[int]], sizes: list[int], corpus: Corpus, frequent: np.ndarray) -> dict[str, np.ndarray]:
    """The postings of some documents, by term and then by document, with the maxima of terms and pairs."""
    lengths = np.fromiter(map(len, terms), np.int64, len(terms))
    term = np.concatenate([np.array(t, np.int32) for t in terms])
    tf = np.concatenate([np.array(t, np.int64) for t in tfs])
    doc = np.repeat(np.arange(len(terms), dtype=np.int32), lengths)
    damped = np.repeat(corpus.damping(sizes), lengths)
    impact = corpus.weights()[term] * (1_000_000_000 * tf // (1000 * tf + 20 * damped))
    order = np.lexsort((doc, term))
    term, doc, impact = term[order], doc[order], impact[order]
    held, starts = np.unique(term, return_index=True)
    dense = np.zeros((len(terms), len(frequent)), np.int64)
    present = np.zeros(dense.shape, bool)
    for column, t in enumerate(frequent):
        at = np.searchsorted(held, t)
        if at < len(held) and held[at] == t:
            rows = slice(starts[at], starts[at + 1] if at + 1 < len(held) else None)
            dense[doc[rows], column], present[doc[rows], column] = impact[rows], True
    first, second, joint = [], [], []
    for a in range(len(frequent) - 1):
        both = present[:, a : a + 1] & present[:, a + 1 :]
        most = np.where(both, dense[:, a : a + 1] + dense[:, a + 1 :], -1).max(0)
        for b in np.flatnonzero(most >= 0):
            first.append(frequent[a])
            second.append(frequent[a + 1 + b])
            joint.append(most[b])
    return {
        "terms": held,
        "starts": np.append(starts, len(term)).astype(np.int32),
        "docs": doc,
        "impacts": impact,
        "tops": np.maximum.reduceat(impact, starts),
        "first": np.array(first, np.int32),
        "second": np.array(second, np.int32),
        "joint": np.array(joint, np.int64),
        "frequent": frequent,
    }


_BLOCK_COLUMNS = {
    "terms": pa.int32(), "starts": pa.int32(), "docs": pa.int32(), "impacts": pa.int64(),
    "tops": pa.int64(), "first": pa.int32(), "second": pa.int32(), "joint": pa.int64(), "frequent": pa.int32(),
}
_SQL_TYPES = {pa.int32(): "int", pa.int64(): "long"}


def _blocks(corpus: Corpus, frequent: np.ndarray, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                terms, tfs, sizes = (part.column(c).to_pylist() for c in ("terms", "tfs", "n"))
                cells = block_of(terms, tfs, sizes, corpus, frequent)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                lists = [pa.array([cells[c]], pa.list_(kind)) for c, kind in _BLOCK_COLUMNS.items()]
                yield pa.RecordBatch.from_arrays([ids, *lists], ["ids", *_BLOCK_COLUMNS])

    return run


def build_index(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, frequent: int = FREQUENT) -> DataFrame:
    """The blocks over all rows of ``docs`` for the terms in ``vocabulary``, written to the shared folder."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, n long, terms array<int>, tfs array<long>"
    held = durable(rows.mapInArrow(_holding({t: i for i, t in enumerate(vocabulary)}), schema).where("n > 0"), "postings")
    counts = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    frequency = np.zeros(len(vocabulary), np.int64)
    for term, df in counts.collect():  # a row for a term of the vocabulary
        frequency[term] = df
    total = held.agg(F.count(F.lit(1)), F.sum("n")).first()
    corpus = Corpus(total[0], total[1] or 0, frequency)
    most = np.sort(np.argsort(-frequency, kind="stable")[:frequent].astype(np.int32))
    lists = ", ".join(f"{c} array<{_SQL_TYPES[t]}>" for c, t in _BLOCK_COLUMNS.items())
    return durable(held.where("size(terms) > 0").mapInArrow(_blocks(corpus, most, block), f"ids array<{kind}>, {lists}"), "blocks")


def head_bounds(terms: list[int], tops: list[int], joint: dict[tuple[int, int], int], frequent: set[int]) -> list[int]:
    """The most that the first 0, 1, 2, ... of ``terms`` can give to one document.

    A frequent term is paired with the free frequent term before it that lowers the bound most.
    """
    bounds, total, free = [0], 0, {}
    for term, top in zip(terms, tops, strict=True):
        total += top
        if term in frequent:
            saved, other = 0, None
            for mate, mate_top in free.items():
                both = joint.get((mate, term) if mate < term else (term, mate), 0)
                if (gain := mate_top + top - max(both, mate_top, top)) > saved:
                    saved, other = gain, mate
            if other is None:
                free[term] = top
            else:
                del free[other]
                total -= saved
        bounds.append(total)
    return bounds


class Block:
    """One row of the index, ready for scoring."""

    def __init__(self, size: int, cells: dict[str, np.ndarray]):
        self.size, self.frequent = size, set(cells["frequent"].tolist())
        self.terms, self.starts, self.docs, self.impacts, self.tops = (cells[c] for c in ("terms", "starts", "docs", "impacts", "tops"))
        pairs = zip(cells["first"].tolist(), cells["second"].tolist(), strict=True)
        self.joint = dict(zip(pairs, cells["joint"].tolist(), strict=True))

    def scores(self, wanted: np.ndarray, least: int, seen: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents (of the block) that reach ``least`` and their scores, for an item with the terms ``wanted`` (ascending)."""
        at = np.flatnonzero(np.isin(self.terms, wanted, assume_unique=True) & (self.tops > 0))
        at = at[np.argsort(self.tops[at], kind="stable")]
        terms, tops = self.terms[at].tolist(), self.tops[at].tolist()
        bounds = head_bounds(terms, tops, self.joint, self.frequent)
        head = max((i for i, b in enumerate(bounds) if b < least), default=0)
        if head == len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = np.zeros(self.size, np.int64)
        for i in at[head:]:
            rows = slice(self.starts[i], self.starts[i + 1])
            total[self.docs[rows]] += self.impacts[rows]
        found = np.flatnonzero(total)
        total = total[found]
        if seen is not None:
            seen["skipped"] += head
            seen["documents"] += len(found)
        for left in range(head - 1, -1, -1):
            kept = total + bounds[left + 1] >= least
            found, total = found[kept], total[kept]
            rows = slice(self.starts[at[left]], self.starts[at[left] + 1])
            docs = self.docs[rows]
            spot = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            total = total + np.where(docs[spot] == found, self.impacts[rows][spot], 0)
        kept = total >= max(least, 1)
        return found[kept], total[kept]


def _by_rank(row: tuple) -> tuple:
    score, key = row
    return -score, key is None, 0 if key is None else key


class Best:
    """The best ``k`` rows ``(score, id)`` so far."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], 0

    def add(self, scores: np.ndarray, ids: list) -> None:
        if len(scores) > self.k:
            edge = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = np.flatnonzero(scores >= edge)
        else:
            keep = range(len(scores))
        self.rows = sorted([*self.rows, *((int(scores[i]), ids[i]) for i in keep)], key=_by_rank)[: self.k]
        self.least = self.rows[-1][0] if len(self.rows) == self.k else 0


def _searching(wanted: list[np.ndarray], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = [Best(k) for _ in wanted], None
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for row in range(batch.num_rows):
                ids = batch.column("ids")[row].values
                block = Block(len(ids), {c: batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in _BLOCK_COLUMNS})
                for terms, held in zip(wanted, best, strict=True):
                    docs, scores = block.scores(terms, held.least)
                    if len(docs):
                        held.add(scores, ids.take(pa.array(docs)).to_pylist())
        if kind is not None:
            item = np.repeat(np.arange(len(best), dtype=np.int32), [len(b.rows) for b in best])
            rows = [r for b in best for r in b.rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(item), pa.array([r[1] for r in rows], kind), pa.array([r[0] for r in rows], pa.int64())], ["item", "id", "score"]
            )

    return run


def search(index: DataFrame, wanted: list[np.ndarray], k: int) -> DataFrame:
    """``item, rank, id, score``: the best ``k`` documents of every item, given by the numbers of its terms in the vocabulary (ascending)."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    found = index.mapInArrow(_searching(wanted, k), f"item int, id {kind}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", "id", "score")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block: int = BLOCK,
    items_at_once: int = ITEMS,
) -> DataFrame:
    """``item_col, rank, id_col, score``: for every item the ``k`` documents with the highest scores above 0."""
    rows = items.select(F.col(item_col).alias("key"), F.col(item_text_col).cast("string").alias("text"))
    results: list[DataFrame] = []
    asked = rows.toLocalIterator()  # the query set, a part of it at a time
    while True:
        part = list(islice(asked, items_at_once))
        if not part and results:
            break
        terms = [sorted(term_counts(r["text"] or "")) for r in part]
        vocabulary = sorted({t for found in terms for t in found})
        number = {t: i for i, t in enumerate(vocabulary)}
        index = build_index(docs, vocabulary, id_col, text_col, block)
        found = search(index, [np.array([number[t] for t in found], np.int32) for found in terms], k)
        keys = docs.sparkSession.createDataFrame([(i, r["key"]) for i, r in enumerate(part)], f"item int, key {rows.schema['key'].dataType.simpleString()}")
        results.append(found.join(F.broadcast(keys), "item"))  # at most ``items_at_once`` rows
    return reduce(DataFrame.unionByName, results).select(F.col("key").alias(item_col), "rank", F.col("id").alias(id_col), "score")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, text FROM benchmark),
fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS term),
words AS (SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, a, b), term)) AS t FROM d, fold),
asked AS (SELECT DISTINCT iid, item_id, unnest(regexp_extract_all(translate(text, a, b), term)) AS t FROM i, fold),
tf AS (SELECT rid, doc_id, t, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT rid, sum(tf)::BIGINT AS n FROM tf GROUP BY rid),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM sizes),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
weights AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
scored AS (
  SELECT iid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // len))))::BIGINT AS score
  FROM asked JOIN tf USING (t) JOIN weights USING (t) JOIN sizes USING (rid), total GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""
