"""Spelling variants through a dictionary of trie-node pairs.

Words come from the runs of letters of all texts. The prefixes of all words are the nodes of a forward trie, the suffixes those of a
reversed one, and every node has a number. A word of L characters enters the dictionary under 2L + 1 pairs of integers (prefix node, suffix
node): L *skips*, which leave out one of its characters, and L + 1 *splits*, which leave out none. Two words share a skip exactly if one
replaced character tells them apart; the skip of one is the split of another exactly if it has that character more. So equality of
pairs finds the neighbours within one edit without a miss or a false one, and a long word costs as many rows as it has characters.

Numbering: words are cut into ranges at border words. Within a range they arrive sorted, and a word gets new nodes beyond what it
shares with the word before it. Only prefixes of a border word reach over ranges; they are numbered by the borders themselves, at most ``MAX_RANGES``
words of at most ``BORDER_CHARS`` characters, which is all that the driver holds.

Pairs of words are never listed: a pair of nodes has at most one split and one skip for each letter of the alphabet, and each member
takes the number of the others and the best of them. A word is met once only: of equal characters in a row only the first counts as skipped.

Forms: a word's form is its most frequent neighbour, if that has ``FACTOR`` times its number; the root is reached by following forms. Each step
multiplies the number by ``FACTOR``, so the chain is short and a few rounds of pointer doubling reach its end.

Defined cases: NULL or empty text has no run; a NULL id counts as the empty text; repeated rows count again; equal numbers go to the word
that is first in code-point order; a word longer than any border is numbered like others; an empty table gives an empty one; other columns
are left out. A text is held whole in one task, and a run costs memory in proportion to its length.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daypanel.llm.common import slices
from daypanel.session import durable

LEAST_CHARS = 7
LEAST_COUNT = 2
FACTOR = 10
#: One run in so many loses a character before it is counted.
DROPPED = 31
RANGE_WORDS = 4_096
MAX_RANGES = 4_096
BORDER_CHARS = 64
#: Distinct words that a task counts before it hands them on; dictionary rows in one batch.
HELD_WORDS = 100_000
BATCH_ROWS = 65_536

_LOWER = {c: c + 32 for c in range(65, 91)}
SPLIT, SKIP, FIRST_SKIP = 0, 1, 2


def counted_form(key: str, run: str, dropped: int = DROPPED) -> str:
    """The lower-cased run as it is counted: one in ``dropped`` loses the character that the checksum of key and run points at."""
    mark = zlib.crc32(f"{key}:{run}".encode())
    if mark % dropped:
        return run
    at = mark % len(run)
    return run[:at] + run[at + 1 :]


def _counting(least: int, dropped: int):
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")  # shorter runs cannot give a word

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in slices(batches):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                found: Counter = Counter()
                for raw, n in Counter(m[0] for m in runs.finditer(text)).items():
                    found[raw.translate(_LOWER)] += n
                for word, n in found.items():
                    word = counted_form(key, word, dropped)
                    if len(word) >= least:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield batch_of(held)
                    held = Counter()
        yield batch_of(held)

    return run


def word_counts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_chars: int = LEAST_CHARS,
    least_count: int = LEAST_COUNT,
    dropped: int = DROPPED,
) -> DataFrame:
    """``(word, n)``: distinct words of at least ``least_chars`` characters that occur at least ``least_count`` times."""
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(_counting(least_chars, dropped), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Numbering:
    """Numbers of the trie nodes along words that come in order, range by range.

    ``borders`` cut the words into ranges; every prefix of a border has its number from here, every other one from its range.
    """

    def __init__(self, borders: list[str]):
        self.borders = borders
        self.shared = {p: i for i, p in enumerate(dict.fromkeys(b[:d] for b in ["", *borders] for d in range(len(b) + 1)))}
        self.range, self.word, self.nodes, self.made = -1, "", [0], 0

    def range_of(self, word: str) -> int:
        return bisect_right(self.borders, word)

    def path(self, word: str, part: int) -> list[int]:
        """The nodes of ``word`` from the root on; ``part`` is its range."""
        if part != self.range:
            self.range, self.word, self.nodes, self.made = part, "", [self.shared[""]], (part + 1) << 40
        same = 0
        for a, b in zip(self.word, word, strict=False):
            if a != b:
                break
            same += 1
        nodes = self.nodes[: same + 1]
        known = True
        for d in range(same + 1, len(word) + 1):
            number = self.shared.get(word[:d]) if known and d <= BORDER_CHARS else None
            if number is None:
                known, number = False, self.made
                self.made += 1
            nodes.append(number)
        self.word, self.nodes = word, nodes
        return nodes


def borders_of(words: DataFrame, ranges: int) -> list[str]:
    """At most ``ranges - 1`` words (their first ``BORDER_CHARS`` characters) that cut ``words`` into ranges, by the smallest hashes."""
    if ranges <= 1:
        return []
    first = words.select("word").orderBy(F.xxhash64("word"), "word").limit(ranges - 1)
    return sorted({r[0] for r in first.select(F.substring("word", 1, BORDER_CHARS)).collect()})


def _ranged(borders: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbering = Numbering(borders)
        for batch in batches:
            parts = [numbering.range_of(w) for w in batch.column("turned").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int32())], [*batch.schema.names, "part"])

    return run


def _in_order(words: DataFrame, turned, borders: list[str]) -> DataFrame:
    """``words`` dealt by the range of ``turned`` and sorted by it."""
    rows = words.withColumn("turned", turned)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_ranged(borders), f"{schema}, part int").repartition("part").sortWithinPartitions("part", "turned")


def _prefixes(borders: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbering, place = Numbering(borders), 0
        for batch in batches:
            ids, paths = [], []
            for word, part in zip(batch.column("word").to_pylist(), batch.column("part").to_pylist(), strict=True):
                place = 0 if part != numbering.range else place + 1
                paths.append(numbering.path(word, part))
                ids.append((part << 40) + place)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), batch.column("word"), batch.column("n"), pa.array(paths, pa.list_(pa.int64()))],
                ["wid", "word", "n", "prefixes"],
            )

    return run


def entries_of(word: str, prefixes: list[int], suffixes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix nodes, suffix nodes and kinds of the 2L + 1 dictionary rows of a word; both paths start at their root."""
    before, behind = np.array(prefixes, np.int64), np.array(suffixes[::-1], np.int64)  # behind[j]: the node of word[j:]
    chars = np.array(list(word))
    kinds = np.full(2 * len(word) + 1, SPLIT, np.int8)
    kinds[len(word) + 1 :] = np.where(np.r_[True, chars[1:] != chars[:-1]], FIRST_SKIP, SKIP)
    return np.concatenate([before, before[:-1]]), np.concatenate([behind, behind[1:]]), kinds


def _entries(borders: list[str]):
    names = ["p", "s", "wid", "n", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbering = Numbering(borders)
        made: list[tuple] = []
        rows = 0
        for batch in batches:
            cells = (batch.column(c).to_pylist() for c in ("turned", "part", "wid", "n", "prefixes"))
            for turned, part, wid, n, prefixes in zip(*cells, strict=True):
                p, s, kinds = entries_of(turned[::-1], prefixes, numbering.path(turned, part))
                made.append((p, s, np.full(len(p), wid), np.full(len(p), n), kinds))
                rows += len(p)
                if rows >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], names)
                    made, rows = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], names)

    return run


def number_words(words: DataFrame, range_words: int = RANGE_WORDS) -> tuple[DataFrame, DataFrame]:
    """``(wid, word, n)``, with ``wid`` in code-point order, and the dictionary ``(p, s, wid, n, kind)`` of ``(word, n)``."""
    words = durable(words, "words")
    ranges = min(MAX_RANGES, math.ceil(words.count() / range_words))
    forward = borders_of(words, ranges)
    numbered = _in_order(words, F.col("word"), forward).mapInArrow(_prefixes(forward), "wid long, word string, n long, prefixes array<long>")
    numbered = durable(numbered, "prefixes")
    backward = borders_of(words.select(F.reverse("word").alias("word")), ranges)
    turned = _in_order(numbered, F.reverse("word"), backward).select("turned", "part", "wid", "n", "prefixes")
    return numbered.select("wid", "word", "n"), turned.mapInArrow(_entries(backward), "p long, s long, wid long, n long, kind byte")


def neighbours(entries: DataFrame) -> DataFrame:
    """``(wid, n_near, best)`` of the words that have a neighbour; ``best`` is ``(n, turned_wid)`` of the most frequent one.

    ``turned_wid`` is minus the number of the word, so that the greater of two is the earlier word.
    """
    row = F.struct("n", (-F.col("wid")).alias("turned_wid"))
    is_skip = F.col("kind") > SPLIT
    order = Window.partitionBy("p", "s").orderBy(is_skip.desc(), F.desc("n"), "wid")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = entries.select(
        "wid",
        "kind",
        F.count(F.when(is_skip, 1)).over(whole).alias("skips"),
        F.count(F.when(F.col("kind") == FIRST_SKIP, 1)).over(whole).alias("first_skips"),
        F.max(F.when(F.col("kind") == SPLIT, row)).over(whole).alias("split"),
        F.max(F.when(F.col("kind") == FIRST_SKIP, row)).over(whole).alias("longer"),
        F.max(F.when(is_skip, row)).over(whole).alias("top"),
        F.lead(F.when(is_skip, row)).over(order).alias("next"),
        row.alias("own"),
    )
    other = F.when(F.col("top") == F.col("own"), F.col("next")).otherwise(F.col("top"))
    shorter = F.when(F.col("kind") == FIRST_SKIP, F.col("split"))
    near = F.when(is_skip, F.col("skips") - 1 + shorter.isNotNull().cast("int")).otherwise(F.col("first_skips"))
    best = F.when(is_skip, F.greatest(other, shorter)).otherwise(F.col("longer"))
    found = met.select("wid", near.alias("near"), best.alias("best")).where("near > 0")
    return found.groupBy("wid").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def roots_of(steps: DataFrame, most: int, factor: int = FACTOR) -> DataFrame:
    """``(wid, root)`` for the words that have a form; ``steps`` is ``(wid, form)`` and no number exceeds ``most``."""
    hops = max(1, math.ceil(math.log(max(most, 2), factor)))  # each hop multiplies by ``factor``
    reached = steps.select("wid", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(hops)) if hops > 1 else 0):
        further = reached.select(F.col("wid").alias("root"), F.col("root").alias("further"))
        reached = reached.join(further, "root", "left").select("wid", F.coalesce("further", "root").alias("root"))
        reached = durable(reached, "roots")
    return reached


def spelling_variants(words: DataFrame, factor: int = FACTOR, range_words: int = RANGE_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``words`` (``word`` distinct, ``n``)."""
    numbered, entries = number_words(words, range_words)
    near = durable(neighbours(entries), "neighbours")
    has_form = F.col("best.n") >= F.lit(factor) * F.col("n")
    joined = numbered.join(near, "wid", "left").select(
        "wid",
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, -F.col("best.turned_wid")).alias("form_wid"),
        F.when(has_form, F.col("best.n")).alias("form_n"),
    )
    joined = durable(joined, "variants")
    steps = joined.where("form_wid IS NOT NULL").select("wid", F.col("form_wid").alias("form"))
    most = joined.agg(F.max("n")).first()[0] or 0
    named = numbered.select("wid", "word")
    ends = steps.join(roots_of(steps, most, factor), "wid")
    ends = ends.join(named.withColumnsRenamed({"wid": "form", "word": "form_word"}), "form")
    ends = ends.join(named.withColumnsRenamed({"wid": "root", "word": "root_word"}), "root")
    result = joined.join(ends.select("wid", "form_word", "root_word"), "wid", "left")
    return result.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def _byte_table() -> str:
    """The 256 steps of the checksum, by its polynomial."""
    steps = []
    for step in range(256):
        for _ in range(8):
            step = step >> 1 ^ (0xEDB88320 if step & 1 else 0)
        steps.append(str(step))
    return ", ".join(steps)


SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{{LEAST_CHARS},}}')) AS raw FROM documents),
lowered AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS key, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM runs GROUP BY ALL),
hexed AS (SELECT run, k, hex(encode(key || ':' || run)) AS h FROM lowered),
marked AS (
  SELECT run, k, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 1 + 2 * i::BIGINT, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, ([{_byte_table()}]::BIGINT[])[1 + (xor(c, b) & 255)])), 4294967295::BIGINT) AS mark
  FROM hexed),
made AS (
  SELECT CASE WHEN mark % {DROPPED} = 0 THEN left(run, (mark % length(run))::BIGINT) || substr(run, (mark % length(run))::BIGINT + 2) ELSE run END AS word, k
  FROM marked),
words AS (SELECT word, sum(k)::BIGINT AS n FROM made WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
spots AS (SELECT word, n, unnest(range(0, length(word))) AS i FROM words),
cut AS (SELECT word, n, i, left(word, i) AS a, substr(word, i + 2) AS b FROM spots),
near AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, w.word, w.n FROM cut x JOIN words w ON w.word = x.a || x.b
  UNION SELECT w.word, x.word, x.n FROM cut x JOIN words w ON w.word = x.a || x.b),
counted AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
best AS (SELECT word, other, other_n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) = 1),
formed AS (
  SELECT w.word, w.n, coalesce(c.n_near, 0)::BIGINT AS n_near, CASE WHEN b.other_n >= {FACTOR} * w.n THEN b.other END AS form,
         CASE WHEN b.other_n >= {FACTOR} * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN counted c USING (word) LEFT JOIN best b USING (word)),
chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e USING (word)
"""
