"""Exact removal of long repeated byte strings, by suffix sorting of shards.

Every byte covered by a ``WINDOW``-byte string that also starts elsewhere goes. To bring equal strings together without shuffling
a suffix for each byte, windows are grouped by their anchor: the ``GRAM``-byte string inside a window with the smallest hash, leftmost on ties.
Equal windows have equal anchors at equal places, and neighbouring windows mostly share theirs, so a text becomes short runs of
windows ``(anchor, context)``, the context being all bytes of the run.

1. Runs are counted by anchor (two hashes each, combined map side). An anchor seen once is no repeat; one whose contexts all are equal is a
   repeat in every window. Both are settled by their hashes, without moving text.
2. For the others one text of each distinct context is fetched, and contexts are dealt to shards by anchor. A shard is cut at anchors into
   pieces of at most one and a half ``SHARD_BYTES``, whose suffixes are sorted by induction (:mod:`daypanel.llm.induced_sort`); neighbours with
   ``WINDOW`` equal bytes are repeats.
3. An anchor whose contexts need not fit in one shard (more than ``HOT_CONTEXTS`` distinct ones, a line that is everywhere) isn't brought to one
   task: its windows are counted one by one under 128-bit hashes, again combined map side.
4. Repeated windows return to their rows and the covered bytes are cut out.

Defined cases: NULL text counts as empty; texts under ``WINDOW`` bytes keep everything; rows that repeat, also under one id, are occurrences of
their own, so each loses its text if it is long enough; NULL ids are one id; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daypanel.llm.common import slices
from daypanel.llm.induced_sort import suffix_array
from daypanel.session import durable

WINDOW = 200
GRAM = 64  # a power of two
SHARD_BYTES = 3 << 20
#: As many contexts, each of at most ``2 * WINDOW - GRAM`` bytes, fit in a shard whatever their length.
HOT_CONTEXTS = SHARD_BYTES // (2 * WINDOW - GRAM)


def _grams(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of the ``size`` bytes from every position, by doubling."""
    odd, h, n = 0x9E3779B97F4A7C15, data.astype(np.uint64) + np.uint64(1), 1
    while n < size:
        h = h[:-n] * np.uint64(pow(odd, n, 1 << 64)) + h[n:]
        n *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        v, n = np.minimum(v[:-n], v[n:]), 2 * n
    rest = width - n
    return np.minimum(v[:-rest], v[rest:]) if rest else v


def window_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in texts laid end to end: text number, first and last window, width, repeats, anchor, context.

    Neighbouring runs with equal anchor and context (periodic text) are one row with ``repeats`` of them.
    """
    empty = tuple(np.zeros(0, np.int64) for _ in range(7))
    if len(data) < WINDOW:
        return empty
    h = _grams(data)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # ties go to the left
    best = _sliding_min(key, WINDOW - GRAM + 1)
    anchor_at = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    text_of = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor_at)]
    inside = np.arange(len(anchor_at)) + WINDOW <= offsets[1:][text_of]
    new = np.concatenate([[True], (anchor_at[1:] != anchor_at[:-1]) | (inside[1:] != inside[:-1]) | (text_of[1:] != text_of[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchor_at)) - 1
    kept = inside[first]
    first, last = first[kept], last[kept]
    if not len(first):
        return empty
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    context = np.fromiter((digest(view[a : b + WINDOW]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first))
    anchor, text = h[anchor_at[first]], text_of[first]
    same = (anchor[1:] == anchor[:-1]) & (context[1:] == context[:-1]) & (text[1:] == text[:-1])
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    repeats = np.diff(np.append(head, len(first)))
    base, width = offsets[text[head]], last[head] - first[head] + 1
    end = last[np.append(head[1:], len(first)) - 1]
    return text[head], first[head] - base, end - base, width, repeats, anchor[head].view(np.int64), context[head].view(np.int64)


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins."""
    parts = [(t or "").encode() for t in texts.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), offsets


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        text, first, last, width, repeats, anchor, context = window_runs(*_flat(batch.column("text")))
        rows = pa.array(text)
        columns = [batch.column(c).take(rows) for c in ("id", "th", "tk")]
        columns += [pa.array(c.astype(np.int32)) for c in (first, last, width, repeats)] + [pa.array(anchor), pa.array(context)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "th", "tk", "first", "last", "width", "repeats", "anchor", "context"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts asked of each text; of hot anchors the hashes of each window."""
    for batch in slices(batches):
        rows = []
        for text, asked in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
            data = (text or "").encode()
            for a in asked:
                part = data[a["first"] : a["first"] + a["width"] + WINDOW - 1]
                rows.append((a["anchor"], a["context"], a["copies"], a["hot"], part))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "context", "copies", "hot", "bytes"]
        )


def repeated_windows(contexts: list[bytes]) -> np.ndarray:
    """For contexts laid end to end: whether the window at each byte is equal to another one. Places without a whole window are False."""
    parts = [np.frombuffer(c, np.uint8) for c in contexts]
    lengths = np.array([len(c) for c in contexts], np.int64)
    data = np.concatenate(parts)
    # Symbols: 0 ends the string, 1 ends a context, bytes follow.
    where = np.arange(len(data)) + np.repeat(np.arange(len(contexts)), lengths)
    t = np.ones(len(data) + len(contexts) + 1, np.int16)
    t[where] = data.astype(np.int16) + 2
    t[-1] = 0
    whole = np.zeros(len(t), bool)
    whole[where] = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths) <= np.repeat(lengths, lengths) - WINDOW
    order = suffix_array(t, WINDOW)
    order = order[whole[order]]
    alike = np.arange(max(0, len(order) - 1))  # neighbours still equal, eight bytes at a time
    eight = np.lib.stride_tricks.sliding_window_view(t.astype(np.uint8) - 2, 8) if len(t) >= 8 else None
    packed = eight.copy().view(np.uint64).ravel() if eight is not None else np.zeros(0, np.uint64)
    for step in range(0, WINDOW, 8):
        a, b = order[alike] + min(step, WINDOW - 8), order[alike + 1] + min(step, WINDOW - 8)
        alike = alike[packed[a] == packed[b]]
    found = np.zeros(len(t), bool)
    found[order[alike]] = True
    found[order[alike + 1]] = True
    return found[where]


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of True as (first, last)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of contexts that arrive ordered by anchor; several anchors are sorted together."""
    held: dict[tuple[int, int], bytes] = {}
    size, last = 0, None

    def settle() -> pa.RecordBatch:
        flags, at, rows = repeated_windows(list(held.values())), 0, []
        for (anchor, context), data in held.items():
            spans = _spans(flags[at : at + len(data)])
            at += len(data)
            if spans:
                rows.append((anchor, context, [{"a": a, "b": b} for a, b in spans]))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), _SPANS], strict=True)], ["anchor", "context", "spans"]
        )

    for batch in batches:
        for anchor, context, data in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "bytes")), strict=True):
            if anchor != last and size > SHARD_BYTES // 2:
                yield settle()
                held, size = {}, 0
            last = anchor
            if (anchor, context) not in held:
                held[anchor, context] = data
                size += len(data)
    if held:
        yield settle()


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "bytes", 1 << 20):
        rows = []
        for anchor, context, copies, data in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "copies", "bytes")), strict=True):
            for x in range(len(data) - WINDOW + 1):
                rows.append((anchor, context, copies, x, xxhash.xxh3_128_digest(data[x : x + WINDOW])))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "context", "copies", "x", "hash"]
        )


def _hot_windows(contexts: DataFrame) -> DataFrame:
    """Repeated windows of hot anchors, counted under their hashes: ``anchor, context, spans``."""
    schema = "anchor long, context long, copies long, x int, hash binary"
    windows = contexts.where("hot").select("anchor", "context", "copies", "bytes").mapInArrow(_window_hashes, schema)
    place = F.struct("context", "x")
    seen = windows.groupBy("hash").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.max("copies").alias("most"))
    twice = seen.where("low != high OR most > 1").select("hash")
    spans = F.collect_set(F.struct(F.col("x").alias("a"), F.col("x").alias("b")))  # at most WINDOW - GRAM + 1 windows
    return windows.join(twice, "hash", "left_semi").groupBy("anchor", "context").agg(spans.alias("spans"))


def repeated_spans(rows: DataFrame) -> DataFrame:
    """``id, th, tk, spans``: first and last repeated windows of each text that has any; ``rows`` are ``id, th, tk, text``.

    ``th`` and ``tk`` are 128 bits of hash that tell texts of one id apart.
    """
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, th long, tk long, first int, last int, width int, repeats int, anchor long, context long"
    runs = rows.mapInArrow(_runs, schema)
    anchors = runs.groupBy("anchor").agg(F.sum("repeats").alias("n"), F.min("context").alias("low"), F.max("context").alias("high"))
    anchors = anchors.where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed"))
    settled = F.when(F.col("mixed") & (F.col("repeats") == 1), F.lit(False)).otherwise(F.lit(True))
    joined = runs.join(anchors, "anchor").select(
        "id", "th", "tk", "first", "last", F.when(F.col("mixed"), F.col("width")).alias("width"), "repeats", settled.alias("settled"),
        F.when(F.col("mixed"), F.col("anchor")).alias("anchor"), F.when(F.col("mixed"), F.col("context")).alias("context"),
    )
    shared = durable(joined, "runs")
    mixed = shared.where("anchor IS NOT NULL")
    one = F.min(F.struct("id", "th", "tk", "first", "width")).alias("one")
    distinct = mixed.groupBy("anchor", "context").agg(F.sum("repeats").alias("copies"), one)
    distinct = durable(distinct, "contexts")
    many = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts"))
    asked = distinct.join(many, "anchor").select(
        "one.id", "one.th", "one.tk", F.struct("one.first", "one.width", "anchor", "context", "copies", (F.col("contexts") > HOT_CONTEXTS).alias("hot")).alias("a")
    )
    asked = asked.groupBy(F.col("id").alias("aid"), F.col("th").alias("ath"), F.col("tk").alias("atk")).agg(F.collect_list("a").alias("asked"))  # bounded by one text
    same = F.col("id").eqNullSafe(F.col("aid")) & (F.col("th") == F.col("ath")) & (F.col("tk") == F.col("atk"))
    fetched = rows.join(asked, same).select("text", "asked")
    contexts = durable(fetched.mapInArrow(_contexts, "anchor long, context long, copies long, hot boolean, bytes binary"), "context-bytes")
    cold = contexts.where("NOT hot").select("anchor", "context", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    found = cold.mapInArrow(_sorted_shards, "anchor long, context long, spans array<struct<a:int,b:int>>")
    found = found.unionByName(_hot_windows(contexts))
    several = distinct.where("copies > 1").select("anchor", "context", F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans"))
    answers = found.join(several.select("anchor", "context"), ["anchor", "context"], "left_anti").unionByName(several)
    back = mixed.where("NOT settled").join(answers, ["anchor", "context"]).select("id", "th", "tk", "first", "last", "spans")
    whole = F.array(F.struct(F.col("first").alias("a"), F.col("last").alias("b")))
    part = F.transform("spans", lambda s: F.struct((F.col("first") + s["a"]).alias("a"), (F.col("first") + s["b"]).alias("b")))
    windows = back.select("id", "th", "tk", F.coalesce(part, whole).alias("spans"))
    windows = windows.unionByName(shared.where("settled").select("id", "th", "tk", whole.alias("spans")))
    return windows.groupBy("id", "th", "tk").agg(F.flatten(F.collect_set("spans")).alias("spans"))  # bounded by one text


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        removed, kept, shown = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data, gone, at, rest = (text or "").encode(), [], 0, []
            for a, b in sorted((s["a"], s["b"] + WINDOW) for s in spans or []):
                if gone and a <= gone[-1][1]:
                    gone[-1] = (gone[-1][0], max(gone[-1][1], b))
                else:
                    gone.append((a, b))
            for a, b in gone:
                rest.append(data[at:a])
                at = b
            rest.append(data[at:])
            removed.append([{"a": a, "b": b} for a, b in gone])
            kept.append(b"".join(rest))
            shown.append("".join(r.decode(errors="ignore") for r in rest) if gone else text)
        columns = [batch.column("row"), pa.array(removed, _SPANS), pa.array(kept, pa.binary()), pa.array(shown, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "removed", "kept", "kept_text"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """Id, ``removed`` (maximal byte spans from ``a`` to before ``b``), ``kept`` (the other bytes) and ``kept_text`` of every row.

    ``kept_text`` leaves out characters of which only some bytes are kept. ``others`` are columns of ``df`` to carry along, in ``row``.
    """
    text = F.col(text_col).cast("string")
    carried = F.struct(F.col(id_col), *[F.col(c) for c in others if c not in (id_col, text_col)]).alias("row")
    digest = (F.xxhash64(text).alias("th"), F.xxhash64(F.lit(1), text).alias("tk"))  # the first argument seeds the second
    rows = df.select(carried, F.col(id_col).alias("id"), *digest, text.alias("text"))
    spans = repeated_spans(rows.drop("row")).withColumnsRenamed({"id": "sid", "th": "sth", "tk": "stk"})
    same = F.col("id").eqNullSafe(F.col("sid")) & (F.col("th") == F.col("sth")) & (F.col("tk") == F.col("stk"))
    joined = rows.join(spans, same, "left").select("row", "text", "spans")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, removed array<struct<a:int,b:int>>, kept binary, kept_text string"
    return joined.mapInArrow(_cut, schema).select(F.col(f"row.`{id_col}`").alias(id_col), "row", "removed", "kept", "kept_text")
