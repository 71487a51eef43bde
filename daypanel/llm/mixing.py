"""Mixing sources to target weights by the cube method of balanced sampling.

A source that is to give r times its words gives each of its documents floor(r) times, and once more to a sample drawn with
probability r - floor(r). The sample is balanced on documents and on words: in every block of at most about ``BLOCK`` documents of one
source the flight phase takes three undecided documents, moves their probabilities along the null space of the two constraints
until one of them is 0 or 1, and goes on, so both totals stay exact. The at most two documents left of a block go to the blocks of the next
level; after a few levels (the number of rows shrinks a hundredfold each time) a source has one block, and its last documents are landed
on the choice nearest to the words still owed.

Ranks of sources and the shares under the cap are computed on the table of sources as Spark jobs.

Defined cases: NULL text has size 0; a NULL source is a source of its own, last in order; a document is a key ``(id, source, text)``:
repeated rows of it are one unit and share the decision; equal draws are settled by the order of hash, id and size; a source without
words has target 0 and gives nothing; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daypanel.llm.common import CHUNK_ROWS, in_chunks, words
from daypanel.session import durable

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BLOCK = 256


def flight(chance: list[float], size: list[float], draw: random.Random) -> list[float]:
    """Move probabilities until at most two stay strictly between 0 and 1, keeping their sum and their size-weighted sum."""
    p, open_ = list(chance), []
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        open_.append(i)
        while len(open_) >= 3 or len(open_) == 2 and size[open_[0]] == size[open_[1]]:
            if len(open_) >= 3:
                a, b, c = (size[j] for j in open_[:3])
                step = (c - b, a - c, b - a) if not a == b == c else (1.0, -1.0, 0.0)
            else:
                step = (1.0, -1.0)
            moved = list(zip(open_, step, strict=False))
            up = min((1 - p[j]) / u if u > 0 else p[j] / -u for j, u in moved if u)
            down = min(p[j] / u if u > 0 else (1 - p[j]) / -u for j, u in moved if u)
            by = up if draw.random() * (up + down) < down else -down
            for j, u in moved:
                p[j] += by * u
                if p[j] < 1e-9:
                    p[j] = 0.0
                elif p[j] > 1 - 1e-9:
                    p[j] = 1.0
            open_ = [j for j in open_ if 0.0 < p[j] < 1.0]
    return p


def landing(chance: list[float], size: list[float]) -> list[float]:
    """Decide the few open rows: the choice whose words come nearest to those owed, then whose number does."""
    left = [i for i, c in enumerate(chance) if 0.0 < c < 1.0]
    owed, number = sum(chance[i] * size[i] for i in left), sum(chance[i] for i in left)
    choices = [[i for k, i in enumerate(left) if pick >> k & 1] for pick in range(1 << len(left))]
    best = min(choices, key=lambda s: (abs(sum(size[i] for i in s) - owed), abs(len(s) - number), s))
    return [1.0 if i in best else 0.0 if i in left else c for i, c in enumerate(chance)]


def _decide(last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["draw", "key_text", "size"], kind="stable").reset_index(drop=True)
        seed = f"{group['rank'].iloc[0]}:{group['level'].iloc[0]}:{group['block'].iloc[0]}"
        chance = flight(group["chance"].tolist(), group["size"].astype(float).tolist(), random.Random(seed))
        group["chance"] = landing(chance, group["size"].astype(float).tolist()) if last else chance
        return group

    return run


def source_targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """For every source ``source_size``, ``units``, ``rank`` (code points, NULL last) and ``target``."""
    sources = units.groupBy("source").agg(F.sum("total").alias("source_size"), F.count(F.lit(1)).alias("units"))
    order = [F.col("source").isNull(), F.col("source")]
    ordered = sources.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id is the partition's number in the high bits and the row's place within it in the low 33.
    placed = durable(ordered.withColumn("place", F.monotonically_increasing_id()), "sources")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = placed.withColumn("part", part).join(starts, "part").withColumn("rank", F.col("start") + within)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    table = ranked.select("source", "source_size", "units", "rank", weight.alias("weight"))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    limit, level, capped = F.col("source_size") * float(cap), 0.0, -1
    while True:  # the level at which free sources get weight x level; capped ones only become more
        full = limit <= F.col("weight") * F.lit(level)
        now = table.agg(
            F.sum(full.cast("long")).alias("capped"),
            F.sum(F.when(full, limit).otherwise(0.0)).alias("held"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free"),
        ).first()
        if not now["free"] or now["capped"] == capped:
            break
        capped, level = now["capped"], (total - now["held"]) / now["free"]
    return table.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def repeats(units: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``units`` (``key``, ``key_text``, ``source``, ``size``, ``total``, ``rows``, ``h``) with ``source_size``, ``target`` and ``copies``."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    part = F.when(rate - F.floor(rate) < 1e-9, 0.0).when(rate - F.ceil(rate) > -1e-9, 0.0).otherwise(rate - F.floor(rate))
    whole = F.when(rate - F.ceil(rate) > -1e-9, F.ceil(rate)).otherwise(F.floor(rate)).cast("long")
    planned = units.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    planned = planned.withColumns({"whole": whole, "chance": part})
    columns = ["key", "h", "source", "size", "total", "rows", "source_size", "target", "whole"]
    decided = [planned.where("chance = 0").select(*columns, F.lit(0.0).alias("chance"))]
    draw = F.xxhash64("key_text", "h", F.lit("mix"))
    left = planned.where("chance > 0").select(
        *columns, "chance", "key_text", F.col("rank"), draw.alias("draw"), F.greatest(F.lit(1), F.ceil(F.col("units") / block)).cast("long").alias("blocks")
    )
    # "size" is what the draw is balanced on: the words of all rows of the unit.
    left = left.withColumnsRenamed({"size": "row_size", "total": "size"})
    level = 0
    while True:
        last = not level_rows(left)
        blocked = left.withColumns({"level": F.lit(level), "block": F.pmod(F.xxhash64("draw", F.lit(level)), F.col("blocks"))})
        flown = blocked.groupBy("rank", "block").applyInPandas(_decide(last), blocked.schema)
        done = durable(flown.drop("level", "block"), f"mix-{level}")
        open_ = (F.col("chance") > 0) & (F.col("chance") < 1)
        decided.append(done.where(~open_).withColumnsRenamed({"size": "total", "row_size": "size"}).select(*columns, "chance"))
        if last:
            break
        fewer = F.greatest(F.lit(1), F.ceil(F.col("blocks") * 2 / block)).cast("long")
        left, level = done.where(open_).withColumn("blocks", fewer), level + 1
    every = decided[0]
    for d in decided[1:]:
        every = every.unionByName(d)
    return every.withColumn("copies", F.col("whole") + F.round("chance").cast("long")).drop("whole", "chance")


def level_rows(left: DataFrame) -> bool:
    """Whether some source still has more than one block."""
    return (left.agg(F.max("blocks")).first()[0] or 1) > 1


def units_of(df: DataFrame, id_col: str, text_col: str, source_col: str, size: Column | None = None) -> DataFrame:
    """One row per document key with ``size`` (words), ``rows`` (repeated rows) and ``total`` (their words)."""
    size = F.size(words(F.col(text_col))).cast("long") if size is None else size
    keyed = df.select(
        F.col(id_col).alias("key"),
        F.col(source_col).cast("string").alias("source"),
        size.alias("size"),
        F.xxhash64(text_col).alias("h"),
    )
    units = keyed.groupBy("key", "source", "size", "h").agg(F.count(F.lit(1)).alias("rows"))
    return units.withColumns({"total": F.col("size") * F.col("rows"), "key_text": F.coalesce(F.col("key").cast("string"), F.lit(""))})


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    cap: int = MAX_REPEATS, block: int = BLOCK,
) -> DataFrame:
    """One row per document key: ``key``, ``h`` (hash of the text), ``source``, ``size``, ``rows``, ``source_size``, ``target``, ``copies``."""
    units = durable(units_of(df, id_col, text_col, source_col), "units")
    return repeats(units, source_targets(units, weights, cap), block)


def mix_rows(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``df``: id, ``size``, ``source_size``, ``target`` and ``taken`` (its words times its copies)."""
    mixed = mix(df, id_col, **options)
    # What many equal rows stand for is spread in chunks before it is listed.
    chunks = in_chunks(mixed.where(F.col("rows") > CHUNK_ROWS), "rows").repartition("key", "h", "chunk").drop("chunk")
    spread = mixed.where(F.col("rows") <= CHUNK_ROWS).unionByName(chunks)
    every = spread.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return every.select(F.col("key").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``df``, all columns, each as often as the mix takes it."""
    chosen = mix(df, id_col, text_col, source_col, **options).where("copies > 0").select(
        "key", F.col("source").alias("from"), F.col("h").alias("kh"), "copies"
    )
    source = F.col(source_col).cast("string").alias("rsource")
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("rid"), source, F.xxhash64(text_col).alias("rh"))
    same = F.col("rid").eqNullSafe(F.col("key")) & F.col("rsource").eqNullSafe(F.col("from")) & (F.col("rh") == F.col("kh"))
    taken = rows.join(chosen, same).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select("row.*")
