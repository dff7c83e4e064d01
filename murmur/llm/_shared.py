"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from murmur.sources.scratch import discard, materialise, new_path, qualified

__all__ = ["attach", "components", "copies", "discard", "in_order", "materialise", "new_path", "qualified", "ranked", "release", "salt_of", "slices", "small_batches", "spans", "trim"]

#: Bytes of text that a task takes in and looks at together; one longer text is taken alone.
SLICE_BYTES = 1 << 19
#: Edges up to which their nodes' minima, of 16 bytes each and two an edge at most, are broadcast.
BROADCAST_EDGES = 100_000
#: Copies of a row that are made at once.
COPIES = 1 << 16
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Have Spark send Arrow batches of SLICE_BYTES at most. The setting is read when a plan runs, so it stays in the
    session; it bounds memory alone and changes no result."""
    now = spark.conf.get(_BATCH_BYTES).lower()
    if not now.removesuffix("b").isdigit() or int(now.removesuffix("b")) > SLICE_BYTES:  # a setting with a unit is larger
        spark.conf.set(_BATCH_BYTES, str(SLICE_BYTES))


def spans(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes of text each, or of one row."""
    upto = np.r_[0, np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64))]
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + most, "right")) - 1)
        yield at, end
        at = end


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``most`` bytes of text, or of one row, so that scratch memory follows the
    longest text and not the number of rows in a batch."""
    for batch in batches:
        for a, b in spans(batch.column(column), most):
            yield batch.slice(a, b - a)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage, and give what Python freed back to the system: Spark keeps shuffle files and broadcasts of
    finished jobs until it is collected, and a driver between long stages may not do so for itself."""
    gc.collect()
    trim()
    spark._jvm.System.gc()


def trim() -> None:
    """Give what this process freed back to the system: a Python worker lives on after a task, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library alone
        give_back(0)


def salt_of(column: str | Column, salts: int) -> Column:
    """A salt from a row's own id, the same in every attempt of a task."""
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], salt: str, salts: int = 32) -> DataFrame:
    """Left join of facts, one row per key, to rows whose keys may be hot.

    The facts go first to the distinct (salt, key) pairs, which hold at most ``salts`` rows a key; the rows
    then join on (salt, key), so a hot key's rows lie in as many tasks. Null keys match null keys.
    """
    rows = rows.withColumn("_salt", salt_of(salt, salts))
    more = [c for c in facts.columns if c not in keys]
    facts = facts.select(*(F.col(k).alias(f"_f_{k}") for k in keys), *more)
    pairs = rows.select(F.col("_salt").alias("_s"), *(F.col(k).alias(f"_k_{k}") for k in keys)).distinct()
    pairs = pairs.join(facts, reduce(Column.__and__, (F.col(f"_k_{k}").eqNullSafe(F.col(f"_f_{k}")) for k in keys)))
    met = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys), F.col("_salt") == F.col("_s"))
    return rows.join(pairs, met, "left").drop("_salt", "_s", *(f"_{x}_{k}" for k in keys for x in "kf"))


def in_order(df: DataFrame, order: list[Column], tag: str) -> DataFrame:
    """df, written in ranges of ``order``, with piece (the range's number, ascending) and nth (a row's place in it, from 0).
    Rows that are equal in ``order`` lie in one range. df is read twice, to draw the ranges and to deal the rows."""
    placed = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("nth", F.monotonically_increasing_id()), tag)
    return placed.withColumns({"piece": F.shiftright("nth", 33).cast("int"), "nth": F.col("nth").bitwiseAND((1 << 33) - 1)})


def ranked(df: DataFrame, order: list[Column], tag: str) -> DataFrame:
    """df with rank, its rows' places in ``order`` from 0 without gaps: ranges are sorted by themselves and start at the
    number of rows in the ranges before, of which there is a row a range to broadcast."""
    placed = in_order(materialise(df, tag), order, tag)
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("piece").agg(F.count("*").alias("n")).select("piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(starts), "piece").withColumn("rank", F.col("_before") + F.col("nth")).drop("piece", "nth", "_before")


def copies(df: DataFrame, n: str, nth: str) -> DataFrame:
    """Every row n times, numbered from 0 in nth, instead of n; COPIES of a row are made at once, however many there are."""
    chunks = df.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(COPIES).cast("long"))))
    return chunks.withColumn(nth, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + COPIES, F.col(n)) - 1))).drop(n, "_from")


def _written(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    """Edges in the shared folder, where they lie, and a count and an order-free sum over them, taken while writing."""
    seen, path = Observation(), new_path(edges.sparkSession, "edges")
    edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).write.parquet(path)
    return edges.sparkSession.read.schema("a long, b long").parquet(path), path, (seen.get.get("n"), seen.get.get("s"))


def _minima(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """rows (a, b) with the minimum m of their a: by a broadcast where the edges, so the nodes, are few, else salted."""
    if edges <= BROADCAST_EDGES:
        return rows.join(F.broadcast(least), "a")
    return attach(rows, least, ["a"], "b")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Connected components of an edge list (a, b): one row (node, root) per node, root its smallest node.

    Large-star and small-star rounds in turn, each a grouped minimum and a join, until the edges no longer
    change; every round is written to the shared folder, in place of the one before. A hub's minimum is
    pre-aggregated before the shuffle and goes back to the hub's edges through salted joins, or a broadcast while
    there are BROADCAST_EDGES edges or fewer. Edges of a node to
    itself and repeated ones count for nothing, null ends are dropped; no edges give no rows.
    """
    spark = edges.sparkSession
    now, path, seen = _written(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct())
    for _ in range(rounds):
        if not seen[0]:
            break
        release(spark)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = _minima(both.filter("b > a"), least, seen[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        hung = _minima(down, least, seen[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        old, last = path, seen
        now, path, seen = _written(hung.union(least.select("a", F.col("m").alias("b"))).distinct())
        discard(spark, old)
        if last == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
