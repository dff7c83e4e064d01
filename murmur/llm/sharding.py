"""Balanced sharding by histogram sort, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm._shared import materialise

#: Keys are 62-bit. A round of probes cuts each bracket into 2**PROBE_BITS cells, or fewer where there are many
#: brackets: of CELLS cells at most, or two a bracket, the driver sees the sizes.
KEY_BITS, PROBE_BITS, CELLS = 62, 8, 1 << 16


def text_key(text) -> F.Column:
    """A key in [0, 2**62) that equal texts share."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS)


def splitters(rows: DataFrame, parts: int, tolerance: float = 0.002) -> list[int]:
    """parts - 1 ascending keys that cut rows (key, size) into ranges of nearly equal size.

    Each round counts the exact size in every cell of every open bracket with one map-side combined
    aggregation, then narrows each bracket to the cell that holds its target. All open brackets of a round have one
    width, so the bits above it say which bracket a key is in. A splitter is settled when the size below it is
    within ``tolerance`` of a part, or when its bracket is one key wide: then a single key outweighs the tolerance
    and the nearer side of it is taken. No rows give ends of the key space.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = [total * k / parts for k in range(1, parts)]
    found: list[int | None] = [None] * len(targets)
    brackets = {0: 0}  # the bits above the bracket's width: the size below it
    wanted, width = dict.fromkeys(range(len(targets)), 0), KEY_BITS
    while wanted and total:
        probe = min(width, PROBE_BITS, max(1, (CELLS // len(brackets)).bit_length() - 1))
        step = width - probe
        inside = rows if width == KEY_BITS else rows.filter(F.shiftright("key", width).isin(list(brackets)))
        sizes = {r["cell"]: r["size"] for r in inside.groupBy(F.shiftright("key", step).alias("cell")).agg(F.sum("size").alias("size")).collect()}
        narrowed: dict[int, int] = {}
        for k, bracket in list(wanted.items()):
            below = brackets[bracket]
            for cell in range(bracket << probe, (bracket + 1) << probe):
                above = below + sizes.get(cell, 0)
                if above >= targets[k]:
                    near = min((below, cell << step), (above, (cell + 1) << step), key=lambda x: abs(x[0] - targets[k]))
                    if step == 0 or abs(near[0] - targets[k]) <= tolerance * total / parts:
                        found[k] = near[1]
                        del wanted[k]
                    else:
                        narrowed[cell] = below
                        wanted[k] = cell
                    break
                below = above
        brackets, width = narrowed, step
    return sorted(x for x in (1 << KEY_BITS if f is None else f for f in found))


def part_of(key: F.Column, cuts: list[int]) -> F.Column:
    """How many of the ascending cuts are at or below key, as a balanced tree of comparisons."""

    def pick(low: int, high: int) -> F.Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < cuts[middle], pick(low, middle)).otherwise(pick(middle + 1, high))

    return pick(0, len(cuts)).cast("int")


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002, rows_a_task: int = 100_000) -> DataFrame:
    """docs and the columns size, shard and slot, in shards of nearly equal bytes; equal texts share a shard.

    A row's size is its text's UTF-8 bytes plus one (null: one). The sort key is a hash of the text. Splitters
    come from a narrow (key, size) table; then one exchange, by (shard, part of a shard), numbers the rows of a
    shard from 0 without gaps: a part holds about ``rows_a_task`` rows, chosen by the row's id, and starts at
    the number of rows in the parts before it. So neither a shard nor a text with a third of all rows is one
    task. A text that outweighs a shard makes its shard larger, since its copies stay together.

    Null texts form one group, equal to the empty text. Repeated rows and equal ids get slots in any order. Null ids
    are spread by their texts, and copies of one text without an id lie in one part. An empty table gives none. Columns
    of docs named size, shard or slot are replaced; any other names may clash.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("size", "shard", "slot")]
    keyed = docs.select(F.struct(*kept).alias("row"), F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), text_key(text).alias("key"))
    narrow = materialise(keyed.select("id", "key", "size"), "keys")
    cuts = splitters(narrow, shards, tolerance)
    parts = max(1, -(-narrow.count() // (shards * rows_a_task)))

    def placed(df: DataFrame) -> DataFrame:
        salt = F.when(F.col("id").isNull(), F.col("key")).otherwise(F.xxhash64("id"))
        return df.withColumns({"shard": part_of(F.col("key"), cuts), "part": F.pmod(salt, F.lit(parts)).cast("int")})

    counts = placed(narrow).groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id"))
    out = placed(keyed).withColumn("nth", nth).join(starts, ["shard", "part"])
    return out.select("row.*", "size", "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of nearly equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shard(docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long")))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL: dict[str, str] = {}
QUERIES = {"op2_sharding": op2_sharding}
