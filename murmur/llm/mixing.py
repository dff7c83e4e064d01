"""Mixing sources to target weights by hash-random order and distributed prefix sums, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm._shared import copies, materialise, ranked

#: Bits of a random key, and rows of a cell (a range of keys of one source) about.
KEY_BITS, CELL_ROWS = 60, 4096
WORD = r"[^\x20\x09-\x0D]+"


def random_key(id_: Column, text: Column, seed: str) -> Column:
    """A key in [0, 2**60) from the id, or from the text where there is no id; the same in every run."""
    named = F.coalesce(id_.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), named).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """sources (unnamed, source, source_size) and target: each one's share of all sizes by its weight, ``most`` times its size
    at most, what is above shared again among the others until none is above.

    Sources take the weights in turn, in code point order, null (unnamed) last. A round sums the sources at their
    bound and deals what is left to the rest; the share of one weight only grows, so rounds end when no more
    source is at its bound. The driver sees two sums a round; sources are numbered in ranges, not in one task.
    """
    table = ranked(sources, [F.col("unnamed"), F.col("source")], "sources")
    table = table.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights)).cast("int") + 1))
    table = table.withColumn("bound", most * F.col("source_size"))
    total, weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    left, open_, was = total or 0, weight or 0, None
    while was != (left, open_):
        was = left, open_
        bounded = F.col("bound").cast("decimal(38,0)") * F.lit(open_) < F.col("weight").cast("decimal(38,0)") * F.lit(left)
        size, heavy = table.filter(bounded).agg(F.coalesce(F.sum("bound"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        left, open_ = (total or 0) - size, (weight or 0) - heavy
    share = (F.col("weight").cast("long") * F.lit(left).cast("long")).cast("double") / F.lit(max(open_, 1)).cast("double")
    return table.select("unnamed", "source", "source_size", F.when(bounded, F.col("bound").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", cell_rows: int = CELL_ROWS) -> DataFrame:
    """What a mix takes of every row of docs: id, source, size, source_size, target, epochs, part, taken.

    size counts the words of the text (null: 0), target is the words that the row's source gives, see
    ``targets``. A source's rows are put in the order of hash-random keys; the mix takes the source as often as it
    goes into the target whole (``epochs`` of each row), then once more from the start of that order until the target,
    rounded down, is met: ``part`` words of a row, all of them before the cut, the first few at it. taken is
    epochs * size + part, so a source's taken words are its target, rounded down, and no row gives more than
    ``most`` times its size.

    Keys are hashes, so ranges of them (cells, of about ``cell_rows`` rows) fill evenly: each (source, cell) is sorted and
    summed by itself and starts at the sum of the source's cells before, so a source with a third of all
    rows is as many tasks. Texts aren't shuffled; rows that agree in id, source and size are counted before they are.

    Null ids take their order from their texts. Null sources are one source, the last; empty ones are another. Ties and
    repeated rows each count and are taken by themselves. No words: all targets 0. An empty table gives none. Other
    columns of docs are not read, whatever their names.
    """
    text, source = F.col(text_col).cast("string"), F.col(source_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), source.isNull().alias("unnamed"), F.coalesce(source, F.lit("")).alias("source"), size.alias("size"), random_key(F.col(id_col), text, seed).alias("key"))
    rows = materialise(rows, "sizes")
    bits = max(0, (rows.count() // cell_rows).bit_length())
    rows = rows.withColumn("cell", F.shiftright("key", KEY_BITS - bits))
    cells = materialise(rows.groupBy("unnamed", "source", "cell").agg(F.sum("size").alias("words")), "cells")
    found = targets(cells.groupBy("unnamed", "source").agg(F.sum("words").alias("source_size")), weights, most)
    before = Window.partitionBy("unnamed", "source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_start", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(found, ["unnamed", "source"])

    same = rows.groupBy("unnamed", "source", "cell", "key", "id", "size").agg(F.count("*").alias("n"))
    before = Window.partitionBy("unnamed", "source", "cell").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("start", F.coalesce(F.sum(F.col("size") * F.col("n")).over(before), F.lit(0))).join(cells, ["unnamed", "source", "cell"])
    out = copies(same, "n", "nth")
    budget, whole = F.floor("target").cast("long"), F.greatest("source_size", F.lit(1))
    rest = F.pmod(budget, whole)
    ahead = rest - F.col("cell_start") - F.col("start") - F.col("nth") * F.col("size")
    out = out.withColumns({"epochs": ((budget - rest) / whole).cast("long"), "part": F.greatest(F.lit(0), F.least("size", ahead)).cast("long")})
    named = F.when(~F.col("unnamed"), F.col("source"))
    return out.select(F.col("id").alias(id_col), named.alias(source_col), "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def op11_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix of weights 5, 2, 1 takes of every document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op11_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS key
            FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
            FROM d GROUP BY source
        ), o AS (
            SELECT *, row_number() OVER a AS k, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS words_left,
                   sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS open_weight
            FROM s WINDOW a AS (ORDER BY source_size / w, source NULLS LAST),
                          b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), l AS (
            SELECT words_left, open_weight FROM o WHERE 3 * source_size * open_weight >= w * words_left ORDER BY k LIMIT 1
        ), t AS (
            SELECT source, source_size, CASE WHEN 3 * source_size * open_weight < w * words_left THEN (3 * source_size)::DOUBLE
                   ELSE (w * words_left)::DOUBLE / open_weight::DOUBLE END AS target
            FROM s, (SELECT * FROM l)
        ), c AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget, greatest(t.source_size, 1) AS whole,
                   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target, (budget // whole * size + greatest(0, least(size, budget % whole - start)))::BIGINT AS taken FROM c
    """,
}
QUERIES = {"op11_mixing": op11_mixing}
