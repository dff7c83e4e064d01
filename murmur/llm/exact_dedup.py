"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm._shared import materialise, salt_of

#: Runs at the bottom of the tree at least, rows of a run at most, and how many runs one round merges.
RUNS, RUN_ROWS, FAN_IN = 16, 1 << 22, 4


def _merge(runs: DataFrame) -> DataFrame:
    """Merge the entries of equal (run, digest, length), in the order of the digests, to their smallest and largest
    identifier. The smallest and largest check hash must agree, else digests collided.

    Identifiers are kept as structs, which Spark aggregates by sorting: a round sorts what it exchanges by run and
    digest and merges the sorted runs in one streaming pass that holds one entry.
    """
    of = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.min("c_lo").alias("c_lo"), F.max("c_hi").alias("c_hi")]
    verified = F.when(F.col("c_lo") == F.col("c_hi"), F.col("c_lo")).otherwise(F.raise_error(F.lit("different texts share a SHA-256 digest")).cast("long"))
    return runs.groupBy("run", "digest", "n_bytes").agg(*of).withColumn("c_lo", verified)


def _text(text: Column, normalise) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return normalise(text) if normalise else text


def dedup_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=None, runs: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are (``normalise``: Column to Column; none: unchanged). Null
    texts count as empty. Of a group, the row with the smallest or largest id stays. Rows are dealt into
    runs by their id (RUNS, or more, so that a run has about RUN_ROWS rows at most); each run is reduced to one
    entry per digest, written, and rounds merge ``fan_in`` runs at a time until one is left, so a text that fills a
    third of the table is at most one entry a run after the first, map-side combined, aggregation. The winners go
    back down to the runs and from there to the rows, again at most one row of a digest per run. Only digests
    move, no texts.

    Ties and repeated rows: rows that repeat an id with an equal text count in group_size and are all marked
    kept if that id stays (``exact_dedup`` returns one of them). Null ids lose against any id; a group of null
    ids only keeps null. Other columns of docs are not read, whatever their names. An empty table gives none.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep!r}")
    text = _text(F.col(text_col), normalise)
    members = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("check"))
    members = materialise(members, "digests")
    if runs is None:
        runs = RUNS
        while runs * RUN_ROWS < members.count():
            runs *= fan_in
    members = members.withColumn("run", salt_of("id", runs))
    known = F.when(F.col("id").isNotNull(), F.struct("id"))
    level = _merge(members.select("run", "digest", "n_bytes", known.alias("lo"), known.alias("hi"), F.lit(1).cast("long").alias("n"), F.col("check").alias("c_lo"), F.col("check").alias("c_hi")))
    bottom = level = materialise(level, "runs")
    left = runs
    while left > 1:
        level = _merge(level.withColumn("run", (F.col("run") / fan_in).cast("int")))
        left = -(-left // fan_in)
    stays = F.col("lo.id" if keep == "smallest" else "hi.id")
    winners = level.filter("n > 1").select("digest", "n_bytes", stays.alias("keep_id"), F.col("n").alias("group_size"), F.lit(True).alias("shared"))

    down = bottom.select("run", "digest", "n_bytes").join(winners, ["digest", "n_bytes"])
    out = members.join(down, ["run", "digest", "n_bytes"], "left")
    out = out.withColumn("keep_id", F.when(F.col("shared"), F.col("keep_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), "keep_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=None) -> DataFrame:
    """docs with one row of each group of equal texts, in docs' own columns, whatever their names.

    Rows are named by id and text digest, null ids too, so an id may repeat with other texts. Of rows that repeat
    both, the one whose columns have the smallest hash stays. Null texts count as empty. The kept pairs meet the
    rows in one join, whose order the row number reuses. An empty table gives none.
    """
    kept = dedup_groups(docs, id_col, text_col, keep, normalise).filter("kept").select(F.col(id_col).alias("kept_id"), F.unhex("text_sha256").alias("kept_digest"))
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.unhex(F.sha2(_text(F.col(text_col), normalise), 256)).alias("digest"), F.xxhash64(*plain).alias("tie"))
    out = rows.join(kept, (F.col("digest") == F.col("kept_digest")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("id", "digest").orderBy("tie"))
    return out.withColumn("nth", nth).filter("nth = 1").select("row.*")


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents; of equal texts the row with the largest doc_id stays."""
    return dedup_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
QUERIES = {"op1_exact_dedup": op1_exact_dedup}
