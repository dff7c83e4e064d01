"""Running values along an order, over windows or, for keys with very many rows, over ranges of rows whose ends are carried on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.sources.scratch import materialise

#: Cells that a round of ``exact_percentiles`` cuts a bracket into.
CELLS = 256


def _same(names: list[str], mark: str) -> Column:
    return reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"{mark}{c}")) for c in names))


class Scan:
    """Rows of ``keys`` in ``order``, with running values; each method adds columns from expressions over those there are.

    Over windows a key's rows stream through one task. With ``spread``, rows are dealt in ranges of (keys, order), so that a key
    with all rows of the table is as many tasks as any other rows. A range's rows are scanned by themselves, from what the ranges
    before carry on: the value of the last row, a sum, the last or first value that isn't null. That is a row a range and key at
    most that begins before the range, so no more rows than ranges, which are broadcast. Rows equal in ``order`` lie in one
    range; they come in any order, as over windows. Null keys are a key. An empty table stays empty.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], spread: bool = False):
        self.keys, self.order, self.spread, self.rows = keys, order, spread, df
        if spread:
            by = [F.col(c) for c in [*keys, *order]]
            ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that is named isn't made smaller
            placed = materialise(materialise(df, "scan").repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_nth", F.monotonically_increasing_id()), "ranges")
            self.rows = placed.withColumn("_piece", F.shiftright("_nth", 33).cast("int"))

    def _window(self):
        return Window.partitionBy("_piece", *self.keys).orderBy("_nth") if self.spread else Window.partitionBy(*self.keys).orderBy(*self.order)

    def _carried(self, own: dict[str, Column], on: dict[str, Column]) -> DataFrame:
        """The rows with what is carried into their range: ``own`` sums a range up, ``on`` goes over a key's ranges before."""
        ends = self.rows.groupBy("_piece", *self.keys).agg(*(c.alias(n) for n, c in own.items()))
        in_order = Window.partitionBy(*self.keys).orderBy("_piece")
        ends = ends.select(F.col("_piece").alias("_of_piece"), *(F.col(k).alias(f"_of_{k}") for k in self.keys), *(c.over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias(n) for n, c in on.items()), F.row_number().over(in_order).alias("_ranges"))
        ends = F.broadcast(ends.filter("_ranges > 1").drop("_ranges"))
        met = (F.col("_piece") == F.col("_of_piece")) & _same(self.keys, "_of_")
        return self.rows.join(ends, met, "left").drop("_of_piece", *(f"_of_{k}" for k in self.keys))

    def _with(self, columns: dict[str, Column], own, on, local, both) -> Scan:
        window = self._window()
        if not self.spread:
            self.rows = self.rows.withColumns({n: local(c, window) for n, c in columns.items()})
            return self
        rows = self._carried({f"_in_{n}": own(c) for n, c in columns.items()}, {f"_in_{n}": on(F.col(f"_in_{n}")) for n in columns})
        self.rows = rows.withColumns({n: both(local(c, window), F.col(f"_in_{n}"), window) for n, c in columns.items()}).drop(*(f"_in_{n}" for n in columns))
        return self

    def before(self, **columns: Column) -> Scan:
        """The value of the row before; null for the first of a key."""
        return self._with(columns, lambda c: F.max_by(c, "_nth"), lambda c: F.last(c), lambda c, w: F.lag(c).over(w), lambda x, carried, w: F.when(F.row_number().over(w) == 1, carried).otherwise(x))

    def totals(self, **columns: Column) -> Scan:
        """The sum up to the row."""
        return self._with(columns, lambda c: F.sum(c), lambda c: F.sum(c), lambda c, w: F.sum(c).over(w), lambda x, carried, w: x + F.coalesce(carried, F.lit(0)))

    def latest(self, **columns: Column) -> Scan:
        """The last value up to the row that isn't null."""
        own = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("_nth")))
        return self._with(columns, own, lambda c: F.last(c, True), lambda c, w: F.last(c, True).over(w), lambda x, carried, w: F.coalesce(x, carried))

    def earliest(self, **columns: Column) -> Scan:
        """The first value up to the row that isn't null."""
        own = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("_nth")))
        local = lambda c, w: F.first(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return self._with(columns, own, lambda c: F.first(c, True), local, lambda x, carried, w: F.coalesce(carried, x))

    def facts(self, found: DataFrame) -> Scan:
        """What is known of each key: the other columns of ``found``, which has a row a key; null where it has none."""
        on = [*(["_piece"] if self.spread else []), *self.keys]
        if self.spread:
            held = self.rows.select(*on).distinct()
            found = held.join(found.withColumnsRenamed({k: f"_of_{k}" for k in self.keys}), _same(self.keys, "_of_")).drop(*(f"_of_{k}" for k in self.keys))
        found = found.withColumnsRenamed({c: f"_at_{c}" for c in on})
        self.rows = self.rows.join(found, _same(on, "_at_"), "left").drop(*(f"_at_{c}" for c in on))
        return self

    def done(self, *dropped: str) -> DataFrame:
        return self.rows.drop("_nth", "_piece", *dropped)


def exact_percentiles(values: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys, n, percentile): the exact percentile of each key's whole numbers, between neighbours in proportion; null numbers
    don't count, and a key without any has no row.

    Equal numbers of a key are counted before anything is exchanged. The places around the percentile are then narrowed for
    all keys at once: a round counts the numbers in CELLS cells of each bracket and goes on in the cell that holds the place, until a
    cell is one number. So no key's numbers are sorted or held; three rounds do for numbers that differ by 16 million.
    """
    counts = materialise(values.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("long").alias("_v")).agg(F.count("*").alias("_n")), "counts")
    ends = counts.groupBy(*keys).agg(F.min("_v").alias("_low"), (F.max("_v") - F.min("_v") + 1).alias("_size"), F.sum("_n").alias("n"))
    place = F.lit(share) * (F.col("n") - 1)
    now = ends.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place))))).withColumn("_below", F.lit(0).cast("long"))
    now = materialise(now.select(*keys, "n", "_rank", "_low", "_size", "_below"), "brackets")
    while (now.agg(F.max("_size")).first()[0] or 1) > 1:
        brackets = now.withColumnsRenamed({k: f"_of_{k}" for k in keys})
        inside = counts.join(brackets, _same(keys, "_of_")).drop(*keys).withColumnsRenamed({f"_of_{k}": k for k in keys})
        step = F.greatest(F.ceil(F.col("_size") / CELLS), F.lit(1))
        inside = inside.filter("_v >= _low AND _v < _low + _size").withColumn("_cell", F.floor((F.col("_v") - F.col("_low")) / step).cast("long"))
        cells = inside.groupBy(*keys, "n", "_rank", "_low", "_size", "_below", "_cell").agg(F.sum("_n").alias("_in"))
        in_order = Window.partitionBy(*keys, "_rank").orderBy("_cell")
        upto = cells.withColumn("_upto", F.col("_below") + F.sum("_in").over(in_order))
        found = upto.filter("_upto - _in <= _rank AND _rank < _upto")
        now = materialise(found.select(*keys, "n", "_rank", (F.col("_low") + F.col("_cell") * step).alias("_low"), step.cast("long").alias("_size"), (F.col("_upto") - F.col("_in")).alias("_below")), "brackets")
    low, high = F.min_by("_low", "_rank").cast("double"), F.max_by("_low", "_rank").cast("double")
    part = F.lit(share) * (F.first("n") - 1) - F.min("_rank")
    return now.groupBy(*keys).agg(F.first("n").alias("n"), F.when(low == high, low).otherwise((1 - part) * low + part * high).alias("percentile"))
