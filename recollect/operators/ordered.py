"""Order-dependent steps that survive a hot key.

"The row before", "the last known value" and "running total" need the rows of a
key in order.  A plain window puts each key into one task, which fails when one
key holds a large share of the data.  So keys are counted first; when a key has
more than ``limit`` rows it is cut into consecutive segments of about that size,
each segment is windowed on its own, and only one carried value per segment
crosses the borders.  The carried table has at most 2 * rows / limit entries,
which bounds what is broadcast.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000
GRAIN_US = 1_000_000


class Ordered:
    """A frame whose rows are ordered within keys.

    keys   grouping columns, may be empty (one global order)
    order  columns that give a total order within a key
    pos    a numeric column that grows with the order (time in micros, a turn)
    grain  how finely `pos` may be cut
    """

    def __init__(self, df, keys, order, pos, limit=HOT_ROWS, grain=GRAIN_US):
        if not keys:
            df = df.withColumn("_all", F.lit(0))
            keys = ["_all"]
        self.keys, self.order = list(keys), list(order)
        counts = (df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n"))
                  .filter(F.col("_n") > limit).select(*self.keys))
        self.hot = not counts.isEmpty()
        # Without hot keys rows are clustered by key alone, which later groupings
        # by key can use without another shuffle.
        self.parts = [*self.keys, "_seg"] if self.hot else self.keys
        self.df = self._cut(df, counts, pos, limit, grain) if self.hot else df
        self.window = Window.partitionBy(*self.parts).orderBy(*self.order)
        self.upto = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.before = self.window.rowsBetween(Window.unboundedPreceding, -1)

    def _cut(self, df, hot_keys, pos, limit, grain):
        cell = F.floor(pos / grain)
        sizes = (df.join(F.broadcast(hot_keys), self.keys, "left_semi")
                 .groupBy(*self.keys, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n")))
        w = Window.partitionBy(*self.keys).orderBy("_cell")
        starts = (sizes.withColumn("_part", F.floor((F.sum("_n").over(w) - F.col("_n")) / limit))
                  .groupBy(*self.keys, "_part").agg(F.min("_cell").alias("_lo"))
                  .groupBy(*self.keys).agg(F.collect_list("_lo").alias("_los")))
        seg = F.size(F.filter("_los", lambda lo: lo <= cell))
        return (df.join(F.broadcast(starts), self.keys, "left")
                .withColumn("_seg", F.coalesce(seg, F.lit(0))).drop("_los"))

    def _carry(self, tails, value):
        """Hand `value`, computed over earlier segments, to each later segment."""
        carried = (tails.withColumn("_carry", value).filter(F.col("_carry").isNotNull())
                   .select(*self.keys, "_seg", "_carry"))
        return self.df.join(F.broadcast(carried), [*self.keys, "_seg"], "left")

    def _seg_window(self):
        return Window.partitionBy(*self.keys).orderBy("_seg")

    def _replace(self, df):
        self.df = df
        return self

    def previous(self, columns, name):
        """Struct of `columns` of the row before, NULL on the first row."""
        local = F.lag(F.struct(*columns)).over(self.window)
        if not self.hot:
            return self._replace(self.df.withColumn(name, local))
        tails = self.df.groupBy(*self.keys, "_seg").agg(
            F.max_by(F.struct(*columns), F.struct(*self.order)).alias("_tail"))
        df = self._carry(tails, F.lag("_tail").over(self._seg_window()))
        return self._replace(df.withColumn(name, F.coalesce(local, "_carry")).drop("_carry"))

    def last_known(self, values, inclusive=True):
        """Add, per (name, column) pair, the latest non-null value so far."""
        span = self.upto if inclusive else self.before
        local = {n: F.last(c, ignorenulls=True).over(span) for n, c in values}
        if not self.hot:
            return self._replace(self.df.withColumns(local))
        tails = self.df.groupBy(*self.keys, "_seg").agg(*[
            F.max_by(F.when(c.isNotNull(), F.struct(c.alias("v"))),
                     F.when(c.isNotNull(), F.struct(*self.order))).alias(n) for n, c in values])
        w = self._seg_window().rowsBetween(Window.unboundedPreceding, -1)
        carry = F.struct(*[F.last(n, ignorenulls=True).over(w)["v"].alias(n) for n, _ in values])
        df = self._carry(tails, carry)
        return self._replace(df.withColumns(
            {n: F.coalesce(local[n], F.col("_carry")[n]) for n, _ in values}).drop("_carry"))

    def running_sum(self, column, name):
        """Inclusive running total of a column."""
        local = F.sum(column).over(self.upto)
        if not self.hot:
            return self._replace(self.df.withColumn(name, local))
        tails = self.df.groupBy(*self.keys, "_seg").agg(F.sum(column).alias("_tail"))
        w = self._seg_window().rowsBetween(Window.unboundedPreceding, -1)
        df = self._carry(tails, F.sum("_tail").over(w))
        return self._replace(
            df.withColumn(name, local + F.coalesce("_carry", F.lit(0))).drop("_carry"))

    def result(self):
        return self.df.drop("_seg", "_all")
