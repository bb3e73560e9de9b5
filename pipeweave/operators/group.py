"""Groups: ``group(k) | map(...)`` as one hash aggregate; the items as lists only on request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipeweave.operators import aggregates as A
from pipeweave.operators.order import Key
from pipeweave.operators.rel import Rel, positions


class Groups:
    def __init__(self, rel: Rel, by: tuple, named: dict[str, Column], having: Column | None = None):
        self.rel, self.by, self.named, self.having = rel, by, named, having

    def _grouped(self):
        return self.rel.raw.groupBy(*self.by, *[c.alias(n) for n, c in self.named.items()])

    def filter(self, by: Column) -> Groups:
        """Keep groups by a reduction over their items."""
        return Groups(self.rel, self.by, self.named, by if self.having is None else self.having & by)

    def map(self, **named: Column) -> DataFrame:
        """A row for each group: the key and the named reductions, combined before the shuffle."""
        aggs = [c.alias(n) for n, c in named.items()]
        if self.having is None:
            return self._grouped().agg(*aggs)
        return self._grouped().agg(*aggs, self.having.alias("__having")).where("__having").drop("__having")

    def items(self, name: str = "items") -> DataFrame:
        """Each group's rows as a list in the sequence's order; for groups that fit a task."""
        order = F.struct(*[k.column.alias(f"k{i}") for i, k in enumerate(self.rel.order)]) if self.rel.order else F.struct(*self.rel.columns)
        return self.map(**{name: A.items(*self.rel.columns, order=order)})

    def size(self, name: str = "size") -> DataFrame:
        return self.map(**{name: A.size()})


def modes(df: DataFrame, by: list[str], column: str, name: str = "mode") -> DataFrame:
    """The most frequent value of each group, the least of equals, by counts of (group, value)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*by).agg(F.min_by(column, F.struct(-F.col("__n"), F.col(column))).alias(name))


def semi_structured_key(column: str) -> Column:
    """A text that equal open values share, to group, join and sort by."""
    return F.to_json(F.col(column))


def quantiles_by_rank(df: DataFrame, by: list[str], column: str, shares: list[float], name: str = "quantiles") -> DataFrame:
    """Exact interpolated quantiles of each group, for groups of any size: rows are ranked by one range partition and a prefix
    sum, and only the two rows beside each cut are kept, so no task holds a group's values (``aggregates.quantile`` does)."""
    keys = [F.col(c) for c in by]
    rows = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("__x"))
    placed = positions(rows, [Key(k) for k in [*keys, F.col("__x")]], "__at")
    groups = placed.groupBy(*by).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    cut = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(shares)])).alias("__cut")
    wanted = groups.select(*by, "__first", "__n", cut).withColumn("__spot", F.col("__cut.q") * (F.col("__n") - 1))
    low = F.col("__first") + F.floor("__spot")
    sides = F.array(F.struct(low.alias("at"), (1 - (F.col("__spot") - F.floor("__spot"))).alias("w")), F.struct((low + 1).alias("at"), (F.col("__spot") - F.floor("__spot")).alias("w")))
    wanted = wanted.select(*by, F.col("__cut.i").alias("__i"), F.explode(sides).alias("__side")).where("__side.w > 0")
    wanted = wanted.select(*[F.col(c).alias(f"__{c}") for c in by], "__i", F.col("__side.at").alias("__at"), F.col("__side.w").alias("__w"))
    hits = wanted.join(placed.select("__at", "__x"), "__at")
    found = hits.groupBy(*[f"__{c}" for c in by], "__i").agg(F.sum(F.col("__w") * F.col("__x")).alias("__q"))
    out = found.groupBy(*[f"__{c}" for c in by]).agg(F.array_sort(F.collect_list(F.struct("__i", "__q"))).alias("__all"))
    return out.select(*[F.col(f"__{c}").alias(c) for c in by], F.transform("__all", lambda r: r["__q"]).alias(name))
