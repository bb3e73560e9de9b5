"""Rel: a DataFrame that may have an order, and the steps over it.

An order is a list of hidden columns, not a number in each row: steps keep it without a shuffle
and rows are sorted only where order is observed (``df``, ``take``, window functions). Steps that
need positions 0..n-1 (``enumerate``, ``zip``, ``at``, ``slice``) get them by one range partition and
a prefix sum over partition sizes, never by a window over all rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipeweave.operators import aggregates as A
from pipeweave.operators.order import Comparison, Key, keys

HIDDEN = "__o"
POSITION = "__position"
#: Rows that one task orders and holds; to take more, or to skip rows of a larger relation, goes by position.
HEAD = 10_000
#: Bytes of an Arrow batch while a step or an operator writes its own tables.
BATCH = 8 << 20


class Unbounded(TypeError):
    """A step that needs a finite input met a stream."""


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one in local tests."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="pipeweave-")
    return found.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``BATCH`` bytes for what is planned and run here; the session's own setting comes back.

    Executors hold a batch in the JVM and in Python, and buffers of twice its size while it grows.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stable(df: DataFrame) -> DataFrame:
    """Fix a result that two evaluations could give differently: a checkpoint in the shared folder, or a cache without one."""
    sc = df.sparkSession.sparkContext
    return df.checkpoint() if sc.getCheckpointDir() else df.persist()


def positions(df: DataFrame, order: Sequence[Key], name: str = POSITION) -> DataFrame:
    """Add the place 0..n-1 of each row in the order."""
    by = [k.sorted() for k in order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df
    marked = stable(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    sizes = marked.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).select("__part", "__start")
    return marked.join(F.broadcast(starts), "__part").withColumn(name, F.col("__row") + F.col("__start")).drop("__part", "__row", "__start")


class Rel:
    def __init__(self, df: DataFrame, order: Sequence[Key] = (), unique: bool = False, most: int | None = None):
        self.raw = df
        self.order = Comparison(order)
        self.unique = unique  # a set: no row comes twice, whatever it is mapped to
        self.most = most  # how many rows there are at most, where that is known

    # construction and observation

    @classmethod
    def of(cls, df: DataFrame, *by: str | Column | Key | Comparison) -> Rel:
        """A sequence in the order of ``by`` (unique keys), or without it a collection."""
        if not by:
            return cls(df)
        found = keys(*by)
        named = [f"{HIDDEN}{i}" for i in range(len(found))]
        return cls(df.withColumns({n: k.column for n, k in zip(named, found, strict=True)}), [Key(F.col(n), k.ascending) for n, k in zip(named, found, strict=True)])

    @property
    def columns(self) -> list[str]:
        return [c for c in self.raw.columns if not c.startswith(HIDDEN)]

    @property
    def hidden(self) -> list[str]:
        return [c for c in self.raw.columns if c.startswith(HIDDEN)]

    @property
    def df(self) -> DataFrame:
        """The rows in order, without hidden columns."""
        out = self.raw.orderBy(*[k.sorted() for k in self.order]) if self.order else self.raw
        return out.select(*self.columns)

    def collection(self) -> Rel:
        """The rows without their order."""
        return Rel(self.raw.select(*self.columns))

    def finite(self, step: str) -> None:
        if self.raw.isStreaming:
            raise Unbounded(f"{step} needs a finite input, and a stream may not end; bound it first with take(n), or work in batches")

    def _keep(self, df: DataFrame) -> Rel:
        return Rel(df, self.order, self.unique, self.most)

    def as_set(self) -> Rel:
        """The rows as a set: each once, in no order. Filters and maps of a set are sets; sorting it gives a sequence."""
        return Rel(self.raw.select(*self.columns).dropDuplicates(), unique=True)

    def pipe(self, step: Callable, *args, **kwargs):
        return step(self, *args, **kwargs)

    # elementwise

    def filter(self, by: Column | str) -> Rel:
        """Rows for which the predicate is true (absent counts as false)."""
        return self._keep(self.raw.where(by))

    def map(self, *exprs: Column | str, **named: Column) -> Rel:
        """New columns for each row; of a set, its image."""
        out = self._keep(self.raw.select(*exprs, *[c.alias(n) for n, c in named.items()], *self.hidden))
        return out.as_set() if self.unique else out

    def extend(self, **named: Column) -> Rel:
        return self._keep(self.raw.withColumns(named))

    def somes(self, column: str) -> Rel:
        return self.filter(F.col(column).isNotNull())

    def oks(self, result: str) -> Rel:
        return self.filter(F.col(f"{result}.is_ok")).map(F.col(f"{result}.ok").alias(result))

    def errs(self, result: str) -> Rel:
        return self.filter(~F.col(f"{result}.is_ok")).map(F.col(f"{result}.err").alias(result))

    def of_type(self, data: str, kind: str) -> Rel:
        """Rows whose open value has a type that SQL names so, read as that type."""
        return self.filter(F.schema_of_variant(data) == kind.upper()).extend(**{data: F.try_variant_get(data, "$", kind)})

    def flat_map(self, items: Column, name: str = "item") -> Rel:
        """A row for each element, in the row's and then the array's order."""
        place = f"{HIDDEN}{len(self.hidden)}"
        out = self.raw.select("*", F.posexplode(items).alias(place, name))
        return Rel(out, [*self.order, Key(F.col(place))] if self.order else ())

    def emit(self, column: str) -> Rel:
        return self.flat_map(F.col(column), "__item").map(F.col("__item").alias(column))

    # order

    def sort(self, *by: str | Column | Key | Comparison) -> Rel:
        """Stable: what the keys leave equal keeps its order."""
        self.finite("sort")
        found, start = keys(*by), len(self.hidden)
        named = [f"{HIDDEN}{start + i}" for i in range(len(found))]
        df = self.raw.withColumns({n: k.column for n, k in zip(named, found, strict=True)})
        return Rel(df, [*[Key(F.col(n), k.ascending) for n, k in zip(named, found, strict=True)], *self.order])

    def reverse(self) -> Rel:
        self.finite("reverse")
        return Rel(self.raw, [k.reversed() for k in self.order], most=self.most)

    def _ordered(self) -> Rel:
        """A collection in the order of its rows."""
        return self if self.order else Rel(self.raw, keys(*self.columns), self.unique, self.most)

    def _placed(self, start: int, end: int | None) -> Rel:
        """Rows start..end-1 by position, for any number of rows: no task holds them."""
        rows, at = self._ordered(), F.col("__place")
        out = positions(rows.raw, rows.order, "__place").where((at >= start) if end is None else (at >= start) & (at < end))
        return rows._keep(out.drop("__place"))

    def take(self, n: int) -> Rel:
        """The first n; of a collection, the n least rows."""
        if self.raw.isStreaming:
            return self._keep(self.raw.limit(n))
        if n > HEAD:
            return self._placed(0, n)
        by = [k.sorted() for k in self.order] or [F.col(c) for c in self.columns]
        return Rel(self.raw.orderBy(*by).limit(n), self.order or keys(*self.columns), most=n)

    def drop(self, n: int) -> Rel:
        """All but the first n."""
        self.finite("drop")
        if n > 0 and (self.most is None or self.most > HEAD):
            return self._placed(n, None)
        return self._keep(self.raw.orderBy(*[k.sorted() for k in self.order]).offset(n))

    def top_k(self, k: int, by: Column | str) -> Rel:
        """The k highest, first of equals first."""
        return self.sort(Comparison(x.reversed() for x in keys(by))).take(k)

    def first(self) -> Rel:
        return self.take(1)

    def last(self) -> Rel:
        return self.reverse().take(1)

    def one(self) -> Rel:
        """The only row; an error where there are none or more."""
        self.finite("one")
        two = self.raw.limit(2)
        count = two.agg(F.count(F.lit(1)).alias("__n"))
        checked = count.select(F.assert_true(F.col("__n") == 1, F.lit("one() needs exactly one row")).alias("__ok"))
        return self._keep(two.join(F.broadcast(checked), how="left").where(F.col("__ok").isNull()).drop("__ok"))

    def find(self, by: Column) -> Rel:
        return self.filter(by).take(1)

    def enumerate(self, name: str = "first") -> Rel:
        self.finite("enumerate")
        out = positions(self.raw, self.order, name)
        return Rel(out, self.order or [Key(F.col(name))])

    def at(self, i: int) -> Rel:
        return self.slice(i, i + 1 if i != -1 else None) if i else self.take(1)

    def slice(self, start: int | None = None, end: int | None = None) -> Rel:
        """Rows start..end-1; negatives count from the end."""
        self.finite("slice")
        start, rows = start or 0, self._ordered()
        if -HEAD <= start < 0 and (end is None or end < 0):
            back = [k.column.desc_nulls_first() if k.ascending else k.column.asc_nulls_first() for k in rows.order]
            return Rel(rows.raw.orderBy(*back).limit(-start).offset(-(end or 0)), rows.order, rows.unique, -start)
        if start < 0 or end is not None and end < 0:
            n = self.raw.count()
            start, end = max(0, n + start) if start < 0 else start, max(0, n + end) if end is not None and end < 0 else end
        if end is None:
            return rows.drop(start) if start else rows
        if end > HEAD:
            return rows._placed(start, end)
        out = rows.take(end)
        return out.drop(start) if start else out

    def position(self, by: Column) -> DataFrame:
        return self.enumerate(POSITION).raw.agg(F.min(F.when(by, F.col(POSITION))).alias("position"))

    def _prefix(self, by: Column, before: bool) -> Rel:
        """Rows before (or from) the first that fails: that row's keys are found by one aggregate."""
        self.finite("take_while")
        failing = self.raw.where(~F.coalesce(by, F.lit(False)))
        cut = failing.orderBy(*[k.sorted() for k in self.order]).limit(1).select(*[k.column.alias(f"__c{i}") for i, k in enumerate(self.order)], F.lit(True).alias("__cut"))
        joined = self.raw.join(F.broadcast(cut), how="left")  # one row at most
        lower, same = F.lit(False), F.lit(True)
        for i, k in enumerate(self.order):
            lower = lower | (same & ((k.column < F.col(f"__c{i}")) if k.ascending else (k.column > F.col(f"__c{i}"))))
            same = same & (k.column == F.col(f"__c{i}"))
        none = F.col("__cut").isNull()
        keep = (none | lower) if before else (~none & ~lower)
        return self._keep(joined.where(keep).drop("__cut", *[f"__c{i}" for i in range(len(self.order))]))

    def take_while(self, by: Column) -> Rel:
        return self._prefix(by, True)

    def drop_while(self, by: Column) -> Rel:
        return self._prefix(by, False)

    def zip(self, other: Rel) -> Rel:
        """Rows at equal positions as first and second; the shorter side ends it."""
        self.finite("zip")
        other.finite("zip")
        a = positions(self.raw, self.order).select(POSITION, F.struct(*self.columns).alias("first"))
        b = positions(other.raw, other.order).select(POSITION, F.struct(*other.columns).alias("second"))
        return Rel.of(a.join(b, POSITION), POSITION).map("first", "second")

    def windows(self, n: int, item: Column) -> Rel:
        """Every run of n neighbours."""
        out = self.enumerate(POSITION).raw
        parts = out.select(F.explode(F.sequence(F.greatest(F.lit(0), F.col(POSITION) - n + 1), F.col(POSITION))).alias("__w"), F.struct(F.col(POSITION).alias("p"), item.alias("x")).alias("__x"))
        runs = parts.groupBy("__w").agg(F.array_sort(F.collect_list("__x")).alias("__r")).where(F.size("__r") == n)
        return Rel.of(runs.select("__w", F.transform("__r", lambda r: r.x).alias("items")), "__w").map("items")

    def collect(self, n: int, item: Column) -> Rel:
        """Batches of n, the last may be short."""
        self.finite("collect")
        out = self.enumerate(POSITION).raw.withColumn("__b", F.floor(F.col(POSITION) / n))
        runs = out.groupBy("__b").agg(F.array_sort(F.collect_list(F.struct(F.col(POSITION).alias("p"), item.alias("x")))).alias("__r"))
        return Rel.of(runs.select("__b", F.transform("__r", lambda r: r.x).alias("items")), "__b").map("items")

    def partition(self, *by: str | Column) -> Rel:
        """The same rows, those of a key together: a hint for what follows."""
        return self._keep(self.raw.repartition(*by))

    # sets

    def distinct(self) -> Rel:
        """Each row once; of a sequence, at its first place."""
        if not self.order:
            return Rel(self.raw.dropDuplicates())
        self.finite("distinct")
        if len({k.ascending for k in self.order}) > 1:  # mixed directions: by position
            return Rel(positions(self.raw, self.order, f"{HIDDEN}p"), [Key(F.col(f"{HIDDEN}p"))]).distinct()
        struct = F.struct(*[k.column.alias(f"k{i}") for i, k in enumerate(self.order)])
        best = F.min(struct) if self.order[0].ascending else F.max(struct)
        out = self.raw.groupBy(*self.columns).agg(best.alias("__k"))
        out = out.select(*self.columns, *[F.col(f"__k.k{i}").alias(f"{HIDDEN}{i}") for i in range(len(self.order))])
        return Rel(out, [Key(F.col(f"{HIDDEN}{i}"), k.ascending) for i, k in enumerate(self.order)])

    def concat(self, *others: Rel) -> Rel:
        """End to end."""
        sides = [self, *others]
        if not all(s.order for s in sides):
            return Rel(fold(lambda a, b: a.unionByName(b), [s.raw.select(*s.columns) for s in sides]))
        width = max(len(s.order) for s in sides)
        parts = []
        for n, s in enumerate(sides):
            found = [k.column.alias(f"{HIDDEN}{i + 1}") for i, k in enumerate(s.order)]
            if any(not k.ascending for k in s.order):
                found = [F.col(POSITION).alias(f"{HIDDEN}1")]
                s = Rel(positions(s.raw, s.order), s.order)
                cols = [c for c in s.columns if c != POSITION]
            else:
                cols = s.columns
            found += [F.lit(None).alias(f"{HIDDEN}{i + 1}") for i in range(len(found), width)]
            parts.append(s.raw.select(*cols, F.lit(n).alias(f"{HIDDEN}0"), *found))
        out = fold(lambda a, b: a.unionByName(b), parts)
        return Rel(out, [Key(F.col(f"{HIDDEN}{i}")) for i in range(width + 1)])

    def union(self, other: Rel) -> Rel:
        return Rel(self.raw.select(*self.columns).unionByName(other.raw.select(*other.columns)).dropDuplicates(), unique=True)

    def intersection(self, other: Rel) -> Rel:
        return Rel(self.raw.select(*self.columns).intersect(other.raw.select(*self.columns)), unique=True)

    def difference(self, other: Rel) -> Rel:
        return Rel(self.raw.select(*self.columns).subtract(other.raw.select(*self.columns)), unique=True)

    def merge(self, other: Rel) -> Rel:
        """One row from each in turn, then what is left."""
        a = positions(self.raw, self.order).select(*self.columns, F.col(POSITION).alias(f"{HIDDEN}0"), F.lit(0).alias(f"{HIDDEN}1"))
        b = positions(other.raw, other.order).select(*self.columns, F.col(POSITION).alias(f"{HIDDEN}0"), F.lit(1).alias(f"{HIDDEN}1"))
        return Rel(a.unionByName(b), [Key(F.col(f"{HIDDEN}0")), Key(F.col(f"{HIDDEN}1"))])

    # grouping, joins, windows: modules of their own

    def group(self, *by: str | Column, **named: Column):
        from pipeweave.operators.group import Groups

        self.finite("group")
        return Groups(self, by, named)

    def over(self, by: Sequence[str | Column] = (), order: Sequence = (), into: Callable | None = None, **named) -> Rel:
        from pipeweave.operators.window import over

        self.finite("over")
        return over(self, by, order, into, named)

    def agg(self, **named: Column) -> DataFrame:
        """One row of reductions."""
        self.finite("a reduction")
        return self.raw.agg(*[c.alias(n) for n, c in named.items()])

    def min_by(self, by: Column | str) -> Rel:
        """The row with the least key, first of equals."""
        return self.sort(by).take(1)

    def max_by(self, by: Column | str) -> Rel:
        return self.top_k(1, by)

    def count_by(self, **by: Column) -> DataFrame:
        return self.raw.groupBy(*[c.alias(n) for n, c in by.items()]).agg(F.count(F.lit(1)).alias("count"))

    def histogram(self, column: Column, width: float | int) -> DataFrame:
        """Counts by the lower edge of each cell of ``width``."""
        return self.raw.groupBy(A.bucket(column, width).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))

    def reduce(self, item: Column, initial: Column | None, by: str | Callable[[Column, Column], Column]) -> DataFrame:
        """A fold of all rows. A named combiner (``aggregates.COMBINERS``, or the operator that it names) is a built-in
        aggregate, combined before the shuffle; any other function folds in order in one task, for small inputs."""
        self.finite("reduce")
        named = A.combiner(by)
        if named is not None:
            whole, both = named
            rest = whole(item)
            if initial is None:
                return self.raw.agg(F.when(F.count(F.lit(1)) > 0, rest).alias("reduced"))
            return self.raw.agg(F.when(F.count(F.lit(1)) > 0, both(initial, rest)).otherwise(initial).alias("reduced"))
        order = [k.column.alias(f"k{i}") for i, k in enumerate(self.order)]
        rows = F.array_sort(F.collect_list(F.struct(*order, item.alias("x"))))
        items = F.transform(rows, lambda r: r.x)
        start = initial if initial is not None else F.get(items, F.lit(0))
        rest = items if initial is not None else F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))
        return self.raw.agg(F.aggregate(rest, start, by).alias("reduced"))

    def sample(self, n: int, seed: int, key: Column | None = None) -> Rel:
        """n rows by the digest of the seed and a key, in their own order."""
        return self._keep(self.raw.withColumn("__h", self._draw(seed, key)).orderBy("__h", *self.columns).limit(n).drop("__h"))

    def shuffle(self, seed: int, key: Column | None = None) -> Rel:
        return Rel.of(self.raw.select(*self.columns).withColumn("__h", self._draw(seed, key)), "__h", *self.columns).map(*self.columns)

    def _draw(self, seed: int, key: Column | None) -> Column:
        """A digest as random number: ``md5`` of seed, colon and key, the same in any engine."""
        return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string") if key is not None else F.to_json(F.struct(*self.columns))))

    def choice(self, seed: int) -> Rel:
        return self.sample(1, seed)
