"""Fan-out over one evaluation of the input."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from pipeweave.operators.rel import Rel


@contextmanager
def shared(rel: Rel) -> Iterator[Rel]:
    """The input held (memory, then disk) while its branches run."""
    held = rel.raw.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield Rel(held, rel.order)
    finally:
        held.unpersist()


class Fork(dict):
    """Results by branch. The input is held from the first branch that runs until ``close`` (or the end of ``with``)."""

    def __init__(self, held: DataFrame | None, found: dict[str, object]):
        super().__init__(found)
        self.held = held

    def __enter__(self) -> Fork:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        if self.held is not None:
            self.held.unpersist()
            self.held = None


def _held(rel: Rel, hold: bool) -> Rel:
    return Rel(rel.raw.persist(StorageLevel.MEMORY_AND_DISK), rel.order) if hold and not rel.raw.isStreaming else rel


def fork(rel: Rel, *, hold: bool = True, **branches: Callable[[Rel], object]) -> Fork:
    """Each branch over one evaluation of the input. Branches are lazy: one that nothing reads is not run.

    Without ``hold`` every branch evaluates the input itself, which costs less where it is a plain scan that branches prune. A stream
    is not held: send its branches to sinks by micro-batch (``streaming.live.route``).
    """
    one = _held(rel, hold)
    return Fork(one.raw if one is not rel else None, {name: branch(one) for name, branch in branches.items()})


def tee(rel: Rel, branch: Callable[[Rel], object], hold: bool = True) -> tuple[Rel, object]:
    """The main line unchanged, and a side result, over one evaluation of the input."""
    one = _held(rel, hold)
    return one, branch(one)


def quarantine(rel: Rel, result: str = "result") -> tuple[Rel, Rel]:
    """A validated input as its good rows and its rejected rows."""
    return rel.oks(result), rel.errs(result)


def deduplicate(df: DataFrame, key: list[str], latest: str) -> DataFrame:
    """The row of each key that ``latest`` (and then all columns) puts last, by one aggregate."""
    from pyspark.sql import functions as F

    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(latest, *[c for c in rest if c != latest])).alias("__row")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str], latest: str) -> DataFrame:
    """Both tables end to end, the latest row of each key."""
    return deduplicate(old.unionByName(new), key, latest)


def newer(df: DataFrame, column: str, than: DataFrame) -> DataFrame:
    """Rows beyond the largest value that the other table holds (all, if it is empty)."""
    from pyspark.sql import functions as F

    mark = than.agg(F.max(column).alias("__mark"))
    return df.join(F.broadcast(mark), F.col("__mark").isNull() | (F.col(column) > F.col("__mark"))).drop("__mark")
