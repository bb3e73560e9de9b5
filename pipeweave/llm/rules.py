"""Quality rules: fixed limits on rule statistics, then an isolation forest over the statistics.

Each text gets counts (words, symbols, duplicate lines, words in repeated 5-word windows, ...).
Two fixed limits decide ``base_failed``. The forest isolates documents by random splits of the
statistics' ratios: the fewer splits a document needs, the more unusual it is. Being unusual is
no fault in itself, so the score above which a document is dropped is set for each band (the
statistic that stands out in it, and its rate to the power of ten) from all labelled rows: the lowest score, ``USUAL`` at least, at
which rows labelled bad outnumber good ones and above which the band loses no more than ``lost``
of all rows labelled good. A band whose bad rows nowhere outnumber its good ones drops nothing, so one odd sign in a
long text is not judged by texts full of them.

Defined results: null, empty and wordless texts have all counts 0 and fail the base limits;
without rows labelled good nothing is dropped by the forest, nor in a band without rows labelled bad; repeated rows get equal results;
texts are read whole; an empty table gives an empty result; existing columns named like the
added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipeweave.llm.common import Workspace, bounded_sample, fresh, mix64, slices

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SPACES = " \t\n\r\x0b\x0c"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct")
#: Rows the forest is grown on at most (a hundred trees of 256 rows each).
SAMPLE, TREES, LEAFY = 25_600, 100, 256
#: The anomaly of a row whose path is as long as expected; no limit lies below it.
USUAL = 0.5
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) | 1 for j in range(WINDOW)], np.uint64)


def repeat_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more, first occurrences included."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    code = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            code += ids[j : j + n] * _FACTORS[j]
    _, at, seen = np.unique(mix64(code), return_inverse=True, return_counts=True)
    again = seen[at] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += again
    edge[width : width + n] -= again
    return int((np.cumsum(edge)[:-1] > 0).sum())


def rule_counts(text: str | None) -> tuple[int, ...]:
    """The counts named in ``COUNTS``."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    if not words:
        lines = 0 if text is None else text.count("\n") + 1
        return (0, 0, sum(map(text.count, SYMBOLS)) if text else 0, 0, 0, lines, 0, 0, 0)
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.uint64) + np.uint64(1)
    lines = text.split("\n")
    full = [x for x in lines if x.strip(SPACES)]
    octets = np.frombuffer(raw, np.uint8)
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(full) - len(set(full)), repeat_words(ids),
        len(lines), int(((octets >= 65) & (octets <= 90)).sum()), text.count("!") + text.count("?"), len(known),
    )


def ratios(counts: np.ndarray) -> np.ndarray:
    """What the forest sees of the counts, a column each: rates, so that length alone is not unusual."""
    words, chars, symbols, dup, repeat, lines, upper, marks, _ = counts.astype(np.float64).T
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    rates = [symbols / w, symbols / c, dup / np.maximum(lines, 1), repeat / w, np.maximum(0, upper - lines - marks) / c, marks / w]
    return np.column_stack([np.sqrt(np.minimum(x, 1)) for x in rates])


@dataclass(frozen=True)
class Forest:
    """Flat arrays, a row a tree: feature (-1: leaf), threshold, first child, and the leaf's path length."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    length: np.ndarray
    size: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path length / expected length): near 1 unusual, below 0.5 usual."""
        n, trees = len(x), len(self.feature)
        at = np.zeros((n, trees), np.int64)
        tree = np.arange(trees)
        rows = np.arange(n)[:, None]
        while True:
            f = self.feature[tree, at]
            live = f >= 0
            if not live.any():
                break
            right = x[rows, np.maximum(f, 0)] >= self.threshold[tree, at]
            at = np.where(live, self.child[tree, at] + right, at)
        return 2.0 ** (-self.length[tree, at].mean(axis=1) / expected_length(self.size))


def expected_length(n: int) -> float:
    """Mean path length of a failed search in a binary tree of n rows."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2) or 1e-9


def grow(x: np.ndarray, trees: int = TREES, size: int = LEAFY, seed: int = 29) -> Forest:
    """Random splits at random places, down to single rows or a depth of log2(size)."""
    rng = np.random.default_rng(seed)
    size = min(size, len(x))
    deepest = int(np.ceil(np.log2(max(size, 2))))
    nodes = 2 ** (deepest + 1)
    feature, child = np.full((trees, nodes), -1), np.zeros((trees, nodes), np.int64)
    threshold, length = np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        todo, used = [(0, rng.choice(len(x), size, replace=False), 0)], 1
        while todo:
            node, rows, depth = todo.pop()
            part = x[rows]
            wide = np.flatnonzero(np.ptp(part, axis=0) > 0) if len(rows) > 1 else rows[:0]
            if depth >= deepest or not len(wide):
                length[t, node] = depth + (expected_length(len(rows)) if len(rows) > 1 else 0)
                continue
            f = int(rng.choice(wide))
            cut = rng.uniform(part[:, f].min(), part[:, f].max())
            high = part[:, f] >= cut
            feature[t, node], threshold[t, node], child[t, node] = f, cut, used
            todo += [(used, rows[~high], depth + 1), (used + 1, rows[high], depth + 1)]
            used += 2
    return Forest(feature, threshold, child, length, size)


def with_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Add the counts and ``base_failed``."""
    kind = pa.struct([(c, pa.int64()) for c in COUNTS])

    @F.arrow_udf(f"struct<{','.join(f'{c}:bigint' for c in COUNTS)}>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in chain.from_iterable(map(slices, batches)):
            table = np.array([rule_counts(t) for t in batch.to_pylist()], np.int64).reshape(len(batch), len(COUNTS))
            yield pa.StructArray.from_arrays([pa.array(column) for column in table.T], fields=list(kind))

    name = fresh(docs, "counts")
    out = docs.withColumn(name, measure(F.col(text)))
    out = out.withColumns({c: F.col(f"{name}.{c}") for c in COUNTS}).drop(name)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def fit_forest(counted: DataFrame, *, key: str = "doc_id", sample: int = SAMPLE, seed: int = 29) -> Forest | None:
    """Grow the forest on at most ``sample`` rows that pass the base limits, those with the smallest key hash."""
    drawn = bounded_sample(counted.where(~F.col("base_failed")).select(F.col(key).alias("__key"), *COUNTS), "__key", sample).toArrow()
    if drawn.num_rows < 2:
        return None
    return grow(ratios(np.column_stack([drawn.column(c).to_numpy() for c in COUNTS])), seed=seed)


def with_anomaly(counted: DataFrame, forest: Forest | None) -> DataFrame:
    """Add ``anomaly`` (0 to 1) to rows that have the counts."""
    if forest is None:
        return counted.withColumn("anomaly", F.lit(0.0))

    @F.arrow_udf("double")
    def isolate(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in chain.from_iterable(map(slices, batches)):
            yield pa.array(forest.score(ratios(np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns]))))

    return counted.withColumn("anomaly", isolate(*COUNTS))


def _rates() -> dict[str, Column]:
    w, c = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbols": F.col("n_symbols") / w,
        "repeats": F.greatest(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), F.col("n_repeat_words") / w),
        "capitals": (F.col("n_upper") - F.col("n_lines") - F.col("n_marks")) / c - F.lit(0.1),
        "marks": F.col("n_marks") / w,
    }


def leading_rule() -> Column:
    """The rule whose rate is highest in a row: symbols, repeats, capitals, marks, or none."""
    rates = _rates()
    top = F.greatest(*rates.values())
    rule = F.lit("none")
    for name, rate in rates.items():
        rule = F.when((rate == top) & (top > 0), F.lit(name)).otherwise(rule)
    return rule


def band() -> Column:
    """The leading rule with the power of ten that its rate reaches, such as ``symbols 1e-1``; ``none`` without one."""
    top = F.greatest(*_rates().values())
    power = F.floor(F.log10(F.least(F.lit(1.0), F.greatest(F.lit(1e-6), top)))).cast("string")
    return F.when(top > 0, F.concat(leading_rule(), F.lit(" 1e"), power)).otherwise(F.lit("none"))


def thresholds(scored: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", lost: float = 0.0005, bins: int = 2000, by: str = "rule") -> dict[str, float]:
    """For each value of ``by`` the lowest anomaly, ``USUAL`` at least, in whose bin rows labelled bad outnumber good ones
    and from which on it drops no more than ``lost`` of all rows labelled good that pass the base limits.
    Values without such a bin are left out.

    All labelled rows count: a histogram of (value, bin) comes to the driver.
    """
    small = scored.where(~F.col("base_failed")).select(F.col(key).alias("__key"), F.col(by).alias("rule"), F.floor(F.col("anomaly") * bins).cast("int").alias("bin"))
    marks = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("__key"), F.col(label).alias("y"))
    found = small.join(marks, "__key").groupBy("rule", "bin").agg(F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") == 0).alias("bad")).collect()
    total = sum(r["good"] for r in found)
    out = {}
    for rule in sorted({r["rule"] for r in found}) if total else []:
        good, bad = np.zeros(bins + 2), np.zeros(bins + 2)
        for r in found:
            if r["rule"] == rule:
                good[r["bin"]], bad[r["bin"]] = r["good"], r["bad"]
        dropped = np.cumsum(good[::-1])[::-1]
        fit = (bad > good) & (dropped <= lost * total) & (np.arange(bins + 2) >= USUAL * bins)
        if fit.any():
            out[rule] = int(np.argmax(fit)) / bins
    return out


def judged(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", lost: float = 0.0005) -> DataFrame:
    """``key``, the counts, ``base_failed``, ``rule``, ``band``, ``anomaly`` and ``kept`` for every row of ``docs``.

    The texts are read once; counts go to the shared folder as a small table.
    """
    space = Workspace(docs.sparkSession, "rules")
    counted = space.save(with_counts(docs.select(key, text), text=text).drop(text), "counts")
    scored = space.save(with_anomaly(counted, fit_forest(counted, key=key)).withColumns({"rule": leading_rule(), "band": band()}), "scored")
    space.keep("scored")
    limit = F.lit(float("inf"))
    for value, at in thresholds(scored, labels, key=key, lost=lost, by="band").items():
        limit = F.when(F.col("band") == value, F.lit(at)).otherwise(limit)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < limit))
