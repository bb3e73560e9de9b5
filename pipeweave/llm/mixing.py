"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). Raking multiplies each cell's weight so that
the sums over sources, languages and topics meet their targets in turn, until all three do. The
budget is then spread over the cells in proportion to the raked weights, no cell above what it
has (water filling), and each document is drawn with its cell's share as probability, by a
hashed uniform number, so a draw does not depend on partitions.

Without a topic column topics are learned: each text's longer words are counted in hashed buckets, with the
length of words and lines and of the text beside them, and k-means over all rows finds ``TOPICS`` clusters.
Targets default to the corpus' own marginals flattened by ``temperature`` (share to that power,
normalised), which needs no list of values and behaves alike at every size.

Texts are read once: token counts and features are saved with the columns to return. Everything is DataFrame
expressions; windows run over the cell table only.

Defined results: null source, language or topic is a value of its own; null and wordless texts
have 0 tokens and probability 1 if their cell has no tokens, else the cell's; an empty table
gives an empty result; rows with equal keys draw the same number; existing columns named like
the added ones (``topic``, ``n_tokens``, ``weight``, ``probability``, ``selected``, ``gap``) are replaced; targets that the
cells cannot meet (a value that no document has, or values that exclude each other) leave a ``gap``, and a warning.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipeweave.llm.common import Workspace

AXES = ("s", "l", "t")
#: Cells up to which the cell table (some 60 bytes a row) is sent to every executor and raked in one task; beyond it is joined and raked by shuffle.
SMALL_CELLS = 20_000
#: Topics that are learned, buckets of hashed words, letters of the words that are counted, and rows that first centres are taken from.
TOPICS, BUCKETS, LONG, STARTS = 8, 8, 5, 256
#: Rounds of raking planned and written together.
TOGETHER = 5
ADDED = ("topic", "n_tokens", "weight", "probability", "selected", "gap")
_WHITE = r"[\x20\x09-\x0D]+"


def _features() -> dict[str, Column]:
    """Numbers from 0 to about 1 that say what a text is like, over ``n``, ``chars``, ``lines`` and ``buckets``."""
    long = F.greatest(F.size("buckets"), F.lit(1))
    words = F.greatest("n", F.lit(1))
    out = {f"f{i}": F.sqrt(F.size(F.filter("buckets", lambda b, i=i: b == i)) / long) for i in range(BUCKETS)}
    shapes = (F.size("buckets") / words, F.least(F.lit(1.0), F.col("chars") / words / 20), F.least(F.lit(1.0), 5 * F.col("lines") / words), F.log1p(F.col("n").cast("double")) / 16)
    return out | {f"f{BUCKETS + i}": c for i, c in enumerate(shapes)}


FEATURES = tuple(f"f{i}" for i in range(BUCKETS + 4))


def nearest(centres: list[tuple[float, ...]]) -> Column:
    """The number of the centre that the features lie nearest to, the first of equals."""
    if len(centres) == 1:
        return F.lit(0)
    away = [" + ".join(f"({f} - {x!r}D) * ({f} - {x!r}D)" for f, x in zip(FEATURES, c, strict=True)) for c in centres]
    return F.expr("least(" + ", ".join(f"named_struct('d', {d}, 'i', {i})" for i, d in enumerate(away)) + ")").getField("i")


def first_centres(rows: list[tuple[float, ...]], topics: int) -> list[tuple[float, ...]]:
    """Of a few rows, the first and then always the one furthest from those taken."""
    out = rows[:1]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    while out and len(out) < topics:
        far = max(rows, key=lambda r: min(gap(r, c) for c in out))
        if far in out:
            break
        out.append(far)
    return out


def learned_centres(table: DataFrame, topics: int = TOPICS, rounds: int = 6) -> list[tuple[float, ...]]:
    """K-means over all rows that have words: each round is one aggregate, and the driver gets a row for each topic.

    First centres come from the rows with the smallest hashes (``STARTS`` at most).
    """
    known = table.where("n > 0").select(*FEATURES)
    few = known.orderBy(F.xxhash64(*FEATURES), *FEATURES).limit(STARTS).collect()
    centres = first_centres(sorted({tuple(r) for r in few}), topics)
    for _ in range(rounds if len(centres) > 1 else 0):
        sums = known.groupBy(nearest(centres).alias("i")).agg(*[F.avg(f).alias(f) for f in FEATURES]).collect()
        moved = dict(enumerate(centres)) | {r["i"]: tuple(round(r[f], 6) for f in FEATURES) for r in sums}
        new = [moved[i] for i in range(len(centres))]
        if new == centres:
            break
        centres = new
    return sorted(centres)


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None, temperature: float, space: Workspace, rounds: int = 100, tolerance: float = 1e-6) -> tuple[DataFrame, float]:
    """``cells`` (axes, ``tokens``) with ``weight``, summing to 1, raked to the targets of each axis; and the largest
    difference left between a marginal and its target.

    A target table has a column ``value`` and a column ``share``. Rounds end when the difference is below ``tolerance`` or falls no more.
    """
    table = cells.where("tokens > 0")
    lost = 0.0
    for axis in AXES:
        own = table.groupBy(axis).agg(F.sum("tokens").alias("n"))
        if targets and axis in targets:
            goal = targets[axis].select(F.col("value").alias("v"), F.col("share").cast("double").alias("x"))
            whole = goal.agg(F.sum("x")).first()[0] or 0.0
            flat = own.join(goal, F.col(axis).eqNullSafe(F.col("v")), "left").select(axis, F.coalesce("x", F.lit(0.0)).alias("x"))
        else:
            whole = None
            flat = own.select(axis, F.pow(F.col("n").cast("double"), F.lit(temperature)).alias("x"))
        norm = flat.agg(F.sum("x")).first()[0] or 0.0
        if whole:
            lost = max(lost, 1 - norm / whole)  # of targets for values that no document has
        goal = flat.select(F.col(axis).alias("v"), (F.col("x") / F.lit(norm or 1.0)).alias(f"goal_{axis}"))
        table = table.join(goal, table[axis].eqNullSafe(goal["v"]), "left").drop("v")
    tokens, n = cells.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    w = space.save(table.withColumn("weight", F.col("tokens") / F.lit(float(max(tokens or 0, 1)))), "rake-0")
    gap, before = 0.0, float("inf")
    for r in range(TOGETHER, rounds + 1, TOGETHER):
        x = w.coalesce(1) if n <= SMALL_CELLS else w
        for axis in AXES * TOGETHER:
            x = x.selectExpr(*[c for c in w.columns if c != "weight"], f"weight * goal_{axis} / nullif(sum(weight) OVER (PARTITION BY {axis}), 0) AS weight").na.fill(0.0, ["weight"])
        w = space.save(x, f"rake-{r}")
        space.drop(f"rake-{r - TOGETHER}")
        off = [w.groupBy(axis, f"goal_{axis}").agg(F.sum("weight").alias("m")).select(F.abs(F.col("m") - F.col(f"goal_{axis}")).alias("off")) for axis in AXES]
        gap = off[0].unionAll(off[1]).unionAll(off[2]).agg(F.max("off")).first()[0] or 0.0
        if gap < tolerance or gap > 0.99 * before:
            break
        before = gap
    return w.select(*AXES, "tokens", "weight"), max(gap, lost)


def shares(raked: DataFrame, budget: float) -> DataFrame:
    """Each cell's ``probability``: the budget (a share of all tokens) spread by weight, none above 1.

    Water filling: the level at which the clipped shares spend the budget, found by sums at 30 levels
    at a time over the cell table.
    """
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return raked.withColumn("probability", F.lit(1.0))
    goal, low, high = budget * total, 0.0, 0.0
    share = lambda x: f"least(1D, {x!r}D * weight / tokens)"
    levels = [float(total) * 10 ** (e / 5) * budget for e in range(31)]
    for _ in range(5):
        spent = raked.selectExpr(*[f"sum({share(x)} * tokens) AS x{i}" for i, x in enumerate(levels)]).first()
        at = next((i for i in range(len(levels)) if spent[i] >= goal * (1 - 1e-12)), len(levels) - 1)
        low, high = levels[max(0, at - 1)], levels[at]
        levels = [low + (high - low) * i / 30 for i in range(31)]
    return raked.withColumn("probability", F.expr(share(high)))


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, targets: dict[str, DataFrame] | None = None, temperature: float = 0.5, budget: float = 0.5, seed: int = 17, returned: list[str] | None = None) -> DataFrame:
    """All rows of ``docs`` with ``topic``, ``n_tokens``, ``weight`` (the cell's raked share),
    ``probability``, ``selected`` and ``gap`` (what raking left between marginals and targets).

    ``targets`` may name axes ``source``, ``lang`` and ``topic``, each a table (value, share). ``returned`` names the
    columns of ``docs`` to return (all, if not given): they are saved with the counts, so that texts are split once.
    """
    space = Workspace(docs.sparkSession, "mixing")
    columns = [c for c in (docs.columns if returned is None else returned) if c not in ADDED]
    row = F.struct(*[F.col(c) for c in columns]) if columns else F.struct(F.lit(None).alias("none"))
    t = F.coalesce(F.col(text), F.lit(""))
    number = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 50)) / F.lit(float(1 << 50))
    axes = [F.col(source).alias("s"), F.col(lang).alias("l"), *([] if topic is None else [topic.alias("t")])]
    words = F.filter(F.split(t, _WHITE), lambda w: w != "")
    read = docs.select(row.alias("row"), *axes, number.alias("number"), F.char_length(t).alias("chars"), (F.char_length(t) - F.char_length(F.replace(t, F.lit("\n"), F.lit("")))).alias("lines"), words.alias("words"))
    kept = ["row", "number", "n", *("s", "l", "t")[: len(axes)]]
    if topic is None:
        hashed = F.transform(F.filter("words", lambda w: F.char_length(w) >= LONG), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("tinyint"))
        counted = read.select("*", F.size("words").cast("long").alias("n"), hashed.alias("buckets")).drop("words")
        table = space.save(counted.select(*kept, *[c.alias(f) for f, c in _features().items()]), "rows")
        centres = learned_centres(table)
        kind = F.when(F.col("n") > 0, F.concat(F.lit("topic"), nearest(centres))) if centres else F.lit(None).cast("string")
        table = table.withColumn("t", F.coalesce(kind, F.lit("none")))
    else:
        table = space.save(read.withColumn("n", F.size("words").cast("long")).select(*kept), "rows")
    cells = space.save(table.groupBy(*AXES).agg(F.sum("n").alias("tokens")), "cells")
    names = dict(zip(("source", "lang", "topic"), AXES, strict=True))
    raked, gap = rake(cells, {names[k]: v for k, v in targets.items()} if targets else None, temperature, space)
    if gap > 1e-3:
        warnings.warn(f"raking left a marginal {gap:.2g} from its target", stacklevel=2)
    drawn = space.save(shares(raked, budget), "shares")
    small = drawn.count() <= SMALL_CELLS
    space.keep("rows", "shares")
    drawn = drawn.select(*[F.col(a).alias(f"{a}x") for a in AXES], "weight", "probability")
    same = table["s"].eqNullSafe(drawn["sx"]) & table["l"].eqNullSafe(drawn["lx"]) & table["t"].eqNullSafe(drawn["tx"])
    out = table.join(F.broadcast(drawn) if small else drawn, same, "left")
    p = F.coalesce("probability", F.lit(1.0))
    chosen = F.coalesce(F.col("number") < p, F.lit(False))
    return out.select(*[F.col("row")[c].alias(c) for c in columns], F.col("t").alias("topic"), F.col("n").alias("n_tokens"), F.coalesce("weight", F.lit(0.0)).alias("weight"), p.alias("probability"), chosen.alias("selected"), F.lit(gap).alias("gap"))
