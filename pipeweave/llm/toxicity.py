"""Toxicity by maximum-scoring segments.

Words get scores from labelled texts: the log-odds of a word in toxic against other texts under
an informative Dirichlet prior, shrunk by its standard error, so a word must be clearly tied to
the label to score above zero; every other word costs ``drift``. In training a word counts once in a
text, so that one text that repeats it is no evidence. Beginnings of words (four to seven letters) are counted
like words, if several words of toxic texts share them: a word has the highest of its own score and those of its beginnings. In scoring every occurrence counts; inside one
passage (a run over which the sum of scores stays above zero) each repeat is worth half the one before.
One linear scan finds all maximal scoring segments of a text (segments that no extension or split improves). A segment's
score becomes an E-value by extreme-value theory, ``K m exp(-lambda S)`` over the m words of its text,
with ``lambda`` the root of ``sum p(w) exp(lambda s(w)) = 1`` over the words of texts without the
label, and K from the scores of the maximal segments in all training texts without the label. The significance of all segments together, and of the best one, is calibrated to a
probability on the labelled rows, by scores that each half of them gives the other.

Defined results: null, empty and wordless texts have no segment and get the probability of such
a text; without labelled rows of both kinds, all texts get score 0; texts are read whole;
repeated rows get equal results; a key with contradictory labels counts as unlabelled, and of rows that share a
labelled key one is learned from; existing columns named ``toxic_score`` or ``segments`` are
replaced, other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipeweave.llm.common import Workspace, fit_logistic, fresh, labelled_rows, slices, small_batches

WORD = re.compile(r"[^\W_]+")
#: Labelled rows that the model is fitted on at most. Their texts bound the table of scores too.
SAMPLE = 20_000
#: Lengths of the beginnings of words that are counted, the longest first, and the mark that sets them apart.
BEGINNINGS, MARK = (7, 6, 5, 4), "*"
#: Words of toxic texts that must share a beginning for it to count.
KINDS = 5
#: Words whose score a task remembers.
KNOWN = 500_000
#: Width of a bin of segment scores.
BIN = 0.01
#: Segments that a score needs to say something about K.
FEW = 30
SEGMENT = "struct<start:int,end:int,score:double,evalue:double>"


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return WORD.findall(text.lower()) if text else []


def maximal_segments(positions: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text whose words at
    ``positions`` have the given positive scores and whose other words cost ``drift`` each.

    Linear time: each step either pushes a candidate or merges one away.
    """
    # a candidate: first word, last word, sum before it, sum up to its end
    held: list[tuple[int, int, float, float]] = []
    total, after = 0.0, 0
    for p, s in zip(positions, scores, strict=True):
        total -= drift * (p - after)
        first, last, left, right = p, p, total, total + s
        while held:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j -= 1
            if j < 0 or held[j][3] >= right:
                break
            first, left = held[j][0], held[j][2]
            del held[j:]
        held.append((first, last, left, right))
        total, after = total + s, p + 1
    return [(a, b, r - x) for a, b, x, r in held]


def units(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(word[:n] + MARK for n in BEGINNINGS if len(word) > n)]


def together(marks: list[float]) -> float:
    """Log-significance of several segments, by the extreme-value law for sums: that the r best reach a sum of s has
    probability ``exp(-s) s^(r-1) / (r! (r-1)!)``; the r that says most counts. ``marks``: -log E-values, best first."""
    best = s = 0.0
    for r, mark in enumerate(marks, 1):
        s += mark
        best = max(best, s if r == 1 else s - (r - 1) * math.log(max(s, 1e-9)) + math.lgamma(r + 1) + math.lgamma(r))
    return best


@dataclass(frozen=True)
class ToxicityModel:
    scores: dict[str, float]
    drift: float = 1.0
    rate: float = 1.0
    constant: float = 0.1
    cutoff: float = 0.5
    weights: tuple[float, ...] = ()
    known: dict[str, float] = field(default_factory=dict, compare=False, repr=False)

    @cached_property
    def heads(self) -> frozenset[str]:
        """The first letters of all that has a score: any other word has none."""
        return frozenset(u.removesuffix(MARK)[: BEGINNINGS[-1]] for u in self.scores)

    def score_of(self, word: str) -> float:
        """The highest score of a word and its beginnings in the table; 0: none."""
        s = self.known.get(word)
        if s is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            s = self.known[word] = max(self.scores.get(u, 0.0) for u in units(word))
        return s

    def candidates(self, found: list[str]) -> list[tuple[int, int, float]]:
        """The maximal segments of a text's words: first word, last word, score."""
        known, score_of, heads, head = self.known.get, self.score_of, self.heads, BEGINNINGS[-1]
        hits: list[tuple[int, float]] = []
        worth: dict[str, float] = {}  # of the next occurrence in this passage
        total, after = 0.0, 0
        for i, w in enumerate(found):
            if w[:head] not in heads:
                continue
            s = known(w)
            if s is None:
                s = score_of(w)
            if s:
                total -= self.drift * (i - after)
                if total <= 0:  # no maximal segment reaches over this place
                    total = 0.0
                    worth.clear()
                s = worth.get(w, s)
                worth[w] = s / 2
                hits.append((i, s))
                total, after = total + s, i + 1
        return maximal_segments([i for i, _ in hits], [s for _, s in hits], self.drift)

    def segments(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """Significant segments: first word, last word, score and E-value over all words of the text."""
        found = words(text)
        out = []
        for a, b, s in self.candidates(found):
            e = self.constant * len(found) * math.exp(-min(700.0, self.rate * s))
            if e <= self.cutoff:
                out.append((a, b, s, e))
        return out

    def features(self, text: str | None) -> tuple[list[tuple[int, int, float, float]], tuple[float, float]]:
        """The significant segments, and their log-significance: of the best, and of the best ones together."""
        found = self.segments(text)
        marks = sorted((-math.log(max(e, 1e-300)) for _, _, _, e in found), reverse=True)
        return found, (math.log1p(max(marks, default=0.0)), math.log1p(together(marks)))

    def probability(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(features))
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(features @ w[:-1] + w[-1], -30, 30)))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of this task with label and half that hold each word or beginning, flushed when the table is large."""
    held: dict[str, list[int]] = {}
    names = ("o0", "t0", "o1", "t1")

    def out() -> Iterator[pa.RecordBatch]:
        keys = list(held)
        for a in range(0, len(keys), 50_000):
            part = keys[a : a + 50_000]
            counts = {n: pa.array([held[w][i] for w in part], pa.int64()) for i, n in enumerate(names)}
            yield pa.RecordBatch.from_pydict({"word": pa.array(part, pa.string())} | counts)
        held.clear()

    for b in chain.from_iterable(map(slices, batches)):
        for y, half, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            place = 2 * half + (1 if y else 0)
            for u in {u for w in set(words(text)) for u in units(w)}:
                held.setdefault(u, [0, 0, 0, 0])[place] += 1
        if len(held) > 300_000:
            yield from out()
    yield from out()


def segment_rate(scores: np.ndarray, frequency: np.ndarray, drift: float, rest: float) -> float:
    """The positive root of ``sum p exp(rate s) + rest exp(-rate drift) = 1``; 1 where scores give none."""
    value = lambda t: float(frequency @ np.exp(t * scores)) + rest * math.exp(-t * drift) - 1
    top = 1.0
    while value(top) < 0 and top < 64:
        top *= 2
    low = top
    while value(low) >= 0 and low > 1e-6:
        low /= 2
    if low <= 1e-6:
        return 1.0
    for _ in range(60):
        middle = (low + top) / 2
        low, top = (middle, top) if value(middle) < 0 else (low, middle)
    return min(top, 8.0)


def segment_constant(bins: dict[int, int], n_words: int, rate: float) -> float:
    """The least K with which ``K m exp(-rate S)`` gives no fewer segments than were seen, at every score that
    ``FEW`` or more reach: words that keep company give high scores more often than the law of single words.
    ``bins`` has the segments by score in units of ``BIN``; with fewer, K is that of one segment at score 0."""
    seen, most = 0, 1.0
    for at in sorted(bins, reverse=True):
        seen += bins[at]
        if seen >= FEW:
            most = max(most, seen * math.exp(min(600.0, rate * at * BIN)))
    return most / max(n_words, 1)


def with_kinds(counts: DataFrame) -> DataFrame:
    """Add ``kinds``: of a beginning, the words of toxic texts that share it; of a word, ``KINDS``."""
    begins = [F.when(F.char_length("word") > n, F.concat(F.substring("word", 1, n), F.lit(MARK))) for n in BEGINNINGS]
    plain = counts.where(~F.endswith("word", F.lit(MARK)) & (F.col("t0") + F.col("t1") > 0))
    shared = plain.select(F.explode(F.array_compact(F.array(*begins))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    kinds = F.when(F.endswith("word", F.lit(MARK)), F.coalesce("n", F.lit(0))).otherwise(F.lit(KINDS))
    return counts.join(shared, "word", "left").withColumn("kinds", kinds).drop("n")


def scored_words(counts: DataFrame, prior: float, certainty: float, least: int, floor: float) -> list[dict[str, float]]:
    """The scores of the words and beginnings clearly tied to the label (held by ``least`` labelled texts, above ``floor``),
    by the texts of the first half, of the second, and of both."""
    totals = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("t0", "o0", "t1", "o1")]).first()
    score = []
    for t, o, space_t, space_o in (("t0", "o0", *totals[:2]), ("t1", "o1", *totals[2:]), ("t0 + t1", "o0 + o1", totals[0] + totals[2], totals[1] + totals[3])):
        if not space_t or not space_o:
            score.append(F.lit(None).cast("double"))
            continue
        t, o, n = F.expr(t), F.expr(o), float(space_t + space_o)
        own = prior * (t + o)
        odds = lambda c, total: F.log((c + own) / (F.lit(total + prior * n) - c - own))  # noqa: E731, B023
        sure = odds(t, space_t) - odds(o, space_o) - certainty * F.sqrt(1 / (t + own) + 1 / (o + own))
        score.append(F.when((t >= least) & (F.col("kinds") >= KINDS), sure))
    rows = counts.select("word", *[s.alias(f"s{i}") for i, s in enumerate(score)]).where(F.greatest("s0", "s1", "s2") > floor).collect()
    return [{r["word"]: r[f"s{i}"] for r in rows if r[f"s{i}"] is not None and r[f"s{i}"] > floor} for i in range(3)]


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, prior: float = 0.05, certainty: float = 2.0, drift: float = 1.0, least: int = 3, floor: float = 0.25) -> ToxicityModel:
    """Fit on at most ``sample`` labelled rows, those with the smallest key hash.

    Only the sampled keys (a bounded table) are broadcast to the texts; the sampled texts are
    saved, and words counted in each task and summed by word. The driver gets the words that ``least`` toxic
    texts of the sample hold and whose score passes ``floor``, two numbers for each sampled row, and counts by score.
    The prior weighs ``prior`` of all counts.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "toxicity")
    rows = labelled_rows(docs, labels, key, label, {"text": F.col(text)}, sample).where(F.col("text").isNotNull())
    train = space.save(rows.select("y", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"), "text"), "train")
    parts = ("o0", "t0", "o1", "t1")
    counts = train.mapInArrow(_word_counts, "word string, o0 long, t0 long, o1 long, t1 long").groupBy("word").agg(*[F.sum(c).alias(c) for c in parts])
    counts = space.save(with_kinds(space.save(counts, "words")), "kinds")
    *by_half, scores = scored_words(counts, prior, certainty, least, floor)
    # where a half alone gives no scores, both halves stand in for it
    halves = [ToxicityModel(x if all(by_half) else scores, drift) for x in by_half]
    two = tuple(halves)

    def chance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of this task's texts without the label, by the other half's scores: words (kind 0), words by score (1), segments by score (2)."""
        n: Counter = Counter()
        for b in chain.from_iterable(map(slices, batches)):
            for half, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found, model = words(t), two[1 - half]
                n[0, 0] += len(found)
                n.update((1, int(s / BIN)) for s in map(model.score_of, (w for w in found if w[: BEGINNINGS[-1]] in model.heads)) if s)
                n.update((2, int(s / BIN)) for _, _, s in model.candidates(found))
        yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in n], pa.int32()), "bin": pa.array([at for _, at in n], pa.int64()), "n": pa.array(list(n.values()), pa.int64())})

    with small_batches(spark):
        counted = train.where(F.col("y") == 0).select("half", "text").mapInArrow(chance, "kind int, bin long, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n")).collect()
    by_kind = {k: {r["bin"]: r["n"] for r in counted if r["kind"] == k} for k in (0, 1, 2)}
    n_words = by_kind[0].get(0, 0)
    hits = np.array(sorted(by_kind[1].items()), np.float64).reshape(-1, 2)
    frequency = hits[:, 1] / max(n_words, 1)
    rate = segment_rate((hits[:, 0] + 0.5) * BIN, frequency, drift, 1 - frequency.sum()) if len(hits) else 1.0
    constant = segment_constant(by_kind[2], n_words, rate)
    two = tuple(replace(h, rate=rate, constant=constant) for h in halves)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(map(slices, batches)):
            marks = [two[1 - half].features(t)[1] for half, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"y": b.column(0).cast(pa.int32()), "best": pa.array([r[0] for r in marks], pa.float64()), "all": pa.array([r[1] for r in marks], pa.float64())})

    with small_batches(spark):
        seen = train.mapInArrow(measure, "y int, best double, all double").collect()
    space.keep()
    x, y = np.array([[r["best"], r["all"]] for r in seen]).reshape(-1, 2), np.array([float(bool(r["y"])) for r in seen])
    if len(np.unique(y)) < 2:
        return ToxicityModel({})
    return ToxicityModel(scores, drift, rate, constant, weights=tuple(fit_logistic(x, y, l2=0.01).tolist()))


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text") -> DataFrame:
    """Add ``toxic_score`` (0 to 1) and ``segments``: the significant passages as word positions
    (``start`` included, ``end`` excluded), their score and E-value."""
    kind = pa.struct([("score", pa.float64()), ("segments", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("evalue", pa.float64())])))])

    @F.arrow_udf(f"struct<score:double,segments:array<{SEGMENT}>>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in chain.from_iterable(map(slices, batches)):
            rows = [model.features(t) for t in batch.to_pylist()]
            p = model.probability(np.array([f for _, f in rows]).reshape(len(rows), 2))
            yield pa.array([{"score": float(v), "segments": [{"start": a, "end": b + 1, "score": s, "evalue": e} for a, b, s, e in found]} for v, (found, _) in zip(p, rows, strict=True)], kind)

    name = fresh(docs, "judged")
    out = docs.withColumn(name, judge.asNondeterministic()(F.col(text)))
    return out.withColumns({"toxic_score": F.col(f"{name}.score"), "segments": F.col(f"{name}.segments")}).drop(name)
