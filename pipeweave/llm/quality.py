"""Quality classifier by co-training two views.

One classifier sees the text's content (hashed words and word pairs), the other the page's
metadata: source and language by the quality that labelled rows of that source and language have,
the declared length, and the page's layout (shares of character classes, shapes of words and
lines), but no word. Both are linear discriminants of moments (rows, sums, sums of products by class), which
add up over tasks, so all rows can teach. In each round every unlabelled row that one view is sure of joins the
moments of the other with that label; rows on which both are sure and disagree teach neither. In each class such rows
weigh no more than the labelled ones together. Probabilities come from scores out of fold, by models
that were taught the same rows, and the two views' calibrated scores are combined by a logistic
regression on the labelled rows.

Defined results: null and empty texts have content 0 and a layout of nothing; null metadata is a value of its own;
without labels of both kinds all rows get 1.0 (nothing is rejected); repeated rows get equal
scores; a key with contradictory labels counts as unlabelled, and of rows that share a labelled
key one is learned from; texts are read whole; an existing column ``quality_score`` is replaced, others pass
through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeweave.llm.common import Workspace, chosen_labels, fit_logistic, fresh, mix64, sigmoid, slices

#: Labelled rows that the model is fitted on at most.
LABELLED = 8_000
#: Buckets of hashed words and of hashed pairs of neighbours.
WORDS, PAIRS = 192, 64
#: Rows of a value that its labelled rate is worth before it counts for itself.
PRIOR = 20
#: Tasks that add up moments at most: each gives a row for each number of the moments.
ADDERS = 512
#: One class for each ASCII sign, one for lower-case letters, upper-case letters, digits, spaces, and all else.
_CLASSES = np.array([1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c in b" \t\r\x0b\x0c" else 5 if c == 10 else c - 33 + 6 if 33 <= c <= 47 else c - 58 + 21 if 58 <= c <= 64 else c - 91 + 28 if 91 <= c <= 96 else c - 123 + 34 if 123 <= c <= 126 else 0 for c in range(256)], np.int64)
_N = int(_CLASSES.max()) + 1
_SHAPES = 7
TEXT_FEATURES, META_FEATURES = WORDS + PAIRS + 3, _N + _SHAPES + 8


def _octets(x: np.ndarray) -> np.ndarray:
    """Features lie between 0 and 1 and are kept as bytes."""
    return np.rint(np.clip(x, 0, 1) * 255).astype(np.uint8)


def text_features(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed words and pairs, the share of distinct words, the most frequent one's share, and the number of words."""
    out = np.zeros(TEXT_FEATURES)
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if words:
        digest = xxhash.xxh3_64_intdigest
        ids = np.array([digest(w) for w in words], np.uint64)
        with np.errstate(over="ignore"):
            pairs = mix64(ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:])
        out[:WORDS] = np.sqrt(np.bincount((ids % np.uint64(WORDS)).astype(np.int64), minlength=WORDS) / len(ids))
        if len(pairs):
            out[WORDS : WORDS + PAIRS] = np.sqrt(np.bincount((pairs % np.uint64(PAIRS)).astype(np.int64), minlength=PAIRS) / len(pairs))
        _, seen = np.unique(ids, return_counts=True)
        out[-3:] = len(seen) / len(ids), seen.max() / len(ids), np.log1p(len(ids)) / 16
    return _octets(out)


def layout_features(text: str | None) -> np.ndarray:
    """Square roots of the shares of character classes, then shapes of words and lines, and how much of the words is new."""
    out = np.zeros(_N + _SHAPES)
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    n = len(words)
    if n:
        out[:_N] = np.sqrt(np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=_N) / len(raw))
        lines = raw.split(b"\n")
        widths = np.fromiter(map(len, lines), np.int64, len(lines))
        out[_N:] = np.log1p(n) / 16, min(1.0, len(raw) / n / 20), len(set(lines)) / len(lines), np.log1p(len(lines)) / 12, np.log1p(widths.max()) / 16, min(1.0, 10 / n), len(set(words)) / n
    return out


@dataclass(frozen=True)
class Rates:
    """The mean label of each value of a metadata field, drawn to the mean of all; ``by`` maps a value to sum and rows of each half."""

    by: dict[str | None, tuple[float, int, float, int]] = field(default_factory=dict)
    mean: float = 0.5

    def of(self, value: str | None, half: int | None) -> tuple[float, float]:
        """Rate and weight (0 to 1) of a value; by the other half's rows where a ``half`` is named."""
        a = self.by.get(value, (0.0, 0, 0.0, 0))
        total, n = (a[0] + a[2], a[1] + a[3]) if half is None else a[2:] if half == 0 else a[:2]
        return (total + PRIOR * self.mean) / (n + PRIOR), n / (n + PRIOR)

    @classmethod
    def count(cls, values: list[str | None], y: np.ndarray, half: np.ndarray) -> Rates:
        by: dict[str | None, list] = {}
        for v, label, h in zip(values, y.tolist(), half.tolist(), strict=True):
            a = by.setdefault(v, [0.0, 0, 0.0, 0])
            a[2 * h] += label
            a[2 * h + 1] += 1
        return cls({v: tuple(a) for v, a in by.items()}, float(y.mean()) if len(y) else 0.5)


def meta_features(text: str | None, source: str | None, lang: str | None, length: int | None, sources: Rates, langs: Rates, half: int | None = None) -> np.ndarray:
    """Rates of source and language, the declared length, and the page's layout."""
    out = np.zeros(META_FEATURES)
    out[: _N + _SHAPES] = layout_features(text)
    out[_N + _SHAPES : _N + _SHAPES + 4] = (*sources.of(source, half), *langs.of(lang, half))
    if length is None:
        out[-1] = 1
    else:
        size = np.log1p(max(0, length))
        out[-4:-1] = size / 20, (size / 20) ** 2, length < 100
    return _octets(out)


@dataclass
class Moments:
    """Rows, sums and sums of products of the features, by class."""

    n: np.ndarray
    s: np.ndarray
    p: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> Moments:
        parts = [x[y == c] for c in (0, 1)]
        return cls(np.array([float(len(a)) for a in parts]), np.array([a.sum(axis=0) for a in parts]), np.array([a.T @ a for a in parts]))

    @classmethod
    def none(cls, width: int) -> Moments:
        return cls(np.zeros(2), np.zeros((2, width)), np.zeros((2, width, width)))

    def plus(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.s + other.s, self.p + other.p)

    def at_most(self, rows: np.ndarray) -> Moments:
        """Weighed down to no more than ``rows`` in each class."""
        k = np.minimum(1.0, rows / np.maximum(self.n, 1))
        return Moments(self.n * k, self.s * k[:, None], self.p * k[:, None, None])


def discriminant(m: Moments, shrink: float = 0.05) -> np.ndarray:
    """Weights (last: the constant) of a linear discriminant with classes of equal weight; 0 without both."""
    if not m.n.all():
        return np.zeros(m.s.shape[1] + 1)
    mean = m.s / m.n[:, None]
    inner = sum(m.p[c] / m.n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)) / 2
    spread = np.diag(inner)
    inner += np.diag(shrink * spread + 1e-4 + 1e-3 * spread.mean())
    w = np.linalg.solve(inner, mean[1] - mean[0])
    return np.r_[w, -w @ mean.mean(axis=0)]


def _logit(x: np.ndarray, w) -> np.ndarray:
    w = np.asarray(w)
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def fit_view(x: np.ndarray, y: np.ndarray, half: np.ndarray, taught: Moments) -> tuple[np.ndarray, np.ndarray]:
    """Weights whose logistic is the probability of a good row, and the labelled rows' logits out of fold.

    Each fold's model learns from the other labelled rows and from the same taught ones.
    """
    whole = Moments.of(x, y)
    more = taught.at_most(whole.n)
    z = np.zeros(len(y))
    for f in (0, 1):
        rest = Moments.of(x[half != f], y[half != f])
        z[half == f] = _logit(x[half == f], discriminant((rest if rest.n.all() else whole).plus(more)))
    slope, offset = fit_logistic(z[:, None], y, l2=0.01)
    w = discriminant(whole.plus(more)) * slope
    w[-1] += offset
    return w, np.clip(z * slope + offset, -30, 30)


def sure_rows(text: np.ndarray, meta: np.ndarray, weights: list[np.ndarray], sure: float) -> list[np.ndarray]:
    """What each view teaches the other of each row: 1, 0, or -1 for nothing."""
    out = []
    for x, w in zip((text, meta), weights, strict=True):
        p = sigmoid(_logit(x, w))
        out.append(np.where(p >= sure, 1, np.where(p <= 1 - sure, 0, -1)))
    at_odds = (out[0] >= 0) & (out[1] >= 0) & (out[0] != out[1])
    for mark in out:
        mark[at_odds] = -1
    return out


def lessons(text: np.ndarray, meta: np.ndarray, weights: list[np.ndarray], sure: float) -> list[Moments]:
    """The moments that each view is taught: its features, the other's labels."""
    by_text, by_meta = sure_rows(text, meta, weights, sure)
    return [Moments.of(text[by_meta >= 0], by_meta[by_meta >= 0]), Moments.of(meta[by_text >= 0], by_text[by_text >= 0])]


@dataclass(frozen=True)
class QualityModel:
    """Weights of each view and of their combination; empty where there was nothing to learn from."""

    text: tuple[float, ...] = ()
    meta: tuple[float, ...] = ()
    join: tuple[float, ...] = ()
    taught: tuple[int, int] = (0, 0)
    sources: Rates = Rates()
    langs: Rates = Rates()

    def logits(self, texts: np.ndarray, metas: np.ndarray) -> np.ndarray:
        return np.column_stack([_logit(texts, self.text), _logit(metas, self.meta)])

    def scores(self, texts: np.ndarray, metas: np.ndarray) -> np.ndarray:
        if not self.join:
            return np.ones(len(texts))
        return sigmoid(self.logits(texts, metas) @ np.array(self.join[:-1]) + self.join[-1])


Teach = Callable[[list[np.ndarray]], list[Moments]]


def exchange(text: np.ndarray, meta: np.ndarray, y: np.ndarray, half: np.ndarray, teach: Teach, rounds: int) -> QualityModel:
    """Co-train: ``teach`` gives, for the views' weights, the moments that each is taught by the other."""
    if len(np.unique(y)) < 2:
        return QualityModel()
    views = (text, meta)
    taught = [Moments.none(v.shape[1]) for v in views]
    for _ in range(rounds + 1):
        found = [fit_view(v, y, half, t) for v, t in zip(views, taught, strict=True)]
        if _ == rounds:
            break
        new = teach([w for w, _ in found])
        if all((a.n == b.n).all() and np.allclose(a.s, b.s) for a, b in zip(new, taught, strict=True)):
            break
        taught = new
    z = np.column_stack([logits for _, logits in found])
    join = fit_logistic(z, y, l2=0.1)
    return QualityModel(tuple(found[0][0].tolist()), tuple(found[1][0].tolist()), tuple(join.tolist()), tuple(int(t.n.sum()) for t in taught))


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = 3, sure: float = 0.97) -> QualityModel:
    """Co-training on arrays: labelled rows and unlabelled ones."""
    return exchange(text, meta, y, np.arange(len(y)) % 2, lambda w: lessons(pool_text, pool_meta, w, sure), rounds)


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width) / 255.0


def _rows(batches: Iterator[pa.RecordBatch], sources: Rates, langs: Rates) -> Iterator[pa.RecordBatch]:
    for b in chain.from_iterable(map(slices, batches)):
        key, y, text, source, lang, length = (c.to_pylist() for c in b.columns)
        halves = [None if label is None else xxhash.xxh3_64_intdigest(k) & 1 for k, label in zip(key, y, strict=True)]
        t = [text_features(x).tobytes() for x in text]
        m = [meta_features(*x, sources, langs, h).tobytes() for *x, h in zip(text, source, lang, length, halves, strict=True)]
        yield pa.RecordBatch.from_pydict({"k": b.column(0), "y": pa.array(y, pa.int32()), "half": pa.array(halves, pa.int32()), "text": pa.array(t, pa.binary()), "meta": pa.array(m, pa.binary())})


def _moments(batches: Iterator[pa.RecordBatch], weights: list[np.ndarray], sure: float) -> Iterator[pa.RecordBatch]:
    """This task's lessons, a row for each number: view, class, cell (upper triangle, then sums, then rows)."""
    total = [Moments.none(TEXT_FEATURES), Moments.none(META_FEATURES)]
    for b in chain.from_iterable(slices(x, 4096) for x in batches):
        found = lessons(_unpacked(b.column(0), TEXT_FEATURES), _unpacked(b.column(1), META_FEATURES), weights, sure)
        total = [a.plus(c) for a, c in zip(total, found, strict=True)]
    for view, m in enumerate(total):
        upper = np.triu_indices(m.s.shape[1])
        for c in (0, 1):
            if m.n[c]:
                x = np.concatenate([m.p[c][upper], m.s[c], m.n[c : c + 1]])
                yield pa.RecordBatch.from_pydict({"place": pa.array(np.full(len(x), 2 * view + c), pa.int32()), "cell": pa.array(np.arange(len(x)), pa.int32()), "x": x})


def _added(cells: DataFrame) -> list[Moments]:
    out = [Moments.none(TEXT_FEATURES), Moments.none(META_FEATURES)]
    table = cells.toArrow()
    place, cell, x = (table.column(n).to_numpy() for n in ("place", "cell", "x"))
    for view, m in enumerate(out):
        width = m.s.shape[1]
        upper = np.triu_indices(width)
        for c in (0, 1):
            row = np.zeros(len(upper[0]) + width + 1)
            mine = place == 2 * view + c
            row[cell[mine]] = x[mine]
            m.p[c][upper] = row[: len(upper[0])]
            m.p[c] = np.triu(m.p[c]) + np.triu(m.p[c], 1).T
            m.s[c], m.n[c] = row[len(upper[0]) : -1], row[-1]
    return out


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", length: str = "n_chars", label: str = "quality", labelled: int = LABELLED, rounds: int = 3, sure: float = 0.97) -> QualityModel:
    """Fit on at most ``labelled`` labelled rows, those with the smallest key hash, and on all other rows without their labels.

    The sampled keys (a bounded table) are broadcast. Features of all rows (some 330 bytes each) are
    saved; each round reads them once and adds up moments by cell. The driver gets the sampled rows' features and, each round, as many numbers as the
    moments have (some 80,000), whatever the number of rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "quality")
    chosen = space.save(chosen_labels(labels, key, label, labelled), "chosen")
    columns = {"text": F.col(text), "source": F.col(source).cast("string"), "lang": F.col(lang).cast("string"), "length": F.col(length).cast("long")}
    rows = docs.select(F.col(key).cast("string").alias("k"), *[c.alias(n) for n, c in columns.items()]).join(F.broadcast(chosen), "k", "left")
    marked = rows.where(F.col("y").isNotNull()).groupBy("k").agg(F.first("y").alias("y"), F.min(F.struct("source", "lang")).alias("m")).select("k", "y", "m.source", "m.lang").orderBy("k").collect()
    y = np.array([float(r["y"]) for r in marked])
    if len(np.unique(y)) < 2:
        space.keep()
        return QualityModel()
    half = np.array([xxhash.xxh3_64_intdigest(r["k"]) & 1 for r in marked])
    sources, langs = (Rates.count([r[c] for r in marked], y, half) for c in ("source", "lang"))
    made = rows.select("k", "y", *columns).mapInArrow(lambda b: _rows(b, sources, langs), "k string, y int, half int, text binary, meta binary")
    features = space.save(made, "features")
    one = features.where(F.col("y").isNotNull()).groupBy("k").agg(F.min(F.struct("y", "half", "text", "meta")).alias("r")).select("k", "r.*").orderBy("k").toArrow()
    pool = features.where(F.col("y").isNull()).select("text", "meta")

    def teach(weights: list[np.ndarray]) -> list[Moments]:
        cells = pool.coalesce(ADDERS).mapInArrow(lambda b: _moments(b, weights, sure), "place int, cell int, x double")
        return _added(cells.groupBy("place", "cell").agg(F.sum("x").alias("x")))

    t, m = _unpacked(one.column("text"), TEXT_FEATURES), _unpacked(one.column("meta"), META_FEATURES)
    model = exchange(t, m, one.column("y").to_numpy().astype(np.float64), one.column("half").to_numpy(), teach, rounds)
    space.keep()
    return QualityModel(model.text, model.meta, model.join, model.taught, sources, langs)


def score(docs: DataFrame, model: QualityModel, *, text: str = "text", source: str = "source", lang: str = "lang", length: str = "n_chars") -> DataFrame:
    """Add ``quality_score`` (0 to 1, higher: better) to every row, and beside it what each view says (``quality_views``: text, meta)."""
    kind = pa.struct([("score", pa.float64()), ("text", pa.float64()), ("meta", pa.float64())])

    @F.arrow_udf("struct<score:double,text:double,meta:double>")
    def rate(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in chain.from_iterable(map(slices, batches)):
            rows = list(zip(*(c.to_pylist() for c in columns), strict=True))
            if not rows or not model.join:
                yield pa.array([{"score": 1.0, "text": None, "meta": None}] * len(rows), kind)
                continue
            texts = np.array([text_features(r[0]) for r in rows]) / 255.0
            metas = np.array([meta_features(*r, model.sources, model.langs) for r in rows]) / 255.0
            views = sigmoid(model.logits(texts, metas))
            yield pa.StructArray.from_arrays([pa.array(x) for x in (model.scores(texts, metas), views[:, 0], views[:, 1])], fields=list(kind))

    name = fresh(docs, "rated")
    out = docs.withColumn(name, rate.asNondeterministic()(F.col(text), F.col(source).cast("string"), F.col(lang).cast("string"), F.col(length).cast("long")))
    return out.withColumns({"quality_score": F.col(f"{name}.score"), "quality_views": F.struct(f"{name}.text", f"{name}.meta")}).drop(name)
