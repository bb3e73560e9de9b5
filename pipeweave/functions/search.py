"""Ranked retrieval: a hashed bag of words, and vectors by cosine. Scores of 0 and less are dropped, ties go by name."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipeweave.functions.text import ONE_LOWER
from pipeweave.operators.rel import small_batches, stable

#: Fixed values of the lexical model: buckets, and the FNV-1a offset and prime.
BUCKETS, FNV_OFFSET, FNV_PRIME = 256, 0xCBF29CE484222325, 0x100000001B3


_WORD = re.compile(r"[^\W_]+")
#: Bytes of text that a worker turns into words at once.
PIECE = 1 << 18


def word_buckets(words: Sequence[str]) -> np.ndarray:
    """FNV-1a modulo ``BUCKETS``, all words together: the last 8 bits of a product come from the last 8 bits of its factors."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data, starts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    starts, longer = starts[order], np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)))  # how many words go beyond each byte
    h = np.full(len(raw), FNV_OFFSET % BUCKETS, np.uint8)
    for at, n in enumerate(longer):
        h[:n] = (h[:n] ^ data[starts[:n] + at]) * np.uint8(FNV_PRIME % BUCKETS)
    out = np.empty_like(h)
    out[order] = h
    return out


def _words(text: str) -> list[str]:
    for c, one in ONE_LOWER.items():
        text = text.replace(c, one)
    return _WORD.findall(text.lower())


def bags(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """For each text the unit vector of 1 + ln(count) by bucket of lower-case words of letters and digits."""
    counts = [Counter(_words(t or "")) for t in texts]
    words = list(dict.fromkeys(w for c in counts for w in c))
    bucket = dict(zip(words, word_buckets(words).tolist(), strict=True))
    for c in counts:
        v = np.bincount([bucket[w] for w in c], list(c.values()), BUCKETS) if c else np.zeros(BUCKETS)
        v = np.where(v > 0, 1 + np.log(np.maximum(v, 1)), 0)
        n = np.linalg.norm(v)
        yield v / n if n else v


def pieces(texts: pa.Array, most: int = PIECE) -> Iterator[list[str | None]]:
    """The texts in runs of at most ``most`` bytes, or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield texts.slice(a, b - a).to_pylist()
        a = b


def lexical(docs: DataFrame, query: str, name: str, text: str, k: int | None = None) -> DataFrame:
    """``name`` and ``score`` by cosine with the query's bag of words, best first."""
    want = next(bags([query]))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([float(v @ want) for p in pieces(b) for v in bags(p)], pa.float64())

    scored = docs.select(name, score(F.col(text)).alias("score")).where("score > 0")
    if k:
        return scored.orderBy(F.desc("score"), name).limit(k)
    with small_batches(docs.sparkSession):
        fixed = stable(scored)  # a sort of all rows would score them twice
    return fixed.orderBy(F.desc("score"), name)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def semantic(docs: DataFrame, query: list[float], name: str, vector: str, k: int | None = None) -> DataFrame:
    """``name`` and ``score`` by cosine with a query vector, best first."""
    want = F.array(*[F.lit(float(x)) for x in query])
    out = docs.select(name, cosine(F.col(vector), want).alias("score")).where("score > 0").orderBy(F.desc("score"), name)
    return out.limit(k) if k else out
