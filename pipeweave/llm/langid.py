"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams in rank order. A text is
compared with each profile by the out-of-place distance: for each of the text's own most
frequent n-grams, how far its rank lies from the rank in the profile, or the full profile
length where the profile lacks it. The language with the least distance wins.

Defined results: null text, empty text and text without a letter give ``und`` with score 0;
ties go to the language that sorts first; an empty training table gives ``und`` for all;
repeated rows each get their own (equal) result; texts of any length are read whole; other
columns pass through untouched, and existing columns named ``lang_pred``, ``lang_score`` or
``lang_distance`` are replaced.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipeweave.llm.common import fresh, release_memory, slices, small_batches

ORDERS = 3
PROFILE = 400
UND = "und"
_TABLE: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    if not _TABLE:
        n = sys.maxunicode + 1
        flags = np.fromiter((chr(c).isalpha() for c in range(n)), bool, n)
        _TABLE.append(np.where(flags, np.arange(n), 32).astype(np.int64))
    return _TABLE[0]


def ngram_codes(text: str | None, orders: int = ORDERS) -> np.ndarray:
    """The letter n-grams of a text, one int64 each (21 bits a code point), with word edges as spaces."""
    if not text:
        return np.empty(0, np.int64)
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = letter_table()[raw]
    space = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    c = c[keep]
    if len(c) < 3:
        return np.empty(0, np.int64)
    space = c == 32
    parts = [c[~space]]
    code, inner = c, np.zeros(len(c), bool)
    for n in range(2, orders + 1):
        code = (code[:-1] << 21) | c[n - 1 :]
        if n > 2:
            inner = inner[:-1] | space[n - 2 : len(c) - 1]
        else:
            inner = inner[:-1]
        parts.append(code[~inner])
    return np.concatenate(parts)


def ranked(codes: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent codes, most frequent first, ties by code."""
    values, counts = np.unique(codes, return_counts=True)
    if len(values) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= least
        values, counts = values[keep], counts[keep]
    order = np.lexsort((values, -counts))[:top]
    return values[order]


@dataclass(frozen=True)
class LanguageModel:
    """Rank-order profiles. ``profiles`` maps a language to its codes, most frequent first."""

    profiles: dict[str, np.ndarray]
    size: int = PROFILE
    orders: int = ORDERS

    def arrays(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        names = sorted(self.profiles)
        vocabulary = np.unique(np.concatenate([self.profiles[n] for n in names])) if names else np.empty(0, np.int64)
        ranks = np.full((len(vocabulary) + 1, len(names)), self.size, np.int64)
        for j, name in enumerate(names):
            codes = self.profiles[name]
            ranks[np.searchsorted(vocabulary, codes), j] = np.arange(len(codes))
        return names, vocabulary, ranks


def out_of_place(text: str | None, vocabulary: np.ndarray, ranks: np.ndarray, model: LanguageModel) -> np.ndarray | None:
    """Mean distance of the text to each profile as a share of the profile length, or None without a letter."""
    codes = ngram_codes(text, model.orders)
    if not len(codes):
        return None
    own = ranked(codes, model.size)
    at = np.searchsorted(vocabulary, own)
    at[at == len(vocabulary)] = 0
    found = vocabulary[at] == own
    seen = ranks[np.where(found, at, len(vocabulary))]
    gap = np.abs(seen - np.arange(len(own))[:, None])
    gap[seen == model.size] = model.size
    return gap.mean(axis=0) / model.size


def _counts(batches: Iterator[pa.RecordBatch], orders: int, flush: int) -> Iterator[pa.RecordBatch]:
    """Per language and n-gram, how often it occurs in this task's rows; flushed when the table is large."""
    held: dict[str, list[np.ndarray]] = {}
    pending: dict[str, tuple[list[np.ndarray], int]] = {}

    def merge(lang: str) -> None:
        parts, _ = pending.pop(lang)
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        if lang in held:
            old, old_n = held[lang]
            both, at = np.unique(np.concatenate([old, values]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([old_n, counts])).astype(np.int64)
            values = both
        held[lang] = [values, counts]

    def out() -> Iterator[pa.RecordBatch]:
        for lang in sorted(held):
            values, counts = held[lang]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(values), pa.string()), "code": values, "n": counts})
        held.clear()

    for batch in chain.from_iterable(map(slices, batches)):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes = ngram_codes(text, orders)
            parts, n = pending.get(lang, ([], 0))
            parts.append(codes)
            pending[lang] = (parts, n + len(codes))
            if n + len(codes) > 2_000_000:
                merge(lang)
        if sum(len(v) for v, _ in held.values()) > flush:
            yield from out()
    for lang in list(pending):
        merge(lang)
    yield from out()
    release_memory()


def fit(train: DataFrame, *, text: str = "text", lang: str = "lang", size: int = PROFILE, orders: int = ORDERS, flush: int = 1_000_000) -> LanguageModel:
    """Learn one profile of ``size`` n-grams for each language from every row with a language and a text.

    Counting is partial in each task and summed by (language, n-gram), so a hot language spreads
    over all reducers. What reaches the driver is at most ``size`` rows a language.
    """
    rows = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(lambda b: _counts(b, orders, flush), "lang string, code long, n long")
    totals = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    profiles: dict[str, list[tuple[int, int]]] = {}
    with small_batches(train.sparkSession):
        found = top.select("lang", "rank", "code").collect()
    for r in found:
        profiles.setdefault(r["lang"], []).append((r["rank"], r["code"]))
    return LanguageModel({k: np.array([c for _, c in sorted(v)], np.int64) for k, v in profiles.items()}, size, orders)


def predict(docs: DataFrame, model: LanguageModel, *, text: str = "text", sharpness: float = 24.0) -> DataFrame:
    """Add ``lang_pred``, ``lang_score`` (0 to 1: the winner's share of exp(-sharpness x distance)) and
    ``lang_distance`` (0: profiles agree, 1: nothing in common) to every row."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("distance", pa.float64())])

    @F.arrow_udf("struct<lang:string,score:double,distance:double>")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, vocabulary, ranks = model.arrays()
        for batch in chain.from_iterable(map(slices, batches)):
            out = []
            for value in batch.to_pylist():
                gaps = out_of_place(value, vocabulary, ranks, model) if names else None
                if gaps is None:
                    out.append((UND, 0.0, 1.0))
                    continue
                best = int(gaps.argmin())
                share = 1 / np.exp(-sharpness * (gaps - gaps[best])).sum()
                out.append((names[best], float(share), float(gaps[best])))
            yield pa.array([dict(zip(("lang", "score", "distance"), r, strict=True)) for r in out], kind)

    name = fresh(docs, "langid")
    found = docs.withColumn(name, identify.asNondeterministic()(F.col(text)))
    return found.withColumns({"lang_pred": F.col(f"{name}.lang"), "lang_score": F.col(f"{name}.score"), "lang_distance": F.col(f"{name}.distance")}).drop(name)
