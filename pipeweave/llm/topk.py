"""Exact top-k inner products by norm-sorted, SVD-rotated, pruned search.

All vectors are quantised to integers. Candidates are dealt out by descending length and packed
into blocks, queries into blocks of their own; every query block meets every candidate block
that can still matter. When a block is packed its vectors are rotated, once, to the principal axes
of all candidates, so the first few coordinates carry most of an inner product, and
Cauchy-Schwarz bounds the rest by the product of the residual lengths. Only pairs whose bound
reaches the query's current k-th score get their exact integer product.

Defined results: vectors that are null, or hold a null or non-finite component, take no part;
an empty vector scores 0 against all; of two vectors of unequal dimension the shorter is padded
with zeros; components are whole 64-bit numbers, and products are exact: a component of 2^62 or
more after scaling, or a product beyond 64 bits among the pairs that the bounds leave, raises an
error; a query's own id is no candidate (also if its row is repeated); of rows that share a query id the one
with the least vector (by the bytes of its components) asks, once; ties go to the smaller id; each repeated candidate row counts;
ids may be negative; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipeweave.llm.common import Workspace, slices

#: Components (scaled) and products of lengths stay below these for 64-bit sums.
MOST, SAFE = float(1 << 62), float(1 << 62)
#: Products of lengths below which sums of doubles are exact.
EXACT = float(1 << 53)
#: Vectors in a candidate block, in a query block, and in the head that gives first thresholds.
CANDIDATES, QUERIES, HEAD = 2048, 512, 2048
#: Bytes of query blocks, by estimate, that a task holds while candidate blocks pass by.
ASKED = 64 << 20
#: What rounding may take off a bound, as a share of the product of lengths (directions are 32-bit numbers).
SLACK = 1e-5
_BLOCK = "lane int, ids binary, vectors binary, lead binary, rest binary, lengths binary, wide boolean, longest double"


@dataclass(frozen=True)
class Rotation:
    """The principal axes of the candidates that carry ``share`` of the energy."""

    axes: np.ndarray  # dim x lead


@dataclass(frozen=True)
class Block:
    """Vectors with what bounds need: directions on the leading axes, the share of the length off them, and the length."""

    ids: np.ndarray
    v: np.ndarray
    lead: np.ndarray
    rest: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, v: np.ndarray, turn: Rotation) -> Block:
        x = v.astype(np.float64)
        length = np.sqrt((x**2).sum(axis=1))
        x /= np.maximum(length, 1e-300)[:, None]
        lead = x @ turn.axes
        rest = np.sqrt(np.maximum(0.0, (x**2).sum(axis=1) - (lead**2).sum(axis=1)))
        return cls(ids, v, lead.astype(np.float32), rest.astype(np.float32), length)

    def pack(self) -> dict[str, pa.Array]:
        wide = bool(len(self.v)) and int(np.abs(self.v).max(initial=0)) >= 1 << 31
        raw = {"ids": self.ids, "vectors": self.v if wide else self.v.astype(np.int32), "lead": self.lead, "rest": self.rest, "lengths": self.length}
        out = {k: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for k, x in raw.items()}
        return out | {"wide": pa.array([wide]), "longest": pa.array([float(self.length.max(initial=0))])}

    @classmethod
    def unpack(cls, r: dict, prefix: str = "") -> Block:
        ids = np.frombuffer(r[f"{prefix}ids"], np.int64)
        n = len(ids)
        v = np.frombuffer(r[f"{prefix}vectors"], np.int64 if r[f"{prefix}wide"] else np.int32)
        rows = lambda x: x.reshape(n, -1) if n else x.reshape(0, 1)
        return cls(ids, rows(v).astype(np.int64), rows(np.frombuffer(r[f"{prefix}lead"], np.float32)), np.frombuffer(r[f"{prefix}rest"], np.float32), np.frombuffer(r[f"{prefix}lengths"], np.float64))

    def take(self, at: np.ndarray) -> Block:
        return Block(self.ids[at], self.v[at], self.lead[at], self.rest[at], self.length[at])


def _quantised(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Whole and finite vectors as integers: bytes of 32-bit numbers, or of 64-bit ones (``wide``), with dimension and length."""
    for b in chain.from_iterable(slices(x, 2048) for x in batches):
        column = b.column(1)
        there = ~column.is_null().to_numpy(zero_copy_only=False)
        sizes = np.where(there, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        row = np.repeat(np.arange(len(column)), sizes)
        whole = there & (np.bincount(row[~np.isfinite(x)], minlength=len(column)) == 0)
        x = np.floor(np.where(whole[row], x, 0.0) * scale)
        if len(x) and np.abs(x).max() >= MOST:
            raise OverflowError(f"a component of vector {b.column(0)[int(row[np.abs(x).argmax()])]} is beyond 2^62 after scaling")
        v = x.astype(np.int64)
        wide = np.bincount(row[np.abs(v) >= 1 << 31], minlength=len(column)) > 0
        norm = np.sqrt(np.bincount(row, weights=x * x, minlength=len(column)))
        ends = np.cumsum(sizes)
        keep = np.flatnonzero(whole)
        raw = [v[e - n : e].astype("<i8" if w else "<i4").tobytes() for e, n, w in zip(ends[keep].tolist(), sizes[keep].tolist(), wide[keep].tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"id": b.column(0).take(pa.array(keep)), "v": pa.array(raw, pa.binary()), "wide": wide[keep], "dim": pa.array(sizes[keep], pa.int32()), "norm": norm[keep]})


def quantised(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """``id``, ``v`` (the integers' bytes), ``wide``, ``dim`` and ``norm`` of every row whose vector is complete and finite."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(vector))
    return rows.mapInArrow(lambda b: _quantised(b, scale), "id long, v binary, wide boolean, dim int, norm double")


def _padded(b: pa.RecordBatch, dim: int) -> np.ndarray:
    """The integers of a batch, a row each, with zeros up to ``dim``."""
    raw, wide, dims = b.column("v").to_pylist(), b.column("wide").to_numpy(zero_copy_only=False), b.column("dim").to_numpy()
    if len(raw) and not wide.any() and (dims == dim).all():
        return np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), dim).astype(np.int64)
    out = np.zeros((len(raw), dim), np.int64)
    for i, x in enumerate(raw):
        out[i, : dims[i]] = np.frombuffer(x, "<i8" if wide[i] else "<i4")
    return out


def _gram(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Of directions, so that a few long vectors do not settle the axes."""
    total = np.zeros((dim, dim))
    for b in batches:
        for part in slices(b, 1024):
            v = _padded(part, dim).astype(np.float64)
            v /= np.maximum(np.sqrt((v**2).sum(axis=1)), 1e-300)[:, None]
            total += v.T @ v
    yield pa.RecordBatch.from_pydict({"cell": np.arange(dim * dim, dtype=np.int64), "x": total.ravel()})


def rotation(vectors: DataFrame, dim: int, share: float = 0.8) -> Rotation:
    """Axes from the Gram matrix of all vectors: partial sums in each task, dim x dim sums after one shuffle."""
    cells = vectors.select("v", "wide", "dim").mapInArrow(lambda b: _gram(b, dim), "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x"))
    gram, found = np.zeros(dim * dim), cells.toArrow()
    gram[found["cell"].to_numpy()] = found["x"].to_numpy()
    energy, axes = np.linalg.eigh(gram.reshape(dim, dim))
    energy, axes = np.maximum(energy[::-1], 0), axes[:, ::-1]
    total = energy.sum()
    lead = dim if total <= 0 else int(np.searchsorted(np.cumsum(energy) / total, share) + 1)
    return Rotation(np.ascontiguousarray(axes[:, : max(1, min(lead, dim))]))


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, size: int, lanes: int, turn: Rotation) -> Iterator[pa.RecordBatch]:
    """Pack the rows of a task, which come by descending length, into rotated blocks of ``size``."""
    ids: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    n = made = 0

    def out(take: int) -> pa.RecordBatch:
        nonlocal ids, rows, n, made
        i, v = np.concatenate(ids), np.concatenate(rows)
        ids, rows, n = [i[take:]], [v[take:]], len(i) - take
        made += 1
        lane = (int(i[0]) * 7919 + made) % lanes
        return pa.RecordBatch.from_pydict({"lane": pa.array([lane], pa.int32())} | Block.of(i[:take], v[:take], turn).pack())

    for b in batches:
        for part in slices(b, 1024):
            ids.append(part.column("id").to_numpy())
            rows.append(_padded(part, dim))
            n += part.num_rows
            while n >= size:
                yield out(size)
    if n:
        yield out(n)


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The exact inner products of rows ``i`` of ``a`` and ``j`` of ``b``; ``bound``: the products of their lengths.

    No partial sum exceeds the bound, so below 2^53 sums of doubles are exact, and below 2^62 sums of integers are.
    """
    if bound.max() < EXACT and len(i) > 0.05 * len(a) * len(b):
        return (a.astype(np.float64) @ b.astype(np.float64).T)[i, j].astype(np.int64)
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), 65536):
        out[s : s + 65536] = np.einsum("ij,ij->i", a[i[s : s + 65536]], b[j[s : s + 65536]])
    for n in np.flatnonzero(bound >= SAFE).tolist():
        exact = sum(x * y for x, y in zip(a[i[n]].tolist(), b[j[n]].tolist(), strict=True))
        if not -(1 << 63) < exact < 1 << 63:
            raise OverflowError(f"inner product {exact} does not fit 64 bits")
        out[n] = exact
    return out


def best_of(scores: np.ndarray, ids: np.ndarray, there: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the k highest scores, ties to the smaller id; absent entries stand last."""
    order = np.lexsort((ids, ~scores, ~there), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1), np.take_along_axis(there, order, 1)


@dataclass
class Found:
    """The best candidates of each query so far: ``there`` says which places are taken."""

    scores: np.ndarray
    ids: np.ndarray
    there: np.ndarray
    exact: int = 0


def search_block(q: Block, c: Block, k: int, floor: np.ndarray, step: int = 512) -> Found:
    """The k best candidates of each query among ``c`` that reach ``floor``; also how many exact products were taken.

    ``c`` is worked through by descending length, ``step`` vectors at a time, and the k-th score
    found so far raises the floor for the rest.
    """
    c = c.take(np.argsort(-c.length, kind="stable"))
    n = len(q.ids)
    out = Found(np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), bool))
    floor = floor.astype(np.float64).copy()
    for a in range(0, len(c.ids), step):
        b = min(a + step, len(c.ids))
        live = np.flatnonzero(q.length * c.length[a] * (1 + SLACK) + 1 >= floor)
        if not len(live):
            break
        bound = (q.lead[live] @ c.lead[a:b].T).astype(np.float64)
        bound += np.outer(q.rest[live], c.rest[a:b])
        bound += SLACK
        bound *= q.length[live][:, None]
        bound *= c.length[a:b]
        i, j = np.nonzero((bound + 1 >= floor[live][:, None]) & (q.ids[live][:, None] != c.ids[a:b]))
        if not len(i):
            continue
        out.exact += len(i)
        product = products(q.v[live], c.v[a:b], i, j, q.length[live[i]] * c.length[a + j])
        i, j = live[i], j + a
        # the best k of each query among these, then merged with what it has
        by = np.lexsort((c.ids[j], ~product, i))
        i, j, product = i[by], j[by], product[by]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        place = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
        near = place < k
        i, j, product, place = i[near], j[near], product[near], place[near]
        rows = np.unique(i)
        at = np.searchsorted(rows, i)
        new_s, new_i, new_t = np.zeros((len(rows), k), np.int64), np.zeros((len(rows), k), np.int64), np.zeros((len(rows), k), bool)
        new_s[at, place], new_i[at, place], new_t[at, place] = product, c.ids[j], True
        out.scores[rows], out.ids[rows], out.there[rows] = best_of(np.hstack([out.scores[rows], new_s]), np.hstack([out.ids[rows], new_i]), np.hstack([out.there[rows], new_t]), k)
        full = out.there[rows, k - 1]
        floor[rows[full]] = np.maximum(floor[rows[full]], out.scores[rows[full], k - 1])
    return out


def _floors(batches: Iterator[pa.RecordBatch], k: int, head: Block) -> Iterator[pa.RecordBatch]:
    """Give each query block its first thresholds: the k-th score among the longest candidates."""
    for b in batches:
        for part in slices(b, 1):
            for r in part.to_pylist():
                q = Block.unpack(r)
                found = search_block(q, head, k, np.full(len(q.ids), -np.inf))
                floor = np.where(found.there[:, k - 1], found.scores[:, k - 1].astype(np.float64), -np.inf)
                columns = {f"q_{c}": part.column(c) for c in ("ids", "vectors", "lead", "rest", "lengths", "wide", "longest")}
                yield pa.RecordBatch.from_pydict(columns | {"floors": pa.array([floor.tobytes()], pa.binary()), "least": [float(floor.min())]})


def _pairs(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in slices(b, 1):
            for r in part.to_pylist():
                q, c = Block.unpack(r, "q_"), Block.unpack(r)
                found = search_block(q, c, k, np.frombuffer(r["floors"], np.float64))
                row, place = np.nonzero(found.there)
                yield pa.RecordBatch.from_pydict({"query_id": q.ids[row], "vec_id": found.ids[row, place], "score": found.scores[row, place]})


def top_k(queries: DataFrame, candidates: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, share: float = 0.8) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: the exact ``k`` best candidates of each query.

    Candidates are range-partitioned by (length, id), so equal vectors spread too, and their blocks are dealt
    out to ``lanes`` lanes, long ones among short ones. Every query block meets every candidate block once, as an
    exact search must: a task goes through the candidate blocks of a lane with some ASKED bytes of query
    blocks, read from the work folder; these are neither broadcast nor copied through a shuffle, whatever
    the session's broadcast threshold. Broadcast to tasks: the axes (dim x dim at most) and HEAD vectors.
    """
    spark = candidates.sparkSession
    space = Workspace(spark, "topk")
    c = space.save(quantised(candidates, key, vector, scale), "candidates")
    q = quantised(queries, key, vector, scale).groupBy("id").agg(F.min(F.struct("v", "wide", "dim")).alias("r")).select("id", "r.*")
    q = space.save(q, "asking")
    widest, rows = c.agg(F.max("dim"), F.count(F.lit(1))).first()
    widest_asking, asking = q.agg(F.max("dim"), F.count(F.lit(1))).first()
    dim = max(widest or 1, widest_asking or 1)
    turn = rotation(c, dim, share)
    # partitions of three quarters of a block: few need a second one
    lanes = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * rows // (3 * CANDIDATES))))
    top = c.orderBy(F.desc("norm"), "id").limit(HEAD).toArrow().combine_chunks().to_batches()
    head = Block.of(top[0].column("id").to_numpy(), _padded(top[0], dim), turn) if top else Block.of(np.empty(0, np.int64), np.empty((0, dim), np.int64), turn)
    dealt = c.repartitionByRange(lanes, F.desc("norm"), F.col("id")).sortWithinPartitions(F.desc("norm"), "id")
    c_blocks = dealt.mapInArrow(lambda b: _blocks(b, dim, CANDIDATES, lanes, turn), _BLOCK).repartition(lanes, "lane").drop("lane")
    q_blocks = q.repartition(max(1, -(-4 * asking // (3 * QUERIES))), "id").mapInArrow(lambda b: _blocks(b, dim, QUERIES, lanes, turn), _BLOCK)
    q_blocks = q_blocks.mapInArrow(lambda b: _floors(b, k, head), "q_ids binary, q_vectors binary, q_lead binary, q_rest binary, q_lengths binary, q_wide boolean, q_longest double, floors binary, least double")
    q_blocks = space.save(q_blocks, "queries").coalesce(max(1, -(-asking * dim * 12 // ASKED)))
    meet = c_blocks.join(q_blocks.hint("shuffle_replicate_nl"), F.col("longest") * F.col("q_longest") * (1 + SLACK) + 1 >= F.col("least"))
    found = space.save(meet.drop("longest", "q_longest", "least").mapInArrow(lambda b: _pairs(b, k), "query_id long, vec_id long, score long"), "found")
    space.keep("found")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
