"""Near-duplicate groups by MinHash bands, odd sketches and exact confirmation.

A document is the set of its 5-word shingles (ASCII lower case, words between ASCII white space;
fewer words: the whole sequence). Documents whose sets are equal form a class and are handled as
one. Each class has 128 MinHash samples: 32 bands of 4 choose candidates (two sets of similarity
0.75 share no band with probability 5e-6), and the samples folded into a 256-bit parity bitmap,
the odd sketch, judge a candidate pair by the population count of the bitmaps' XOR before its
full sets are compared. A link is confirmed on the full sets only.

Three rounds keep pairs linear in the input: (1) in each band bucket, everyone against the
bucket's smallest id; (2) everyone against a randomly chosen member, across components only;
(3) what is left, members of one bucket in different components: their sketches alone are compared first, in piles, and
documents that some sketch of another component comes near then take their sets to blocks of bounded size that
compare all cross pairs not already connected. Links become components by alternating star contraction; later
links contract the components that earlier ones gave.

No join waits for one key: buckets and hubs (the documents many others are compared with) that hold more than 1 in 20,000
rows are so few (640,000 at most, as each document has 32 bands) that what is joined to them is broadcast, or
they are dealt out by salt.

Defined results: null, empty and wordless texts have 0 shingles, no links, and stay; rows with
equal ids count as one document and are in one component; rows with a null id stay unlinked;
texts of any length are read whole; an empty table gives an empty result; only key and text are
read, so extra columns cannot clash. Keys are whole numbers, or text that spells them (other text raises an error in
ANSI mode, and counts as null otherwise).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipeweave.llm.common import Workspace, mix64, release_executors, release_memory, slices

WIDTH, SAMPLES, BANDS, BITS = 5, 128, 32, 256
#: XOR bits above which a pair cannot be similar enough: 5.4 standard deviations above the mean at 0.75.
MOST_BITS = 92
#: Shingles in one block of a bucket, about (2 MB); a task holds two blocks.
BLOCK = 262_144
#: Sketches (48 bytes each) in a pile at least and at most, and the piles of a bucket from which on these grow.
PILE, MOST_PILE, PILES = 512, 16_384, 32
#: Rows of a bucket or hub up to which it is dealt like any other, at least; and its share of all classes, 1 in so many.
CROWD, SHARE = 256, 20_000
_FEATURES = "id long, n long, h1 long, h2 long, bands array<long>, sketch array<long>"
_FACTORS = [pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) | 1 for j in range(WIDTH)]


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    w = np.array([digest(x) for x in words], np.uint64)
    with np.errstate(over="ignore"):
        if len(w) < WIDTH:
            total = np.uint64(len(w))
            for j in range(len(w)):
                total = total + w[j] * np.uint64(_FACTORS[j])
            return mix64(np.array([total]) ^ np.uint64(0x5851F42D4C957F2D))
        n = len(w) - WIDTH + 1
        total = np.zeros(n, np.uint64)
        for j in range(WIDTH):
            total += w[j : j + n] * np.uint64(_FACTORS[j])
    return np.unique(mix64(total))


def sample_factors() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 & 0xFFFFFFFF))
    return seeds[:SAMPLES] | np.uint64(1), seeds[SAMPLES:]


def minhash(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each of 128 linear hashes over the set."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 2048):
            np.minimum(best, (s[i : i + 2048, None] * a + b).min(axis=0), out=best)
    return best


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Each (position, sample) flips one of 256 bits; what is left is four 64-bit words."""
    place = np.arange(len(samples), dtype=np.uint64)
    with np.errstate(over="ignore"):
        bit = (mix64(samples + place * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)).astype(np.int64)
    parity = np.bincount(bit, minlength=BITS) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.uint64)


def similarity(sketch_a: np.ndarray, sketch_b: np.ndarray) -> float:
    """What two odd sketches say of the Jaccard similarity of their sets."""
    differ = int(np.bitwise_count(sketch_a ^ sketch_b).sum())
    inner = max(1e-9, 1 - 2 * differ / BITS)
    return float(1 + BITS / (4 * SAMPLES) * np.log(inner))


def band_keys(samples: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        rows = samples.reshape(BANDS, -1)
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
        for j in range(rows.shape[1]):
            key = mix64(key + rows[:, j] * np.uint64(_FACTORS[j]))
    return key


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = sample_factors()
    for batch in chain.from_iterable(slices(b, 256) for b in batches):
        n, h1, h2, bands, sketches = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text)
            n.append(len(s))
            if not len(s):
                h1.append(0)
                h2.append(0)
                bands.append(None)
                sketches.append(None)
                continue
            with np.errstate(over="ignore"):
                h1.append(int(mix64(s + np.uint64(1)).sum().view(np.int64)))
                h2.append(int(np.bitwise_xor.reduce(mix64(s ^ np.uint64(0x2545F4914F6CDD1D))).view(np.int64)))
            m = minhash(s, a, b)
            bands.append(band_keys(m).view(np.int64))
            sketches.append(odd_sketch(m).view(np.int64))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n": pa.array(n, pa.int64()), "h1": pa.array(h1, pa.int64()), "h2": pa.array(h2, pa.int64()), "bands": pa.array(bands, longs), "sketch": pa.array(sketches, longs)})
    release_memory()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chain.from_iterable(slices(b, 256) for b in batches):
        yield pa.RecordBatch.from_pydict({"id": batch.column(0), "shingles": pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())})
    release_memory()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 x intersection >= percent x union, of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in chain.from_iterable(slices(b, 256) for b in batches):
        x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = [linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y, strict=True)]
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_pydict({"a": batch.column(0).filter(mask), "b": batch.column(1).filter(mask)})
    release_memory()


def block_links(comp: np.ndarray, bands: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, band: int, percent: int, same: bool) -> list[tuple[int, int]]:
    """Links that connect different components among ``left`` x ``right`` (row numbers).

    A pair that shares an earlier band is left to that band's bucket. Components that a link
    has connected are not compared again.
    """
    parent: dict[int, int] = {int(c): int(c) for c in np.unique(comp)}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    for i in left.tolist():
        other = right[comp[right] != comp[i]]
        if same:
            other = other[other > i]
        if not len(other):
            continue
        near = np.bitwise_count(sketch[other] ^ sketch[i]).sum(axis=1) <= MOST_BITS
        if band:
            near &= ~(bands[other, :band] == bands[i, :band]).any(axis=1)
        for j in other[near].tolist():
            mine, theirs = root(int(comp[i])), root(int(comp[j]))
            if mine != theirs and linked(sets[i], sets[j], percent):
                parent[max(mine, theirs)] = min(mine, theirs)
                out.append((i, j))
    return out


def _blocks(keys: tuple, table: pa.Table, percent: int) -> pa.Table:
    """One pair of blocks of one bucket: the spanning links across its components."""
    _, band, first, second = (k.as_py() for k in keys)
    own = table.column("block").to_numpy()
    longs = lambda name, width: np.array(table.column(name).combine_chunks().flatten(), np.int64).view(np.uint64).reshape(-1, width)
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    ids = table.column("id").to_numpy()
    left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
    found = block_links(table.column("comp").to_numpy(), longs("bands", BANDS), longs("sketch", 4), sets, left, right, band, percent, first == second)
    return pa.table({"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())})


def _near(keys: tuple, table: pa.Table) -> pa.Table:
    """One pair of piles of one bucket: the documents whose sketch comes near one of another component."""
    bucket, first, second = (k.as_py() for k in keys)
    own, comp, ids = (table.column(c).to_numpy() for c in ("block", "comp", "id"))
    sketch = np.array(table.column("sketch").combine_chunks().flatten(), np.int64).view(np.uint64).reshape(-1, 4)
    left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
    marked = np.zeros(len(ids), bool)
    for i in left.tolist():
        other = right[comp[right] != comp[i]]
        hits = other[np.bitwise_count(sketch[other] ^ sketch[i]).sum(axis=1) <= MOST_BITS]
        if len(hits):
            marked[i] = True
            marked[hits] = True
    found = ids[marked]
    return pa.table({"bucket": pa.array(np.full(len(found), bucket), pa.int64()), "id": pa.array(found, pa.int64())})


def components(edges: DataFrame, space: Workspace, tag: str, limit: int = 60) -> DataFrame:
    """``node`` and ``comp``, the smallest node reachable, for every node of ``edges`` (``a``, ``b``).

    Alternating large-star and small-star steps; each is two hash aggregations and a join on the
    node, and the edge table of a step is written to the shared folder. Nothing is collected but
    a count and a checksum.
    """
    state = F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    e = space.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{tag}-0")
    before = tuple(e.agg(*state).first())
    for step in range(1, limit + 1):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = space.save(moved.unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), f"{tag}-{step}")
        space.drop(f"{tag}-{step - 1}")
        after = tuple(e.agg(*state).first())
        if after == before:
            return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
        before = after
    raise RuntimeError("components did not settle")


def _distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)


def dealt_join(rows: DataFrame, table: DataFrame, on: list[str], most: int) -> DataFrame:
    """Left join to a table with a row for each key and ``n``, the rows of ``rows`` that have the key: keys of more than
    ``most`` rows, which are few, are broadcast, and their rows stay where they lie."""
    hot, rest = table.where(F.col("n") > most).drop("n"), table.where(F.col("n") <= most).drop("n")
    tagged = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), on, "left").where("__hot").drop("__hot")
    others = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, "left")
    return tagged.unionByName(others)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (smallest id of the document's group) and ``kept``
    (the document is that one), a row for each row of ``docs``."""
    space = Workspace(docs.sparkSession, "neardup")
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    features = space.save(source.mapInArrow(_features, _FEATURES), "features")
    real = features.where(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = real.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
    classes = space.save(classes, "classes")
    most = max(CROWD, classes.count() // SHARE)
    placed = classes.select("id", F.posexplode("bands").alias("band", "bucket"))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first")).where("size > 1")
    sizes = space.save(sizes.withColumn("n", F.col("size")), "sizes")
    crowd = space.save(dealt_join(placed, sizes, ["bucket"], most).where("size is not null"), "crowd")
    involved = crowd.select("id").distinct()
    sets = space.save(source.where(F.col("id").isNotNull()).join(involved, "id", "left_semi").mapInArrow(_sets, "id long, shingles binary").dropDuplicates(["id"]), "sets")
    release_executors(docs.sparkSession)  # sets are large rows to deal out: heaps grow most here
    sketches = classes.select("id", "sketch").dropDuplicates(["id"])
    label = None

    def labelled(df: DataFrame, name: str, out: str) -> DataFrame:
        """``out``: the component of the id in ``name``."""
        if label is None:
            return df.withColumn(out, F.col(name))
        known = label.select(F.col("node").alias("__node"), F.col("comp").alias("__comp"))
        return df.join(known, F.col(name) == F.col("__node"), "left").withColumn(out, F.coalesce("__comp", name)).drop("__node", "__comp")

    def by_bucket(rows: DataFrame, table: DataFrame) -> DataFrame:
        """``rows`` joined to a table with a row for each bucket; both have its ``size``. Few buckets are large."""
        large, small = F.col("size") > most, F.col("size") <= most
        return rows.where(large).join(F.broadcast(table.where(large)), ["bucket", "size"]).unionByName(rows.where(small).join(table.where(small), ["bucket", "size"]))

    def hub_join(pairs: DataFrame, values: DataFrame, hubs: DataFrame) -> DataFrame:
        """``pairs`` joined to ``values`` (a row for each ``a``); a hub's pairs are dealt out by salt. Few ids are hubs."""
        left = pairs.join(F.broadcast(hubs), "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), F.col("spread")), F.lit(0).cast("long"))).drop("spread")
        right = values.join(F.broadcast(hubs), "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("spread", F.lit(1).cast("long")) - 1))).drop("spread")
        return left.join(right, ["a", "salt"]).drop("salt")

    def confirm(pairs: DataFrame, tag: str) -> DataFrame:
        """The pairs (``a``: the one many are compared with) whose sketches and then full sets are alike."""
        pairs = space.save(pairs.distinct(), f"pairs-{tag}")
        hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("a", F.ceil(F.col("n") / F.lit(most)).alias("spread"))
        hubs = space.save(hubs, f"hubs-{tag}")
        with_b = pairs.join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
        both = hub_join(with_b, sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), hubs)
        likely = both.where(_distance(F.col("sa"), F.col("sb")) <= MOST_BITS).select("a", "b")
        with_b = likely.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        with_a = hub_join(with_b, sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), hubs)
        return with_a.select("a", "b", "x", "y").mapInArrow(lambda it: _confirmed(it, percent), "a long, b long")

    def settle(links: DataFrame, tag: str) -> DataFrame:
        """The components of all links so far: new links contract those that earlier rounds gave."""
        found = space.save(links, f"links-{tag}")
        if label is None:
            return space.save(components(found, space, f"stars-{tag}"), f"labels-{tag}")
        across = labelled(labelled(found, "a", "x"), "b", "y").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        across = space.save(across.distinct(), f"across-{tag}")
        if across.isEmpty():
            return label
        more = space.save(components(across, space, f"stars-{tag}"), f"more-{tag}")
        moved = label.join(more.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        return space.save(moved.unionByName(more.join(label.select("node"), "node", "left_anti")), f"labels-{tag}")

    def blocked(rows: DataFrame, blocks: DataFrame) -> DataFrame:
        """Each row once for each block pair of its bucket that its own block is in; ``blocks``: of each bucket, how many."""
        rows = by_bucket(rows, blocks).withColumn("block", F.pmod(F.xxhash64("comp", "id"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return rows.withColumns({"one": F.least("block", "mate"), "two": F.greatest("block", "mate")})

    label = settle(confirm(crowd.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")), "first"), "first")

    larger = space.save(labelled(crowd.where("size > 2").drop("first"), "id", "comp"), "larger")
    split = larger.groupBy("bucket").agg(F.first("size").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min_by(F.struct("id", "comp"), F.xxhash64("id", "bucket")).alias("pick"))
    pairs = by_bucket(larger, split.where("low <> high").select("bucket", "size", "pick"))
    label = settle(confirm(pairs.where("comp <> pick.comp").select(F.col("pick.id").alias("a"), F.col("id").alias("b")), "pick"), "pick")

    rest = labelled(larger.drop("comp"), "id", "comp")
    split = rest.groupBy("bucket").agg(F.first("size").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    rest = space.save(by_bucket(rest, split.select("bucket", "size")), "rest")
    members = rest.groupBy("bucket", "size").agg(F.count(F.lit(1)).alias("m"))
    piles = F.least(F.ceil(F.col("m") / F.lit(PILE)), F.greatest(F.lit(PILES), F.ceil(F.col("m") / F.lit(MOST_PILE))))
    sieve = blocked(rest.join(sketches, "id"), space.save(members.select("bucket", "size", piles.cast("int").alias("blocks")), "piles"))
    sieve = sieve.select("bucket", "one", "two", "block", "id", "comp", "sketch").groupBy("bucket", "one", "two")
    near = space.save(sieve.applyInArrow(_near, "bucket long, id long").distinct(), "near")
    known = classes.select("id", "n", "bands", "sketch").dropDuplicates(["id"])
    slim = space.save(rest.join(near, ["bucket", "id"], "left_semi").join(known, "id"), "slim")
    weights = slim.groupBy("bucket", "size").agg(F.ceil(F.sum("n") / F.lit(float(BLOCK))).cast("int").alias("blocks"))
    spread = blocked(slim, space.save(weights, "weights")).join(sets, "id").groupBy("bucket", "band", "one", "two")
    label = settle(spread.applyInArrow(lambda k, t: _blocks(k, t, percent), "a long, b long"), "rest")

    reps = labelled(classes.select("h1", "h2", "id", F.col("copies").alias("n")), "id", "comp").drop("id")
    placed = features.where(F.col("id").isNotNull() & (F.col("n") > 0)).select("id", "h1", "h2")
    rows = max(CROWD, features.count() // SHARE)
    named = dealt_join(placed, space.save(reps, "reps"), ["h1", "h2"], rows).groupBy("id").agg(F.min("comp").alias("comp"), F.count(F.lit(1)).alias("n"))
    named = space.save(named, "named")
    out = dealt_join(features.select("id", F.col("n").alias("n_shingles")), named, ["id"], rows)
    group = F.coalesce("comp", "id")
    out = out.select(F.col("id").alias(key), "n_shingles", group.alias("component_id"), F.coalesce(F.col("id") == group, F.lit(True)).alias("kept"))
    space.keep("features", "named")
    release_executors(docs.sparkSession)
    return out
