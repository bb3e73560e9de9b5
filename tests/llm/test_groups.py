"""Near duplicates, sharding, mixing and top-k against brute force."""

import collections
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pipeweave.llm import common, mixing, neardup, sharding, topk
from pipeweave.llm.common import Workspace


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        shared = collections.Counter(j for g in s for j in holders[g])
        for g in s:
            holders[g].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def found_groups(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}


def test_groups_equal_brute_force(spark, docs):
    assert found_groups(docs) == brute_groups([(r.doc_id, r.text) for r in docs.collect()])


def test_a_crowd_of_half_alike_copies(spark):
    """Copies of one text with a few words changed: most pairs lie just below the limit, some above."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(500):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i * 3 + 1, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_groups(df) == brute_groups(rows)


def test_small_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 2000)
    test_a_crowd_of_half_alike_copies(spark)


def test_odd_sketch_estimates_high_similarity():
    a, b = neardup.sample_factors()
    rng = np.random.default_rng(1)
    for share in (1.0, 0.95, 0.9, 0.8):
        errors = []
        for _ in range(30):
            both = rng.integers(1, 2**63, 1000, dtype=np.uint64)
            own = int(1000 * (1 - share) / (1 + share))
            x = np.unique(np.r_[both[own:], rng.integers(1, 2**63, own, dtype=np.uint64)])
            y = np.unique(np.r_[both[own:], rng.integers(1, 2**63, own, dtype=np.uint64)])
            real = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            errors.append(neardup.similarity(neardup.odd_sketch(neardup.minhash(x, a, b)), neardup.odd_sketch(neardup.minhash(y, a, b))) - real)
        assert abs(np.mean(errors)) < 0.03


def test_near_duplicate_odd_rows(spark, odd, none):
    out = neardup.near_duplicates(odd).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert len(out) == 10 and len(by[6]) == 2
    assert all(by[i][0].n_shingles == 0 and by[i][0].kept for i in (1, 2, 3))
    assert by[7][0].component_id == 6 and not by[7][0].kept and by[None][0].kept
    assert neardup.near_duplicates(none).count() == 0


def check_shards(out, n, shards=16):
    sizes = {r.shard: r.c for r in out.groupBy("shard").agg(F.count(F.lit(1)).alias("c")).collect()}
    assert sum(sizes.values()) == n and max(sizes.values(), default=0) - min([sizes.get(s, 0) for s in range(shards)]) <= 1
    gaps = out.groupBy("shard").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count_distinct("slot").alias("d"), F.count(F.lit(1)).alias("c")).where("a <> 0 or b <> c - 1 or d <> c")
    assert gaps.count() == 0


def test_near_duplicates_collect_the_executors_memory(spark, docs, monkeypatch):
    """Heaps are collected once the shingle sets are dealt out, and once more at the end (here the driver's, as it has the tasks)."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(common, "RELEASE_S", 3600.0)
    monkeypatch.setattr(common, "_released", [time.monotonic()])
    before = full()
    found = neardup.near_duplicates(docs.limit(20))
    assert full() >= before + 2 and found.count() == 20


def test_shards_are_even_and_keep_groups(spark, docs):
    out = sharding.balanced_shards(docs).persist()
    check_shards(out, 1000)
    groups = out.where("group_id is not null").groupBy("group_id").agg(F.count_distinct("shard").alias("s"))
    assert groups.where("s = 1").count() >= 0.9 * groups.count()


def test_shards_do_not_depend_on_partitions(spark, docs):
    few = docs.unionByName(docs.limit(40)).unionByName(docs.limit(40).withColumn("text", F.concat("text", F.lit(" more"))))
    shape = lambda n: sorted(tuple(r) for r in sharding.balanced_shards(few.repartition(n)).select("doc_id", "size", "text_crc32", "shard", "slot").collect())
    assert shape(1) == shape(7) == shape(50)


def test_sizes_and_checksums(spark, docs):
    got = {r.doc_id: (r.size, r.text_crc32) for r in sharding.balanced_shards(docs).collect()}
    assert got == {r.doc_id: (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()}


def brute_moves(rows, quotas, rounds, draw):
    """``rows``: u to (g, shard). The moves of each round as the module's text says, one row at a time."""
    rows = dict(rows)
    for r in range(1, rounds + 1):
        counts = collections.Counter(rows.values())
        home = {g: max((c, draw["home", g, s], s) for (h, s), c in counts.items() if h == g)[2] for g, _ in counts}
        load = collections.Counter(s for _, s in rows.values())
        leaving, demand = collections.Counter(), collections.Counter()
        for (g, s), c in counts.items():
            if s != home[g]:
                leaving[s] += c
                demand[home[g]] += c
        chance = {s: max(0, quotas[s] - load[s] + 0.5 * leaving[s]) / max(1, demand[s]) for s in range(len(quotas))}
        for u, (g, s) in list(rows.items()):
            p = chance[home[g]]
            if s != home[g] and (p >= 1 or draw[g, r] < 0.5 * p or draw[u, r] < 0.5 * p):
                rows[u] = (g, home[g])
    return rows


def test_moves_equal_brute_force(spark):
    rows = [(u, 1000 + u % 7 + (0 if u < 150 else 50), u * 31 % 4, u % sharding.SALT) for u in range(300)]
    df = spark.createDataFrame(rows, "u long, g long, shard int, salt int")
    quotas, rounds = [60, 60, 59, 59], 3
    draw = {}
    turns = spark.range(1, rounds + 1).select(F.col("id").cast("int").alias("r"))
    for c in ("u", "g"):
        draw |= {(x.k, x.r): x.d for x in df.select(F.col(c).alias("k")).distinct().join(turns).select("k", "r", sharding._draw(F.col("k"), F.col("r")).alias("d")).collect()}
    shards = spark.range(4).select(F.col("id").cast("int").alias("s"))
    draw |= {("home", x.g, x.s): x.d for x in df.select("g").distinct().join(shards).select("g", "s", F.xxhash64("g", "s").alias("d")).collect()}
    space = Workspace(spark, "test")
    got = {x.u: (x.g, x["shard"]) for x in sharding.propagated(space.save(df, "linked-0"), quotas, rounds, space).collect()}
    assert got == brute_moves({u: (g, s) for u, g, s, _ in rows}, quotas, rounds, draw)
    assert got != {u: (g, s) for u, g, s, _ in rows}


def test_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LOT", 30)
    df = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") < 300, "same").otherwise(F.col("id").cast("string")).alias("text"))
    out = sharding.balanced_shards(df).persist()
    check_shards(out, 500)
    assert out.where(f"text_crc32 = {zlib.crc32(b'same')}").count() == 300


def test_a_group_larger_than_a_shard(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    out = sharding.balanced_shards(df).persist()
    check_shards(out, 3000)
    assert out.where("group_id is not null").select("shard").distinct().count() <= 16


def test_a_large_group_has_buckets_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PER_BUCKET", 20)
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    check_shards(sharding.balanced_shards(df), 2000)


def test_shard_odd_rows(spark, odd, none):
    out = sharding.balanced_shards(odd)
    check_shards(out, 10)
    r = {x.doc_id: x for x in out.collect()}
    assert r[1].size == 1 and r[1].text_crc32 == 0 and r[2].size == 1
    assert sharding.balanced_shards(none).count() == 0


def brute_rake(cells, temperature, rounds):
    axes = [sorted({c[a] for c in cells}, key=str) for a in range(3)]
    total = sum(cells.values())
    goal = []
    for a in range(3):
        raw = {v: sum(n for c, n in cells.items() if c[a] == v) ** temperature for v in axes[a]}
        goal.append({v: x / sum(raw.values()) for v, x in raw.items()})
    w = {c: n / total for c, n in cells.items()}
    for _ in range(rounds):
        for a in range(3):
            s = collections.Counter()
            for c, x in w.items():
                s[c[a]] += x
            w = {c: x * goal[a][c[a]] / s[c[a]] for c, x in w.items()}
    return w, goal


def test_raking_meets_its_targets(spark, docs):
    out = mixing.mix(docs).persist()
    cells = {(r.source, r.lang, r.topic): r.n for r in out.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n")).collect() if r.n}
    got = {(r.source, r.lang, r.topic): r.w for r in out.groupBy("source", "lang", "topic").agg(F.first("weight").alias("w")).collect()}
    want, _ = brute_rake(cells, 0.5, 60)
    assert max(abs(got[c] - want[c]) for c in cells) < 1e-4
    spent, total = out.agg(F.sum(F.col("n_tokens") * F.col("probability")), F.sum("n_tokens")).first()
    assert abs(spent / total - 0.5) < 1e-3
    p = out.agg(F.min("probability"), F.max("probability")).first()
    assert 0 < p[0] and p[1] <= 1


def test_named_targets(spark, docs):
    want = {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}
    goal = spark.createDataFrame(list(want.items()), "value string, share double")
    out = mixing.mix(docs, targets={"lang": goal}, temperature=1.0)
    cells = out.where("n_tokens > 0").groupBy("source", "lang", "topic").agg(F.first("weight").alias("w"))
    assert all(abs(r.w - want[r.lang]) < 1e-4 for r in cells.groupBy("lang").agg(F.sum("w").alias("w")).collect())


def test_mixing_odd_rows(spark, odd, none):
    out = mixing.mix(odd.drop("topic"))
    assert out.count() == 10 and out.where("probability is null or selected is null and doc_id is not null").count() == 0
    assert mixing.mix(none).count() == 0


def test_shares_and_draws_by_hand(spark, docs):
    out = mixing.mix(docs, budget=0.3).collect()
    cells = collections.defaultdict(lambda: [0, 0.0, set()])
    for r in out:
        c = cells[r.source, r.lang, r.topic]
        c[0] += r.n_tokens
        c[1] = r.weight
        c[2].add(r.probability)
    total = sum(c[0] for c in cells.values())
    assert total == sum(len((r.text or "").encode().split()) for r in docs.collect())
    low, high = 0.0, 1e9
    for _ in range(200):  # the level at which clipped shares spend the budget
        level = (low + high) / 2
        spent = sum(min(1.0, level * w / n) * n for n, w, _ in cells.values() if n)
        low, high = (level, high) if spent < 0.3 * total else (low, level)
    for n, w, p in cells.values():
        assert len(p) == 1 and abs(p.pop() - (min(1.0, level * w / n) if n else 1.0)) < 1e-3
    draw = {r.doc_id: r.d for r in docs.select("doc_id", (F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 50)) / F.lit(float(1 << 50))).alias("d")).collect()}
    assert all(r.selected == (draw[r.doc_id] < r.probability) for r in out)


def test_topics_are_the_nearest_centres(spark, docs):
    rng = random.Random(2)
    rows = [[rng.random() for _ in mixing.FEATURES] for _ in range(200)]
    df = spark.createDataFrame([(1, *r) for r in rows], "n long, " + ", ".join(f"{f} double" for f in mixing.FEATURES))
    centres = [tuple(rng.random() for _ in mixing.FEATURES) for _ in range(5)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    got = [r.i for r in df.select("*", mixing.nearest(centres).alias("i")).collect()]
    assert got == [min(range(5), key=lambda i: (gap(r, centres[i]), i)) for r in rows]
    learned = mixing.learned_centres(df, 4, 3)
    centres = mixing.first_centres(sorted(map(tuple, rows)), 4)
    assert len(learned) == 4 and sum(min(gap(r, c) for c in learned) for r in rows) < sum(min(gap(r, c) for c in centres) for r in rows)
    shape = lambda n: {r.doc_id: (r.topic, r.selected) for r in mixing.mix(docs.repartition(n)).collect()}
    assert shape(1) == shape(9)


def test_targets_out_of_reach_are_told(spark, docs):
    goal = spark.createDataFrame([("en", 0.5), ("tlh", 0.5)], "value string, share double")
    with pytest.warns(UserWarning, match="raking left"):
        out = mixing.mix(docs.withColumn("__w", F.lit(1)), targets={"lang": goal})
    assert out.first().gap > 0.4 and "__w" in out.columns


def test_planted_pairs_just_above_the_limit(spark):
    """Recall where it is hardest: 3,000 pairs of similarity 0.75 to 0.80, and as many just below that must not link."""
    rng = random.Random(11)
    rows, linked_pairs = [], 0
    for k in range(3000):
        n = rng.randint(40, 120)
        words = [f"w{k}x{rng.randrange(10**6)}" for _ in range(n)]
        other = list(words)
        # one changed word inside takes 5 shingles of either set
        for at in rng.sample(range(6, n - 6), rng.choice((1, 2))):
            other[at] = f"y{k}x{at}"
        cut = rng.randint(0, n // 8)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other[cut:]))]
    near = {}
    for (a, s), (b, t) in zip(rows[::2], rows[1::2], strict=True):
        x, y = s.split(), t.split()
        p, q = ({tuple(z[i : i + 5]) for i in range(len(z) - 4)} for z in (x, y))
        near[a, b] = len(p & q) / len(p | q)
    hard = {pair for pair, j in near.items() if 0.75 <= j < 0.80}
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(hard) > 200 and sum(0.70 <= j < 0.75 for j in near.values()) > 200
    missed = [pair for pair in hard if got[pair[1]] != got[pair[0]]]
    assert len(missed) <= 0.002 * len(hard)
    assert all((got[b] == got[a]) == (100 * j >= 75) for (a, b), j in near.items() if j < 0.75 or j >= 0.80)


def brute_top(rows, k, every):
    v = {i: [math.floor(y * 256) for y in x] for i, x in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = {}
    for q in (i for i in v if i % every == 0):
        ranked = sorted(((-dot(v[q], v[c]), c) for c in v if c != q))[:k]
        out |= {(q, r + 1): (c, -s) for r, (s, c) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("kind", ["normal", "ties", "lengths", "1e5", "1e7", "1e9", "mixed", "negative ids"])
def test_top_k_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "HEAD", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12))
    if kind == "ties":
        x = np.round(x)
        x[200:300] = x[0]
    if kind == "lengths":
        x *= rng.lognormal(0, 2, size=(400, 1))
    if kind.startswith("1e"):  # products stay within 64 bits
        ask = np.arange(400) % 20 == 0
        x[~ask] *= float(kind)
        x[ask] *= min(float(kind), 1e11 / float(kind))
    if kind == "mixed":
        x *= 10.0 ** rng.integers(-2, 6, size=(400, 1))
    rows = [(i - (190 if kind == "negative ids" else 0), [float(np.float32(y)) for y in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df.where("vec_id % 20 = 0"), df, 5).collect()}
    assert got == brute_top(rows, 5, 20)


def test_top_k_sends_no_query_block_to_the_driver(spark, monkeypatch):
    """Whatever the broadcast threshold, blocks are neither broadcast nor copied per lane; each meets all in several parts too."""
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "HEAD", 16)
    monkeypatch.setattr(topk, "ASKED", 1000, raising=False)
    plans, save = {}, topk.Workspace.save

    def watched(self, df, tag):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return save(self, df, tag)

    monkeypatch.setattr(topk.Workspace, "save", watched)
    x = np.random.default_rng(5).normal(size=(400, 12))
    rows = [(i, [float(np.float32(y)) for y in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df.where("vec_id % 10 = 0"), df, 5).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute_top(rows, 5, 10)
    assert "Broadcast" not in plans["found"] and "Generate" not in plans["found"]


def test_pruning_saves_products():
    rng = np.random.default_rng(3)
    c = (rng.normal(size=(2000, 16)) * np.r_[np.full(3, 60.0), np.full(13, 2.0)]).astype(np.int64)
    turn = topk.Rotation(np.linalg.eigh((c.T @ c).astype(float))[1][:, ::-1][:, :3])
    found = topk.search_block(topk.Block.of(np.arange(20), c[:20], turn), topk.Block.of(np.arange(2000), c, turn), 5, np.full(20, -np.inf))
    assert found.exact < 0.5 * 20 * 2000


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [2.0]), (6, []), (7, [1.0, 2.0]), (0, [1.0, 2.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rank": F.lit(1), "score": F.lit(2), "id": F.lit(3), "v": F.lit(4)})
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df.where("vec_id = 0"), df, 5).orderBy("rank").collect()]
    assert got == [(0, 1, 7, 327680), (0, 2, 5, 131072), (0, 3, 6, 0)]
    assert topk.top_k(df.where("false"), df.where("false"), 5).count() == 0
    assert topk.top_k(df.where("vec_id = 7"), df.where("vec_id is null"), 5).count() == 0


def test_top_k_repeated_rows(spark):
    """A repeated query id asks once, by its least vector; each repeated candidate row counts."""
    rows = [(1, [2.0]), (1, [2.0]), (1, [3.0]), (2, [5.0]), (2, [5.0]), (3, [4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df.where("vec_id = 1"), df, 5).orderBy("rank").collect()]
    assert got == [(1, 2, 2 * 5 * 65536), (2, 2, 2 * 5 * 65536), (3, 3, 2 * 4 * 65536)]


def test_top_k_of_large_components(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [70000.0]), (3, [80000.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(df.where("vec_id = 1"), df, 5).orderBy("rank").collect()]
    assert got == [(3, 5242880000), (2, 4587520000)]
    for big in ([1e30], [1e15, 1e15]):  # a component, a product beyond 64 bits
        rows = spark.createDataFrame([(1, big), (2, big)], "vec_id long, embedding array<double>")
        with pytest.raises(PySparkException, match="beyond 2\\^62|does not fit 64 bits"):
            topk.top_k(rows.where("vec_id = 1"), rows, 5).collect()
