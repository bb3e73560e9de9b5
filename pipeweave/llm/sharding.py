"""Balanced label propagation: linked documents share a shard, shards stay exactly even.

Documents with equal texts are linked. Every document starts in a hashed shard. In each round a
linked group's members that are outside the shard holding most of the group propose to move
there; a shard admits proposals up to its quota of linked documents, by a hashed draw whose
probability is the free room over the demand. At the end every shard ranks its documents (linked
groups first) and what lies above the quota moves to the free slots of the others, so counts
differ by one at most and slots have no gaps. Law: ``rows``.

Everything is DataFrame expressions. Moves are decided on (group, shard) counts, at most
``shards`` rows a group, however large the group; ranks come from a prefix sum over buckets, so
no task orders a whole shard; a large group has the more buckets the more members it has.

Rows are known by key, text and a number among equal rows (counted, not ranked by a window), and every draw
is a hash of these: a result does not depend on files, partitions or the order of rows.

Defined results: null text has size 1, crc 0 and no links; rows with equal keys are placed
each on their own, a null key like any other; an empty table gives an empty result; only key and
text are read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipeweave.llm.common import Workspace

SALT, SPREAD = 8, 16
#: Rows that one bucket of a shard holds on average, for ranking.
PER_BUCKET = 50_000
#: Equal rows that one row of the counted table is turned back into in one task.
LOT = 50_000


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) from the hash of the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / F.lit(float(1 << 40))


def numbered(docs: DataFrame, key: str, text: str, space: Workspace) -> DataFrame:
    """``id``, ``size``, ``crc``, ``h`` (hash of the text) and ``u``, a hash of these and of the row's number among equal rows."""
    t = F.col(text)
    base = docs.select(
        F.col(key).alias("id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(t, "UTF-8")), F.lit(0)).cast("long").alias("crc"),
        F.when(t.isNotNull(), F.xxhash64(t)).alias("h"),
    )
    same = ["id", "size", "crc", "h"]
    counted = space.save(base.groupBy(*same).agg(F.count(F.lit(1)).alias("c")), "counted")
    few = counted.where(F.col("c") <= LOT).withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
    lots = counted.where(F.col("c") > LOT).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / LOT)))).repartition("id", "lot")
    first = F.col("lot") * LOT
    many = lots.withColumn("n", F.explode(F.sequence(first, F.least(first + LOT, F.col("c")) - 1)))
    return few.select(*same, "n").unionByName(many.select(*same, "n")).select(*same, F.xxhash64(*same, "n").alias("u"))


def quotas_of(n: int, shards: int) -> list[int]:
    return [n // shards + (1 if s < n % shards else 0) for s in range(shards)]


def propagated(linked: DataFrame, quotas: list[int], rounds: int, space: Workspace) -> DataFrame:
    """The rows of linked groups (``u``, ``g``, ``shard`` and others) with the shards that ``rounds`` of moves give them."""
    quota = F.element_at(F.array(*[F.lit(q).cast("long") for q in quotas]), F.col("shard") + 1)
    for r in range(1, rounds + 1):
        counts = linked.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("c"))
        home = counts.groupBy("g").agg(F.max_by("shard", F.struct("c", F.xxhash64("g", "shard"))).alias("home"))
        plan = space.save(counts.join(home, "g"), f"plan-{r}")
        load = plan.groupBy("shard").agg(F.sum("c").alias("load"), F.sum(F.when(F.col("shard") != F.col("home"), F.col("c")).otherwise(0)).alias("leaving"))
        demand = plan.where("shard <> home").groupBy(F.col("home").alias("shard")).agg(F.sum("c").alias("demand"))
        # a row for each shard: what it may admit
        admit = load.join(demand, "shard", "full").select(
            F.col("shard").alias("home"),
            (F.greatest(F.lit(0), quota - F.coalesce("load", F.lit(0)) + F.lit(0.5) * F.coalesce("leaving", F.lit(0))) / F.greatest(F.lit(1), F.coalesce("demand", F.lit(0)))).alias("chance"),
        )
        moves = plan.where("shard <> home").join(F.broadcast(admit), "home").select("g", "shard", "home", "chance")
        moves = moves.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        # where room is short, half of it goes to whole groups and half to single documents
        lucky = (F.col("chance") >= 1) | (_draw(F.col("g"), F.lit(r)) < F.col("chance") * F.lit(0.5)) | (_draw(F.col("u"), F.lit(r)) < F.col("chance") * F.lit(0.5))
        moved = linked.join(moves, ["g", "shard", "salt"], "left")
        to = F.when(F.col("home").isNotNull() & lucky, F.col("home")).otherwise(F.col("shard"))
        linked = space.save(moved.select(*[to.alias(c) if c == "shard" else F.col(c) for c in linked.columns]), f"linked-{r}")
        space.drop(f"linked-{r - 1}", f"plan-{r}")
    return linked


def balanced_shards(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = 16, rounds: int = 4) -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``, and
    ``group_id`` (null: not linked)."""
    space = Workspace(docs.sparkSession, "sharding")
    base = space.save(numbered(docs, key, text, space), "base")
    n = base.count()
    quotas = quotas_of(n, shards)
    groups = base.where(F.col("h").isNotNull()).groupBy("h", "size", "crc").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    groups = groups.withColumn("g", F.xxhash64("h", "size", "crc")).withColumn("spread", F.greatest(F.lit(SPREAD), F.ceil(F.col("members") / F.lit(PER_BUCKET))).cast("long"))
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salt = F.pmod(F.xxhash64("u", F.lit("salt")), F.lit(SALT)).cast("int")
    start = F.pmod(F.xxhash64("u", F.lit("start")), F.lit(shards)).cast("int")
    state = base.withColumn("salt", salt).join(salted, ["h", "size", "crc", "salt"], "left")
    state = space.save(state.select("id", "u", "size", "crc", "salt", "g", "spread", start.alias("shard")), "state")
    linked = propagated(space.save(state.where("g is not null"), "linked-0"), quotas, rounds, space)
    placed = state.where("g is null").unionByName(linked).drop("salt")
    # linked groups first; a group's members lie in ``spread`` buckets side by side, of PER_BUCKET rows at most on average
    buckets = max(1, n // shards // PER_BUCKET) * 16
    lead = F.when(F.col("g").isNotNull(), F.pmod(F.xxhash64("g"), F.lit(buckets))).otherwise(F.lit(buckets))
    part = F.pmod(F.xxhash64("u", F.lit("part")), F.coalesce("spread", F.lit(buckets * SPREAD)))
    placed = space.save(placed.withColumns({"bucket": lead.cast("long"), "part": part.cast("long")}).drop("spread"), "placed")
    place = ["shard", "bucket", "part"]
    counts = space.save(placed.groupBy(place).agg(F.count(F.lit(1)).alias("c")), "places")
    upto = Window.partitionBy("shard").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(upto), F.lit(0))).select(*place, "before")
    within = Window.partitionBy(place).orderBy("g", "u", "id")
    ranked = placed.withColumn("r", F.row_number().over(within) - 1).join(before, place)
    ranked = ranked.withColumn("rank", F.col("before") + F.col("r")).drop("before", "r")
    loads = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("c").alias("n")).collect()}
    space.keep("placed", "places")
    over, holes, at_over, at_hole = [], [], 0, 0
    for s in range(shards):
        load = loads.get(s, 0)
        over.append(at_over)
        at_over += max(0, load - quotas[s])
        if load < quotas[s]:
            holes.append((at_hole, s, load))
            at_hole += quotas[s] - load
    quota, first = (F.element_at(F.array(*[F.lit(x).cast("long") for x in xs]), F.col("shard") + 1) for xs in (quotas, over))
    spare = F.when(F.col("rank") >= quota, first + F.col("rank") - quota)
    to, slot = F.col("shard"), F.col("rank")
    for start_at, s, load in holes:
        to = F.when(F.col("spare") >= start_at, F.lit(s)).otherwise(to)
        slot = F.when(F.col("spare") >= start_at, F.col("spare") - start_at + load).otherwise(slot)
    out = ranked.withColumn("spare", spare)
    return out.select(
        F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), to.cast("int").alias("shard"),
        slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("g").alias("group_id"),
    )
