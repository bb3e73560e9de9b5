"""Queries over the driver's tables, an operator or a few each, with SQL that says the same.

Every query reads whole tables. Floats are rounded on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pipeweave.functions import graph, numbers, search, text, times, values
from pipeweave.operators import aggregates as A
from pipeweave.operators import joins
from pipeweave.operators.group import modes, quantiles_by_rank, semi_structured_key
from pipeweave.operators.order import ascending, compare, descending
from pipeweave.operators.rel import Rel
from pipeweave.plans import flow
from pipeweave.plans.contract import Contract
from pipeweave.plans.registered import ORACLE, QUERIES, Query, dec, query
from pipeweave.sources import files
from pipeweave.streaming import live

# ---- rows


@query("""SELECT l_orderkey, l_returnflag, round(l_extendedprice * (1 - l_discount), 4) AS net,
 CASE WHEN l_quantity >= 30 THEN 'bulk' ELSE 'retail' END AS size FROM lineitem WHERE l_quantity > 10 AND l_shipdate < TIMESTAMP '1998-01-01'""")
def q_filter_map(t):
    rows = Rel(t.lineitem).filter((F.col("l_quantity") > 10) & (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")))
    net = dec(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rows.map("l_orderkey", "l_returnflag", net=net, size=values.given(F.lit("bulk"), F.col("l_quantity") >= 30, F.lit("retail"))).df


@query("""SELECT l_returnflag, l_linestatus, count(*) AS size, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 4) AS price,
 round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ALL""")
def q_group_agg(t):
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return Rel(t.lineitem).group("l_returnflag", "l_linestatus").map(size=A.size(), quantity=dec(A.sum(F.col("l_quantity")), 2), price=dec(A.average(F.col("l_extendedprice"))), revenue=dec(A.sum(revenue), 2))


@query("SELECT o_custkey, count(*) AS size, round(max(o_totalprice), 2) AS best FROM orders GROUP BY o_custkey HAVING count(*) > 10")
def q_having(t):
    return Rel(t.orders).group("o_custkey").filter(A.size() > 10).map(size=A.size(), best=dec(A.maximum(F.col("o_totalprice")), 2))


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def q_sort_take_drop(t):
    by = ascending("o_orderpriority").then(descending("o_totalprice"))
    return Rel.of(t.orders, "o_orderkey").sort(by).take(30).drop(10).map("o_orderkey", "o_totalprice", "o_orderpriority").df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def q_top_k(t):
    return Rel.of(t.orders, "o_orderkey").top_k(25, "o_totalprice").map("o_orderkey", "o_totalprice").df


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def q_top_k_per_group(t):
    ranked = Rel.of(t.orders, "o_orderkey").over(["o_custkey"], [descending("o_totalprice")], n=lambda w: w.row_number())
    return ranked.filter("n <= 2").map("o_custkey", "o_orderkey").df


@query("SELECT DISTINCT user_id, event_type FROM events")
def q_distinct_set(t):
    return Rel(t.events).map("user_id", "event_type").distinct().df


@query("SELECT row_number() OVER (ORDER BY first_id) - 1 AS place, user_id FROM (SELECT user_id, min(event_id) AS first_id FROM events GROUP BY user_id)")
def q_distinct_first(t):
    return Rel.of(t.events, "event_id").map("user_id").distinct().enumerate("place").df


@query("SELECT event_id - (SELECT min(event_id) FROM events) AS place, event_id FROM events")
def q_enumerate(t):
    return Rel.of(t.events, "event_id").map("event_id").enumerate("place").df


@query("""WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM events), o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey DESC) AS n FROM orders)
 SELECT e.event_id, o.o_orderkey FROM e JOIN o ON e.n = o.n""")
def q_zip(t):
    pairs = Rel.of(t.events, "event_id").map("event_id").zip(Rel.of(t.orders, descending("o_orderkey")).map("o_orderkey"))
    return pairs.map(event_id=F.col("first.event_id"), o_orderkey=F.col("second.o_orderkey")).df


@query("SELECT event_id FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE value > 95)")
def q_take_while(t):
    return Rel.of(t.events, "event_id").take_while(F.col("value") <= 95).map("event_id").df


@query("SELECT event_id FROM events WHERE event_id >= (SELECT min(event_id) FROM events WHERE value > 95)")
def q_drop_while(t):
    return Rel.of(t.events, "event_id").drop_while(F.col("value") <= 95).map("event_id").df


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 7")
def q_reverse(t):
    return Rel.of(t.events, "event_id").reverse().take(7).map("event_id").df


@query("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () AS c FROM orders)
 SELECT o_orderkey FROM o WHERE n BETWEEN 100 AND 119 OR n BETWEEN c - 5 AND c - 3 OR n = 7 OR n = c - 1""")
def q_slice_at(t):
    s = Rel.of(t.orders, "o_orderkey").map("o_orderkey")
    return s.slice(100, 120).concat(s.slice(-5, -2), s.at(7), s.at(-1)).collection().df


@query("SELECT min(n) AS position FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS n, value FROM events) WHERE value > 90")
def q_position(t):
    return Rel.of(t.events, "event_id").position(F.col("value") > 90)


@query("""WITH o AS (SELECT o_orderkey AS k, lead(o_orderkey, 1) OVER w AS b, lead(o_orderkey, 2) OVER w AS c FROM orders WINDOW w AS (ORDER BY o_orderkey))
 SELECT k AS first, k + b + c AS total FROM o WHERE c IS NOT NULL""")
def q_window_runs(t):
    runs = Rel.of(t.orders, "o_orderkey").windows(3, F.col("o_orderkey"))
    return runs.map(first=F.get("items", F.lit(0)), total=F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x)).df


@query("SELECT CAST(min(o_orderkey) AS BIGINT) AS first, count(*) AS n FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS b FROM orders) GROUP BY b")
def q_collect_batches(t):
    return Rel.of(t.orders, "o_orderkey").collect(64, F.col("o_orderkey")).map(first=F.get("items", F.lit(0)), n=F.size("items").cast("bigint")).df


@query("SELECT o_orderkey FROM orders")
def q_emit(t):
    return Rel.of(t.orders, "o_orderkey").collect(3, F.col("o_orderkey")).emit("items").map(o_orderkey=F.col("items")).df


# ---- joins and sets



def _orders(t):
    return Rel.of(t.orders, "o_orderkey").map("o_orderkey", "o_custkey", "o_totalprice")


def _cust(t):
    return Rel.of(t.customer, "c_custkey").map("c_custkey", "c_nationkey", "c_acctbal")


KEYS = {"left_on": ["c_custkey"], "right_on": ["o_custkey"]}


def _into():
    return {"c_custkey": F.col("l.c_custkey"), "o_orderkey": F.col("r.o_orderkey")}


def _large(_, r):
    return r("o_totalprice") > 300000


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def q_join_inner(t):
    return joins.join(_cust(t), _orders(t), **KEYS, into=_into()).df


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def q_join_left(t):
    return joins.left_join(_cust(t), _orders(t), **KEYS, on=_large, into=_into()).df


@query("SELECT c_custkey, o_orderkey FROM customer RIGHT JOIN orders ON c_custkey = o_custkey AND c_acctbal > 5000")
def q_join_right(t):
    return joins.right_join(_cust(t), _orders(t), **KEYS, on=lambda l, _: l("c_acctbal") > 5000, into=_into()).df


@query("SELECT c_custkey, o_orderkey FROM customer FULL JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 AND c_acctbal > 5000")
def q_join_full(t):
    return joins.full_join(_cust(t), _orders(t), **KEYS, on=lambda l, r: _large(l, r) & (l("c_acctbal") > 5000), into=_into()).df


@query("SELECT s_suppkey, n_name FROM supplier CROSS JOIN nation")
def q_join_cross(t):
    return joins.cross_join(Rel.of(t.supplier, "s_suppkey"), Rel.of(t.nation, "n_nationkey"), into={"s_suppkey": F.col("l.s_suppkey"), "n_name": F.col("r.n_name")}).df


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 300000 AND o_custkey = c_custkey)")
def q_join_semi(t):
    return joins.semi_join(_cust(t), _orders(t), **KEYS, on=_large).map("c_custkey").df


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 300000 AND o_custkey = c_custkey)")
def q_join_anti(t):
    return joins.anti_join(_cust(t), _orders(t), **KEYS, on=_large).map("c_custkey").df


@query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON n_regionkey < 2 AND s_nationkey < n_nationkey")
def q_join_theta(t):
    on = lambda l, r: (r("n_regionkey") < 2) & (l("s_nationkey") < r("n_nationkey"))
    return joins.join(Rel.of(t.supplier, "s_suppkey"), Rel.of(t.nation, "n_nationkey"), on=on, into={"s_suppkey": F.col("l.s_suppkey"), "n_nationkey": F.col("r.n_nationkey")}).df


@query("SELECT o_orderkey, count(*) AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY GROUP BY o_orderkey")
def q_join_key_and_on(t):
    lines = Rel(t.lineitem.select("l_orderkey", "l_shipdate"))
    orders = Rel(t.orders.select("o_orderkey", "o_orderdate"))
    found = joins.join(lines, orders, ["l_orderkey"], ["o_orderkey"], lambda l, r: l("l_shipdate") > times.plus(r("o_orderdate"), times.duration(days=60)), {"o_orderkey": F.col("r.o_orderkey")})
    return found.group("o_orderkey").map(late=A.size())


@query("""SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 WHERE o_orderpriority LIKE '1%' GROUP BY ALL""")
def q_star_revenue(t):
    lines = t.lineitem.select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    orders = t.orders.where(F.col("o_orderpriority").startswith("1")).select("o_orderkey", "o_custkey")
    wide = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    wide = wide.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return Rel(wide).group("r_name", "n_name").map(revenue=dec(A.sum(F.col("net")), 2))


_CELLS = "SELECT c_nationkey AS nation, CAST(floor(c_acctbal / 500) AS BIGINT) AS cell FROM customer %s SELECT s_nationkey, CAST(floor(s_acctbal / 500) AS BIGINT) FROM supplier"


def _cells(df, p):
    """Each nation with its balances in steps of 500."""
    return Rel(df).map(nation=F.col(f"{p}_nationkey"), cell=F.floor(F.col(f"{p}_acctbal") / 500))


@query(_CELLS % "UNION")
def q_union(t):
    return _cells(t.customer, "c").union(_cells(t.supplier, "s")).df


@query(_CELLS % "UNION ALL")
def q_concat(t):
    return _cells(t.customer, "c").concat(_cells(t.supplier, "s")).df


@query(_CELLS % "INTERSECT")
def q_intersection(t):
    return _cells(t.customer, "c").intersection(_cells(t.supplier, "s")).df


@query(_CELLS % "EXCEPT")
def q_difference(t):
    return _cells(t.customer, "c").difference(_cells(t.supplier, "s")).df


@query("""WITH a AS (SELECT o_orderkey AS x, 2 * (row_number() OVER (ORDER BY o_orderkey) - 1) AS n FROM orders), b AS (SELECT event_id AS x, 2 * (row_number() OVER (ORDER BY event_id) - 1) + 1 AS n FROM events)
 SELECT x, row_number() OVER (ORDER BY n) - 1 AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def q_merge_streams(t):
    return Rel.of(t.orders, "o_orderkey").map(x=F.col("o_orderkey")).merge(Rel.of(t.events, "event_id").map(x=F.col("event_id"))).enumerate("place").df


# ---- reductions


@query("SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def q_count_by(t):
    return Rel(t.events).count_by(event_type=F.col("event_type"))


@query("SELECT p_size - p_size % 10 AS bucket, count(*) AS count FROM part GROUP BY 1")
def q_histogram(t):
    return Rel(t.part).histogram(F.col("p_size"), 10)


@query("SELECT floor(value / 12.5) * 12.5 AS bucket, count(*) AS count FROM events GROUP BY 1")
def q_histogram_float(t):
    return Rel(t.events).histogram(F.col("value"), 12.5)


@query("""SELECT l_orderkey, CAST(product(CASE WHEN l_linenumber = 0 THEN 1 ELSE l_linenumber END) AS BIGINT) AS exact, round(product(1 + l_tax), 6) AS float FROM lineitem GROUP BY l_orderkey HAVING count(*) < 12""")
def q_product(t):
    rows = Rel(t.lineitem).group("l_orderkey").filter(A.size() < 12)
    return rows.map(exact=A.product(F.col("l_linenumber"), exact=True), float=dec(A.product(1 + F.col("l_tax")), 6))


@query("""SELECT user_id, bool_or(value > 99) AS any, bool_and(value > 1) AS all, CAST(count_if(event_type = 'click') AS BIGINT) AS clicks, bool_or(event_type = 'purchase') AS has FROM events GROUP BY user_id""")
def q_any_all(t):
    return Rel(t.events).group("user_id").map(any=A.any(F.col("value") > 99), all=A.all(F.col("value") > 1), clicks=A.count(F.col("event_type"), "click"), has=A.contains(F.col("event_type"), "purchase"))


@query("SELECT o_custkey, arg_min(o_orderkey, {'a': o_totalprice, 'b': o_orderkey}) AS least, arg_max(o_orderkey, {'a': o_totalprice, 'b': -o_orderkey}) AS most FROM orders GROUP BY o_custkey")
def q_min_max_by(t):
    k = F.col("o_orderkey")
    return Rel(t.orders).group("o_custkey").map(least=A.min_by(k, F.col("o_totalprice"), k), most=A.max_by(k, F.col("o_totalprice"), k))


@query("SELECT list_reduce(list(c_custkey ORDER BY c_custkey), lambda a, x: (a * 31 + x) % 100003, 7) AS reduced FROM customer")
def q_reduce_fold(t):
    return Rel.of(t.customer, "c_custkey").reduce(F.col("c_custkey"), F.lit(7).cast("bigint"), lambda a, x: (a * 31 + x) % 100003)


@query("SELECT CAST(0 AS BIGINT) AS sum, 1.0 AS product, CAST(NULL AS DOUBLE) AS average, CAST(0 AS BIGINT) AS size, true AS empty, false AS any, true AS all")
def q_empty_identities(t):
    none = Rel(t.orders).filter("o_orderkey < 0")
    return none.agg(sum=A.sum(F.col("o_custkey")), product=A.product(F.col("o_totalprice")), average=A.average(F.col("o_totalprice")), size=A.size(), empty=A.is_empty(), any=A.any(F.col("o_custkey") > 0), all=A.all(F.col("o_custkey") > 0))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS exact, true AS close FROM orders GROUP BY o_orderpriority")
def q_approx_distinct(t):
    """The estimate lies within three standard errors (1.6 % each) of the exact number."""
    exact = F.count_distinct("o_custkey")
    return Rel(t.orders).group("o_orderpriority").map(exact=exact, close=F.abs(A.approx_distinct(F.col("o_custkey")) - exact) <= F.greatest(F.lit(2), exact * 0.05))


@query("""SELECT l_returnflag, round(avg(l_quantity), 4) AS mean, round(var_samp(l_quantity), 4) AS variance, round(stddev_samp(l_quantity), 4) AS stdev,
 round(var_pop(l_quantity), 4) AS pvariance, round(stddev_pop(l_quantity), 4) AS pstdev FROM lineitem GROUP BY l_returnflag""")
def q_stats_spread(t):
    q = F.col("l_quantity")
    return Rel(t.lineitem).group("l_returnflag").map(mean=dec(A.mean(q)), variance=dec(A.sample_variance(q)), stdev=dec(A.stdev(q)), pvariance=dec(A.pvariance(q)), pstdev=dec(A.pstdev(q)))


@query("""SELECT l_returnflag, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90,
 list_transform(quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]), lambda x: round(x, 4))[1] AS q1 FROM lineitem GROUP BY l_returnflag""")
def q_stats_quantiles(t):
    out = quantiles_by_rank(t.lineitem, ["l_returnflag"], "l_extendedprice", [0.5, 0.9, 0.25])
    return out.select("l_returnflag", *[dec(F.get("quantiles", F.lit(i))).alias(n) for i, n in enumerate(("median", "p90", "q1"))])


@query("SELECT user_id, arg_min(event_type, {'a': -n, 'b': event_type}) AS mode FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def q_stats_mode(t):
    return modes(t.events, ["user_id"], "event_type")


@query("""SELECT l_returnflag, round(covar_samp(l_quantity, l_extendedprice), 3) AS cov, round(corr(l_quantity, l_extendedprice), 6) AS cor,
 CAST(NULL AS DOUBLE) AS flat FROM lineitem GROUP BY l_returnflag""")
def q_stats_cov_corr(t):
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    return Rel(t.lineitem).group("l_returnflag").map(cov=dec(A.covariance(x, y), 3), cor=dec(A.correlation(x, y), 6), flat=A.correlation(x * 0, y))


@query("""SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey)[1] AS first, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY o_custkey""")
def q_group_items(t):
    out = Rel.of(t.orders, "o_orderkey").map("o_custkey", "o_orderkey").group("o_custkey").items()
    keys = F.transform("items", lambda r: r.o_orderkey)
    return out.select("o_custkey", F.get(keys, F.lit(0)).alias("first"), F.aggregate(keys, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS states, list_sort(list(DISTINCT o_orderkey % 3))[1] AS least FROM orders GROUP BY o_custkey")
def q_concat_union_all(t):
    k = F.col("o_orderkey")
    return Rel(t.orders).group("o_custkey").map(states=F.array_join(A.concat_all(F.array("o_orderstatus"), k), ""), least=F.get(A.union_all(F.array(k % 3)), F.lit(0)))


# ---- windows


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS n,
 rank() OVER w AS rank, dense_rank() OVER w AS dense FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def q_over_ranks(t):
    out = Rel.of(t.orders, "o_orderkey").over(["o_custkey"], ["o_orderpriority"], n=lambda w: w.row_number(), rank=lambda w: w.rank(), dense=lambda w: w.dense_rank())
    return out.map("o_orderkey", *[F.col(c).cast("bigint").alias(c) for c in ("n", "rank", "dense")]).df


@query("SELECT event_id, lag(event_type) OVER w AS before, lead(event_id, 2) OVER w AS later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def q_over_lag_lead(t):
    return Rel.of(t.events, "event_id").over(["user_id"], ["ts"], before=lambda w: w.lag(F.col("event_type")), later=lambda w: w.lead(F.col("event_id"), 2)).map("event_id", "before", "later").df


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS balance FROM events")
def q_over_running(t):
    return Rel.of(t.events, "event_id").over(["user_id"], ["ts"], balance=lambda w: dec(w.running().sum(F.col("value")))).map("event_id", "balance").df


@query("""SELECT event_id, round(avg(value) OVER w, 4) AS around, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""")
def q_over_rows(t):
    return Rel.of(t.events, "event_id").over(["user_id"], ["ts"], around=lambda w: dec(w.rows(2, 1).average(F.col("value"))), n=lambda w: w.rows(2, 1).size()).map("event_id", "around", "n").df


@query("""SELECT event_id, max(value) OVER (PARTITION BY user_id) AS best, first_value(event_id) OVER w AS first, last_value(event_id) OVER w AS last FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def q_over_whole(t):
    e = F.col("event_id")
    return Rel.of(t.events, "event_id").over(["user_id"], ["ts"], best=lambda w: w.whole().max(F.col("value")), first=lambda w: w.first(e), last=lambda w: w.last(e)).map("event_id", "best", "first", "last").df


# ---- idioms


@query("SELECT event_id, user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def q_dedup_latest(t):
    return flow.deduplicate(t.events.select("event_id", "user_id", "value"), ["user_id"], "event_id")


@query("""SELECT k, v FROM (SELECT user_id AS k, event_id AS v FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, event_id FROM events WHERE event_type = 'click') QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC) = 1""")
def q_merge_upsert(t):
    part = lambda kind: t.events.where(F.col("event_type") == kind).select(F.col("user_id").alias("k"), F.col("event_id").alias("v"))
    return flow.upsert(part("view"), part("click"), ["k"], "v")


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'purchase' AND value < 50)")
def q_incremental_watermark(t):
    return flow.newer(t.events, "ts", t.events.where("event_type = 'purchase' and value < 50")).select("event_id")


@query("SELECT event_id, CASE WHEN value > 50 THEN value * 2 ELSE value END AS value FROM events WHERE event_type <> 'view' UNION ALL SELECT -1, 0.0")
def q_mutations(t):
    rows = files.delete(t.events.select("event_id", "event_type", "value"), F.col("event_type") == "view")
    rows = files.update(rows, F.col("value") > 50, value=F.col("value") * 2).select("event_id", "value")
    return files.insert(rows, t.spark.createDataFrame([(-1, 0.0)], "event_id long, value double"))


# ---- scalars


@query(r"""SELECT word, count(*) AS count FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word""")
def q_word_count(t):
    return Rel(t.documents).map("text").flat_map(text.words(text.lower(F.col("text"))), "word").count_by(word=F.col("word"))


@query("""SELECT c_custkey, upper(c_name) AS up, length(c_name) AS size, reverse(c_name) AS back, c_name[1:3] AS head, replace(c_name, 'Customer', 'C') AS short,
 starts_with(c_name, 'Cust') AS starts, contains(c_name, '99') AS has, nullif(instr(c_name, '0'), 0) - 1 AS zero, lpad(CAST(c_custkey AS VARCHAR), 12, '*') AS padded FROM customer""")
def q_string_basic(t):
    n = F.col("c_name")
    return t.customer.select("c_custkey", text.upper(n).alias("up"), text.size(n).alias("size"), text.reverse(n).alias("back"), text.slice(n, 0, 3).alias("head"), text.replace_all(n, "Customer", "C").alias("short"), text.starts_with(n, "Cust").alias("starts"), text.contains(n, "99").alias("has"), text.index_of(n, "0").alias("zero"), text.pad_left(F.col("c_custkey").cast("string"), 12, "*").alias("padded"))


@query(r"""SELECT doc_id, len(string_split(text, 'the')) - 1 AS n_the, trim(text, E' \t\n\r') = text AS trimmed, upper(text[1]) || text[2:] AS cap,
 substr(text, length(text) - 4) AS tail, len(string_split(text, E'\n')) - CASE WHEN text LIKE E'%\n' THEN 1 ELSE 0 END AS n_lines FROM documents""")
def q_string_text(t):
    s = F.col("text")
    return t.documents.select("doc_id", text.occurrences(s, "the").alias("n_the"), (text.trim(s) == s).alias("trimmed"), text.capitalize(s).alias("cap"), text.slice(s, -5).alias("tail"), F.size(text.lines(s)).cast("bigint").alias("n_lines"))


@query("""SELECT p_partkey, string_split(p_type, ' ')[1] AS first, CASE WHEN starts_with(p_brand, 'Brand') THEN substr(p_brand, 6) END AS rest, p_name || '-' || p_size AS made,
 TRY_CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS number, repeat('ab', 2) AS twice, lower(p_brand) = lower('BRAND#11') AS same FROM part""")
def q_string_parts(t):
    b = F.col("p_brand")
    return t.part.select("p_partkey", F.get(text.split(F.col("p_type"), " "), F.lit(0)).alias("first"), text.strip_prefix(b, "Brand").alias("rest"), text.fmt("{}-{}", F.col("p_name"), F.col("p_size")).alias("made"), text.to_int(F.regexp_extract(b, "([0-9]+)", 1)).alias("number"), text.repeat(F.lit("ab"), 2).alias("twice"), text.equals_ignore_case(b, "BRAND#11").alias("same"))


@query(r"""SELECT page_id, regexp_matches(url, '^https?://[^/]+/en') AS english, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, len(regexp_extract_all(html, '<a ')) AS links,
 regexp_replace(url, '[0-9]+', 'N', 'g') AS shape, regexp_replace(url, '[0-9]+', 'N') AS first, len(regexp_split_to_array(url, '[/?&]')) AS parts FROM pages""")
def q_regex(t):
    u, h = F.col("url"), F.col("html")
    title = F.nullif(F.get(text.captures(h, "<title>([^<]*)</title>", 1), F.lit(1)), F.lit(""))
    return t.pages.select("page_id", text.is_match(u, "^https?://[^/]+/en").alias("english"), title.alias("title"), F.size(text.find_all(h, "<a ")).cast("bigint").alias("links"), text.regex_replace_all(u, "[0-9]+", "N").alias("shape"), text.regex_replace_first(u, "[0-9]+", "N").alias("first"), F.size(text.regex_split(u, "[/?&]")).cast("bigint").alias("parts"))


@query("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, isodow(o_orderdate) AS wd, dayofyear(o_orderdate) AS yd, weekofyear(o_orderdate) AS wk, isoyear(o_orderdate) AS iy, hour(o_orderdate) AS h FROM orders""")
def q_time_parts(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", times.year(d).alias("y"), times.month(d).alias("m"), times.day(d).alias("d"), times.weekday(d).alias("wd"), times.day_of_year(d).alias("yd"), times.iso_week(d).alias("wk"), times.iso_year(d).alias("iy"), times.hour(d).alias("h"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS count FROM events GROUP BY ALL")
def q_time_truncate(t):
    return Rel(t.events).count_by(hour=times.truncate(F.col("ts"), "HOUR").cast("timestamp_ntz"), event_type=F.col("event_type"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) + 10 AS later, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS month, datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days,
 o_orderdate + INTERVAL 36 HOUR AS plus, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS shown, CAST(date_trunc('week', o_orderdate) AS DATE) AS week FROM orders""")
def q_time_arith(t):
    d, day = F.col("o_orderdate"), F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", times.add_days(day, 10).alias("later"), times.add_months(day, 1).alias("month"), times.days_since(day, F.lit("1992-01-01").cast("date")).alias("days"), times.plus(d, times.duration(hours=36)).alias("plus"), times.fmt(d, "%Y/%m/%d %H:%M").alias("shown"), times.truncate_date(day, "WEEK").alias("week"))


@query("""SELECT event_id, strftime(CAST(ts AS TIMESTAMP) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS berlin, epoch_us(ts) // 1000000 AS seconds, epoch_us(ts) // 1000 AS millis FROM events""")
def q_time_zone(t):
    i = F.col("ts").cast("timestamp")
    return t.events.select("event_id", F.date_format(times.at(i, "Europe/Berlin"), "yyyy-MM-dd HH:mm:ss").alias("berlin"), times.unix_seconds(i).alias("seconds"), times.unix_millis(i).alias("millis"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, abs(l_quantity - 25) AS off, CAST(sign(l_quantity - 25) AS BIGINT) AS side, floor(l_extendedprice) AS low, ceil(l_extendedprice) AS high, round(sqrt(l_extendedprice), 6) AS root,
 round(ln(l_quantity), 6) AS log, l_partkey // 7 AS q, l_partkey % 7 AS r, CAST(gcd(l_partkey, l_suppkey) AS BIGINT) AS g, CAST(pow(l_linenumber, 3) AS BIGINT) AS cube FROM lineitem""")
def q_math(t):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", numbers.abs(q - 25).alias("off"), numbers.sign(q - 25).alias("side"), numbers.floor(p).alias("low"), numbers.ceil(p).alias("high"), F.round(numbers.sqrt(p), 6).alias("root"), F.round(numbers.ln(q), 6).alias("log"), numbers.int_div("l_partkey", "7").alias("q"), numbers.rem(F.col("l_partkey"), F.lit(7)).alias("r"), numbers.gcd(F.col("l_partkey"), F.col("l_suppkey")).alias("g"), numbers.int_pow(F.col("l_linenumber"), 3).alias("cube"))


@query("""SELECT c_custkey, lower(hex(encode(c_name))) AS hex, base64(encode(c_name)) AS b64, md5(c_name) AS md5, sha1(c_name) AS sha1, sha256(c_name) AS sha256, octet_length(encode(c_name)) AS size, c_name AS back FROM customer""")
def q_encoding_digest(t):
    n = F.col("c_name")
    return t.customer.select("c_custkey", text.encode(n, "hex").alias("hex"), text.encode(n, "base64").alias("b64"), *[text.digest(n, h).alias(h) for h in ("md5", "sha1", "sha256")], text.bytes_size(F.encode(n, "UTF-8")).alias("size"), text.decode(text.encode(n, "base64url"), "base64url").alias("back"))


@query("""SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS count, CAST(0 AS BIGINT) AS missing FROM events GROUP BY 1""")
def q_data_props(t):
    rows = Rel(t.events).extend(d=values.data(F.col("props")))
    rows = rows.extend(k=values.field(F.col("d"), "k", "bigint"), none=values.unwrap_or(values.field(F.col("d"), "nothing", "bigint"), F.lit(0)))
    return rows.group("k").map(count=A.size(), missing=A.sum(F.col("none")))


@query("SELECT count(DISTINCT props) AS keys, count(*) AS rows FROM events")
def q_data_key(t):
    rows = t.events.withColumn("d", values.data(F.col("props"))).withColumn("key", semi_structured_key("d"))
    return rows.agg(F.count_distinct("key").alias("keys"), F.count(F.lit(1)).alias("rows"))


@query("""SELECT doc_id, quality IS NOT NULL AS labelled, coalesce(quality, -1) AS quality, CASE WHEN quality IS NOT NULL THEN quality + 10 END AS more, quality IS NOT DISTINCT FROM toxic AS same
 FROM documents LEFT JOIN labels USING (doc_id)""")
def q_option(t):
    q = F.col("quality")
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return rows.select("doc_id", values.is_some(q).alias("labelled"), values.unwrap_or(q, F.lit(-1)).alias("quality"), values.and_then(q, lambda x: x + 10).alias("more"), values.equal(q, F.col("toxic")).alias("same"))


def _contract():
    return Contract("event", {"event_id": "bigint", "value": "double"}).require("value is small", F.col("value") < 80).require("not a view", F.col("event_type") != "view")


@query("""SELECT event_id, value < 80 AND event_type <> 'view' AS ok, CASE WHEN value >= 80 THEN 1 ELSE 0 END + CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS broken FROM events""")
def q_result_validate(t):
    rows = Rel.of(t.events, "event_id").map("event_id", "event_type", "value")
    out = _contract().validate(rows).raw
    r = F.col("result")
    return out.select(F.coalesce("result.ok.event_id", "result.err.value.event_id").alias("event_id"), values.is_ok(r).alias("ok"), F.coalesce(F.size("result.err.violations"), F.lit(0)).alias("broken"))


@query("""SELECT 'good' AS side, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value < 80 AND event_type <> 'view' UNION ALL SELECT 'bad', count(*), round(sum(value), 2) FROM events WHERE NOT (value < 80 AND event_type <> 'view')""")
def q_quarantine(t):
    good, bad = flow.quarantine(_contract().validate(Rel(t.events).map("event_id", "event_type", "value")))
    count = lambda side, path, rel: rel.agg(n=A.size(), total=dec(A.sum(F.col(path)), 2)).select(F.lit(side).alias("side"), "n", "total")
    return count("good", "result.value", good).unionByName(count("bad", "result.value.value", bad))


@query("""SELECT event_type, count(*) AS n, (SELECT count(*) FROM events) AS all FROM events GROUP BY event_type""")
def q_fork_tee(t):
    main, total = flow.tee(Rel(t.events), lambda r: r.agg(all=A.size()))
    branches = flow.fork(main, by=lambda r: r.group("event_type").map(n=A.size()), unread=lambda r: r.map("event_id"))
    return branches["by"].join(F.broadcast(total))


@query("""SELECT user_id, CAST(count_if(event_type = 'click') AS BIGINT) AS clicks, count(DISTINCT event_type) AS kinds, CAST(99 AS BIGINT) AS more FROM events GROUP BY user_id""")
def q_maps(t):
    counts = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = counts.groupBy("user_id").agg(A.count_map(F.col("n"), F.col("event_type")).alias("m"))
    c = F.col("m")
    bigger = values.with_key(c, "extra", F.lit(99).cast("bigint"))
    return m.select("user_id", values.unwrap_or(values.get(c, "click"), F.lit(0).cast("bigint")).alias("clicks"), F.size(values.entries(values.without(bigger, "extra"))).cast("bigint").alias("kinds"), values.get(bigger, "extra").alias("more"))


@query("""SELECT p_partkey, list_extract([p_size, p_partkey, 7], -1) AS last, CAST(len(range(0, p_size)) AS INTEGER) AS n, CAST(list_sum([p_size, p_partkey, 7]) AS BIGINT) AS total FROM part""")
def q_lists(t):
    xs = F.array(F.col("p_size").cast("bigint"), F.col("p_partkey"), F.lit(7).cast("bigint"))
    return t.part.select("p_partkey", values.list_at(xs, -1).alias("last"), F.size(F.filter(values.list_range(0, 100), lambda x: x < F.col("p_size"))).alias("n"), values.list_fold(xs, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal < 1000 THEN 'low' ELSE 'fine' END AS state, CAST(sign(s_nationkey - 12) AS INTEGER) AS side, least(s_nationkey, 5) AS low FROM supplier")
def q_match(t):
    b, n = F.col("s_acctbal"), F.col("s_nationkey")
    return t.supplier.select("s_suppkey", values.match((b < 0, F.lit("debt")), (b < 1000, F.lit("low")), otherwise=F.lit("fine")).alias("state"), compare(n, F.lit(12)).alias("side"), values.least(n, F.lit(5)).alias("low"))


# ---- graph, search, streams


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT e FROM q) AS DOUBLE[])) AS s FROM embeddings) WHERE s > 0 ORDER BY s DESC, vec_id LIMIT 20""")
def q_vector_rank(t):
    want = t.embeddings.where("vec_id = 0").first()["embedding"]
    return search.semantic(t.embeddings, list(want), "vec_id", "embedding", 20).select("vec_id", F.round("score", 6).alias("score"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS word FROM documents
 UNION ALL SELECT -1, unnest(regexp_extract_all(lower((SELECT text FROM benchmark ORDER BY item_id LIMIT 1)), '[\p{L}\p{N}]+'))),
h AS (SELECT word, list_reduce(list_transform(range(1, octet_length(encode(word)) + 1), lambda i: CAST(('0x' || hex(encode(word))[2 * i - 1:2 * i]) AS HUGEINT)), lambda a, x: (xor(a, x) * 1099511628211) % 18446744073709551616, CAST(14695981039346656037 AS HUGEINT)) % 256 AS b FROM (SELECT DISTINCT word FROM w)),
c AS (SELECT doc_id, b, 1 + ln(count(*)) AS x FROM w JOIN h USING (word) GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM c GROUP BY doc_id)
SELECT d.doc_id, round(sum(d.x * q.x) / (any_value(n.norm) * (SELECT norm FROM n WHERE doc_id = -1)), 4) AS score FROM c d JOIN c q ON q.doc_id = -1 AND d.b = q.b JOIN n ON n.doc_id = d.doc_id WHERE d.doc_id >= 0 GROUP BY d.doc_id HAVING sum(d.x * q.x) > 0""")
def q_lexical_rank(t):
    want = t.benchmark.orderBy("item_id").first()["text"]
    return search.lexical(t.documents, want, "doc_id", "text").select("doc_id", dec(F.col("score")).alias("score"))


_EDGES = "SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer"


@query(f"""WITH e AS ({_EDGES}) SELECT name, min(depth) AS depth FROM (SELECT 'r1' AS name, 0 AS depth UNION ALL SELECT target, 1 FROM e WHERE source = 'r1'
 UNION ALL SELECT b.target, 2 FROM e a JOIN e b ON a.target = b.source WHERE a.source = 'r1') GROUP BY name""")
def q_graph_expand(t):
    a = t.nation.select(F.concat(F.lit("r"), "n_regionkey").alias("source"), F.concat(F.lit("n"), "n_nationkey").alias("target"))
    b = t.customer.select(F.concat(F.lit("n"), "c_nationkey").alias("source"), F.concat(F.lit("c"), "c_custkey").alias("target"))
    seed = t.spark.createDataFrame([("r1",)], "name string")
    return graph.expand(seed, a.unionByName(b), 2, "up").select("name", "depth")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value > 20 GROUP BY event_type")
def q_stream_sink(t):
    out = t.folder("stream")
    rows = live.tap(t.spark, f"{t.sf_dir}/events.parquet*", t.events.schema).filter("value > 20").map("event_id", "event_type", "value")
    live.sink_parquet(rows, f"{out}/rows", f"{out}/log").awaitTermination()
    return Rel(t.spark.read.parquet(f"{out}/rows")).group("event_type").map(n=A.size(), total=dec(A.sum(F.col("value")), 2))


@query("SELECT o_orderkey FROM orders ORDER BY md5('3:' || o_orderkey) LIMIT 100")
def q_sample(t):
    return Rel(t.orders).map("o_orderkey").sample(100, seed=3, key=F.col("o_orderkey")).df


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5('5:' || o_orderkey)) - 1 AS place FROM orders")
def q_shuffle(t):
    return Rel(t.orders).map("o_orderkey").shuffle(5, F.col("o_orderkey")).enumerate("place").df


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (ORDER BY md5('9:{\"event_id\":' || event_id || ',\"user_id\":' || user_id || '}')) = 1")
def q_choice(t):
    return Rel(t.events).map("event_id", "user_id").choice(9).df


def queries() -> dict[str, Query]:
    from pipeweave.plans import roundtrips, scalars  # noqa: F401 - they add theirs

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLE)
