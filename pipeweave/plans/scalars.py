"""Queries of scalar functions, each over a whole table, several functions a query."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from pipeweave.functions import graph, numbers, text, times, udf, values
from pipeweave.operators import aggregates as A
from pipeweave.operators.group import quantiles_by_rank
from pipeweave.operators.rel import Rel
from pipeweave.plans.registered import dec, query

# ---- strings


@query("""SELECT c_custkey, ltrim('  ' || c_name) AS a, rtrim(c_name || '  ') AS b, c_name LIKE '%7' AS ends, length(c_name) - strpos(reverse(c_name), '0') AS last, CASE WHEN c_name LIKE '%1' THEN c_name[1:-2] END AS stripped,
 CASE WHEN starts_with(c_name, 'Cust') THEN c_name[5:] ELSE c_name END AS headless, CASE WHEN c_name LIKE '%0' THEN c_name[1:-2] ELSE c_name END AS tailless, rpad(c_mktsegment, 12, '.') AS padded, c_mktsegment[1:4] AS short FROM customer""")
def q_string_ends(t):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    return t.customer.select("c_custkey", text.trim_start(F.concat(F.lit("  "), n)).alias("a"), text.trim_end(F.concat(n, F.lit("  "))).alias("b"), text.ends_with(n, "7").alias("ends"), text.last_index_of(n, "0").alias("last"), text.strip_suffix(n, "1").alias("stripped"), text.trim_prefix(n, "Cust").alias("headless"), text.trim_suffix(n, "0").alias("tailless"), text.pad_right(m, 12, ".").alias("padded"), text.truncate(m, 4).alias("short"))


@query("""SELECT p_partkey, p_name[3:3] AS third, p_name[-1:] AS final, nullif(p_name[9:9], '') AS ninth, len(string_split(p_type, '')) AS n_chars, list_reverse(string_split(p_type, '')) AS chars, unicode(p_brand[1:1]) AS code, chr(97 + CAST(p_size % 26 AS INTEGER)) AS letter,
 array_to_string(string_split(p_type, ' '), '/') AS joined, CASE WHEN strpos(p_type, ' ') > 0 THEN p_type[1:strpos(p_type, ' ') - 1] || '_' || p_type[strpos(p_type, ' ') + 1:] ELSE p_type END AS first_only, CAST(p_size AS VARCHAR) AS shown FROM part""")
def q_string_chars(t):
    n, k, b = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    return t.part.select("p_partkey", text.at(n, 2).alias("third"), text.at(n, -1).alias("final"), text.char_at(n, 8).alias("ninth"), F.size(text.chars(k)).cast("bigint").alias("n_chars"), F.reverse(text.chars(k)).alias("chars"), text.ord(text.at(b, 0)).alias("code"), text.chr(F.col("p_size") % 26 + 97).alias("letter"), text.join(text.split(k, " "), "/").alias("joined"), text.replace_first(k, " ", "_").alias("first_only"), text.to_text(F.col("p_size")).alias("shown"))


@query("""WITH x AS (SELECT o_orderkey, CAST(round(o_totalprice, 2) AS VARCHAR) AS s, o_orderkey % 3 AS m FROM orders)
 SELECT o_orderkey, CAST(s AS DOUBLE) AS f, CAST(CASE WHEN m = 0 THEN NULL ELSE s END AS DECIMAL(18, 2)) AS d, CASE WHEN m = 0 THEN true WHEN m = 1 THEN false END AS b, m = 1 AS blank, m = 2 AS empty, CASE WHEN m = 0 THEN NULL ELSE o_orderkey END AS whole FROM x""")
def q_string_numbers(t):
    m = F.col("o_orderkey") % 3
    s = F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string")
    flag = values.match((m == 0, F.lit(" true ")), (m == 1, F.lit("false")), otherwise=F.lit("yes"))
    blank, empty = values.given(F.lit(" \t"), m == 1, F.lit("x")), values.given(F.lit(""), m == 2, F.lit(" "))
    number = values.given(F.lit("12x"), m == 0, F.col("o_orderkey").cast("string"))
    return t.orders.select("o_orderkey", text.to_float(s).alias("f"), text.to_decimal(values.given(F.lit("?"), m == 0, s), 18, 2).alias("d"), text.to_bool(flag).alias("b"), text.is_blank(blank).alias("blank"), text.is_empty(empty).alias("empty"), text.to_int(number).alias("whole"))


@query("""SELECT doc_id, octet_length(encode(text)) AS size, unicode(text[1:1]) AS head, length(text) AS n, lpad(text[1:5], 6, '*') || '**' AS centred, hex(encode(text[1:2])) AS hex FROM documents WHERE length(text) >= 5""")
def q_string_bytes(t):
    s = F.col("text")
    rows = t.documents.where(text.size(s) >= 5)
    two = text.bytes(text.truncate(s, 2))
    return rows.select("doc_id", text.bytes_size(F.encode(s, "UTF-8")).alias("size"), text.ord(text.at(s, 0)).alias("head"), text.size(s).alias("n"), text.center(text.truncate(s, 5), 8, "*").alias("centred"), F.array_join(F.transform(two, lambda b: F.lpad(F.hex(b), 2, "0")), "").alias("hex"))


@query(r"""SELECT page_id, nullif(regexp_extract(url, '[0-9]+'), '') AS number, octet_length(encode(coalesce(html, ''))) AS n, coalesce(url, '')[1:7] AS head, CAST(('0x' || substr(hex(encode(url)), 9, 2)) AS BIGINT) AS fifth, replace(replace(replace(url, ':', '%3A'), '/', '%2F'), '?', '%3F') AS part, url AS back FROM pages""")
def q_regex_bytes(t):
    u = F.col("url")
    raw = text.to_bytes(text.encode(u, "base64url"), "base64url")
    part = text.regex_replace_all(text.regex_replace_all(text.regex_replace_all(u, ":", "%3A"), "/", "%2F"), r"\?", "%3F")
    return t.pages.select("page_id", text.find(u, "[0-9]+").alias("number"), text.bytes_size(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("n"), text.bytes_to_text(text.bytes_slice(raw, 0, 7)).alias("head"), text.bytes_at(raw, 4).alias("fifth"), part.alias("part"), text.decode(text.encode(u, "percent"), "percent").alias("back"))


@query("""SELECT event_id, sha256(props) AS print, props AS canonical, sha256(concat('{"a":', event_id, '}')) AS made FROM events""")
def q_fingerprint(t):
    d = values.data(F.col("props"))
    made = values.data(F.concat(F.lit('{ "a" : '), F.col("event_id").cast("string"), F.lit(" }")))
    plain = lambda c: F.replace(c, F.lit(":"), F.lit(": "))  # noqa: E731 - the table writes a space there
    return t.events.select("event_id", F.sha2(plain(text.canonical(d)), 256).alias("print"), plain(text.canonical(d)).alias("canonical"), text.fingerprint(made).alias("made"))


# ---- numbers


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(pow(l_quantity, 1.5), 4) AS power, round(exp(l_discount), 6) AS grown, round(log10(l_quantity), 6) AS digits, round(sin(l_quantity), 6) AS s, round(cos(l_quantity), 6) AS c, round(tan(l_discount), 6) AS g,
 CAST(l_quantity AS BIGINT) AS whole, CAST(l_linenumber AS DOUBLE) AS real, CAST(round(l_quantity, 2) AS DECIMAL(18, 2)) AS exact, round(l_quantity / 4) AS quarter, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS back FROM lineitem""")
def q_math_functions(t):
    q, d = F.col("l_quantity"), F.col("l_discount")
    out = {"power": dec(numbers.pow(q, 1.5)), "grown": dec(numbers.exp(d), 6), "digits": dec(numbers.log10(q), 6), "s": dec(numbers.sin(q), 6), "c": dec(numbers.cos(q), 6), "g": dec(numbers.tan(d), 6)}
    out |= {"whole": numbers.int(q), "real": numbers.float(F.col("l_linenumber")), "exact": numbers.decimal(F.round(q, 2), 18, 2), "quarter": numbers.round(q / 4), "back": numbers.float(numbers.int(q))}
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *[c.alias(n) for n, c in out.items()])


@query("""SELECT o_orderkey % 7 AS k, count(*) AS n, true AS inside, true AS unit, true AS even, count(*) AS ids FROM orders GROUP BY 1""")
def q_random_numbers(t):
    """Draws by key: within their bounds, spread evenly, and ids that never repeat."""
    k = F.col("o_orderkey")
    i, f = numbers.random_int(1, 6, k, 5), numbers.random_float(k, 5)
    rows = t.orders.select((k % 7).alias("k"), i.alias("i"), f.alias("f"), numbers.uuid().alias("u"))
    spread = F.abs(F.avg("f") - 0.5) < 6 / F.sqrt(12.0 * F.count(F.lit(1)))
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("i") >= 1) & (F.col("i") <= 6)).alias("inside"), F.bool_and((F.col("f") >= 0) & (F.col("f") < 1)).alias("unit"), spread.alias("even"), F.count_distinct("u").alias("ids"))


# ---- time


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderdate AS dt, epoch_us(o_orderdate) AS us, CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE) AS parsed, o_orderdate AS clock, epoch_us(o_orderdate) AS instant, CAST(NULL AS DATE) AS bad FROM orders""")
def q_time_parse(t):
    c = F.col("o_orderdate")
    iso, spaced = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    slashed = F.date_format(c, "dd/MM/yyyy HH:mm:ss")
    us = lambda i: F.unix_micros(i)
    return t.orders.select("o_orderkey", times.to_date(F.date_format(c, "yyyy-MM-dd")).alias("d"), times.to_datetime(spaced).alias("dt"), us(times.to_instant(F.concat(iso, F.lit("Z")))).alias("us"), times.parse_date(F.date_format(c, "dd.MM.yyyy"), "%d.%m.%Y").alias("parsed"), times.parse_datetime(slashed, "%d/%m/%Y %H:%M:%S").alias("clock"), us(times.parse_instant(slashed, "%d/%m/%Y %H:%M:%S")).alias("instant"), times.to_date(F.date_format(c, "yyyy/MM/dd")).alias("bad"))


@query("""SELECT event_id, minute(ts) AS m, second(ts) AS s, (epoch_us(ts) % 1000000) * 1000 AS ns, CAST(ts AS DATE) AS d, ts - INTERVAL 90 MINUTE AS before, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) // 1000 AS millis,
 round(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1000000.0, 3) AS seconds, -date_diff('microsecond', TIMESTAMP '2024-01-01', ts) // 1000 AS back, 5400000 * 3 AS thrice, CAST(ts AS DATE) + INTERVAL 2 YEAR AS later, 3600 AS shift FROM events""")
def q_time_spans(t):
    c, zero = F.col("ts"), F.lit("2024-01-01").cast("timestamp_ntz")
    span, short = times.since(c, zero), times.duration(minutes=90)
    later = times.add_years(times.date_of(c), 2).cast("timestamp_ntz")
    shift = times.total_seconds(times.offset(F.col("ts").cast("timestamp"), "Europe/Berlin")).cast("int")
    return t.events.select("event_id", times.minute(c).alias("m"), times.second(c).alias("s"), times.nanosecond(c).alias("ns"), times.date_of(c).alias("d"), times.minus(c, short).alias("before"), times.total_millis(span).alias("millis"), F.round(times.total_seconds(span).cast("double"), 3).alias("seconds"), (-times.total_millis(times.negate(times.negate(span)))).alias("back"), times.total_millis(times.times(short, 3)).alias("thrice"), later.alias("later"), shift.alias("shift"))


@query("""SELECT c_custkey, CAST(c_custkey % 5 AS BIGINT) AS n, CASE WHEN c_custkey % 5 > 0 THEN DATE '2024-02-27' + CAST(c_custkey % 5 - 1 AS INTEGER) END AS last, 1000 * (3600 * (c_custkey % 24) + 60 * (c_custkey % 60)) AS millis, true AS ordered, 7 * 86400 AS week FROM customer""")
def q_time_ranges(t):
    k = F.col("c_custkey")
    first = F.lit("2024-02-27").cast("date")
    days = times.dates(first, F.date_add(first, (k % 5).cast("int")))
    spelt = F.concat(F.lit("PT"), (k % 24).cast("string"), F.lit("H"), (k % 60).cast("string"), F.lit("M"))
    ordered = (times.today() <= times.now().cast("date")) & (times.today("Asia/Tokyo") >= times.today())
    return t.customer.select("c_custkey", F.size(days).cast("bigint").alias("n"), F.try_element_at(days, F.lit(-1)).alias("last"), times.total_millis(times.to_duration(spelt)).alias("millis"), ordered.alias("ordered"), times.total_seconds(times.duration(days=7)).cast("int").alias("week"))


@query("""SELECT o_orderkey, epoch_us(o_orderdate - CASE WHEN o_orderdate IS NULL THEN NULL ELSE INTERVAL 9 HOUR END) AS tokyo FROM orders""")
def q_time_in_zone(t):
    return t.orders.select("o_orderkey", F.unix_micros(times.in_zone(F.col("o_orderdate"), "Asia/Tokyo")).alias("tokyo"))


# ---- absent values, results, open values


@query("""SELECT doc_id, quality IS NULL AS none, coalesce(quality, toxic, 7) AS other, CASE WHEN quality = 1 THEN quality END AS kept, coalesce(quality, 5) AS alt, coalesce(quality, -1) AS made FROM documents LEFT JOIN labels USING (doc_id)""")
def q_option_rest(t):
    q = F.col("quality")
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return rows.select("doc_id", values.is_none(q).alias("none"), values.or_else(values.or_else(q, F.col("toxic")), F.lit(7)).alias("other"), values.keep(q, lambda x: x == 1).alias("kept"), values.alternative(q, F.lit(5)).alias("alt"), values.unwrap_or_else(q, F.lit(-1)).alias("made"))


@query("""SELECT event_id, value >= 50 AS bad, CASE WHEN value < 50 THEN value END AS ok, CASE WHEN value >= 50 THEN 'large' END AS err, CASE WHEN value < 50 THEN value ELSE -1 END AS held, CASE WHEN value < 50 THEN value ELSE 5.0 END AS made, CASE WHEN value >= 50 THEN 'LARGE' END AS loud,
 CASE WHEN value < 50 THEN value * 2 END AS twice, value < 20 AS small, CASE WHEN value < 20 THEN NULL WHEN value < 50 THEN 'middling' ELSE 'large' END AS why, true AS mended FROM events""")
def q_result_rest(t):
    v = F.col("value")
    r = values.result(v < 50, v, F.lit("large"))
    then = values.result_and_then(r, lambda x: values.result(x < 20, x, F.lit("middling")))
    mended = values.result_or_result(r, lambda e: values.ok(F.length(e).cast("double")))
    return t.events.select("event_id", values.is_err(r).alias("bad"), values.ok_of(r).alias("ok"), values.err_of(r).alias("err"), values.result_or(r, F.lit(-1.0)).alias("held"), values.result_or_else(r, lambda e: F.length(e).cast("double")).alias("made"), values.err_of(values.map_err(r, text.upper)).alias("loud"), values.ok_of(values.map_ok(r, lambda x: x * 2)).alias("twice"), values.is_ok(then).alias("small"), values.err_of(then).alias("why"), values.is_ok(mended).alias("mended"))


@query("""SELECT event_id, CAST(event_id * 2 AS BIGINT) AS d FROM events WHERE event_id % 3 = 0""")
def q_of_type(t):
    k = F.col("event_id")
    kind = values.match((k % 3 == 0, (k * 2).cast("string")), (k % 3 == 1, F.lit('"text"')), otherwise=F.lit("true"))
    return Rel(t.events.select("event_id", F.try_parse_json(kind).alias("d"))).of_type("d", "bigint").df


@query("""SELECT event_type, count(*) AS n, CAST(count_if(event_id % 2 = 0) AS BIGINT) AS numbers, CAST(count_if(event_id % 2 = 1) AS BIGINT) AS strings FROM events GROUP BY event_type""")
def q_is_type(t):
    d = values.data(F.when(F.col("event_id") % 2 == 0, F.lit("12")).otherwise(F.lit('"a"')))
    return Rel(t.events).group("event_type").map(n=A.size(), numbers=A.count(values.is_type(d, "bigint"), True), strings=A.count(values.is_type(d, "string"), True))


@query("""SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic = 1""")
def q_somes(t):
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left").where("toxic = 1 or toxic is null")
    return Rel(rows).somes("quality").map("doc_id", "quality").df


@query("""SELECT (SELECT min(event_id) FROM events WHERE value > 99) AS found, (SELECT count(*) FROM events WHERE value > 50) AS n""")
def q_find_one(t):
    first = Rel.of(t.events, "event_id").find(F.col("value") > 99).one().map(found=F.col("event_id")).df
    return first.join(F.broadcast(Rel(t.events).partition("user_id").filter("value > 50").agg(n=A.size())))


@query("SELECT DISTINCT l_linenumber % 3 AS third, l_returnflag FROM lineitem")
def q_set_image(t):
    return Rel(t.lineitem.select("l_linenumber", "l_returnflag", "l_linestatus")).as_set().map("l_returnflag", third=F.col("l_linenumber") % 3).df


# ---- lists, maps


@query("""SELECT o_custkey, CAST(min(o_orderkey) AS BIGINT) AS low, max(o_orderkey) AS high, round(var_pop(o_totalprice / 10000), 3) AS spread, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_custkey""")
def q_min_max_variance(t):
    k = F.col("o_orderkey")
    return Rel(t.orders).group("o_custkey").map(low=A.minimum(k), high=A.maximum(k), spread=dec(A.variance(F.col("o_totalprice") / 10000), 3), kinds=F.size(A.union_all(F.array("o_orderpriority"))).cast("bigint"))


@query("""WITH m AS (SELECT user_id, event_type, max_by(event_id, {'a': ts, 'b': event_id}) AS v FROM events GROUP BY ALL)
 SELECT user_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(event_type) AS first, max(CASE WHEN event_type = 'click' THEN v END) AS click FROM m GROUP BY user_id""")
def q_merge_all(t):
    one = F.create_map("event_type", "event_id")
    m = Rel(t.events).group("user_id").map(m=A.merge_all(one, F.struct("ts", "event_id")))
    c = F.col("m")
    return m.select("user_id", F.size(values.entries(c)).cast("bigint").alias("n"), values.list_fold(values.values(c), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.get(values.sorted_map(c), F.lit(0)).getField("key").alias("first"), values.get(c, "click").alias("click"))


@query("""SELECT p_partkey, p_size AS a, p_size + 1 AS b, 2 AS n, true AS same, 9 AS merged FROM part""")
def q_map_build(t):
    k = F.col("p_size")
    m = values.map_of(F.array(F.lit("a"), F.lit("b")), F.array(k, k + 1))
    other = values.map_of(F.array(F.lit("b"), F.lit("a")), F.array(k + 1, k))
    merged = values.merge(m, F.create_map(F.lit("b"), F.lit(9)))
    return t.part.select("p_partkey", values.get(m, "a").alias("a"), values.get(m, "b").alias("b"), F.size(values.values(values.with_key(m, "b", k))).alias("n"), values.same_map(m, other).alias("same"), values.get(merged, "b").alias("merged"))


@query("""WITH x AS (SELECT o_orderkey, [o_custkey % 10, o_orderkey % 10, o_custkey % 10, 3] AS xs FROM orders)
 SELECT o_orderkey, CAST(list_sum(list_transform(list_zip(xs, [1, 2, 3]), lambda z: coalesce(z[1] * z[2], 0))) AS BIGINT) AS zipped, CAST(list_sum(list_transform(xs, lambda v, i: v * (i - 1))) AS BIGINT) AS numbered, len(list_distinct(xs)) AS kinds,
 CAST(xs[2] + xs[3] AS BIGINT) AS middle, CAST(2 * (xs[1] + xs[2] + xs[3] + xs[4]) - xs[1] - xs[4] AS BIGINT) AS windows, 12 AS stepped FROM x""")
def q_list_functions(t):
    xs = F.array(F.col("o_custkey") % 10, F.col("o_orderkey") % 10, F.col("o_custkey") % 10, F.lit(3).cast("bigint"))
    add = lambda ys: values.list_fold(ys, F.lit(0).cast("bigint"), lambda a, x: a + x)
    pairs = values.list_zip(xs, F.array(F.lit(1), F.lit(2), F.lit(3)))
    numbered = values.list_enumerate(xs)
    return t.orders.select("o_orderkey", add(F.transform(pairs, lambda p: p.first * p.second)).alias("zipped"), add(F.transform(numbered, lambda p: p.first * p.second)).alias("numbered"), F.size(values.list_distinct(xs)).cast("bigint").alias("kinds"), add(values.list_slice(xs, 1, -1)).alias("middle"), add(F.flatten(values.list_windows(xs, 2))).alias("windows"), add(values.list_range(6, 0, -2)).cast("int").alias("stepped"))


@query("""SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99, round(max(l_extendedprice), 4) AS most FROM lineitem GROUP BY ALL""")
def q_quantiles_by_rank(t):
    out = quantiles_by_rank(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.5, 0.1, 0.99, 1.0])
    return out.select("l_returnflag", "l_linestatus", *[dec(F.get("quantiles", F.lit(i))).alias(n) for i, n in enumerate(("median", "p10", "p99", "most"))])


# ---- folds by named combiners, user operations, graphs


@query("""SELECT CAST(sum(o_orderkey) + 10 AS BIGINT) AS added, CAST(min(o_orderkey) AS BIGINT) AS least, greatest(max(o_orderkey), 5) AS most, bool_or(o_orderstatus = 'P') AS some, bool_and(o_totalprice > 0) AS every FROM orders""")
def q_reduce_named(t):
    rows = Rel.of(t.orders, "o_orderkey")
    k = F.col("o_orderkey")
    parts = [rows.reduce(k, F.lit(10).cast("bigint"), "add"), rows.reduce(k, None, F.least), rows.reduce(k, F.lit(5).cast("bigint"), "max"), rows.reduce(F.col("o_orderstatus") == "P", None, "or"), rows.reduce(F.col("o_totalprice") > 0, F.lit(True), "and")]
    names = ("added", "least", "most", "some", "every")
    out = parts[0].withColumnRenamed("reduced", names[0])
    for name, part in zip(names[1:], parts[1:], strict=True):
        out = out.join(F.broadcast(part.withColumnRenamed("reduced", name)))  # one row each
    return out


@query("""SELECT l_returnflag, round(sum(l_quantity * 2), 2) AS twice, round(max(l_quantity) - min(l_quantity), 2) AS width FROM lineitem GROUP BY l_returnflag""")
def q_user_functions(t):
    @udf.elementwise("double")
    def double(s: pd.Series) -> pd.Series:
        return s * 2

    @udf.combined("double", low=pd.Series.min, high=pd.Series.max)
    def width(low: float, high: float) -> float:
        return high - low

    rows = t.lineitem.select("l_returnflag", double("l_quantity").alias("d"))
    sums = rows.groupBy("l_returnflag").agg(dec(F.sum("d"), 2).alias("twice"))
    widths = width(t.lineitem, ["l_returnflag"], "l_quantity", "width")
    return sums.join(widths.withColumn("width", dec(F.col("width"), 2)), "l_returnflag")


@query("""SELECT user_id, CAST(floor(max(value)) AS BIGINT) AS best, count(*) AS n FROM events GROUP BY user_id""")
def q_user_partition(t):
    @udf.partition("user_id long, best long, n long", "user_id")
    def best(d: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [d.user_id.iloc[0]], "best": [int(d.value.max())], "n": [len(d)]})

    return best(Rel(t.events.select("user_id", "value"))).df


@query("""SELECT event_id, value >= 1 AS is_ok, CASE WHEN value >= 1 THEN floor(value) END AS ok FROM events""")
def q_retry(t):
    def whole(v: float) -> float:
        if v < 1:
            raise ValueError("too small")
        return float(v // 1)

    r = udf.retry(whole, 2, "double")(F.col("value"))
    return t.events.select("event_id", r.alias("r")).select("event_id", "r.is_ok", "r.ok")


_LINKS = "SELECT 'c' || o_custkey AS source, 'o' || o_orderkey AS target FROM orders"


@query(f"WITH e AS ({_LINKS}) SELECT source AS name, 'member' AS presence FROM e UNION SELECT target, 'member' FROM e")
def q_graph_nodes(t):
    return graph.graph(t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("o"), "o_orderkey").alias("target")))


@query(f"""WITH e AS ({_LINKS}), s AS (SELECT 'c' || c_custkey AS name FROM customer WHERE c_nationkey < 5 UNION ALL SELECT 'o' || o_orderkey FROM orders WHERE o_totalprice > 200000)
 SELECT 'up' AS way, source, target FROM e WHERE source IN (SELECT name FROM s) UNION ALL SELECT 'down', source, target FROM e WHERE target IN (SELECT name FROM s)""")
def q_graph_links(t):
    edges = t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("o"), "o_orderkey").alias("target"))
    seed = t.customer.where("c_nationkey < 5").select(F.concat(F.lit("c"), "c_custkey").alias("name")).union(t.orders.where("o_totalprice > 200000").select(F.concat(F.lit("o"), "o_orderkey")))
    found = {"up": graph.uplinks(seed, edges), "down": graph.downlinks(seed, edges)}
    up, down = (df.select(F.lit(way).alias("way"), "source", "target") for way, df in found.items())
    return up.unionByName(down)
