"""One query for each kind of operator, on the driver's tables, with SQL that gives the same rows.

The tables are no hospital's, so each query has a stand-in: lines for shifts, parts for pay, events
for starts of shifts, labelled embeddings for labelled tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import parsing as P
from ..functions import units
from ..functions.compatibility import FITS, compatibility
from ..operators import clustering, interval_join, knowledge, matching, profiler, tokens
from ..streaming import kpi
from . import reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- joins, aggregates and reports ---------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, p_brand, coalesce(l_quantity / 60.0, 8.0) AS hours,
       round(coalesce(l_quantity / 60.0, 8.0) * coalesce(p_retailprice, 0.0), 2) AS cost
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def cost_per_row(spark, sf_dir):
    """Left join, coalesced rate, rounded cost."""
    lines, parts = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part")
    hours = F.coalesce(F.col("l_quantity") / F.lit(60.0), F.lit(8.0))
    joined = lines.join(parts, lines["l_partkey"] == parts["p_partkey"], "left")
    return joined.select("l_orderkey", "l_linenumber", "p_brand", hours.alias("hours"), P.rounded(hours * F.coalesce("p_retailprice", F.lit(0.0)), 2).alias("cost"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity), 1) AS total_quantity,
       count(CASE WHEN s_acctbal > 0 THEN 1 END) AS in_credit, round(avg(CASE WHEN s_acctbal > 0 THEN l_extendedprice END), 2) AS in_credit_price,
       round(count(CASE WHEN s_acctbal > 0 THEN 1 END) * 100.0 / nullif(count(*), 0), 1) AS in_credit_pct,
       CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_returnflag, l_linestatus""")
def cost_summary(spark, sf_dir):
    """Conditional counts and means of groups."""
    lines, suppliers = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "supplier")
    good = F.col("s_acctbal") > 0
    return lines.join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"], "left").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), P.rounded(F.sum("l_quantity"), 1).alias("total_quantity"), F.count_if(good).alias("in_credit"), P.rounded(F.avg(F.when(good, F.col("l_extendedprice"))), 2).alias("in_credit_price"),
        P.rounded(P.ratio(F.count_if(good) * 100.0, F.count("*")), 1).alias("in_credit_pct"), F.min("l_shipdate").cast("date").alias("first_day"), F.max("l_shipdate").cast("date").alias("last_day"),
    )


_BAND_SQL = "CASE WHEN m < 300 THEN 'NIGHT' WHEN m < 540 THEN 'MORNING' WHEN m < 780 THEN 'MID_DAY' WHEN m < 1020 THEN 'AFTERNOON' WHEN m < 1260 THEN 'EVENING' ELSE 'NIGHT' END"


@query(f"""
WITH e AS (SELECT *, CAST(extract(hour FROM ts) * 60 + extract(minute FROM ts) AS INTEGER) AS m FROM events)
SELECT {_BAND_SQL} AS band, event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(m) AS earliest, max(m) AS latest,
       round(count(CASE WHEN value > 50 THEN 1 END) * 100.0 / count(*), 1) AS high_pct
FROM e GROUP BY 1, 2""")
def bucket_patterns(spark, sf_dir):
    """Bands of the day."""
    rows = _t(spark, sf_dir, "events").withColumn("m", F.hour("ts") * 60 + F.minute("ts"))
    return rows.groupBy(clustering.band(F.col("m")).alias("band"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("m").alias("earliest"), F.max("m").alias("latest"), P.rounded(P.ratio(F.count_if(F.col("value") > 50) * 100.0, F.count("*")), 1).alias("high_pct"))


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) - 30 AS late, CAST(l_quantity AS INTEGER) - 25 AS left_
           FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT l_orderkey, l_linenumber, CAST(late AS INTEGER) AS late,
       CASE WHEN late > 20 THEN 'LATE' WHEN late < -15 THEN 'TOO_EARLY' WHEN late < 0 THEN 'EARLY_OK' ELSE 'ON_TIME' END AS arrival,
       CASE WHEN left_ < -15 THEN 'LEFT_EARLY' WHEN left_ > 30 THEN 'OVERTIME' ELSE 'NORMAL' END AS departure,
       CASE WHEN late > 20 THEN 'FLAGGED_LATE' WHEN late < -15 THEN 'FLAGGED_TOO_EARLY' WHEN left_ < -15 THEN 'FLAGGED_EARLY_DEPARTURE' ELSE 'OK' END AS flag
FROM d""")
def lateness_flags(spark, sf_dir):
    """The report's three statuses, on days instead of minutes."""
    orders, lines = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    late = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")) - 30
    left = F.col("l_quantity").cast("int") - 25
    rows = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).select("l_orderkey", "l_linenumber", late.alias("late"), left.alias("left"))
    return rows.select("l_orderkey", "l_linenumber", "late", reports.arrival_status(F.col("late"), 15, 20).alias("arrival"), reports.departure_status(F.col("left")).alias("departure"), reports.compliance_flag(F.col("late"), F.col("left"), 15, 20).alias("flag"))


@query("""
WITH a AS (SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order, count(*) AS n, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities
           FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey)
SELECT c_custkey, c_mktsegment, first_order, last_order, coalesce(n, 0) AS n, coalesce(priorities, '') AS priorities,
       CASE WHEN n IS NULL THEN 'NO_ACTIVITY_RECORDED' ELSE 'HAS_ACTIVITY' END AS status
FROM customer LEFT JOIN a ON c_custkey = o_custkey""")
def activity_discrepancies(spark, sf_dir):
    """Left join of an aggregate, with an ordered list of distinct values."""
    a = _t(spark, sf_dir, "orders").where("o_totalprice > 200000").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ", ").alias("priorities"))
    c = _t(spark, sf_dir, "customer")
    out = c.join(a, c["c_custkey"] == a["o_custkey"], "left")
    return out.select("c_custkey", "c_mktsegment", "first_order", "last_order", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("priorities", F.lit("")).alias("priorities"), F.when(F.col("n").isNull(), "NO_ACTIVITY_RECORDED").otherwise("HAS_ACTIVITY").alias("status"))


@query("""
SELECT p_type, max(p_brand) AS brand, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(avg(p_retailprice * 0.5), 2) AS avg_cost, round(min(p_retailprice * 0.5), 2) AS min_cost,
       round(max(p_retailprice * 0.5), 2) AS max_cost, round(avg(l_extendedprice), 2) AS avg_revenue
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE p_retailprice > 0 GROUP BY p_type""")
def avg_cost_by_type(spark, sf_dir):
    lines, parts = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part")
    cost = F.col("p_retailprice") * 0.5
    rows = lines.join(parts, lines["l_partkey"] == parts["p_partkey"], "left").where("p_retailprice > 0")
    return rows.groupBy("p_type").agg(F.max("p_brand").alias("brand"), F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), P.rounded(F.avg(cost), 2).alias("avg_cost"), P.rounded(F.min(cost), 2).alias("min_cost"), P.rounded(F.max(cost), 2).alias("max_cost"), P.rounded(F.avg("l_extendedprice"), 2).alias("avg_revenue"))


@query("""
WITH r AS (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(n, 0) AS n, round(coalesce(revenue, 0.0), 2) AS revenue, round(coalesce(revenue, 0.0) - o_totalprice, 2) + 0.0 AS profit,
       CASE WHEN revenue > 0 THEN round((revenue - o_totalprice) / revenue * 100, 1) + 0.0 ELSE 0.0 END AS margin_pct
FROM orders LEFT JOIN r ON o_orderkey = l_orderkey""")
def gross_profit(spark, sf_dir):
    """Margin guarded against revenue of nothing."""
    lines = _t(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    orders = _t(spark, sf_dir, "orders")
    revenue = F.coalesce("revenue", F.lit(0.0))
    out = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
    return out.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), P.rounded(revenue, 2).alias("revenue"), P.rounded(revenue - F.col("o_totalprice"), 2).alias("profit"), F.when(revenue > 0, P.rounded((revenue - F.col("o_totalprice")) / F.nullif(revenue, F.lit(0.0)) * 100, 1)).otherwise(0.0).alias("margin_pct"))


@query("""
WITH x AS (SELECT l_suppkey, p_type, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey),
     own AS (SELECT l_suppkey, p_type, count(*) AS n, round(avg(l_quantity), 2) AS mine FROM x GROUP BY ALL HAVING count(*) >= 2),
     peers AS (SELECT p_type, round(avg(l_quantity), 2) AS theirs, count(DISTINCT l_suppkey) AS suppliers FROM x GROUP BY p_type)
SELECT l_suppkey, own.p_type, n, mine, theirs, suppliers, round((mine - theirs) / theirs * 100, 1) + 0.0 AS variance_pct,
       CASE WHEN mine > theirs * 1.5 THEN 'VERY_SLOW' WHEN mine > theirs * 1.2 THEN 'SLOW' WHEN mine < theirs * 0.9 THEN 'FAST' ELSE 'AVERAGE' END AS flag
FROM own JOIN peers ON own.p_type = peers.p_type""")
def performer_vs_peer(spark, sf_dir):
    """Two levels of means; compared after rounding."""
    lines, parts = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part")
    x = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select("l_suppkey", "p_type", "l_quantity")
    own = x.groupBy("l_suppkey", "p_type").agg(F.count("*").alias("n"), P.rounded(F.avg("l_quantity"), 2).alias("mine")).where("n >= 2")
    peers = x.groupBy("p_type").agg(P.rounded(F.avg("l_quantity"), 2).alias("theirs"), F.countDistinct("l_suppkey").alias("suppliers"))
    return own.join(peers, "p_type").select("l_suppkey", "p_type", "n", "mine", "theirs", "suppliers", P.rounded((F.col("mine") - F.col("theirs")) / F.col("theirs") * 100, 1).alias("variance_pct"), reports.performance_flag(F.col("mine"), F.col("theirs")).alias("flag"))


@query("""
WITH w AS (SELECT user_id, min(ts) + INTERVAL 1 DAY AS low, min(ts) + INTERVAL 10 DAY AS high FROM events GROUP BY user_id)
SELECT w.user_id, count(e.event_id) AS n FROM w LEFT JOIN events e ON e.user_id = w.user_id AND e.ts BETWEEN w.low AND w.high GROUP BY w.user_id""")
def range_join_count(spark, sf_dir):
    """Equal keys and an interval, both ends inclusive; users without events in it count 0."""
    e = _t(spark, sf_dir, "events")
    w = e.groupBy("user_id").agg((F.min("ts") + F.expr("interval 1 day")).alias("low"), (F.min("ts") + F.expr("interval 10 days")).alias("high"))
    return interval_join.count_inside(w, e, ["user_id"], *[interval_join.micros(F.col(c)) for c in ("low", "high", "ts")], 86_400_000_000, ["user_id"])


@query("""
WITH x AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN -1 ELSE user_id END AS user_id, ts FROM events),
     w AS (SELECT user_id, date_trunc('day', ts) + INTERVAL 20 HOUR AS low, date_trunc('day', ts) + INTERVAL 30 HOUR AS high, count(*) AS own FROM x GROUP BY ALL)
SELECT w.user_id, w.low, count(x.event_id) AS n FROM w LEFT JOIN x ON x.user_id = w.user_id AND x.ts BETWEEN w.low AND w.high GROUP BY w.user_id, w.low""")
def range_join_hot(spark, sf_dir):
    """Nights of users, of whom one has half of all events: its events are dealt to bins of time."""
    hot = F.when(F.col("event_id") % 2 == 0, F.lit(-1)).otherwise(F.col("user_id")).cast("long")
    e = _t(spark, sf_dir, "events").select("event_id", hot.alias("user_id"), "ts")
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    w = e.select("user_id", (day + F.expr("interval 20 hours")).alias("low")).distinct()
    start = F.pmod(interval_join.micros(F.col("low")), F.lit(86_400_000_000))
    end = interval_join.micros(F.col("low")) - start + interval_join.overnight(start, F.lit(6 * 3_600_000_000))
    out = interval_join.count_inside(w, e, ["user_id"], interval_join.micros(F.col("low")), end, interval_join.micros(F.col("ts")), 6 * 3_600_000_000, ["user_id", "low"])
    return out.select("user_id", F.col("low").cast("timestamp_ntz").alias("low"), "n")


@query("SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_unindexed(spark, sf_dir):
    """Rows that an index does not have yet."""
    return knowledge.not_indexed(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source")


@query("""
WITH seen AS (SELECT source, list(DISTINCT lang) AS langs FROM documents GROUP BY source)
SELECT source, needs.name AS name, len(list_filter(needs.langs, lambda x: NOT list_contains(seen.langs, x))) = 0 AS applicable,
       CAST(len(list_filter(needs.langs, lambda x: NOT list_contains(seen.langs, x))) AS INTEGER) AS missing
FROM seen, (VALUES ('west', ['en', 'fr']), ('all', ['en', 'fr', 'de', 'es']), ('none', ['it'])) needs(name, langs)""")
def subset_requirements(spark, sf_dir):
    """What is required against what is there."""
    seen = _t(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("there"))
    needs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, ls)).alias("langs")) for n, ls in (("west", ["en", "fr"]), ("all", ["en", "fr", "de", "es"]), ("none", ["it"]))]))
    missing = F.size(F.array_except("x.langs", "there"))
    return seen.withColumn("x", needs).select("source", F.col("x.name").alias("name"), (missing == 0).alias("applicable"), missing.alias("missing"))


# --- profiles ---------------------------------------------------------------------------------------

_CELLS = "SELECT p_partkey AS pos, unnest(['p_name', 'p_brand', 'p_type', 'p_size']) AS column_name, unnest([p_name, p_brand, p_type, CAST(p_size AS VARCHAR)]) AS raw FROM part"
_VALUES = f"""c AS ({_CELLS}), v AS (SELECT pos, column_name, CASE WHEN lower(t) IN ('', 'na', 'n/a', 'null', 'none', '-', '--', 'nan') THEN NULL ELSE t END AS value
    FROM (SELECT pos, column_name, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS t FROM c)),
  s AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY pos, value) AS rank FROM v WHERE value IS NOT NULL), few AS (SELECT * FROM s WHERE rank <= 2000)"""
_PROFILED = ["p_name", "p_brand", "p_type", "p_size"]


@query(f"""
WITH {_VALUES}
SELECT column_name, count(value) AS non_null_count, count(*) - count(value) AS null_count, any_value(u) AS unique_count, any_value(l) AS avg_strlen, any_value(m) AS max_strlen
FROM v LEFT JOIN (SELECT column_name AS k, count(DISTINCT value) AS u, round(avg(length(value)), 6) AS l, CAST(max(length(value)) AS INTEGER) AS m FROM few GROUP BY column_name) ON k = column_name GROUP BY column_name""")
def profile_basic(spark, sf_dir):
    """Counts over all rows; distinct values and lengths over the sample."""
    p = profiler.profile(_t(spark, sf_dir, "part"), F.col("p_partkey"), _PROFILED)
    return p.select("column_name", "non_null_count", "null_count", "unique_count", P.rounded("avg_strlen", 6).alias("avg_strlen"), "max_strlen")


@query(f"""
WITH {_VALUES}
SELECT column_name, round(avg(CASE WHEN regexp_matches(value, '^\\s*[-+]?\\d+\\s*$') THEN 1.0 ELSE 0 END), 6) AS int_like,
       round(avg(CASE WHEN regexp_matches(value, '^\\s*[-+]?\\d+(\\.\\d+)?\\s*$') THEN 1.0 ELSE 0 END), 6) AS float_like,
       round(avg(CASE WHEN regexp_matches(value, '^[A-Za-z0-9][A-Za-z0-9_\\-]{{3,}}$') THEN 1.0 ELSE 0 END), 6) AS id_like,
       round(avg(CASE WHEN regexp_matches(value, '^\\s*\\d+\\s*$') THEN 1.0 ELSE 0 END), 6) AS pure_number_like
FROM few GROUP BY column_name""")
def profile_regex_rates(spark, sf_dir):
    p = profiler.profile(_t(spark, sf_dir, "part"), F.col("p_partkey"), _PROFILED)
    return p.select("column_name", *[P.rounded(F.col("regex_hits")[n], 6).alias(n) for n in ("int_like", "float_like", "id_like", "pure_number_like")])


@query()
def profile_detected_type(spark, sf_dir):
    """Every column of the order lines: detected type and confidence.  Tests hold the scorer against its definition."""
    p = profiler.profile(_t(spark, sf_dir, "lineitem"), F.struct("l_orderkey", "l_linenumber"))
    return p.select("column_name", "detected_type", P.rounded("confidence", 6).alias("confidence"), P.rounded("unique_ratio", 6).alias("unique_ratio"), "numeric_min", "numeric_max", "sample_values")


@query()
def profile_text(spark, sf_dir):
    """Columns in words, as they are matched."""
    return profiler.described(profiler.profile(_t(spark, sf_dir, "orders"), F.col("o_orderkey"))).select("column_name", "text", "embedding_text")


# --- values -------------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS dmy, CASE WHEN day(o_orderdate) <= 12 THEN CAST(make_date(CAST(year(o_orderdate) AS BIGINT), CAST(day(o_orderdate) AS BIGINT), CAST(month(o_orderdate) AS BIGINT)) AS VARCHAR) ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS mdy,
       CAST(NULL AS VARCHAR) AS digits FROM orders""")
def parse_dates(spark, sf_dir):
    """Formats in order of trial: a day up to 12 is read before the month."""
    day = F.col("o_orderdate")
    text = lambda f: F.date_format(P.date(F.date_format(day, f)), "yyyy-MM-dd")
    return _t(spark, sf_dir, "orders").select("o_orderkey", text("d/M/yyyy").alias("dmy"), text("M/d/yyyy").alias("mdy"), text("yyyyMMdd").alias("digits"))


@query("""
SELECT event_id, extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + extract(second FROM ts) AS clock, extract(minute FROM ts) * 60 AS minutes,
       CAST(trunc(value * 3600) AS BIGINT) AS hours, CAST(NULL AS BIGINT) AS plain FROM (SELECT event_id, ts, round(value, 1) AS value FROM events)""")
def parse_durations(spark, sf_dir):
    hours = F.concat(P.text_number(P.rounded("value", 1), 1), F.lit("h"))
    rows = _t(spark, sf_dir, "events")
    read = lambda c, name: P.duration_seconds(c).alias(name)
    return rows.select("event_id", read(F.date_format("ts", "H:mm:ss"), "clock"), read(F.concat(F.minute("ts").cast("string"), F.lit("m")), "minutes"), read(hours, "hours"), read(F.minute("ts").cast("string"), "plain"))


@query("""
SELECT event_id, CAST(extract(hour FROM ts) * 60 + extract(minute FROM ts) AS INTEGER) AS minutes, strftime(ts + INTERVAL 90 MINUTE, '%H:%M') AS later,
       CAST(NULL AS INTEGER) AS beyond FROM events""")
def parse_times(spark, sf_dir):
    minutes = P.minutes_of_day(F.date_format("ts", "H:mm"))
    return _t(spark, sf_dir, "events").select("event_id", minutes.alias("minutes"), P.clock(minutes + 90).alias("later"), P.minutes_of_day(F.lit("24:00")).alias("beyond"))


@query("""
SELECT p_partkey, CAST(p_size AS DOUBLE) * 60.0 AS minutes, CAST(p_size AS DOUBLE) / 60.0 AS hours, round((CAST(p_size AS DOUBLE) - 32) * 5 / 9, 6) AS celsius,
       round(CAST(p_size AS DOUBLE) * 9 / 5 + 32, 6) AS fahrenheit, round(CAST(p_size AS DOUBLE) / 2.20462, 6) AS kg, round(CAST(p_size AS DOUBLE) / 2.54, 6) AS inches, CAST(p_size AS DOUBLE) AS unknown FROM part""")
def unit_convert(spark, sf_dir):
    to = lambda a, b: units.convert(F.col("p_size"), a, b)
    return _t(spark, sf_dir, "part").select("p_partkey", to("hours", "minutes").alias("minutes"), to("minutes", "hours").alias("hours"), P.rounded(to("fahrenheit", "celsius"), 6).alias("celsius"), P.rounded(to("celsius", "fahrenheit"), 6).alias("fahrenheit"), P.rounded(to("lbs", "kg"), 6).alias("kg"), P.rounded(to("cm", "inches"), 6).alias("inches"), to("m", "kg").alias("unknown"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, o_orderpriority AS same, o_orderstatus = 'Y' AS is_yes FROM orders""")
def format_convert(spark, sf_dir):
    """A value that does not fit its format stays as it is."""
    return _t(spark, sf_dir, "orders").select("o_orderkey", units.iso_date(F.date_format("o_orderdate", "dd/MM/yyyy"), "DD/MM/YYYY").alias("iso"), units.iso_date(F.col("o_orderpriority"), "DD-MM-YYYY").alias("same"), units.yes(F.col("o_orderstatus")).alias("is_yes"))


_DETECTED = ["datetime", "date", "time_of_day", "duration", "integer", "float", "boolean", "categorical", "free_text", "id_like", "text", "empty"]
_FIELDS = ["string", "date", "datetime", "integer", "float", "boolean"]


def _one_of(names: list[str], of: str) -> str:
    return f"CASE {of} % {len(names)} {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(names))} END"


@query(f"""
WITH fits(a, b, f) AS (VALUES {", ".join(f"('{a}', '{b}', {f})" for a, b, f in FITS)}),
     d AS (SELECT p_partkey, {_one_of(_DETECTED, "p_partkey")} AS a, {_one_of(_FIELDS, "p_size")} AS b FROM part)
SELECT p_partkey, d.a AS detected, d.b AS field, CAST(CASE WHEN d.a = 'empty' THEN 0.5 ELSE coalesce(x.f, y.f,
         CASE WHEN d.a IN ('integer', 'float', 'duration') AND d.b IN ('integer', 'float', 'number') THEN 0.85 WHEN d.a IN ('datetime', 'date', 'time_of_day') AND d.b IN ('datetime', 'date', 'time') THEN 0.8 ELSE 0.4 END) END AS DOUBLE) AS fit
FROM d LEFT JOIN fits x ON x.a = d.a AND x.b = d.b LEFT JOIN fits y ON y.a = d.b AND y.b = d.a""")
def type_compat(spark, sf_dir):
    """Fits of types that the parts' numbers stand for: every pair of them."""
    pairs = _t(spark, sf_dir, "part").selectExpr("p_partkey", f"{_one_of(_DETECTED, 'p_partkey')} AS detected", f"{_one_of(_FIELDS, 'p_size')} AS field")
    return pairs.select("p_partkey", "detected", "field", compatibility(F.col("detected"), F.col("field")).alias("fit"))


@query("""
WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS w, generate_subscripts(string_split_regex(text, '\\s+'), 1) AS i FROM documents),
     f AS (SELECT doc_id, min(i) AS i, arg_min(w, i) AS w FROM w WHERE w <> '' GROUP BY doc_id, lower(w))
SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS tokens FROM f GROUP BY doc_id""")
def field_text_dedupe(spark, sf_dir):
    """First spellings of a text's words, in order."""
    return tokens.distinct_tokens(_t(spark, sf_dir, "documents"), "doc_id")


@query("""
WITH f AS (SELECT lang, source, min(doc_id) AS first FROM documents GROUP BY lang, source), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY first) AS rank FROM f)
SELECT lang, source, first, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 15""")
def top_n_sample(spark, sf_dir):
    """The first different values in a given order."""
    first = _t(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("first"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("first"))).where("rank <= 15")


# --- neighbours, votes, scores --------------------------------------------------------------------------

_COS = "list_sum(list_transform(list_zip(q.v, i.v), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(q.v, lambda z: z * z))) * sqrt(list_sum(list_transform(i.v, lambda z: z * z))))"
_NEAR = f"""e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
     s AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, i.label AS label, round({_COS}, 6) AS similarity FROM e q, e i WHERE q.vec_id % 20 = 0),
     n AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS INTEGER) AS rank FROM s), k AS (SELECT * FROM n WHERE rank <= 5)"""


def _near(spark, sf_dir, k: int = 5) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "label", F.col("embedding").alias("vector"))
    return matching.nearest(e.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "vector"), e, k)


@query(f"WITH {_NEAR} SELECT query_id, item_id, label, similarity, rank FROM k")
def knn_topk(spark, sf_dir):
    """Cosine neighbours of the vectors whose id is divisible by 20 among all."""
    return _near(spark, sf_dir).select("query_id", "item_id", "label", "similarity", "rank")


_VOTE = "v AS (SELECT query_id, label, sum(similarity) AS weight FROM k GROUP BY ALL), t AS (SELECT query_id, sum(weight) AS total FROM v GROUP BY query_id), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, label) AS rank FROM v)"


@query(f"WITH {_NEAR}, {_VOTE} SELECT b.query_id, label, round(weight / total, 3) AS confidence FROM b JOIN t ON b.query_id = t.query_id WHERE rank = 1")
def knn_vote(spark, sf_dir):
    return matching.vote(_near(spark, sf_dir), "label")


_KNOWN = f"""m AS (SELECT 'v' || CAST(label % 2 AS VARCHAR) AS vertical, 't' || CAST(label AS VARCHAR) AS document_type, 'c' || CAST(vec_id AS VARCHAR) AS source_column, 'f' || CAST(vec_id % 7 AS VARCHAR) AS target_field, v FROM e),
     x AS (SELECT q.vec_id AS query_id, source_column, document_type, target_field, round({_COS}, 6) AS similarity FROM e q, m i WHERE q.vec_id % 20 = 0 AND vertical = 'v1'),
     y AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, document_type, source_column, target_field) AS INTEGER) AS rank FROM x)"""


def _similar(spark, sf_dir, k: int = 3) -> DataFrame:
    name = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    e = _t(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    known = e.select(name("v", F.col("label") % 2).alias("vertical"), name("t", F.col("label")).alias("document_type"), name("c", F.col("vec_id")).alias("source_column"), name("f", F.col("vec_id") % 7).alias("target_field"), F.lit(1).cast("long").alias("occurrence_count"), "vector")
    return matching.similar_columns(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector"), known, k, vertical="v1")


@query(f"WITH {_NEAR}, {_KNOWN} SELECT query_id, source_column, document_type, target_field, similarity, rank FROM y WHERE rank <= 3")
def similar_columns(spark, sf_dir):
    """Known columns of one vertical that are most similar to each column."""
    return _similar(spark, sf_dir).select("query_id", "source_column", "document_type", "target_field", "similarity", "rank")


@query(f"""
WITH {_NEAR}, {_VOTE}, {_KNOWN}, d AS (SELECT b.query_id, 'f' || CAST(label AS VARCHAR) AS target, round(weight / total, 3) AS v FROM b JOIN t ON b.query_id = t.query_id WHERE rank = 1 AND b.query_id % 40 = 0),
     o AS (SELECT a.vec_id AS query_id, target, v, target_field, source_column, round(similarity, 3) AS n FROM embeddings a LEFT JOIN d ON d.query_id = vec_id LEFT JOIN (SELECT * FROM y WHERE rank = 1) z ON z.query_id = vec_id WHERE vec_id % 20 = 0)
SELECT 'c' || CAST(query_id AS VARCHAR) AS source_column, CASE WHEN n > coalesce(v, 0) THEN target_field ELSE target END AS target_field, CASE WHEN n > coalesce(v, 0) THEN n ELSE coalesce(v, 0) END AS confidence,
       CASE WHEN n > coalesce(v, 0) THEN 'column_similarity' WHEN v IS NOT NULL THEN 'similar_tables' ELSE 'no_match' END AS origin, CASE WHEN n > coalesce(v, 0) THEN source_column END AS matched_column FROM o""")
def column_suggestions(spark, sf_dir):
    """For each column the surer of the neighbours' vote, which half of the columns have, and the most similar known column."""
    column = F.concat(F.lit("c"), F.col("query_id").cast("string")).alias("source_column")
    voted = matching.vote(_near(spark, sf_dir), "label").where("query_id % 40 = 0").select(column, F.concat(F.lit("f"), F.col("label").cast("string")).alias("target_field"), "confidence")
    similar = _similar(spark, sf_dir).select(column, "target_field", "similarity", "rank", F.col("source_column").alias("matched_column"))
    columns = _t(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id")).select(column)
    return matching.column_suggestions(columns, voted, similar)


_DOC = "SELECT label AS document_type, avg(similarity) AS document_score FROM k GROUP BY label"


@query(f"""
WITH {_NEAR}, d AS ({_DOC}), c AS (SELECT label AS document_type, avg(similarity) AS column_score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY query_id, rank) AS n FROM k) WHERE n <= 3 GROUP BY label),
     g AS (SELECT label AS document_type, count(*) FILTER (WHERE label % 2 = 0) * 1.0 / count(*) AS coverage FROM embeddings GROUP BY label)
SELECT coalesce(d.document_type, c.document_type) AS document_type, round(0.3 * coalesce(document_score, 0) + 0.5 * coalesce(column_score, 0) + 0.2 * coalesce(coverage, 0), 4) AS score
FROM d FULL JOIN c ON d.document_type = c.document_type LEFT JOIN g ON g.document_type = coalesce(d.document_type, c.document_type)""")
def hybrid_score(spark, sf_dir):
    """Three scores joined in full, weighted."""
    near = _near(spark, sf_dir).withColumnRenamed("label", "document_type")
    columns = matching.column_scores(near.select("document_type", F.col("query_id").alias("column_position"), "rank", F.col("similarity").alias("adjusted")), 3)
    covered = _t(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("document_type")).agg(F.avg(F.when(F.col("label") % 2 == 0, 1.0).otherwise(0.0)).alias("coverage"))
    return matching.hybrid(matching.document_scores(near), columns, covered).select("document_type", "score")


@query(f"""
WITH {_NEAR}, m AS (SELECT label AS document_type, item_id % 7 AS f, max(similarity * 0.95) AS best FROM k GROUP BY ALL),
     f AS (SELECT DISTINCT label AS document_type, vec_id % 7 AS f FROM embeddings)
SELECT f.document_type, count(*) FILTER (WHERE best > 0.5 AND f.f < 4) * 1.0 / nullif(count(*) FILTER (WHERE f.f < 4), 0) AS coverage
FROM f LEFT JOIN m ON m.document_type = f.document_type AND m.f = f.f GROUP BY f.document_type""")
def coverage_score(spark, sf_dir):
    """Share of required fields (numbers below 4) that are matched above one half."""
    m = _near(spark, sf_dir).select(F.col("label").alias("document_type"), (F.col("item_id") % 7).alias("field_name"), (F.col("similarity") * 0.95).alias("adjusted"))
    fields = _t(spark, sf_dir, "embeddings").select(F.col("label").alias("document_type"), (F.col("vec_id") % 7).alias("field_name")).distinct().withColumn("required", F.col("field_name") < 4)
    return matching.coverage(m, fields)


_LEADS = f"""{_NEAR}, l AS (SELECT query_id AS column_name, label AS field_name, similarity AS confidence, row_number() OVER w AS n, lead(similarity) OVER w AS next, lead(label) OVER w AS next_field FROM k WINDOW w AS (PARTITION BY query_id ORDER BY similarity DESC, label)),
     x AS (SELECT column_name, field_name, confidence, round(confidence - coalesce(next, 0), 6) AS lead, CASE WHEN confidence < 0.82 THEN 'unmapped' WHEN next IS NULL OR round(confidence - next, 9) >= 0.01 OR next_field = field_name THEN 'mapped' ELSE 'ambiguous' END AS status FROM l WHERE n = 1)"""


def _suggested(spark, sf_dir) -> DataFrame:
    return matching.suggest(_near(spark, sf_dir).select(F.col("query_id").alias("column_name"), F.col("label").alias("field_name"), F.col("similarity").alias("confidence")))


@query(f"WITH {_LEADS} SELECT column_name, CASE WHEN status = 'mapped' THEN field_name END AS target_field, confidence, lead, status FROM x")
def suggest_with_gap(spark, sf_dir):
    return _suggested(spark, sf_dir)


@query(f"WITH {_LEADS}, y AS (SELECT * FROM x WHERE status = 'mapped') SELECT field_name AS target_field, string_agg(column_name, ',' ORDER BY confidence DESC, column_name) AS members FROM y GROUP BY field_name HAVING count(*) > 1")
def mapping_conflicts(spark, sf_dir):
    return matching.conflicts(_suggested(spark, sf_dir)).select("target_field", F.array_join("columns", ",").alias("members"))


@query(f"""
WITH {_NEAR}, m AS (SELECT 'column_' || CAST(rank AS VARCHAR) AS source_column, 'field_' || CAST(label AS VARCHAR) AS target_field, sum(similarity) AS weight FROM k GROUP BY ALL),
     r AS (SELECT *, row_number() OVER (PARTITION BY source_column ORDER BY weight DESC, target_field) AS n, sum(weight) OVER (PARTITION BY source_column) AS total FROM m)
SELECT source_column, target_field, round(weight / total, 3) AS confidence FROM r WHERE n = 1""")
def mapping_vote(spark, sf_dir):
    """Maps of neighbours, exploded and voted on."""
    maps = F.create_map(F.concat(F.lit("column_"), F.col("rank").cast("string")), F.concat(F.lit("field_"), F.col("label").cast("string")))
    return matching.mapping_vote(_near(spark, sf_dir).select("similarity", maps.alias("column_mappings")))


_ACCEPTS, _GAPS = [0.70, 0.75, 0.78, 0.80, 0.82, 0.85, 0.88, 0.90], [0.01, 0.02, 0.03, 0.05]


@query(f"""
WITH {_LEADS}, g AS (SELECT CAST(a AS DOUBLE) AS accept, CAST(b AS DOUBLE) AS gap FROM (SELECT unnest([{", ".join(map(str, _ACCEPTS))}]) AS a) CROSS JOIN (SELECT unnest([{", ".join(map(str, _GAPS))}]) AS b))
SELECT accept, gap, count(*) FILTER (WHERE confidence < accept) AS below, count(*) FILTER (WHERE confidence >= accept AND lead < gap) AS ambiguous, count(*) FILTER (WHERE confidence >= accept AND lead >= gap) AS above
FROM x, g GROUP BY accept, gap""")
def threshold_sweep(spark, sf_dir):
    return matching.sweep(_suggested(spark, sf_dir), _ACCEPTS, _GAPS)


@query("""
SELECT CASE WHEN l_discount * 10 >= 0.9 THEN '>=90%' WHEN l_discount * 10 >= 0.85 THEN '85-90%' WHEN l_discount * 10 >= 0.82 THEN '82-85%' WHEN l_discount * 10 >= 0.8 THEN '80-82%' WHEN l_discount * 10 >= 0.75 THEN '75-80%'
            WHEN l_discount * 10 >= 0.7 THEN '70-75%' WHEN l_discount * 10 >= 0.6 THEN '60-70%' WHEN l_discount * 10 >= 0.5 THEN '50-60%' ELSE '<50%' END AS band, count(*) AS count
FROM lineitem GROUP BY 1""")
def score_histogram(spark, sf_dir):
    return matching.histogram(_t(spark, sf_dir, "lineitem").select((F.col("l_discount") * F.lit(10.0)).alias("confidence")))


@query("""
SELECT 'medical' AS vertical, l_returnflag AS document_type, l_linestatus AS source_column, 'f' || CAST(l_linenumber AS VARCHAR) AS target_field, CAST(count(*) AS BIGINT) AS occurrence_count
FROM lineitem GROUP BY ALL""")
def kb_upsert(spark, sf_dir):
    """A table of known mappings takes up new ones: twice, half of the lines each time."""
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.lit("medical").alias("vertical"), F.col("l_returnflag").alias("document_type"), F.col("l_linestatus").alias("source_column"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("target_field"))
    first = knowledge.upsert(None, rows.where("l_orderkey <= 2000"))
    return knowledge.upsert(first, rows.where("l_orderkey > 2000"))


# --- clusters -------------------------------------------------------------------------------------------


def _starts(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.date_format("ts", "HH:mm").alias("shift_start"), F.date_format(F.col("ts") + F.expr("interval 8 hours"), "HH:mm").alias("shift_end"))


#: The same dynamic programming over the histogram's cells: c has the cost of one cluster, b2 to b4 the best of more and where the last begins.
_CLUSTERED = """
WITH e AS (SELECT event_id, CAST(extract(hour FROM ts) * 60 + extract(minute FROM ts) AS INTEGER) AS m FROM events),
     h AS (SELECT m, row_number() OVER (ORDER BY m) AS i, sum(n) OVER w AS w, sum(n * m) OVER w AS s, sum(n * m * m) OVER w AS q FROM (SELECT m, CAST(count(*) AS DOUBLE) AS n FROM e GROUP BY m) WINDOW w AS (ORDER BY m)),
     p AS (SELECT * FROM h UNION ALL SELECT -1, 0, 0, 0, 0),
     c AS (SELECT a.i + 1 AS i, b.i AS j, b.q - a.q - (b.s - a.s) * (b.s - a.s) / (b.w - a.w) AS cost FROM p a JOIN p b ON a.i < b.i),
     b1 AS (SELECT j, cost FROM c WHERE i = 1),
     b2 AS (SELECT c.j, min(b1.cost + c.cost) AS cost, arg_min(c.i, b1.cost + c.cost) AS at FROM c JOIN b1 ON b1.j = c.i - 1 GROUP BY c.j),
     b3 AS (SELECT c.j, min(b2.cost + c.cost) AS cost, arg_min(c.i, b2.cost + c.cost) AS at FROM c JOIN b2 ON b2.j = c.i - 1 GROUP BY c.j),
     b4 AS (SELECT c.j, arg_min(c.i, b3.cost + c.cost) AS at FROM c JOIN b3 ON b3.j = c.i - 1 GROUP BY c.j),
     k3 AS (SELECT b4.j AS e3, b4.at AS s3, b3.at AS s2 FROM b4 JOIN b3 ON b3.j = b4.at - 1 WHERE b4.j = (SELECT max(i) FROM h)),
     k AS (SELECT e3, s3, s2, b2.at AS s1 FROM k3 JOIN b2 ON b2.j = s2 - 1),
     r AS (SELECT 0 AS id, 1 AS a, s1 - 1 AS b FROM k UNION ALL SELECT 1, s1, s2 - 1 FROM k UNION ALL SELECT 2, s2, s3 - 1 FROM k UNION ALL SELECT 3, s3, e3 FROM k),
     x AS (SELECT id, a, b, (hi.s - lo.s) / (hi.w - lo.w) AS centre FROM r JOIN p hi ON hi.i = b JOIN p lo ON lo.i = a - 1)
"""


@query(f"""{_CLUSTERED}
SELECT event_id, e.m AS shift_start_minutes, CAST(id AS INTEGER) AS shift_cluster_id, {_BAND_SQL.replace("WHEN m", "WHEN floor(centre)")} AS detected_shift_type,
       round(greatest(0, least(1, 1 - abs(e.m - centre) / 120)) * 100) / 100 AS shift_detection_confidence
FROM e JOIN h ON h.m = e.m JOIN x ON h.i BETWEEN x.a AND x.b""")
def kmeans_buckets(spark, sf_dir):
    """The best four clusters of starts."""
    return clustering.enrich(_starts(spark, sf_dir)).select("event_id", "shift_start_minutes", "shift_cluster_id", "detected_shift_type", "shift_detection_confidence")


@query(f"""
WITH e AS (SELECT event_id, CAST(extract(hour FROM ts) * 60 + extract(minute FROM ts) AS INTEGER) AS m FROM events),
     p AS (SELECT *, CASE WHEN m >= 300 AND m < 720 THEN 0 WHEN m >= 720 AND m < 1020 THEN 1 WHEN m >= 1020 AND m < 1260 THEN 2 ELSE 3 END AS id FROM e),
     c AS (SELECT id, avg(m) AS centre FROM p GROUP BY id)
SELECT event_id, m AS shift_start_minutes, CAST(id AS INTEGER) AS shift_cluster_id, {_BAND_SQL.replace("WHEN m", "WHEN floor(centre)")} AS detected_shift_type, 1.0::DOUBLE AS shift_detection_confidence
FROM p JOIN c USING (id)""")
def rule_buckets(spark, sf_dir):
    """Starts in the four fixed parts of the day."""
    return clustering.enrich(_starts(spark, sf_dir), by_rule=True).select("event_id", "shift_start_minutes", "shift_cluster_id", "detected_shift_type", "shift_detection_confidence")


@query(f"""
WITH e AS (SELECT CAST(extract(hour FROM ts) * 60 + extract(minute FROM ts) AS INTEGER) AS m FROM events)
SELECT {_BAND_SQL} AS band, count(*) AS n, median(m) AS median_start, round(avg((m + 480) % 1440 - m + CASE WHEN (m + 480) % 1440 <= m THEN 1440 ELSE 0 END) / 60, 2) AS mean_hours FROM e GROUP BY 1""")
def shift_median(spark, sf_dir):
    """Median start and mean length; an end before its start is on the next day."""
    m, e = P.minutes_of_day(F.col("shift_start")), P.minutes_of_day(F.col("shift_end"))
    length = F.when(e - m > 0, e - m).otherwise(e - m + 1440)
    rows = _starts(spark, sf_dir).select(m.alias("m"), length.alias("length"))
    return rows.groupBy(clustering.band(F.col("m")).alias("band")).agg(F.count("*").alias("n"), F.median("m").alias("median_start"), P.rounded(F.avg("length") / 60, 2).alias("mean_hours"))


# --- windows of time -----------------------------------------------------------------------------------


@query("""
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_kpi(spark, sf_dir):
    """The streaming plan over a table."""
    return kpi.windowed(_t(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
     s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_kpi(spark, sf_dir):
    out = kpi.sessions(_t(spark, sf_dir, "events"), "6 hours")
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n")
