"""Registered queries of the event engine over the driver's tables, and the SQL that each must equal.

Orders stand for order events, line items for their updates (return flags N, A, R as statuses 1, 2, 3; ship date as
event time) and events for clicks. Timestamps stay without zone, money is summed as decimal and returned as double.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brookmill.operators import dedup, joins, latest, quality, sla, windows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
FLAG_RANK = {"N": 1, "A": 2, "R": 3}
RANK_SQL = "case l_returnflag when 'N' then 1 when 'A' then 2 when 'R' then 3 end"
TIES = ["l_linenumber", "l_partkey", "l_suppkey"]


def query(sql: str):
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(12,2)")


def as_double(c: Column) -> Column:
    return c.cast("double")


def ranked(items: DataFrame) -> DataFrame:
    return items.withColumn("rk", latest.rank_of("l_returnflag", FLAG_RANK))


# -- scans, filters, scalar functions --------------------------------------------


@query("select l_orderkey as order_id, l_linenumber as line, l_extendedprice as amount, l_shipdate as event_ts from lineitem")
def scan_project(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("amount"), F.col("l_shipdate").alias("event_ts"))


@query("select o_orderkey, o_custkey, o_orderdate::date as event_date from orders where o_orderstatus = 'F'")
def filter_project(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("event_date"))


@query("select event_id, event_type in ('click', 'purchase') as listed from events where event_type not in ('error')")
def in_not_in(spark, d):
    return table(spark, d, "events").where(~F.col("event_type").isin("error")).select("event_id", F.col("event_type").isin("click", "purchase").alias("listed"))


@query("select event_id, user_id, ts from events where ts >= timestamp '2024-01-24 00:00:00'")
def recent_filter(spark, d):
    return table(spark, d, "events").where("ts >= timestamp_ntz '2024-01-24 00:00:00'").select("event_id", "user_id", "ts")


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, {RANK_SQL} as rk from lineitem")
def status_rank(spark, d):
    return ranked(table(spark, d, "lineitem")).select("l_orderkey", *TIES, "rk")


def _judged(spark, d) -> DataFrame:
    rules = [
        quality.unlisted("event_type", ["click", "purchase", "view", "signup"], "UNKNOWN_EVENT_TYPE"),
        quality.Rule("LOW_VALUE", F.col("value") < 10),
        quality.Rule("HIGH_VALUE_CLICK", (F.col("event_type") == "click") & (F.col("value") > 90)),
        quality.absent("user_id", "MISSING_USER"),
    ]
    return quality.apply_rules(table(spark, d, "events"), rules)


JUDGED_SQL = """(select *, list_filter([case when not event_type in ('click', 'purchase', 'view', 'signup') then 'UNKNOWN_EVENT_TYPE' end,
    case when value < 10 then 'LOW_VALUE' end, case when event_type = 'click' and value > 90 then 'HIGH_VALUE_CLICK' end,
    case when user_id is null then 'MISSING_USER' end], lambda x: x is not null) as errors from events)"""


@query(f"select event_id, array_to_string(errors, ',') as codes, len(errors) = 0 as is_valid from {JUDGED_SQL}")
def dq_rules(spark, d):
    return _judged(spark, d).select("event_id", F.array_join("dq_errors", ",").alias("codes"), "is_valid")


@query(f"select len(errors) = 0 as is_valid, count(*) as n from {JUDGED_SQL} group by 1")
def dq_route_counts(spark, d):
    return _judged(spark, d).groupBy("is_valid").agg(F.count("*").alias("n"))


@query(f"select event_type as source, errors[1] as primary_reason, count(*) as n from {JUDGED_SQL} where len(errors) > 0 group by 1, 2 order by 1, 3 desc")
def dlq_breakdown(spark, d):
    _, invalid = quality.route(_judged(spark, d))
    return invalid.groupBy(F.col("event_type").alias("source"), F.get("dq_errors", F.lit(0)).alias("primary_reason")).agg(F.count("*").alias("n")).orderBy("source", F.desc("n"))


@query("select event_id, (props->>'k')::int as k from events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("select event_id, upper(hex(encode(event_type[1:2]))) as head, ('0x' || hex(encode(event_type[1:2])))::int as number, substr(event_type, 3) as tail, length(trim(event_type)) = 0 as blank from events")
def scalar_binary(spark, d):
    value = F.col("event_type").cast("binary")
    head = F.hex(F.substring(value, 1, 2))
    tail = F.substring(value, F.lit(3), F.length("event_type") - 2).cast("string")
    return table(spark, d, "events").select("event_id", head.alias("head"), F.conv(head, 16, 10).try_cast("int").alias("number"), tail.alias("tail"), (F.trim("event_type") == "").alias("blank"))


@query("select event_id, ts::date as event_date, ts + interval 300 seconds as due, date_trunc('millisecond', ts) as in_millis from events")
def scalar_time(spark, d):
    millis = F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp"))).cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", F.to_date("ts").alias("event_date"), (F.col("ts") + F.expr("interval 300 seconds")).alias("due"), millis.alias("in_millis"))


@query("select o_orderkey, greatest(o_totalprice, nullif(o_totalprice, o_totalprice)) as most, least(nullif(o_orderstatus, 'F'), 'M') as least_status, coalesce(nullif(o_orderstatus, 'O'), 'none') as status from orders")
def scalar_null(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.greatest("o_totalprice", F.nullif("o_totalprice", "o_totalprice")).alias("most"),
        F.least(F.nullif("o_orderstatus", F.lit("F")), F.lit("M")).alias("least_status"),
        F.coalesce(F.nullif("o_orderstatus", F.lit("O")), F.lit("none")).alias("status"),
    )


# -- de-duplication, latest rows, merges -------------------------------------------

FIRST_SQL = "select * from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey) = 1"


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate from ({FIRST_SQL})")
def dedup_first(spark, d):
    first = dedup.keep_first(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])
    return first.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


LATEST_SQL = f"select *, {RANK_SQL} as rk from lineitem qualify row_number() over (partition by l_orderkey order by {RANK_SQL} desc, l_shipdate desc, l_linenumber, l_partkey, l_suppkey) = 1"


@query(f"select l_orderkey, rk, l_shipdate, l_linenumber, l_partkey from ({LATEST_SQL})")
def latest_per_key(spark, d):
    return latest.furthest(ranked(table(spark, d, "lineitem")), "l_orderkey", "rk", "l_shipdate", TIES).select("l_orderkey", "rk", "l_shipdate", "l_linenumber", "l_partkey")


@query(f"""select a.l_orderkey, a.rk, f.first_n, f.first_price from ({LATEST_SQL}) a join (
    select l_orderkey, min(case when l_returnflag = 'N' then l_shipdate end) as first_n,
           arg_min(l_extendedprice, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) filter (l_quantity > 10) as first_price
    from lineitem group by 1) f using (l_orderkey)""")
def latest_with_firsts(spark, d):
    items = ranked(table(spark, d, "lineitem")).withColumn("price", F.when(F.col("l_quantity") > 10, F.col("l_extendedprice")))
    last = latest.furthest(items, "l_orderkey", "rk", "l_shipdate", TIES)
    firsts = items.groupBy("l_orderkey").agg(F.min(F.when(F.col("l_returnflag") == "N", F.col("l_shipdate"))).alias("first_n"), latest.first_known("price", ["l_shipdate", *TIES]).alias("first_price"))
    return last.join(firsts, "l_orderkey").select("l_orderkey", "rk", "first_n", "first_price")


SPLIT = "1998-01-01"


def _batches(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two batches: later line items arrive first."""
    early = F.col("l_shipdate") < F.lit(SPLIT).cast("timestamp_ntz")
    return items.where(~early), items.where(early)


@query("select distinct l_orderkey, l_linenumber from lineitem")
def merge_insert_only(spark, d):
    keys = ["l_orderkey", "l_linenumber"]
    target, source = (dedup.keep_first(b.select(*keys, "l_shipdate", "l_partkey", "l_suppkey"), keys, ["l_shipdate", "l_partkey", "l_suppkey"]) for b in _batches(table(spark, d, "lineitem")))
    return target.select(*keys).unionByName(latest.insert_only(target, source, keys).select(*keys))


def _current(batch: DataFrame) -> DataFrame:
    last = latest.furthest(ranked(batch), "l_orderkey", "rk", "l_shipdate", TIES)
    placed = batch.groupBy("l_orderkey").agg(F.min(F.when(F.col("l_returnflag") == "N", F.col("l_shipdate"))).alias("placed_ts"))
    return last.join(placed, "l_orderkey").select(F.col("l_orderkey").alias("order_id"), "rk", F.col("l_shipdate").alias("last_ts"), "placed_ts")


def _current_sql(which: str) -> str:
    return f"""(select l_orderkey as order_id, {RANK_SQL} as rk, l_shipdate as last_ts, min(case when l_returnflag = 'N' then l_shipdate end) over (partition by l_orderkey) as placed_ts
        from lineitem where l_shipdate {which} timestamp '{SPLIT} 00:00:00' qualify row_number() over (partition by l_orderkey order by {RANK_SQL} desc, l_shipdate desc) = 1)"""


MERGED_SQL = f"""select coalesce(a.order_id, b.order_id) as order_id,
    case when a.rk is null or b.rk > a.rk or (b.rk = a.rk and b.last_ts > a.last_ts) then b.rk else a.rk end as rk,
    greatest(a.last_ts, b.last_ts) as last_ts, least(a.placed_ts, b.placed_ts) as placed_ts
    from {_current_sql(">=")} a full join {_current_sql("<")} b on a.order_id = b.order_id"""


def _merged(spark, d) -> DataFrame:
    target, source = (_current(b) for b in _batches(table(spark, d, "lineitem")))
    return latest.forward_only(target, source, "order_id", rank="rk", event_time="last_ts", follow=["rk"], latest=["last_ts"], earliest=["placed_ts"], fill=[])


@query(MERGED_SQL)
def merge_forward_only(spark, d):
    return _merged(spark, d)


@query(f"""select c.order_id, c.rk, m.most from {_current_sql("<")} c
    join (select l_orderkey, max({RANK_SQL}) as most from lineitem group by 1) m on c.order_id = m.l_orderkey where c.rk < m.most""")
def regression_check(spark, d):
    """Orders whose state lags behind their events: here the state after the second batch alone."""
    items = table(spark, d, "lineitem")
    current = _current(_batches(items)[1]).select("order_id", "rk")
    most = ranked(items).groupBy("l_orderkey").agg(F.max("rk").alias("most"))
    return current.join(most, current["order_id"] == most["l_orderkey"]).where("rk < most").select("order_id", "rk", "most")


# -- joins --------------------------------------------------------------------------


@query("""select c.event_id as click_id, p.event_id as purchase_id, p.event_id is not null as converted,
    epoch_us(p.ts - c.ts) / 1e6 as seconds_to_order
    from (select * from events where event_type = 'click') c left join (select * from events where event_type = 'purchase') p
    on c.user_id = p.user_id and p.ts >= c.ts and p.ts <= c.ts + interval 6 hours""".replace("epoch_us(p.ts - c.ts)", "(epoch_us(p.ts) - epoch_us(c.ts))"))
def interval_join_left(spark, d):
    events = table(spark, d, "events")
    clicks = events.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("click_ts"))
    buys = events.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("buyer"), F.col("ts").alias("buy_ts"))
    joined = joins.interval_join(clicks, buys, [("user_id", "buyer")], "click_ts", "buy_ts", 6 * 3600)
    return joined.select("click_id", "purchase_id", F.col("purchase_id").isNotNull().alias("converted"), windows.seconds("buy_ts", "click_ts").alias("seconds_to_order"))


@query("select distinct user_id from events where event_type = 'error' and user_id not in (select user_id from events where event_type = 'signup' and ts >= timestamp '2024-01-20 00:00:00')")
def open_breaches_anti(spark, d):
    events = table(spark, d, "events")
    closed = events.where("event_type = 'signup' and ts >= timestamp_ntz '2024-01-20 00:00:00'").select("user_id")
    return events.where("event_type = 'error'").select("user_id").join(closed, "user_id", "left_anti").distinct()


# -- windows and aggregates -----------------------------------------------------------

TUMBLED_SQL = """(select time_bucket(interval 1 hour, ts) as window_start, time_bucket(interval 1 hour, ts) + interval 1 hour as window_end, event_type, count(*) as events,
    count(case when event_type = 'purchase' then 1 end) as placed, coalesce(sum(case when event_type = 'purchase' then value::decimal(12,2) end), 0)::double as gmv
    from events group by all)"""


def _tumbled(spark, d) -> DataFrame:
    buys = F.col("event_type") == "purchase"
    measures = [F.count("*").alias("events"), windows.count_where(buys, "placed"), as_double(F.coalesce(F.sum(F.when(buys, money("value"))), F.lit(0).cast("decimal(12,2)"))).alias("gmv")]
    return windows.windowed(table(spark, d, "events"), "ts", "1 hour", ["event_type"], measures)


@query(f"select * from {TUMBLED_SQL}")
def tumbling_metrics(spark, d):
    return _tumbled(spark, d)


@query("""select w as window_start, w + interval 2 hours as window_end, event_type, count(*) as events from
    (select event_type, time_bucket(interval 1 hour, ts) - to_hours(k) as w from events, (values (0), (1)) o(k)) group by all""")
def sliding_window(spark, d):
    return windows.windowed(table(spark, d, "events"), "ts", "2 hours", ["event_type"], [F.count("*").alias("events")], slide="1 hour")


@query("""with g as (select *, case when ts - lag(ts) over w > interval 6 hours or lag(ts) over w is null then 1 else 0 end as opens from events window w as (partition by user_id order by ts, event_id)),
    s as (select *, sum(opens) over (partition by user_id order by ts, event_id) as n from g)
    select min(ts) as session_start, max(ts) + interval 6 hours as session_end, user_id, count(*) as events, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as active_seconds,
           bool_or(event_type = 'view') as viewed, bool_or(event_type = 'purchase') as bought, count(distinct event_type) as kinds from s group by user_id, n""")
def session_metrics(spark, d):
    kind = F.col("event_type")
    measures = [F.count("*").alias("events"), F.min("ts").alias("_a"), F.max("ts").alias("_b"), windows.any_where(kind == "view", "viewed"), windows.any_where(kind == "purchase", "bought"), F.size(F.collect_set(kind)).cast("long").alias("kinds")]
    found = windows.sessions(table(spark, d, "events"), "ts", "6 hours", ["user_id"], measures)
    return found.withColumn("active_seconds", windows.seconds("_b", "_a")).drop("_a", "_b")


@query("select event_type, count(distinct user_id) as users, count(distinct case when value > 50 then user_id end) as spenders from events group by 1")
def distinct_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("spenders"))


@query("select distinct event_type, true as close from events")
def approx_distinct(spark, d):
    """The sketch that streams use, held against the exact count: SQL states that all must be close."""
    both = table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("a"), F.countDistinct("user_id").alias("e"))
    return both.select("event_type", (F.abs(F.col("a") - F.col("e")) <= 0.15 * F.col("e")).alias("close"))


@query("select distinct user_id, event_type from events")
def distinct_keys(spark, d):
    return table(spark, d, "events").select("user_id", "event_type").distinct()


@query(f"select window_start, sum(placed)::bigint as orders, round(sum(gmv), 2) as gmv from {TUMBLED_SQL} group by 1")
def rollup_per_minute(spark, d):
    return _tumbled(spark, d).groupBy("window_start").agg(F.sum("placed").alias("orders"), F.round(F.sum("gmv"), 2).alias("gmv"))


@query(f"select event_type, sum(events)::bigint as events, round(sum(gmv), 2) as gmv from {TUMBLED_SQL} group by 1")
def rollup_per_zone(spark, d):
    return _tumbled(spark, d).groupBy("event_type").agg(F.sum("events").alias("events"), F.round(F.sum("gmv"), 2).alias("gmv"))


@query(f"select sum(placed)::bigint as orders, round(sum(gmv), 2) as gmv from {TUMBLED_SQL}")
def kpi_totals(spark, d):
    return _tumbled(spark, d).agg(F.sum("placed").alias("orders"), F.round(F.sum("gmv"), 2).alias("gmv"))


@query("select round(avg((event_type = 'purchase')::int), 6) as rate from events where event_type in ('click', 'purchase')")
def conversion_rate(spark, d):
    return table(spark, d, "events").where("event_type in ('click', 'purchase')").agg(F.round(F.avg((F.col("event_type") == "purchase").cast("int")), 6).alias("rate"))


@query("select o_orderpriority, round(quantile_cont(o_totalprice, 0.95), 4) as p95 from orders group by 1")
def latency_p95(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.percentile("o_totalprice", 0.95), 4).alias("p95"))


@query("select o_orderstatus, count(*) as n from orders where o_orderdate >= timestamp '1996-01-01 00:00:00' group by 1")
def status_counts(spark, d):
    return table(spark, d, "orders").where("o_orderdate >= timestamp_ntz '1996-01-01 00:00:00'").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_orderdate, round(o_totalprice / 60, 1) as minutes from orders where o_orderstatus = 'O' order by o_orderdate desc, o_orderkey limit 15")
def topk_open(spark, d):
    """A report of fifteen rows, as asked for."""
    return table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(15).select("o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") / 60, 1).alias("minutes"))


LATEST_EVENT_SQL = "select * from events qualify row_number() over (partition by event_type order by ts desc, event_id desc) = 1"


@query(f"select event_type, event_id, ts, value from ({LATEST_EVENT_SQL})")
def latest_per_group(spark, d):
    return dedup.keep_first(table(spark, d, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_type", "event_id", "ts", "value")


@query(f"select l.user_id, l.event_id, d.dropped from (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) l left join (select user_id, count(*) as dropped from events where event_type = 'error' group by 1) d using (user_id)")
def latest_left_join(spark, d):
    events = table(spark, d, "events")
    last = dedup.keep_first(events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")
    return last.join(events.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("dropped")), "user_id", "left")


@query("select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n <= 40")
def tail_per_group(spark, d):
    """The last forty lines of each series, as the metrics reader takes them."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n <= 40").select("user_id", "event_id", "ts")


@query("""select o_orderkey as id, o_custkey as customer, cast(null as varchar) as payment_method, 1 as version from orders where o_orderkey % 2 = 0
    union all select o_orderkey, o_custkey, o_orderpriority, 2 from orders where o_orderkey % 2 = 1""")
def union_versions(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("payment_method"))
    old = orders.where("id % 2 = 0").drop("payment_method").withColumn("version", F.lit(1))
    new = orders.where("id % 2 = 1").withColumn("version", F.lit(2))
    return old.unionByName(new, allowMissingColumns=True)


VIEWS_SQL = """select r_name, n_name, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name, n_name"""


@query(VIEWS_SQL)
def sql_views(spark, d):
    names = {n: table(spark, d, n) for n in ("customer", "nation", "region")}
    return spark.sql(VIEWS_SQL.replace("customer\n", "{customer}\n").replace("join nation", "join {nation}").replace("join region", "join {region}"), **names)


@query("""with h as (select o_orderkey as order_id, min(o_orderdate) as placed_ts, min(l_shipdate) as delivered from orders left join lineitem on l_orderkey = o_orderkey group by 1),
    late as (select *, placed_ts + interval 30 days as due from h where delivered is null or delivered > placed_ts + interval 30 days)
    select order_id, 'SLA_BREACH' as alert_type, placed_ts, due as detected_at, 2592000.0::double as open_seconds from late
    union all select order_id, 'DELIVERED_AFTER_BREACH', placed_ts, delivered, (epoch_us(delivered) - epoch_us(placed_ts)) / 1e6 from late where delivered is not null""")
def sla_replay(spark, d):
    """The state machine itself over orders (PLACED) and line items (DELIVERED); finished orders are never forgotten."""
    nothing = {c: F.lit(None).cast("string") for c in ("zone", "restaurant_id")}
    placed = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.lit("PLACED").alias("status"), F.col("o_orderdate").alias("event_ts"))
    delivered = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.lit("DELIVERED").alias("status"), F.col("l_shipdate").alias("event_ts"))
    alerts = sla.replayed(placed.unionByName(delivered).withColumns(nothing), 30 * 86_400, 36_500 * 86_400)
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("placed_ts", "detected_at")]
    return alerts.select(F.col("order_id").cast("long").alias("order_id"), "alert_type", *times, "open_seconds")


# -- the rules of orders and clicks -----------------------------------------------------

ORDER_ROWS = """(select o_orderkey, case when o_orderkey % 97 = 0 then ' ' else 'E' end as event_id, case when o_orderkey % 89 = 0 then null else 'O' end as order_id,
    case when o_orderkey % 83 = 0 then '' else 'C' end as customer_id, case when o_orderkey % 79 = 0 then '  ' else o_orderpriority end as zone,
    case o_orderstatus when 'O' then 'PLACED' when 'F' then 'DELIVERED' when 'P' then 'LOST' end as status,
    cast(case when o_orderkey % 73 = 0 then -o_totalprice when o_orderkey % 71 = 0 then null else o_totalprice end as decimal(12,2)) as amount,
    case when o_orderkey % 67 = 0 then null when o_orderkey % 61 = 0 then o_orderdate + interval '301' second when o_orderkey % 59 = 0 then o_orderdate + interval '300' second else o_orderdate end as event_ts,
    o_orderdate as kafka_ts from {orders})"""
CLICK_ROWS = """(select event_id as id, case when event_id % 97 = 0 then ' ' else 'E' end as event_id, case when event_id % 89 = 0 then null else 'S' end as session_id,
    case when event_id % 83 = 0 then '' else 'C' end as customer_id, case event_type when 'click' then 'search' when 'view' then 'view_restaurant' when 'purchase' then 'checkout_started' when 'signup' then 'app_open' end as event_type,
    case when event_id % 67 = 0 then null when event_id % 61 = 0 then ts + interval '301' second else ts end as event_ts, ts as kafka_ts from {events})"""


def _codes_sql(key: str, rows: str, rules: dict[str, str]) -> str:
    cases = ", ".join(f"case when {violated} then '{code}' end" for code, violated in rules.items())
    return f"select {key}, array_to_string(list_filter([{cases}], lambda x: x is not null), ',') as codes from {rows}"


MISSING = "{0} is null or trim({0}) = ''"
FUTURE = "event_ts > kafka_ts + interval 300 seconds"
ORDER_RULES_SQL = {f"MISSING_{c.upper()}": MISSING.format(c) for c in ("event_id", "order_id", "customer_id", "zone")} | {
    "UNKNOWN_STATUS": "coalesce(status, '') not in ('PLACED', 'ACCEPTED', 'PICKED_UP', 'DELIVERED', 'CANCELLED')",
    "NEGATIVE_AMOUNT": "amount < 0",
    "MISSING_AMOUNT_ON_PLACED": "status = 'PLACED' and amount is null",
    "MISSING_EVENT_TS": "event_ts is null",
    "FUTURE_EVENT_TS": FUTURE,
}
CLICK_RULES_SQL = {f"MISSING_{c.upper()}": MISSING.format(c) for c in ("event_id", "session_id", "customer_id")} | {
    "UNKNOWN_EVENT_TYPE": "coalesce(event_type, '') not in ('app_open', 'search', 'view_restaurant', 'add_to_cart', 'checkout_started')",
    "MISSING_EVENT_TS": "event_ts is null",
    "FUTURE_EVENT_TS": FUTURE,
}


def _coded(rows: DataFrame, key: str, rules: list) -> DataFrame:
    return quality.apply_rules(rows, rules).select(key, F.array_join("dq_errors", ",").alias("codes"))


@query(_codes_sql("o_orderkey", ORDER_ROWS.format(orders="orders"), ORDER_RULES_SQL))
def order_rules(spark, d):
    """The nine rules of orders over all orders, in which some keys carry a fault."""
    return _coded(spark.sql(f"select * from {ORDER_ROWS}", orders=table(spark, d, "orders")), "o_orderkey", quality.order_rules(300))


@query(_codes_sql("id", CLICK_ROWS.format(events="events"), CLICK_RULES_SQL))
def click_rules(spark, d):
    """The six rules of clicks over all events, in which some ids carry a fault."""
    return _coded(spark.sql(f"select * from {CLICK_ROWS}", events=table(spark, d, "events")), "id", quality.click_rules(300))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
