"""Relational breadth: joins, grouping, frames, sets, nested data and time, over the star schema and the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.plans.registry import query, read


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_discount), 6) as avg_disc, count(*) as n
    from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey
    join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by n_name""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {k: read(spark, sf_dir, k) for k in ("customer", "orders", "lineitem", "supplier", "nation", "region")}
    joined = (
        t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["supplier"], (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("n_name").agg(F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def customers_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = read(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return read(spark, sf_dir, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)")
def customers_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders").where("o_totalprice > 450000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("select n_name, p_brand, count(*) as n from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join part on l_partkey = p_partkey group by cube (n_name, p_brand)")
def cube_nation_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.cube("n_name", "p_brand").agg(F.count("*").alias("n"))


@query("select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by rollup (o_orderstatus, o_orderpriority)")
def rollup_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""select o_orderkey, ntile(4) over w as quarter, round(percent_rank() over w, 6) as pr, round(cume_dist() over w, 6) as cd, dense_rank() over w as dr,
    round(avg(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 4) as moving, first_value(o_orderkey) over w as first_key from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"), F.dense_rank().over(w).cast("long").alias("dr"),
        F.round(F.avg("o_totalprice").over(w.rowsBetween(-2, 0)), 4).alias("moving"), F.first("o_orderkey").over(w).alias("first_key"))


@query("select event_id, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as last_hour from events")
def range_frame_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("sec").rangeBetween(-3_600_000_000, 0)).alias("last_hour"))


@query("select s_nationkey as k from supplier union select c_nationkey from customer")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).union(read(spark, sf_dir, "customer").select("c_nationkey")).distinct()


@query("select p_partkey as k from part except select l_partkey from lineitem where l_quantity > 45")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).subtract(read(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query("select l_suppkey as k from lineitem where l_quantity > 45 intersect all select l_suppkey from lineitem where l_discount > 0.08")
def set_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    return rows.where("l_quantity > 45").select(F.col("l_suppkey").alias("k")).intersectAll(rows.where("l_discount > 0.08").select("l_suppkey"))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over w <= interval 30 minute then 0 else 1 end as new from events window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
    select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by gaps of over 30 minutes: gaps and islands over one sort a user."""
    w = Window.partitionBy("user_id").orderBy("ts")
    new = F.when(F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w) <= 1_800_000_000, 0).otherwise(1)
    k = read(spark, sf_dir, "events").withColumn("new", new).withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return k.groupBy("user_id", "k").agg(F.min("ts").alias("start"), F.count("*").alias("n")).drop("k")


@query("""with c as (select * from events where event_type = 'click'), p as (select * from events where event_type = 'purchase')
    select p.event_id, (select c.event_id from c where c.user_id = p.user_id and c.ts <= p.ts order by c.ts desc, c.event_id desc limit 1) as click_id from p""")
def asof_last_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join by union and one window: the last click at or before each purchase."""
    rows = read(spark, sf_dir, "events").where("event_type in ('click', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "click", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    click = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return rows.withColumn("click_id", click).where("event_type = 'purchase'").select("event_id", "click_id")


@query("select o_orderkey, l_linenumber from orders join lineitem on l_orderkey = o_orderkey and l_shipdate between o_orderdate and o_orderdate + interval 30 day")
def range_join_ship_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return o.join(li, (F.col("l_orderkey") == F.col("o_orderkey")) & F.col("l_shipdate").between(F.col("o_orderdate"), F.expr("o_orderdate + interval 30 days"))).select("o_orderkey", "l_linenumber")


@query("select event_type, count(*) as n, count(distinct user_id) as users, min(length(props)) as shortest, max(length(props)) as longest, sum(len(json_keys(props)))::bigint as keys from events group by event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min(F.length("props").cast("long")).alias("shortest"), F.max(F.length("props").cast("long")).alias("longest"), F.sum(F.size(F.json_object_keys("props"))).alias("keys"))


@query("select source, list_sort(list_distinct(list(lang))) as langs, count(distinct lang) as n_langs, max(n_chars) as longest, arg_max(doc_id, n_chars * 1000000 - doc_id) as longest_id from documents group by source")
def collect_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("source").agg(
        F.sort_array(F.collect_set("lang")).alias("langs"), F.countDistinct("lang").alias("n_langs"), F.max("n_chars").alias("longest"), F.max_by("doc_id", F.col("n_chars") * 1000000 - F.col("doc_id")).alias("longest_id"))


@query("select lang, sum((source = 'src0')::int)::bigint as src0, sum((source = 'src1')::int)::bigint as src1, sum((source = 'src2')::int)::bigint as src2, sum((coalesce(source, '') not in ('src0', 'src1', 'src2'))::int)::bigint as other from documents group by lang")
def pivot_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = ["src0", "src1", "src2"]
    rows = read(spark, sf_dir, "documents").select("lang", F.when(F.col("source").isin(*named), F.col("source")).otherwise("other").alias("source"))
    return rows.groupBy("lang").pivot("source", [*named, "other"]).agg(F.count(F.lit(1))).na.fill(0)


@query("select event_id, date_trunc('day', ts) as day, extract(dow from ts) + 1 as dow, datediff('day', timestamp '2024-01-01', ts) as days from events")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.date_trunc("day", "ts").alias("day"), F.dayofweek("ts").cast("long").alias("dow"), F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("days"))
