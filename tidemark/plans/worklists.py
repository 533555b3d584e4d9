"""Review queues, listings, batches, validation and simulation results: queries with their DuckDB oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidemark.operators import aggregates, filters, joins, orders
from tidemark.plans import coverage, simulation, validation
from tidemark.plans.queries import _ANALYSIS, NAMES, YEARS, _candidates, _year, cross_validate, query, table


def _modes(parts: dict) -> object:
    """The parts under one another, each with its name as `mode`."""
    return reduce(lambda x, y: x.unionByName(y), [df.select(F.lit(name).alias("mode"), "*") for name, df in parts.items()])


# --- filters ---


@query("""
with s as (select s_suppkey, s_nationkey, r_name, n_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select 'ids' as mode, s_suppkey from s where s_suppkey in (2, 3, 5, 8) union all select 'universities', s_suppkey from s where s_nationkey in (1, 4, 9)
union all select 'places', s_suppkey from s where r_name in ('ASIA', 'EUROPE', 'R1', 'R3') union all select 'all', s_suppkey from s
""")
def candidate_filters(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    s = table(spark, sf, "supplier").join(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), F.col("s_nationkey") == F.col("n_nationkey"))
    asked = {
        "ids": {"unit_ids": (2, 3, 5, 8), "university_ids": (1,), "regions": ("ASIA",)},
        "universities": {"university_ids": (1, 4, 9), "regions": ("ASIA",)},
        "places": {"regions": ("ASIA", "EUROPE", "R1", "R3")},
        "all": {},
    }
    cols = [F.col(c) for c in ("s_suppkey", "s_nationkey", "r_name", "n_name")]
    return _modes({name: s.filter(filters.candidate_filter(*cols, **how)).select("s_suppkey") for name, how in asked.items()})


@query("select o_orderkey, year(o_orderdate) as year from orders where year(o_orderdate) = 1998 and o_orderstatus <> 'F'")
def rule_filter(spark, sf):
    return table(spark, sf, "orders").withColumn("year", _year("o_orderdate")).filter("year = 1998 and o_orderstatus <> 'F'").select("o_orderkey", F.col("year").cast("long").alias("year"))


@query("select o_orderkey, case when o_orderkey % 3 <> 0 then o_totalprice / 300000 between 0.2 and 1.2 else o_totalprice / 3000 between 20 and 100 end as fits from orders")
def outcome_compatibility(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", filters.outcome_fits(F.col("o_orderkey") % 3 != 0, F.lit(300000.0), price, price / 3000).alias("fits"))


@query("""
with t as (select c_custkey, case when c_custkey % 3 = 0 then c_name else substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21, 12) end as x from customer)
select c_custkey, case when c_custkey % 3 <> 0 then x end as id from t
""")
def uuid_guard(spark, sf):
    h = F.md5("c_name")
    dashed = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return table(spark, sf, "customer").select("c_custkey", filters.uuid_or_null(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(dashed)).alias("id"))


@query("""
with e as (select event_id, event_type = 'error' as open, value < 30 as uncertain from events)
select 'pending' as mode, event_id from e where open union all select 'decided', event_id from e where not open union all select 'uncertain', event_id from e where uncertain and not open
""")
def queue_filters(spark, sf):
    e, verdict = table(spark, sf, "events"), F.when(F.col("event_type") != "error", F.col("event_type"))
    asked = {"pending": {"pending": True}, "decided": {"decided": True}, "uncertain": {"decided": True, "only_uncertain": True}}
    return _modes({name: e.filter(filters.in_queue(verdict, F.col("value") < 30, **how)).select("event_id") for name, how in asked.items()})


@query("select o_orderkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus in ('O', 'P')")
def urgent_review(spark, sf):
    return table(spark, sf, "orders").filter((F.col("o_orderpriority") == "1-URGENT") & F.col("o_orderstatus").isin("O", "P")).select("o_orderkey")


@query("""
select l_partkey, l_orderkey, l_extendedprice from lineitem where year(l_shipdate) < 2000 and (l_quantity > 40 or l_discount > 0.08) and l_orderkey in (select o_orderkey from orders where o_orderstatus = 'O')
qualify row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) = 1
""")
def seeded_outcomes(spark, sf):
    parent = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    keep = (_year("l_shipdate") < 2000) & ((F.col("l_quantity") > 40) | (F.col("l_discount") > 0.08))
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate"]
    return filters.seeded(table(spark, sf, "lineitem"), parent, "l_orderkey", "l_partkey", keep, order).select("l_partkey", "l_orderkey", "l_extendedprice")


@query("select doc_id from documents where not regexp_matches(text, '[Ll]icen[sc]e') or regexp_matches(text, 'MIT|GNU')")
def noise_filter(spark, sf):
    return table(spark, sf, "documents").filter(filters.not_blocked(F.col("text"), "[Ll]icen[sc]e", "MIT|GNU")).select("doc_id")


@query("""
with y as (select o_custkey, list_sort(list(distinct year(o_orderdate)) filter (o_orderstatus = 'F')) as explicit, list_sort(list(distinct year(o_orderdate)) filter (o_orderstatus = 'P')) as collected from orders group by all)
select o_custkey, array_to_string(case when len(coalesce(explicit, [])) > 0 then explicit when len(coalesce(collected, [])) = 1 then collected else [] end, '|') as years from y
""")
def inferred_years(spark, sf):
    years = lambda status: F.sort_array(F.collect_set(F.when(F.col("o_orderstatus") == status, _year("o_orderdate"))))
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(years("F").alias("explicit"), years("P").alias("collected"))
    return g.select("o_custkey", F.array_join(filters.inferred_years(F.col("explicit"), F.col("collected")).cast("array<string>"), "|").alias("years"))


# --- joins ---


@query("select n_nationkey from nation where exists (select 1 from supplier where s_nationkey = n_nationkey and s_acctbal > 5000)")
def active_universities(spark, sf):
    units = table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf, "nation").join(units, "n_nationkey", "left_semi").select("n_nationkey")


@query("""
with c as (select c_custkey, c_nationkey, nullif(c_mktsegment, 'BUILDING') as segment, c_acctbal from customer)
select c_custkey from c where exists (select 1 from c d where d.c_acctbal > 9000 and d.c_nationkey is not distinct from c.c_nationkey and d.segment is not distinct from c.segment)
""")
def same_place_ids(spark, sf):
    c = table(spark, sf, "customer").withColumn("segment", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return joins.same_place(c.filter("c_acctbal > 9000"), c, ["c_nationkey", "segment"], "c_custkey").select("c_custkey")


@query("""
with s as (select s_suppkey, s_nationkey, s_acctbal > 5000 as rich from supplier)
select a.s_suppkey, coalesce((select string_agg(b.s_suppkey::varchar, '|' order by b.s_suppkey) from s b where b.s_nationkey = a.s_nationkey and b.rich = a.rich and b.s_suppkey <> a.s_suppkey), '') as siblings from s a
""")
def cluster_siblings(spark, sf):
    s = table(spark, sf, "supplier").withColumn("rich", F.col("s_acctbal") > 5000)
    return joins.siblings(s, ["s_nationkey", "rich"], "s_suppkey").select("s_suppkey", F.array_join(F.col("siblings").cast("array<string>"), "|").alias("siblings"))


@query("""
select c_custkey, e.o_orderkey as evidence, p.o_orderkey as proposal, d.event_type as verdict from customer
left join (select * from orders where o_orderstatus = 'F' qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) = 1) e on e.o_custkey = c_custkey
left join (select * from orders where o_orderstatus = 'O' qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1) p on p.o_custkey = c_custkey
left join (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) d on d.user_id = c_custkey
""")
def queue_evidence(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    sides = {
        "evidence": (o.filter("o_orderstatus = 'F'"), [F.desc("o_orderdate"), "o_orderkey"]),
        "proposal": (o.filter("o_orderstatus = 'O'"), [F.desc("o_totalprice"), "o_orderkey"]),
        "decision": (table(spark, sf, "events").withColumnRenamed("user_id", "c_custkey"), [F.desc("ts"), F.desc("event_id")]),
    }
    found = joins.with_each_latest(table(spark, sf, "customer"), sides, "c_custkey")
    return found.select("c_custkey", F.col("evidence_o_orderkey").alias("evidence"), F.col("proposal_o_orderkey").alias("proposal"), F.col("decision_event_type").alias("verdict"))


@query("select s_suppkey, s_suppkey in (select l_suppkey from lineitem where l_quantity = 50 and l_discount = 0) as found from supplier")
def skipped_candidates(spark, sf):
    known = table(spark, sf, "lineitem").filter("l_quantity = 50 and l_discount = 0").select(F.col("l_suppkey").alias("s_suppkey"))
    return joins.split_by(table(spark, sf, "supplier"), known, "s_suppkey").select("s_suppkey", "found")


@query("""
with o as (select c_nationkey, year(o_orderdate) as year, o_orderstatus, o_totalprice from orders join customer on o_custkey = c_custkey),
n as (select c_nationkey, year, count(*) as n from o where o_orderstatus = 'P' and o_totalprice > 300000 group by all),
g as (select n_nationkey, y.year, coalesce(n.n, 0) as n from nation cross join (select unnest(range(1995, 2002)) as year) y left join n on c_nationkey = n_nationkey and n.year = y.year)
select n_nationkey, year, (case when n = 0 and year in (select year from o where o_totalprice > 400000) then 1 else n end)::bigint as n from g
""")
def national_schedule(spark, sf):
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    o = table(spark, sf, "orders").withColumn("year", _year("o_orderdate")).join(people, "o_custkey")
    cells = joins.scaffold(table(spark, sf, "nation"), YEARS, "year", {"n": o.filter("o_orderstatus = 'P' and o_totalprice > 300000")}, "n_nationkey")
    return joins.with_national(cells, o.filter("o_totalprice > 400000"), "year", "n").select("n_nationkey", F.col("year").cast("long").alias("year"), F.col("n").cast("long").alias("n"))


@query("""
with g as (select n_nationkey, y.year, n_nationkey * 10000 + y.year as gap from nation cross join (select unnest(range(1995, 2002)) as year) y),
s as (select s_suppkey, s_nationkey, 1995 + s_suppkey % 7 as a, 1995 + (s_suppkey // 7) % 7 as b, 1995 + (s_suppkey // 49) % 7 as c, s_acctbal from supplier),
i as (select gap, s_suppkey, min(via) as via from (select gap, s_suppkey, 0 as via from g join s on s_nationkey = n_nationkey and a = year union all select gap, s_suppkey, 1 from g join s on s_nationkey = n_nationkey and b = year union all select gap, s_suppkey, 2 from g join s on s_nationkey = n_nationkey and c = year) group by all),
few as (select gap, n_nationkey from g left join (select gap, count(*) as n from i group by gap) using (gap) where coalesce(n, 0) < 3)
select gap, s_suppkey, via from i union all select gap, s_suppkey, 3 from few join s on s_nationkey = n_nationkey where s_acctbal >= 7000 and (gap, s_suppkey) not in (select (gap, s_suppkey) from i)
""")
def source_indexes(spark, sf):
    gaps = table(spark, sf, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, YEARS))).alias("year")).withColumn("gap", F.col("n_nationkey").cast("long") * 10000 + F.col("year"))
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    years = [(1995 + F.floor(k / d) % 7).cast("int").alias("year") for d in (1, 7, 49)]
    indexes = [(s.select("n_nationkey", "s_suppkey", y), ["n_nationkey", "year"]) for y in years]
    last = s.filter("s_acctbal >= 7000").select("n_nationkey", "s_suppkey")
    return joins.by_indexes(gaps, "gap", indexes, (last, ["n_nationkey"]), 3, "s_suppkey")


@query("""
with t as (select o_orderkey, event_id, case when event_type = 'purchase' and value > 50 then 0 when event_type = 'view' then 1 when value > 90 then 2 end as scope from orders join events on user_id = o_custkey)
select o_orderkey, scope, event_id from orders left join (select * from t where scope is not null qualify row_number() over (partition by o_orderkey order by scope, event_id) = 1) using (o_orderkey)
""")
def scoped_tracks(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    kind, value = F.col("event_type"), F.col("value")
    scopes = [(kind == "purchase") & (value > 50), kind == "view", value > 90]
    return joins.first_scoped(rows, table(spark, sf, "events"), "user_id", "o_orderkey", scopes, ["event_id"]).select("o_orderkey", "scope", "event_id")


# --- aggregates ---


@query("select count(*) filter (agreement = 'agree') as n_agree, count(*) filter (agreement = 'near') as n_near, count(*) filter (agreement = 'disagree') as n_disagree, count(*) filter (agreement = 'uncertain') as n_uncertain from (" + NAMES["cross_validate"][1] + ")")
def agreement_totals(spark, sf):
    return cross_validate(spark, sf).agg(*aggregates.dense_counts("agreement", ("agree", "near", "disagree", "uncertain")))


@query("select user_id, count(*) as total, count(*) filter (event_type <> 'error') as decided, count(*) filter (event_type = 'error') as pending, count(*) filter (value < 30) as uncertain from events group by user_id")
def reviewer_counts(spark, sf):
    n = lambda c, name: F.count_if(c).alias(name)
    error = F.col("event_type") == "error"
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("total"), n(~error, "decided"), n(error, "pending"), n(F.col("value") < 30, "uncertain"))


@query("select n_nationkey, count(s_suppkey) as units from nation left join supplier on s_nationkey = n_nationkey group by n_nationkey")
def units_per_university(spark, sf):
    counts = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("units"))
    return table(spark, sf, "nation").join(counts, "n_nationkey", "left").select("n_nationkey", F.coalesce("units", F.lit(0)).alias("units"))


@query("""
with b as (select *, 'u' || o_custkey % 40 as url, case when o_orderstatus = 'F' then 'core' when o_orderstatus = 'O' then 'schedule' else 'other' end as lane from orders),
k as (select *, case lane when 'core' then o_orderpriority || '|' || year(o_orderdate) when 'schedule' then year(o_orderdate)::varchar else o_orderpriority end as batch_key from b),
u as (select lane, batch_key, url, min(o_orderkey) as seen from k group by all), us as (select lane, batch_key, array_to_string(list_slice(list(url order by seen, url), 1, 5), '|') as urls from u group by all)
select lane, batch_key, count(*) as n, max(o_totalprice) as best, array_to_string(list_slice(list(o_orderkey order by o_orderkey), 1, 20), '|') as ids, any_value(urls) as urls from k join us using (lane, batch_key) group by lane, batch_key
""")
def review_batches(spark, sf):
    o = table(spark, sf, "orders").withColumn("url", F.concat(F.lit("u"), (F.col("o_custkey") % 40).cast("string")))
    lane = F.when(F.col("o_orderstatus") == "F", "core").when(F.col("o_orderstatus") == "O", "schedule").otherwise("other")
    priority, year = F.col("o_orderpriority"), _year("o_orderdate")
    keyed = aggregates.keyed_by_lane(o, lane, {"core": [priority, year], "schedule": [year], "other": [priority]})
    found = aggregates.batched(keyed, ["lane", "batch_key"], "o_orderkey", "url", "o_totalprice")
    return found.withColumns({"ids": F.array_join(F.col("ids").cast("array<string>"), "|"), "urls": F.array_join("urls", "|")})


@query("""
select l_returnflag, l_linestatus, year(l_shipdate) as year, l_linenumber, count(*) as n, sum(l_quantity) as quantity, max(l_extendedprice) as best, count(distinct l_suppkey) as suppliers, min(l_orderkey) as first from lineitem group by all
""")
def crawler_worklist(spark, sf):
    group = ["l_returnflag", "l_linestatus", _year("l_shipdate").cast("long").alias("year"), "l_linenumber"]
    return table(spark, sf, "lineitem").groupBy(*group).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("best"), F.count_distinct("l_suppkey").alias("suppliers"), F.min("l_orderkey").alias("first"))


@query("""
select user_id, event_type, count(*) as n, max(value) as best, array_to_string(list_sort(list(distinct dayofmonth(ts))), '|') as days from events where value > 20 group by all
""")
def release_targets(spark, sf):
    days = F.array_join(F.sort_array(F.collect_set(F.dayofmonth("ts"))).cast("array<string>"), "|")
    return table(spark, sf, "events").filter("value > 20").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("best"), days.alias("days"))


@query("""
with r as (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders)
select o_custkey, max(case when k = 1 then o_orderkey end) as o_orderkey, count(*) as n, array_to_string(list_sort(list(distinct o_orderpriority)), '|') as o_orderpriority from r group by o_custkey
""")
def visual_queue(spark, sf):
    found = aggregates.head_and_union(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], ["o_orderkey"], "o_orderpriority")
    return found.withColumn("o_orderpriority", F.array_join("o_orderpriority", "|"))


@query("""
with r as (select md5(text) as sha, doc_id, source, row_number() over (partition by md5(text) order by doc_id) as k from documents)
select sha, count(*) as n, count(distinct source) as sources, string_agg(doc_id::varchar, '|' order by doc_id) filter (k <= 5) as sample from r group by sha
""")
def image_reference_stats(spark, sf):
    r = table(spark, sf, "documents").select(F.md5("text").alias("sha"), "doc_id", "source")
    r = r.withColumn("k", F.row_number().over(Window.partitionBy("sha").orderBy("doc_id")))
    sample = F.array_join(F.sort_array(F.collect_list(F.when(F.col("k") <= 5, F.col("doc_id")))).cast("array<string>"), "|")
    return r.groupBy("sha").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), sample.alias("sample"))


@query("select 'o_orderstatus' as dimension, o_orderstatus as value, count(*) as n from orders group by all union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by all union all select 'year', year(o_orderdate)::varchar, count(*) from orders group by all")
def summary_counts(spark, sf):
    return aggregates.tally(table(spark, sf, "orders").withColumn("year", _year("o_orderdate")), ["o_orderstatus", "o_orderpriority", "year"])


@query("select event_id, last_value(case when event_type in ('signup', 'purchase') then event_type end ignore nulls) over (partition by user_id order by ts, event_id) as nearest from events")
def nearest_group(spark, sf):
    from tidemark.operators.windows import forward_fill

    mentions = F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type"))
    return forward_fill(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], {"nearest": mentions}).select("event_id", "nearest")


# --- listings: an order and a cut ---


@query("""
select 'gap' as mode, id from (select s_suppkey as id from supplier order by nullif(s_acctbal, 0) desc nulls last, s_suppkey limit 40)
union all select 'readiness', id from (select o_orderkey as id from orders order by list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], o_orderpriority) asc nulls last, o_totalprice > 200000 desc, o_orderdate, o_orderstatus, o_orderkey limit 80)
union all select 'queue', id from (select event_id as id from events order by coalesce(case when event_type <> 'error' then value end, -1) desc, event_type, event_id limit 500)
union all select 'saved', id from (select event_id as id from events order by case when event_type <> 'error' then value end asc nulls last, ts desc, event_id limit 200)
union all select 'created', id from (select event_id as id from events order by ts, event_id limit 100)
union all select 'series', id from (select o_custkey as id from orders group by o_custkey order by count(distinct year(o_orderdate)) desc, count(*) desc, o_custkey limit 60)
union all select 'actions', id from (select o_orderkey as id from orders order by list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], o_orderpriority) asc nulls last, o_totalprice desc, year(o_orderdate) desc, o_orderstatus, o_orderkey limit 90)
union all select 'drafts', id from (select o_orderkey as id from orders order by year(o_orderdate) < 1999, year(o_orderdate) desc, o_orderstatus, o_totalprice desc, o_orderkey limit 70)
""")
def listings(spark, sf):
    return _modes({name: df.orderBy(*order).limit(k).select(F.col(id_col).alias("id")) for name, (df, order, id_col, k) in listing_parts(spark, sf).items()})


def listing_parts(spark, sf) -> dict:
    """Of each listing: rows, order, id column and limit."""
    s, o, e = (table(spark, sf, t) for t in ("supplier", "orders", "events"))
    tiers = ("1-URGENT", "2-HIGH", "3-MEDIUM")
    o = o.withColumn("year", _year("o_orderdate"))
    e = e.withColumn("priority", F.when(F.col("event_type") != "error", F.col("value")))
    series = o.groupBy("o_custkey").agg(F.count_distinct("year").alias("years"), F.count("*").alias("rows"))
    tier = orders.rank_in(F.col("o_orderpriority"), tiers)
    return {
        "gap": (s.withColumn("gap", F.nullif(F.col("s_acctbal"), F.lit(0.0))), orders.by_gap("gap", "s_suppkey"), "s_suppkey", filters.limit_of(40, 20, 80)),
        "readiness": (o, orders.by_readiness(tier, F.col("o_totalprice") > 200000, "o_orderdate", ["o_orderstatus"], "o_orderkey"), "o_orderkey", filters.limit_of(400, 20, 80)),
        "queue": (e, orders.by_priority_or_last("priority", "event_type", "event_id"), "event_id", filters.limit_of(None, 500, 2000)),
        "saved": (e, orders.by_saved("priority", "ts", "event_id"), "event_id", 200),
        "created": (e, orders.by_created("ts", "event_id"), "event_id", 100),
        "series": (series, orders.by_series("years", "rows", ["o_custkey"]), "o_custkey", 60),
        "actions": (o, [*orders.by_gap_action("o_orderpriority", tiers, "o_totalprice", "year", "o_orderstatus", "o_orderkey")], "o_orderkey", 90),
        "drafts": (o, orders.by_draft((F.col("year") < 1999).cast("int"), "year", "o_orderstatus", "o_totalprice", "o_orderkey"), "o_orderkey", 70),
    }


@query("with c as (select o_custkey, unnest([o_orderstatus, o_orderpriority]) as code from orders), n as (select o_custkey, code, count(*) as n from c group by all) select o_custkey, code, n from n qualify row_number() over (partition by o_custkey order by n desc, code) <= 5")
def top_reasons(spark, sf):
    from tidemark.operators.windows import top_k

    codes = table(spark, sf, "orders").select("o_custkey", F.explode(F.array("o_orderstatus", "o_orderpriority")).alias("code"))
    return top_k(codes.groupBy("o_custkey", "code").agg(F.count("*").alias("n")), ["o_custkey"], [F.desc("n"), "code"], 5)


# --- scores of evidence, classes of reviews ---

_TYPES, _ROLES, _LINKS = ("workbook_row", "workbook_sheet", "pdf_page_image", "pdf_snippet", "other"), ("admission_result_row", "screening_method", "schedule_row", "low_text_pdf_page_image", "none"), ("admission_result", "competition_rate", "recruitment_notice", "none")


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _sql(values: tuple[str, ...], n: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{n} % {len(values)} + 1]"


@query(f"""
with e as (select event_id, {_sql(_TYPES, 'event_id')} as t, {_sql(_ROLES, 'event_id // 5')} as r, {_sql(_LINKS, 'event_id // 25')} as l, floor(value)::bigint as s from events)
select event_id, (20 + case t when 'workbook_row' then 24 when 'workbook_sheet' then 18 when 'pdf_page_image' then 10 when 'pdf_snippet' then 12 + least(20, s) else 0 end
  + case r when 'admission_result_row' then 20 when 'screening_method' then 16 when 'schedule_row' then 8 when 'low_text_pdf_page_image' then 6 else 0 end + case l when 'admission_result' then 14 when 'competition_rate' then 12 when 'recruitment_notice' then 8 else 0 end)::bigint as score from e
""")
def evidence_scores(spark, sf):
    n = F.col("event_id")
    score = coverage.evidence_score(_pick(_TYPES, n), _pick(_ROLES, F.floor(n / 5)), _pick(_LINKS, F.floor(n / 25)), F.floor("value"))
    return table(spark, sf, "events").select("event_id", score.cast("long").alias("score"))


@query(r"""
select doc_id, ((case when contains(text, 'the') then 2 else 0 end) + (case when contains(text, 'de') then 2 else 0 end) + least(8, len(regexp_extract_all(text, '[0-9]')) // 12)
  + least(6, len(list_filter(string_split(text, chr(10)), lambda x: len(string_split_regex(trim(x), '[ \t]{2,}')) >= 3))))::bigint as score from documents
""")
def snippet_scores(spark, sf):
    text = F.col("text")
    matched = sum(F.when(text.contains(w), 1).otherwise(0) for w in ("the", "de"))
    return table(spark, sf, "documents").select("doc_id", coverage.window_score(text, matched).cast("long").alias("score"))


_TARGETS = ("HistoricalOutcome", "AdmissionUnit", "GradeCutReference", "AdmissionRule", "University", "AdmissionUnitClusterReview", "Other")


@query(f"""
with e as (select event_id, {_sql(_TARGETS, 'event_id')} as t, case when event_id % 2 = 0 then 'foundation_historical_outcomes' else 'x' end as a, case when event_id % 3 = 0 then '2027' else '2026' end as y from events)
select event_id, case when t = 'HistoricalOutcome' and a = 'foundation_historical_outcomes' then 'historical_outcome_core' when t = 'AdmissionUnit' then 'admission_unit_core' when t = 'GradeCutReference' then 'kice_score_reference'
  when t = 'AdmissionRule' and y = '2027' then 'rule_schedule_2027' when t = 'University' then 'university_master' when t = 'AdmissionUnitClusterReview' then 'continuity_review' else 'other_p0_review' end as lane from e
""")
def review_lanes(spark, sf):
    n = F.col("event_id")
    lane = coverage.review_lane(_pick(_TARGETS, n), F.when(n % 2 == 0, "foundation_historical_outcomes").otherwise("x"), F.when(n % 3 == 0, "2027").otherwise("2026"))
    return table(spark, sf, "events").select("event_id", lane.alias("lane"))


# --- validation ---


@query(r"""
with e as (select event_id, ['kansu', 'probability', 'color', 'memo'][event_id % 4 + 1] as kind, case when event_id % 9 = 0 then ' ' when event_id % 4 = 0 then (floor(value / 10))::int::varchar when event_id % 4 = 1 then (floor(value * 1.5))::int::varchar || '%' when event_id % 4 = 2 then repeat('x', (floor(value / 4))::int) else repeat('m', (floor(value * 6))::int) end as v from events)
select event_id, case when trim(v) = '' then 'empty' when kind = 'kansu' and not (try_cast(v as int) between 1 and 8) then 'kansu' when kind = 'probability' and not (try_cast(replace(v, '%', '') as int) between 0 and 100) then 'probability'
  when kind = 'color' and len(v) > 20 then 'color' when kind = 'memo' and len(v) > 500 then 'memo' else '' end as problem from e
""")
def signal_values(spark, sf):
    n, x = F.col("event_id"), F.col("value")
    whole = lambda c: F.floor(c).cast("int")
    text = F.when(n % 9 == 0, " ").when(n % 4 == 0, whole(x / 10).cast("string")).when(n % 4 == 1, F.concat(whole(x * 1.5).cast("string"), F.lit("%"))).when(n % 4 == 2, F.repeat(F.lit("x"), whole(x / 4))).otherwise(F.repeat(F.lit("m"), whole(x * 6)))
    return table(spark, sf, "events").select("event_id", F.coalesce(validation.signal_problem(_pick(("kansu", "probability", "color", "memo"), n), text), F.lit("")).alias("problem"))


@query("""
with o as (select event_id, event_id % 5 <> 0 as applied, ['accepted', 'rejected', 'waitlisted', 'unknown'][event_id % 4 + 1] as result, case when event_id % 3 = 0 then (event_id % 7) - 1 end as waitlist, event_id % 6 = 0 as registered from events)
select event_id, array_to_string(list_filter([case when not applied and result <> 'unknown' then 'not_applied' end, case when waitlist is not null and result <> 'waitlisted' then 'waitlist_result' end, case when waitlist is not null and result = 'waitlisted' and waitlist < 1 then 'waitlist_number' end, case when registered and result <> 'accepted' then 'registered' end], lambda x: x is not null), '|') as problems from o
""")
def outcome_records(spark, sf):
    n = F.col("event_id")
    problems = validation.outcome_problems(n % 5 != 0, _pick(("accepted", "rejected", "waitlisted", "unknown"), n), F.when(n % 3 == 0, n % 7 - 1), n % 6 == 0)
    return table(spark, sf, "events").select("event_id", F.array_join(problems, "|").alias("problems"))


_SUBJECT = "['korean', 'math', 'english', 'history', 'inquiry1'][event_id % 5 + 1]"


@query(f"""
with s as (select user_id as exam, {_SUBJECT} as subject, case when event_id % 4 > 0 and event_id % 5 not in (2, 3) then value * 1.02 end as percentile, case when event_id % 5 in (2, 3) and event_id % 7 > 0 then event_id % 10 end as grade, case when event_id % 3 = 0 then 'chosen' end as selection, event_id from events),
last as (select * from s qualify row_number() over (partition by exam, subject order by event_id desc) = 1), exams as (select distinct exam from s),
m as (
  select exam, 'duplicate:' || subject as code from (select exam, subject, count(*) as n from s group by all) where n > 1
  union all select exam, 'range:percentile:' || subject from s where percentile > 100 or percentile < 0 union all select exam, 'range:grade:' || subject from s where grade < 1 or grade > 9
  union all select exam, 'required:' || r.subject from exams cross join (select unnest(['korean', 'math', 'english', 'history']) as subject) r where (exam, r.subject) not in (select (exam, subject) from last)
  union all select exam, 'grade_required:' || subject from last where subject in ('english', 'history') and grade is null
  union all select exam, 'metric_required:' || subject from last where subject in ('korean', 'math', 'inquiry1') and percentile is null),
w as (select exam, 'selection:' || subject as code from last where subject in ('math', 'inquiry1') and selection is null union all select exam, 'inquiry' from exams where exam not in (select exam from last where subject = 'inquiry1'))
select exam, coalesce((select string_agg(distinct code, '|' order by code) from m where m.exam = exams.exam), '') as errors, coalesce((select string_agg(distinct code, '|' order by code) from w where w.exam = exams.exam), '') as warnings from exams
""")
def validated_exams(spark, sf):
    n, none = F.col("event_id"), F.lit(None)
    graded = (n % 5).isin(2, 3)
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("exam"), n.alias("at"), _pick(("korean", "math", "english", "history", "inquiry1"), n).alias("subject"), F.when(n % 3 == 0, "chosen").alias("selection"),
        none.cast("double").alias("raw"), none.cast("double").alias("standard"), F.when((n % 4 > 0) & ~graded, F.col("value") * 1.02).alias("percentile"), F.when(graded & (n % 7 > 0), n % 10).cast("int").alias("grade"),
    )
    found = validation.exam_problems(rows, "exam", "at")
    return found.select("exam", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"))


@query("select s_suppkey, s_suppkey % 7 <> 0 and s_suppkey % 3 <> 2 as exact, s_suppkey % 7 <> 0 and s_suppkey % 3 = 2 as relative from supplier")
def rule_unlocks(spark, sf):
    from tidemark.plans.queries import _rules

    rule = F.col("rule")
    return _rules(spark, sf).select("s_suppkey", validation.unlocks_exact(rule).alias("exact"), validation.enables_relative(rule).alias("relative"))


# --- simulation ---

_AFTER = _ANALYSIS.replace("95 + c_custkey * 7 % 55 as ms", "least(200, 95 + c_custkey * 7 % 55 + 6) as ms").replace("55 + c_custkey * 7 % 45 as mp", "least(100, 55 + c_custkey * 7 % 45 + 4) as mp")


@query(f"""
with x as ({_ANALYSIS} select ck, sk, band from b where kind = 'ok'), y as ({_AFTER} select ck, sk, band from b where kind = 'ok'),
c as (select ck, x.band as before, y.band as after from x full join y using (ck, sk) where x.band is distinct from y.band)
select ck as c_custkey, count(*) as changed, count(*) filter (after in ('stable', 'match') and coalesce(before not in ('stable', 'match'), true)) as moved_to_match_or_better from c group by ck
""")
def simulated_changes(spark, sf):
    rows = _candidates(spark, sf, changes=lambda _: F.create_map(F.lit("math"), simulation.change(standard_delta=6, percentile_delta=4)))
    return simulation.band_changes(simulation.compared(rows, ["c_custkey"], "s_suppkey"), ["c_custkey"])
