"""Queries over the star-schema tables, each with its DuckDB oracle.

The tables stand in for admissions data: customers for examinees, suppliers for
units, orders and lineitems for outcomes, events for decisions. NAMES[name] is a
pair of a function (spark, sf_dir) and its SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import keys, numeric, text
from tidemark.operators import aggregates, joins, sets, windows
from tidemark.plans import coverage, scoring

NAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
YEARS = list(range(1995, 2002))


def query(sql: str | None):
    def add(f):
        NAMES[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _year(c: str) -> Column:
    return F.year(c)


# --- latest rows, ranks and fills ---


@query("""
select c_custkey, c_mktsegment, o_orderkey, o_totalprice from customer left join (
  select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1) on c_custkey = o_custkey
""")
def latest_order_per_customer(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.with_latest(table(spark, sf, "customer"), orders, ["c_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("c_custkey", "c_mktsegment", "o_orderkey", "o_totalprice")


@query("""
with chosen as (select s.*, n_name, r_name from supplier s join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select s_suppkey, n_name from chosen where (r_name in ('ASIA', 'EUROPE', 'R1', 'R3') or r_name like '%A%') and s_acctbal > 0
""")
def candidate_filter_precedence(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    chosen = table(spark, sf, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    wanted = F.col("r_name").isin("ASIA", "EUROPE", "R1", "R3") | F.col("r_name").contains("A")
    return chosen.filter(wanted & (F.col("s_acctbal") > 0)).select("s_suppkey", "n_name")


@query("""
with lacking as (select * from customer where c_custkey not in (select o_custkey from orders where year(o_orderdate) = 2001)),
other as (select o_orderkey, o_totalprice, o_orderdate, c_nationkey, c_mktsegment from orders join customer on o_custkey = c_custkey where year(o_orderdate) < 2001),
found as (select l.c_custkey, o.o_orderkey from lacking l join other o using (c_nationkey, c_mktsegment) where o_totalprice between 20000 and 300000
  qualify row_number() over (partition by l.c_custkey order by o_orderdate desc, o_orderkey) = 1)
select c_custkey, o_orderkey from lacking left join found using (c_custkey)
""")
def fallback_lookup(spark, sf):
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    own = orders.filter(_year("o_orderdate") == 2001).select(F.col("o_custkey").alias("c_custkey"))
    other = orders.filter(_year("o_orderdate") < 2001).join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"), "o_custkey").select("o_orderkey", "o_totalprice", "o_orderdate", "c_nationkey", "c_mktsegment")
    fits = F.col("o_totalprice").between(20000, 300000)
    return joins.fallback(customer, own, ["c_custkey"], other, ["c_nationkey", "c_mktsegment"], fits, [F.desc("o_orderdate"), "o_orderkey"]).select("c_custkey", "o_orderkey")


@query("""
with d as (select user_id as o_custkey, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)
select o_orderkey, case when event_type = 'error' then null else coalesce(case when value > 50 then value end, o_totalprice) end as price from orders left join d using (o_custkey)
""")
def decision_overlay(spark, sf):
    decisions = table(spark, sf, "events").select(F.col("user_id").alias("o_custkey"), F.col("event_type").alias("verdict"), F.when(F.col("value") > 50, F.col("value")).alias("new_price"), "ts", "event_id")
    base = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"))
    return joins.overlaid(base, decisions, "o_custkey", [F.desc("ts"), F.desc("event_id")], ["price"], drops=("error",)).select("o_orderkey", "price")


@query("select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1")
def first_row_dedup(spark, sf):
    return windows.top_k(table(spark, sf, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""
with r as (select *, row_number() over (partition by user_id, event_type order by value desc, event_id) > 1 as late from events)
select user_id, event_type, event_id from r qualify row_number() over (partition by user_id order by late, value desc, event_id) <= 4
""")
def snippet_topn(spark, sf):
    return windows.guaranteed_then_fill(table(spark, sf, "events"), ["user_id"], "event_type", [F.desc("value"), "event_id"], 1, 4).select("user_id", "event_type", "event_id")


@query("""
with r as (select * from events qualify row_number() over (partition by user_id, event_type order by value desc, event_id) <= 2)
select user_id, event_id from r qualify row_number() over (partition by user_id order by value desc, event_id) <= 5
""")
def role_quota_cap(spark, sf):
    return windows.quota_then_cap(table(spark, sf, "events"), ["user_id"], "event_type", [F.desc("value"), "event_id"], 2, 5).select("user_id", "event_id")


@query("""
select o_orderkey, o_custkey from (select * from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 2) order by o_totalprice desc, o_orderkey limit 50
""")
def capped_ranking(spark, sf):
    return windows.capped_ranking(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2, 50).select("o_orderkey", "o_custkey")


@query("""
select event_id, user_id, last_value(case when event_id % 3 = 0 then value end ignore nulls) over w as filled,
  last_value(case when event_type = 'error' then event_id end ignore nulls) over w as last_error
from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)
""")
def forward_fill(spark, sf):
    fills = {"filled": F.when(F.col("event_id") % 3 == 0, F.col("value")), "last_error": F.when(F.col("event_type") == "error", F.col("event_id"))}
    return windows.forward_fill(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], fills).select("event_id", "user_id", "filled", "last_error")


@query("""
with e as (select user_id, event_id, floor(epoch(ts))::bigint as s, floor(epoch(ts))::bigint + 3600 as f from events),
r as (select *, max(f) over (partition by user_id order by s, f, event_id rows between unbounded preceding and 1 preceding) as reach from e),
i as (select *, sum(case when reach is null or s > reach + 7200 then 1 else 0 end) over (partition by user_id order by s, f, event_id) as island from r)
select user_id, island::bigint as island, min(s) as start, max(f) as stop, count(*) as n from i group by user_id, island
""")
def merge_windows(spark, sf):
    start = F.unix_timestamp(F.col("ts").cast("timestamp"))
    spans = table(spark, sf, "events").select("user_id", "event_id", start.alias("s"), (start + 3600).alias("f"))
    return windows.islands(spans, ["user_id"], "s", "f", 7200).groupBy("user_id", "island").agg(F.min("s").alias("start"), F.max("f").alias("stop"), F.count("*").alias("n"))


@query("""
select event_id, string_agg(event_type, '|') over (partition by user_id order by ts, event_id rows between 1 preceding and 1 following) as around from events
""")
def context_window(spark, sf):
    return windows.context(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type", 1, 1, "around", "|").select("event_id", "around")


@query("""
with y as (select o_custkey, o_orderkey, o_totalprice, year(o_orderdate) as y from orders),
t as (select *, case when y = 1998 then 0 when y = 2000 then 1 else 2 end as tier from y)
select c_custkey, tier, o_orderkey from customer left join (select * from t qualify row_number() over (partition by o_custkey order by tier, y desc, o_totalprice, o_orderkey) = 1) on c_custkey = o_custkey
""")
def tiered_fallback_site(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", _year("o_orderdate").alias("y"))
    tier = F.when(F.col("y") == 1998, 0).when(F.col("y") == 2000, 1).otherwise(2)
    return joins.tiered(table(spark, sf, "customer"), orders, ["c_custkey"], tier, [F.desc("y"), "o_totalprice", "o_orderkey"]).select("c_custkey", "tier", "o_orderkey")


# --- joins ---


@query("""
with t as (select o_custkey, year(o_orderdate) as y, floor(sum(o_totalprice) * 100 + 0.5) / 100 as total from orders group by all),
a as (select o_custkey, total as prev_total from t where y = 1997), b as (select o_custkey, total as curr_total from t where y = 1998)
select o_custkey, prev_total, curr_total, case when prev_total is null then 'new' when curr_total is null then 'gone' when curr_total > prev_total then 'up' when curr_total < prev_total then 'down' else 'same' end as direction from a full join b using (o_custkey)
""")
def trend_full_outer(spark, sf):
    totals = table(spark, sf, "orders").groupBy("o_custkey", _year("o_orderdate").alias("y")).agg(numeric.round2(F.sum("o_totalprice")).alias("total"))
    both = joins.compared(totals.filter("y = 1997"), totals.filter("y = 1998"), ["o_custkey"], ["total"])
    a, b = F.col("prev_total"), F.col("curr_total")
    return both.withColumn("direction", F.when(a.isNull(), "new").when(b.isNull(), "gone").when(b > a, "up").when(b < a, "down").otherwise("same"))


@query("""
with p as (select p_partkey, p_size + unnest(range(0, case when p_partkey % 4 = 0 then 1 else 3 end))::int as size from part), d as (select distinct p_size as size from part)
select size, count(*) as parts from p join d using (size) group by size
""")
def range_override(spark, sf):
    part = table(spark, sf, "part")
    ranges = part.select("p_partkey", F.col("p_size").alias("low"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") + 2).alias("high"))
    return joins.expanded(ranges, "low", "high", "size").join(part.select(F.col("p_size").alias("size")).distinct(), "size").groupBy("size").agg(F.count("*").alias("parts"))


@query("""
with y as (select unnest(range(1995, 2002))::int as y),
o as (select c_nationkey as n_nationkey, year(o_orderdate)::int as y, count(*) as orders from orders join customer on o_custkey = c_custkey group by all),
l as (select s_nationkey as n_nationkey, year(l_shipdate)::int as y, count(*) as lines from lineitem join supplier on l_suppkey = s_suppkey where l_quantity > 49 group by all)
select n_nationkey, y, coalesce(orders, 0) as orders, coalesce(lines, 0) as lines from nation cross join y left join o using (n_nationkey, y) left join l using (n_nationkey, y)
""")
def coverage_matrix(spark, sf):
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("n_nationkey"), _year("o_orderdate").alias("y"))
    lines = table(spark, sf, "lineitem").filter("l_quantity > 49").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("n_nationkey"), _year("l_shipdate").alias("y"))
    return joins.scaffold(table(spark, sf, "nation"), YEARS, "y", {"orders": orders, "lines": lines}, "n_nationkey")


def _cells(spark, sf) -> DataFrame:
    cells = coverage_matrix(spark, sf).withColumn("year", (F.col("y") + 26).cast("int"))
    c = {k: (F.col("orders") + F.col("lines") + F.col("n_nationkey") * (i + 3) + F.col("year")) % (i + 2) for i, k in enumerate(coverage.POINTS)}
    excluded = F.when(F.col("n_nationkey") % 5 == 0, F.array(F.lit("missing_schedule_draft"), F.lit("missing_csat_rule_draft"))).otherwise(F.array().cast("array<string>"))
    df = cells.withColumn("flags", coverage.missing_flags(c, F.col("year"), excluded)).withColumn("score", coverage.coverage_score(c))
    return df.withColumn("tier", coverage.coverage_tier(F.col("score"), F.col("flags"))).withColumn("collected", F.col("orders") % 2).select("n_nationkey", "year", "flags", "score", "tier", "collected")


_COUNTS = {k: f"(orders + lines + n_nationkey * {i + 3} + year) % {i + 2}" for i, k in enumerate(coverage.POINTS)}
_CASES = {
    **dict.fromkeys(coverage.DRAFTS, "(year <= 2025 and units > 0 and outcomes > 0 and outcome_scores > 0 and year_evidence > 0 and (csat_rules > 0 or n_nationkey % 5 = 0))"),
    "year_evidence": "(" + " and ".join(f"{x} > 0" for x in coverage.CORE) + ")",
    "schedules": "((year <= 2021 and units > 0 and outcomes > 0 and outcome_scores > 0) or n_nationkey % 5 = 0)",
    "csat_rules": "(n_nationkey % 5 = 0)",
}
_CELLS = f"""
with m as (select n_nationkey, (y + 26)::int as year, orders, lines from ({NAMES["coverage_matrix"][1].replace("with y as", "with y as", 1)})),
c as (select n_nationkey, year, orders, {", ".join(f"{v} as {k}" for k, v in _COUNTS.items())} from m),
cells as (select n_nationkey, year, orders % 2 as collected,
  case when listed = 0 then ['{coverage.UNLISTED}'] else list_filter([{", ".join(f"case when {k} = 0 and not {_CASES.get(k, 'false')} then '{f}' end" for k, f in coverage.FLAGS.items())}], lambda x: x is not null) end as flags,
  least({" + ".join(f"case when {k} > 0 then {v} else 0 end" for k, v in coverage.POINTS.items())}, 100) as score from c),
tiers as (select *, case when score >= 80 and not list_contains(flags, 'missing_outcome_scores') and not list_contains(flags, 'missing_csat_rule_draft') then 'source_rich_review_ready'
  when score >= 60 then 'review_ready_partial' when score >= 35 then 'partial_evidence' else 'source_gap' end as tier from cells)
"""


@query(_CELLS + "select n_nationkey, year, array_to_string(flags, '|') as flags, score::int as score, tier from tiers")
def coverage_tiers(spark, sf):
    return _cells(spark, sf).select("n_nationkey", "year", F.array_join("flags", "|").alias("flags"), "score", "tier")


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_GAPS = f""", g as (select n_nationkey, year, unnest(flags) as flag, score, tier, collected from tiers),
p as (select *, case when year <= 2026 and flag in {_in(coverage.CRITICAL)} then 'p0' when year = 2027 and flag in {_in((*coverage.RULE_FLAGS, "missing_admission_office_detected_year_evidence"))} then 'p0'
  when tier = 'source_gap' and year <= 2026 then 'p0' when flag in {_in(coverage.OUTCOME_FLAGS)} and year = 2027 then 'p1'
  when flag in {_in(("missing_schedule_draft", "missing_admission_office_detected_year_evidence", *coverage.CRITICAL))} then 'p1' when flag = '{coverage.UNLISTED}' then 'p2'
  when tier in ('partial_evidence', 'review_ready_partial') then 'p2' else 'p3' end as priority from g),
q as (select *, case priority when 'p0' then 90 when 'p1' then 70 when 'p2' then 45 else 20 end + case flag {" ".join(f"when '{k}' then {v}" for k, v in coverage.ACTION_WEIGHTS.items())} else 10 end
  + case year {" ".join(f"when {k} then {v}" for k, v in coverage.YEAR_BONUS.items())} else 0 end + floor(greatest(0, 100 - score) / 5.0)::bigint + case when collected > 0 then 4 else 0 end as action_score,
  case when flag in {_in(coverage.OUTCOME_FLAGS)} then case when year >= 2027 then 'likely_not_public_until_after_cycle' when year = 2026 then 'check_public_now_or_pending_release' else 'should_be_public_or_parse_gap' end
    when flag in {_in(coverage.RULE_FLAGS)} then case when year = 2027 then 'should_be_public_for_current_cycle' else 'should_be_public_or_parse_gap' end
    when flag = 'missing_admission_office_detected_year_evidence' then 'should_be_public_or_parse_gap' when flag = '{coverage.UNLISTED}' then 'verify_scope_or_institution_status' else 'needs_review' end as availability from p)
"""


@query(_CELLS + _GAPS + "select n_nationkey, year, flag, priority, action_score::bigint as action_score, availability from q")
def gap_fanout(spark, sf):
    return coverage.gaps(_cells(spark, sf)).select("n_nationkey", "year", "flag", "priority", F.col("action_score").cast("long").alias("action_score"), "availability")


@query(
    _CELLS
    + _GAPS
    + """, s as (select n_nationkey, year, flag, s_suppkey, s_acctbal from q join supplier on s_nationkey = n_nationkey where s_acctbal > 2000),
r as (select *, row_number() over (partition by n_nationkey, year, flag order by s_acctbal desc, s_suppkey) as rank from s)
select n_nationkey, year, flag, coalesce(rank, 0)::int as rank, s_suppkey from q left join (select * from r where rank <= 3) using (n_nationkey, year, flag)
"""
)
def gap_topk_candidates(spark, sf):
    found = table(spark, sf, "supplier").filter("s_acctbal > 2000").withColumnRenamed("s_nationkey", "n_nationkey")
    return joins.ranked_with_default(coverage.gaps(_cells(spark, sf)), found, ["n_nationkey"], ["s_suppkey"], [F.desc("s_acctbal"), "s_suppkey"], 3).select("n_nationkey", "year", "flag", "rank", "s_suppkey")


_STAGE = "case when sources > 0 then 'review_existing_source_candidate' when visuals > 0 then 'review_visual_or_ocr_source' when targets > 0 then 'run_or_repair_collection' when availability = 'likely' then 'wait_for_public_release' when unlisted then 'verify_university_scope' else 'manual_source_discovery' end"


@query(
    f"""
with b as (select s_suppkey, s_suppkey % 3 as sources, s_suppkey % 5 // 2 as visuals, s_suppkey % 7 // 3 as targets, case when s_suppkey % 2 = 0 then 'likely' else 'open' end as availability, s_suppkey % 11 = 0 as unlisted, s_suppkey % 40 as base from supplier),
s as (select *, {_STAGE.replace("availability = 'likely'", "availability = 'likely'")} as stage from b)
select s_suppkey, stage, (base + case stage {" ".join(f"when '{k}' then {v}" for k, v in coverage.STAGE_POINTS.items())} end + least(30, sources * 4) + least(25, visuals * 3) + least(20, targets * 2) + case when s_suppkey % 4 = 0 then 12 else 0 end)::bigint as priority from s
"""
)
def next_stage_ladder(spark, sf):
    k = F.col("s_suppkey")
    b = table(spark, sf, "supplier").select("s_suppkey", (k % 3).alias("sources"), F.floor((k % 5) / 2).alias("visuals"), F.floor((k % 7) / 3).alias("targets"), F.when(k % 2 == 0, "likely_not_public_until_after_cycle").otherwise("open").alias("availability"))
    c = [F.col(x) for x in ("sources", "visuals", "targets")]
    b = b.withColumn("stage", coverage.next_stage(*c, F.col("availability"), k % 11 == 0))
    return b.select("s_suppkey", "stage", coverage.operation_priority(k % 40, F.col("stage"), *c, k % 4 == 0, F.col("availability")).cast("long").alias("priority"))


@query("""
with s as (select p_partkey, 40 + case p_size % 3 when 0 then 80 when 1 then 65 else 0 end + case when p_partkey % 2 = 0 then 90 else 0 end + case when p_partkey % 3 = 0 then 55 else 0 end
  + case p_partkey % 5 when 0 then 25 when 1 then 15 else 0 end + case p_partkey % 4 when 0 then 20 when 1 then 12 when 2 then 5 else 0 end + least(30, floor(p_size / 12.0)) as score, p_size % 3 < 2 as target from part)
select p_partkey, score::bigint as score from s where target and score >= 110
""")
def match_score_threshold(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    target = F.when(size % 3 == 0, 80).when(size % 3 == 1, 65).otherwise(0)
    artifact = F.when(k % 5 == 0, "evidence").when(k % 5 == 1, "structured")
    priority = F.when(k % 4 == 0, "p0").when(k % 4 == 1, "p1").when(k % 4 == 2, "p2")
    return table(spark, sf, "part").select("p_partkey", coverage.match_score(target, k % 2 == 0, k % 3 == 0, artifact, priority, size).cast("long").alias("score")).filter("score is not null")


@query("""
with r as (select p_partkey, p_size::double as want from part), n as (select l_partkey as p_partkey, list(distinct l_quantity) as got from lineitem group by 1)
select p_partkey, len(list_filter(got, lambda x: abs(x - want) <= 0.5)) > 0 as confirmed from r join n using (p_partkey)
""")
def verify_tolerance(spark, sf):
    need = table(spark, sf, "part").select("p_partkey", F.array(F.struct(F.col("p_size").cast("double").alias("value"), F.lit(0.5).alias("tolerance"))).alias("need"))
    got = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set("l_quantity").alias("got"))
    return need.join(got, "p_partkey").select("p_partkey", joins.numbers_confirmed(F.col("need"), F.col("got")).alias("confirmed"))


@query("""
select a.s_suppkey, case when a.s_nationkey is distinct from b.c_nationkey then 'nation' when floor(a.s_acctbal) is distinct from floor(b.c_acctbal) then 'balance' end as mismatch from supplier a join customer b on s_suppkey = c_custkey
""")
def first_mismatch(spark, sf):
    both = table(spark, sf, "supplier").join(table(spark, sf, "customer"), F.col("s_suppkey") == F.col("c_custkey"))
    return both.select("s_suppkey", joins.first_mismatch([("nation", F.col("s_nationkey"), F.col("c_nationkey")), ("balance", F.floor("s_acctbal"), F.floor("c_acctbal"))]).alias("mismatch"))


@query("""
select s_suppkey as id, 'missing' as side from supplier where s_suppkey not in (select c_custkey from customer where c_mktsegment <> 'BUILDING')
union all select c_custkey, 'extra' from customer where c_mktsegment <> 'BUILDING' and c_custkey not in (select s_suppkey from supplier)
""")
def reconcile_ids(spark, sf):
    ours = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    theirs = table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("id"))
    return joins.reconciled(ours, theirs, "id")


@query("select count(*) as orphans from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')")
def fk_audit(spark, sf):
    parent = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return joins.orphans(table(spark, sf, "lineitem"), parent, "l_orderkey").agg(F.count("*").alias("orphans"))


@query("""
with o as (select o_custkey, list(distinct o_orderkey % 50) as ids from orders group by 1), w as (select unnest([1, 7, 20]) as id)
select o_custkey from o where len(list_filter(ids, lambda x: x in (1, 7, 20))) > 0
""")
def overlap_semi_join(spark, sf):
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(F.col("o_orderkey") % 50).alias("ids"))
    return joins.overlapping(orders, "ids", spark.createDataFrame([(1,), (7,), (20,)], "id long"), "id", "o_custkey").select("o_custkey")


@query("""
with e as (select user_id, count(*) filter (event_type = 'error') as n from events group by 1)
select e.event_id, 'own' as tier from events e where event_type = 'error'
union all select e.event_id, 'extra' from events e join e c using (user_id) where event_type = 'view' and n < 12
""")
def conditional_extra_tier(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    first = events.filter("event_type = 'error'").withColumn("tier", F.lit("own"))
    return joins.with_extra_tier(first, events.filter("event_type = 'view'").withColumn("tier", F.lit("extra")), "user_id", 12).select("event_id", "tier")


# --- aggregates ---


@query("select o_custkey, count(*) filter (o_orderstatus = 'F') as n_F, count(*) filter (o_orderstatus = 'O') as n_O, count(*) filter (o_orderstatus = 'P') as n_P from orders group by 1")
def dense_status_counts(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(*aggregates.dense_counts("o_orderstatus", ("F", "O", "P")))


@query("""
select p_name, array_to_string(list(p_partkey order by p_size, p_partkey), '|') as ids, sum(p_size)::bigint as size, min(p_retailprice) as price, arg_min(p_brand, (p_size, p_partkey)) as brand from part group by p_name
""")
def merge_display_names(spark, sf):
    part = table(spark, sf, "part").select("p_name", "p_partkey", F.col("p_size").alias("size"), F.col("p_size").alias("o"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand"))
    return aggregates.merged_by_name(part, "p_name", "p_partkey", "size", "price", "o", ["brand"]).select("p_name", F.array_join("ids", "|").alias("ids"), F.col("size").cast("long").alias("size"), "price", "brand")


@query("select sha256(p_brand || '/' || p_type || '/' || p_size::varchar) as signature, count(*) as n, arg_max(p_partkey, (p_retailprice, -p_partkey)) as lead from part group by 1")
def cluster_signature(spark, sf):
    part = table(spark, sf, "part").withColumn("signature", F.sha2(F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")), 256))
    return part.groupBy("signature").agg(F.count("*").alias("n"), aggregates.first_best(F.col("p_partkey"), F.col("p_retailprice"), F.col("p_partkey")).alias("lead"))


@query("""
with y as (select l_suppkey, year(l_shipdate) as y, sum(l_quantity) as q, count(*) as n from lineitem group by all)
select l_suppkey, count(*) as years, sum(n)::bigint as lines, array_to_string(list(y || ':' || q::bigint order by y), '|') as points, array_to_string(list_filter(range(1995, 2002), lambda v: not list_contains(list(y), v)), '|') as missing,
  min(q) as low, max(q) as high, arg_max(q, y) as latest,
  greatest(0, count(*) * 12 + least(sum(n) * 5, 80) + least(sum(n), 50) + case when count(*) >= 5 then 50 else 0 end + case when count(*) = 7 then 30 else 0 end)::bigint as priority
from y group by l_suppkey
""")
def outcome_series(spark, sf):
    y = table(spark, sf, "lineitem").groupBy("l_suppkey", _year("l_shipdate").alias("y")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    n, low, high, latest = aggregates.numeric_range(F.col("q"), F.col("y"))
    point = F.struct("y", F.concat_ws(":", F.col("y").cast("string"), F.col("q").cast("long").cast("string")).alias("t"))
    g = y.groupBy("l_suppkey").agg(n.alias("years"), F.sum("n").alias("lines"), F.sort_array(F.collect_list(point)).alias("p"), low.alias("low"), high.alias("high"), latest.alias("latest"))
    missing = aggregates.missing_from(YEARS, F.transform("p", lambda x: x["y"]))
    priority = coverage.series_priority(F.col("years"), F.col("lines"), F.col("lines"), F.lit(False))
    return g.select("l_suppkey", "years", "lines", F.array_join(F.transform("p", lambda x: x["t"]), "|").alias("points"), F.array_join(missing.cast("array<string>"), "|").alias("missing"), "low", "high", "latest", priority.cast("long").alias("priority"))


@query("""
with c as (select o_custkey, o_orderpriority, count(*) as n, min(o_orderkey) as first from orders group by all)
select o_custkey, arg_max(o_orderpriority, (n, -first)) as o_orderpriority, max(n) as n from c group by o_custkey
""")
def mode_first_seen(spark, sf):
    return aggregates.mode_by_first(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query("""
select user_id, array_to_string(list_slice(list(event_type order by first), 1, 3), '|') as kinds from (select user_id, event_type, min(event_id) as first from events group by all) group by user_id
""")
def capped_unique_lists(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg(aggregates.ordered_unique(F.col("event_type"), F.col("event_id"), 3).alias("k"))
    return g.select("user_id", F.array_join("k", "|").alias("kinds"))


@query("""
select count(*) as rows, count(*) filter (coalesce(nullif(p_name, 'x'), '') = '') as empty_ids, (count(*) - count(distinct p_name))::bigint as duplicate_ids from part
""")
def dup_audit(spark, sf):
    return aggregates.duplicates(table(spark, sf, "part"), "p_name")


@query("""
select p_brand, value, count(*) as n from (select p_brand, unnest([lower(p_type), 'size' || (p_size % 3)::varchar]) as value from part) group by all
""")
def reason_frequency(spark, sf):
    codes = F.array(F.lower("p_type"), F.concat(F.lit("size"), (F.col("p_size") % 3).cast("string")))
    return aggregates.value_counts(table(spark, sf, "part"), codes, by=["p_brand"])


@query("""
select metric, count(*) as n, floor(sum(value) * 100 + 0.5) / 100 as total from (unpivot (select l_orderkey, l_quantity, l_discount, l_tax from lineitem) on l_quantity, l_discount, l_tax into name metric value value) group by metric
""")
def unpivot_metrics(spark, sf):
    long = aggregates.melted(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_quantity", "l_discount", "l_tax"])
    return long.groupBy("metric").agg(F.count("*").alias("n"), numeric.round2(F.sum("value")).alias("total"))


@query("""
with g as (select sha256(source || '/' || md5(text)) as key, doc_id, text from documents)
select key, count(*) as n, min(doc_id) as first, max(length(text)) as longest from g group by key
""")
def evidence_group_hash(spark, sf):
    key = F.sha2(F.concat_ws("/", "source", F.md5("text")), 256)
    return table(spark, sf, "documents").groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max(F.char_length("text").cast("long")).alias("longest"))


@query("""
select 'nation' as kind, n_name as name, null::double as balance from nation union all select 'supplier', s_name, s_acctbal from supplier union all select 'customer', c_name, c_acctbal from customer
""")
def promotion_union(spark, sf):
    return sets.united([
        table(spark, sf, "nation").select(F.lit("nation").alias("kind"), F.col("n_name").alias("name")),
        table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")),
    ])


@query("""
with old as (select event_id, user_id as target, event_type as reviewer from events where ts < '2024-01-26'), new as (select event_id, user_id as target, event_type || '!' as reviewer from events where ts >= '2024-01-26')
select * from old where target not in (select target from new) union all select * from new
""")
def merge_decisions(spark, sf):
    e = table(spark, sf, "events").withColumn("target", F.col("user_id"))
    late = F.col("ts") >= F.lit("2024-01-26").cast("timestamp_ntz")
    old = e.filter(~late).select("event_id", "target", F.col("event_type").alias("reviewer"))
    new = e.filter(late).select("event_id", "target", F.concat("event_type", F.lit("!")).alias("reviewer"))
    return sets.superseded(old, new, "target", "reviewer")


# --- text, keys and numbers ---


@query(r"""
select page_id, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)', 1)) || '://' || lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)', 2)) ||
  coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/') ||
  case when url like '%?%' then '?' || array_to_string(list_sort(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')), '&') else '' end as canonical,
  lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) as host
from pages
""")
def canonical_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.canonical_url(F.col("url"), sort_query=True).alias("canonical"), text.host(F.col("url")).alias("host"))


@query("""select page_id, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) as links, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))), '|') as targets from pages""")
def html_links(spark, sf):
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return table(spark, sf, "pages").select("page_id", F.size(found).cast("long").alias("links"), F.array_join(F.array_sort(F.array_distinct(found)), "|").alias("targets"))


@query(r"""select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as clean, coalesce(nullif(regexp_replace(source, '[\s(){}\[\]]+', '', 'g'), ''), 'unknown') as key from documents""")
def text_scrub(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.collapsed(F.col("text")).alias("clean"), text.group_key(F.col("source")).alias("key"))


@query(r"""
select doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '((?:19|20)[0-9]{2})', 1), lambda x: x::int), lambda y: y between 1950 and 2030))), '|') as years,
  try_cast(nullif(regexp_extract(replace(text, ',', ''), '-?[0-9]+(?:\.[0-9]+)?', 0), '') as double) as first_number from documents
""")
def year_regex(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.years(F.col("text"), 1950, 2030).cast("array<string>"), "|").alias("years"), numeric.first_number(F.col("text")).alias("first_number"))


@query("""
select p_partkey, case when p_name = 'green' then 0 when lower(p_name) like 'b%' then 1 when lower(p_name) like '%b%' then 2 end as rank from part where lower(p_name) like '%b%'
""")
def search_rank(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.search_rank(F.lit(" B"), F.array("p_name")).alias("rank")).filter("rank is not null")


@query("select doc_id, contains(lower(text), 'password') or contains(lower(text), 'worthless') as banned from documents")
def banned_scan(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lower("text").rlike("password|worthless").alias("banned"))


@query("""
with h as (select p_partkey, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('part/' || p_partkey::varchar)) as h from part)
select p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(printf('%02x', (('0x' || substr(h, 17, 2))::int & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) as id from h
""")
def uuid5_key(spark, sf):
    return table(spark, sf, "part").select("p_partkey", keys.uuid5(F.concat(F.lit("part/"), F.col("p_partkey").cast("string"))).alias("id"))


@query("select s_suppkey, list_reduce(list_prepend(0::bigint, list_transform(string_split(s_name, ''), lambda c: ascii(c)::bigint)), lambda h, c: (h * 31 + c) % 4294967296) as h from supplier")
def hash31_key(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", keys.hash31(F.col("s_name")).alias("h"))


def _horner_sql(x: str, terms) -> str:
    out = f"{terms[0]!r}::double"
    for t in terms[1:]:
        out = f"({out} * {x} + ({t!r}::double))"
    return out


_PROBIT = f"""
case when p < {numeric.QUANTILE_TAIL} then {_horner_sql("sqrt(-2 * ln(p))", numeric.QUANTILE_C)} / {_horner_sql("sqrt(-2 * ln(p))", (*numeric.QUANTILE_D, 1.0))}
  when p > 1 - {numeric.QUANTILE_TAIL} then -({_horner_sql("sqrt(-2 * ln(1 - p))", numeric.QUANTILE_C)} / {_horner_sql("sqrt(-2 * ln(1 - p))", (*numeric.QUANTILE_D, 1.0))})
  else {_horner_sql("((p - 0.5) * (p - 0.5))", numeric.QUANTILE_A)} * (p - 0.5) / {_horner_sql("((p - 0.5) * (p - 0.5))", (*numeric.QUANTILE_B, 1.0))} end"""


@query(f"""
with parts as (select c_custkey, unnest([{{'x': (c_acctbal + 1000) / 110, 'w': 0.6::double}}, {{'x': 100 - (c_acctbal + 1000) / 110, 'w': 0.2::double}}, {{'x': case when c_custkey % 2 = 0 then 50.0::double end, 'w': 0.2::double}}]) as r from customer),
ps as (select c_custkey, r.w as w, least(greatest(r.x, 0.6), 99.4) / 100 as p from parts where r.x is not null),
z as (select c_custkey, sum(w * ({_PROBIT})) / sum(w) as z from ps group by c_custkey),
t as (select c_custkey, z, abs(z) / sqrt(2.0::double) as x, 1 / (1 + {numeric.ERF_P} * (abs(z) / sqrt(2.0::double))) as t from z),
e as (select *, 1 - {_horner_sql("t", (*reversed(numeric.ERF_A), 0.0))} * exp(-x * x) as erf from t)
select c_custkey, floor(case when z < 0 then 0.5 * (1 - erf) else 0.5 * (1 + erf) end * 100 * 100 + 0.5) / 100 as composite from e
""")
def probit_composite(spark, sf):
    x = (F.col("c_acctbal") + 1000) / 110
    return table(spark, sf, "customer").select("c_custkey", numeric.round2(numeric.composite_percentile([(x, 0.6), (100 - x, 0.2), (F.when(F.col("c_custkey") % 2 == 0, F.lit(50.0)), 0.2)])).alias("composite"))


# --- scores ---


def _subjects(key: Column) -> Column:
    entry = lambda name, standard, percentile, grade, keep=None: F.struct(F.lit(name).alias("k"), F.when(F.lit(True) if keep is None else keep, F.struct(F.lit(None).cast("string").alias("selection"), standard.cast("double").alias("standard"), percentile.cast("double").alias("percentile"), grade.cast("int").alias("grade"))).alias("v"))
    none = F.lit(None)
    rows = F.array(
        entry("korean", 100 + key % 50, 60 + key % 40, none),
        entry("math", 95 + key * 7 % 55, 55 + key * 7 % 45, none),
        entry("inquiry1", 50 + key * 3 % 25, 50 + key * 3 % 50, none),
        entry("inquiry2", 48 + key * 5 % 25, 45 + key * 5 % 55, none, key % 11 != 0),
        entry("english", none, none, 1 + key % 5),
        entry("history", none, none, 1 + key % 4),
    )
    return F.map_from_entries(F.filter(rows, lambda x: x["v"].isNotNull()))


def _rules(spark, sf) -> DataFrame:
    """Every supplier as a unit with a rule."""
    k = F.col("s_suppkey")
    grades = lambda *v: F.create_map(*(F.lit(x) for i, p in enumerate(v, 1) for x in (i, float(p))))
    kind = F.when(k % 3 == 0, "standard").when(k % 3 == 1, "percentile").otherwise("mixed")
    scale = F.when(k % 3 == 1, 100.0).otherwise(1000.0)
    policy = lambda by_grade: F.struct(F.lit("deduction").alias("mode"), by_grade.alias("by_grade"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("double").alias("score_max"))
    rule = scoring.rule_struct(
        score_type=kind,
        verified_status=F.when(k % 7 == 0, "draft").otherwise("verified"),
        total_scale=scale,
        weights=F.struct(F.lit(0.3).alias("korean"), F.lit(0.4).alias("math"), F.lit(0.3).alias("inquiry")),
        english_policy=policy(grades(0, 2, 6, 12, 20)),
        history_policy=policy(grades(0, 0, 0, 2)),
        inquiry_policy=F.struct(F.lit(2).alias("count"), F.lit("average").alias("mode"), F.lit(None).cast("boolean").alias("c"), F.lit(None).cast("string").alias("t"), F.lit(None).cast("double").alias("m"), F.lit(None).cast("map<int,double>").alias("b")),
    )
    past = F.when(k % 9 != 0, F.struct((scale * (0.55 + (k % 10) / 100.0)).alias("cut_score"), (70 + k % 25).cast("double").alias("percentile_cut"), (k % 40).cast("int").alias("additional_pass")))
    return table(spark, sf, "supplier").select("s_suppkey", rule.alias("rule"), past.alias("history"), (5 + k % 30).cast("int").alias("quota"), (5 + k % 23).cast("int").alias("prev_quota"))


#: Pairs of one task, so that its memory doesn't grow with the tables.
PAIRS_PER_TASK = 1_000_000


def _candidates(spark, sf, units: DataFrame | None = None, changes: Callable[[Column], Column] | None = None) -> DataFrame:
    """Customers as examinees, each with a list of candidate units: the suppliers of its orders, so that pairs grow with the rows.

    A row is an examinee and a rule, with the array `units` of the candidate units that have it. units: those of _rules by default.
    changes: of an examinee's key, for simulation.compared; a row is then of the examinees with equal scores and changes, at most
    scoring.ALIKE of them, so that their scenarios run once, and `units` has their keys.
    """
    items = table(spark, sf, "lineitem")
    # pairs cost far more than rows, so people are dealt to all tasks however few files hold them; later groups by the key stay in place
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), items.count() // PAIRS_PER_TASK)
    lines = items.select("l_orderkey", F.col("l_suppkey").alias("s_suppkey"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    key, columns = "c_custkey", {"subjects": _subjects, **({"changes": changes} if changes else {})}
    if changes:
        people = orders.select("c_custkey").distinct().withColumns({n: f(F.col("c_custkey")) for n, f in columns.items()})
        # a key that is null stands for itself
        key, orders = "like", orders.join(scoring.alike(people, "c_custkey", [*columns]).repartition(tasks, "c_custkey"), "c_custkey", "left")
    pairs = orders.join(lines, "l_orderkey").drop("l_orderkey")
    rows = scoring.by_rule(pairs.repartition(tasks, key).distinct(), _rules(spark, sf) if units is None else units, key, "s_suppkey")
    return rows.withColumns({n: f(F.col(key)) for n, f in columns.items()}).withColumn("exam_type", F.lit("june_mock")).drop("like")


_ANALYSIS = """
with c as (
  select c_custkey as ck, s_suppkey as sk, 100 + c_custkey % 50 as ks, 60 + c_custkey % 40 as kp, 95 + c_custkey * 7 % 55 as ms, 55 + c_custkey * 7 % 45 as mp, 50 + c_custkey * 3 % 25 as i1s, 50 + c_custkey * 3 % 50 as i1p,
    case when c_custkey % 11 <> 0 then 48 + c_custkey * 5 % 25 end as i2s, case when c_custkey % 11 <> 0 then 45 + c_custkey * 5 % 55 end as i2p, 1 + c_custkey % 5 as eg, 1 + c_custkey % 4 as hg,
    case when s_suppkey % 3 = 1 then 100.0::double else 1000.0::double end as scale, s_suppkey % 7 <> 0 as verified from (select distinct o_custkey as c_custkey, l_suppkey as s_suppkey from orders join lineitem on l_orderkey = o_orderkey)),
e as (select *, [0.0, 2.0, 6.0, 12.0, 20.0][eg]::double as ep, case when hg = 4 then 2.0::double else 0.0::double end as hp from c),
v as (select *, case when i2s is null then null when not verified then (0.3::double * kp + 0.4::double * mp + 0.3::double * ((i1p + i2p) / 2.0::double)) / (0.3::double + 0.4::double + 0.3::double)
  when sk % 3 = 1 then (0.3::double * (kp / 100.0::double) + 0.4::double * (mp / 100.0::double) + 0.3::double * (((i1p + i2p) / 2.0::double) / 100.0::double)) / (0.3::double + 0.4::double + 0.3::double) * scale - ep - hp
  when sk % 3 = 0 then (0.3::double * (ks / 200.0::double) + 0.4::double * (ms / 200.0::double) + 0.3::double * (((i1s + i2s) / 2.0::double) / 200.0::double)) / (0.3::double + 0.4::double + 0.3::double) * scale - ep - hp
  else (0.3::double * (ks / 200.0::double) + 0.4::double * (ms / 200.0::double) + 0.3::double * (((i1p * 2 + i2p * 2) / 2.0::double) / 200.0::double)) / (0.3::double + 0.4::double + 0.3::double) * scale - ep - hp end as raw from e),
r as (select *, floor(raw * 100 + 0.5) / 100 as score, case when sk % 9 = 0 then null when verified then scale * (0.55::double + (sk % 10) / 100.0::double) else (70 + sk % 25)::double end as ref from v),
g as (select *, floor((score - ref) * 100 + 0.5) / 100 as gap, case when score is null then 'unsupported' when ref is null then 'insufficientData' else 'ok' end as kind,
  case when not verified then 'low' when sk % 3 = 2 then 'medium' else 'high' end as trust, case when verified then scale else 100.0::double end as own from r),
a as (select *, gap / own * 100 + (case when (sk % 30 - sk % 23) / (5 + sk % 23)::double <= -0.2 then -0.5::double when (sk % 30 - sk % 23) / (5 + sk % 23)::double >= 0.2 then 0.3::double else 0 end
  + case when (sk % 40) / (5 + sk % 30)::double >= 1 then 0.5::double else 0 end + case when 5 + sk % 30 < 10 then -0.5::double else 0 end
  + case when eg >= 3 and 6.0 / scale * 100 >= 1.0 then -0.5::double else 0 end - 0.3::double + case when trust = 'low' then -0.3::double else 0 end) as x from g),
b as (select *, case when kind <> 'ok' then null when x >= 1.5 then case when trust = 'low' then 'match' else 'stable' end when x >= -0.5 then 'match' when x >= -1.5 then 'reach' when x >= -3 then 'challenge' else 'risk' end as band from a)
"""


@query(_ANALYSIS + "select ck as c_custkey, sk as s_suppkey, kind, case when kind = 'ok' then score end as converted_score, case when kind = 'ok' then gap end as score_gap, band, case when kind = 'ok' then trust end as confidence from b")
def admission_analysis(spark, sf):
    return scoring.analyzed(_candidates(spark, sf), codes=False).select("c_custkey", "s_suppkey", "kind", "converted_score", "score_gap", "band", "confidence")


@query(
    _ANALYSIS
    + """select ck as c_custkey, count(*) filter (band = 'stable') as n_stable, count(*) filter (band = 'match') as n_match, count(*) filter (band = 'reach') as n_reach, count(*) filter (band = 'challenge') as n_challenge, count(*) filter (band = 'risk') as n_risk,
count(*) filter (kind = 'ok') as analyzed, count(*) filter (kind = 'unsupported') as unsupported, count(*) filter (kind = 'insufficientData') as insufficient from b group by ck"""
)
def band_distribution(spark, sf):
    kinds = [F.count(F.when(F.col("kind") == k, 1)).alias(n) for k, n in (("ok", "analyzed"), ("unsupported", "unsupported"), ("insufficientData", "insufficient"))]
    return scoring.analyzed(_candidates(spark, sf), codes=False).groupBy("c_custkey").agg(*aggregates.dense_counts("band", scoring.BANDS), *kinds)


@query(
    _ANALYSIS
    + """, g2 as (select *, ['ga', 'na', 'da'][sk % 3 + 1] as grp, list_position(['stable', 'match', 'reach', 'challenge', 'risk'], band) - 1 as rank, [1, 1, 2][sk % 3 + 1] as target from b where band is not null),
o as (select *, case when rank <= target then target - rank else 10 + rank end as ord from g2)
select ck as c_custkey, grp as recruitment_group, sk as unit_id, band, gap as score_gap, ['stable', 'match', 'reach'][target + 1] as target_band, ord <> 0 as fallback from o qualify row_number() over (partition by ck, grp order by ord, gap desc, sk) = 1"""
)
def application_plan(spark, sf):
    groups = F.array(*(F.lit(g) for g in scoring.GROUPS))
    results = scoring.analyzed(_candidates(spark, sf), codes=False).withColumn("recruitment_group", F.element_at(groups, (F.col("s_suppkey") % 3 + 1).cast("int"))).withColumnRenamed("s_suppkey", "unit_id")
    return scoring.application_plan(results, "balanced", by="c_custkey")


@query(
    _ANALYSIS
    + """, s as (select ck as user_id, min(list_position(['stable', 'match', 'reach', 'challenge', 'risk'], band)) - 1 as ours from b group by ck),
ev as (select event_id, user_id, case when value >= 85 and value <= 100 then 0 when value >= 65 and value <= 100 then 1 when value >= 45 and value <= 100 then 2 when value >= 25 and value <= 100 then 3 when value >= 0 and value <= 100 then 4 end as theirs from events)
select event_id, case when ours is null or theirs is null then 'uncertain' when ours = theirs then 'agree' when abs(ours - theirs) = 1 then 'near' else 'disagree' end as agreement from ev left join s using (user_id)"""
)
def cross_validate(spark, sf):
    names = F.array(*(F.lit(b) for b in scoring.BANDS))
    ours = scoring.analyzed(_candidates(spark, sf), codes=False).groupBy(F.col("c_custkey").alias("user_id")).agg(F.min(scoring.band_rank(F.col("band"))).alias("r"))
    ours = ours.select("user_id", F.try_element_at(names, F.col("r") + 1).alias("ours"))
    theirs = scoring.signal_band(F.lit("probability"), F.col("value").cast("decimal(20,6)").cast("string"))
    return table(spark, sf, "events").join(ours, "user_id", "left").select("event_id", scoring.agreement(F.col("ours"), theirs).alias("agreement"))


@query("""
with v as (select l_orderkey, l_extendedprice / 1000 as v, row_number() over (partition by l_orderkey order by l_extendedprice desc) as n from lineitem)
select l_orderkey, floor(sum(case n when 1 then v * 60 else v * 40 end) / 100 * 100 + 0.5) / 100 as score from v where n <= 2 group by l_orderkey having count(*) = 2
""")
def best_n_selection(spark, sf):
    v = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_extendedprice") / 1000).alias("v"))
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("v")))
    best = v.withColumn("n", n).filter("n <= 2").groupBy("l_orderkey").agg(F.count("*").alias("c"), F.sum(F.when(F.col("n") == 1, F.col("v") * 60).otherwise(F.col("v") * 40)).alias("s"))
    return best.filter("c = 2").select("l_orderkey", numeric.round2(F.col("s") / 100).alias("score"))


@query("""
select c_custkey, case when x >= 96 then 1 when x >= 89 then 2 when x >= 77 then 3 when x >= 60 then 4 when x >= 40 then 5 when x >= 23 then 6 when x >= 11 then 7 when x >= 4 then 8 else 9 end as grade
from (select c_custkey, least(greatest(floor(((c_acctbal + 1000) / 110 + 2.5) * 100 + 0.5) / 100, 0), 100) as x from customer)
""")
def simulate_grades(spark, sf):
    x = numeric.clamp(numeric.round2((F.col("c_acctbal") + 1000) / 110 + 2.5), 0, 100)
    return table(spark, sf, "customer").select("c_custkey", numeric.grade_of_percentile(x).alias("grade"))


@query("""
select event_id, event_type, case when value < 0 or value > 100 then 'percentile_range' else '' end as problems from events
""")
def validate_scores(spark, sf):
    none, value = F.lit(None).cast("double"), F.col("value")
    found = scoring.score_problems(F.lit("math"), none, none, value, none)
    return table(spark, sf, "events").select("event_id", "event_type", F.array_join(found, "|").alias("problems"))


# --- windows over events (an extension) ---


@query("select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n, max(value) as high from events group by all")
def event_windows(spark, sf):
    from tidemark.streaming.events import tumbling

    return tumbling(table(spark, sf, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
with g as (select user_id, ts, coalesce(ts >= lag(ts) over (partition by user_id order by ts) + interval 2 hour, true) as fresh from events),
s as (select user_id, ts, sum(fresh::int) over (partition by user_id order by ts) as k from g)
select user_id, min(ts) as start, max(ts) + interval 2 hour as stop, count(*) as n from s group by user_id, k
""")
def event_sessions(spark, sf):
    from tidemark.streaming.events import sessions

    found = sessions(table(spark, sf, "events"))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})
