"""Simulation results, coverage, containment, rule documents and audits: queries with their DuckDB oracles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.functions import text as texts
from tidemark.functions.text import compact, group_key
from tidemark.operators import clusters, containment, grids, guards, matrix
from tidemark.operators import orders as listing
from tidemark.plans import audits, coverage, ruledocs, scoring, simulation
from tidemark.plans.queries import _ANALYSIS, _CASES, NAMES, YEARS, _candidates, _rules, query, table
from tidemark.plans.worklists import listing_parts

# --- simulation ---

_ON = {
    "korean": "ck % 2 = 1 and ck % 10 <> 0",
    "math": "ck % 10 <> 0",
    "english": "ck % 2 = 0",
    "inquiry1": "ck % 10 <> 0",
    "inquiry2": "ck % 2 = 1 and ck % 10 <> 0 and ck % 11 <> 0",
}


def _scenario_sql() -> str:
    """The analysis with a scenario for each examinee: as _ANALYSIS, but values move where the scenario changes their subject."""
    on = lambda s: f"(({_ON[s]}) and scen in ('all', '{s}'))"
    moved = {
        "100 + c_custkey % 50 as ks": f"least(200, 100 + ck % 50 + case when {on('korean')} then 5 else 0 end) as ks",
        "60 + c_custkey % 40 as kp": f"least(100, 60 + ck % 40 + case when {on('korean')} then 3 else 0 end) as kp",
        "95 + c_custkey * 7 % 55 as ms": f"least(200, 95 + ck * 7 % 55 + case when {on('math')} then 6 else 0 end) as ms",
        "55 + c_custkey * 7 % 45 as mp": f"least(100, 55 + ck * 7 % 45 + case when {on('math')} then 4 else 0 end) as mp",
        "50 + c_custkey * 3 % 25 as i1s": f"least(200, 50 + ck * 3 % 25 + case when {on('inquiry1')} then 4 else 0 end) as i1s",
        "50 + c_custkey * 3 % 50 as i1p": f"least(100, 50 + ck * 3 % 50 + case when {on('inquiry1')} then 9 else 0 end) as i1p",
        "48 + c_custkey * 5 % 25 end as i2s": f"least(200, 48 + ck * 5 % 25 + case when {on('inquiry2')} then 2 else 0 end) end as i2s",
        "45 + c_custkey * 5 % 55 end as i2p": f"least(100, 45 + ck * 5 % 55 + case when {on('inquiry2')} then 5 else 0 end) end as i2p",
        "1 + c_custkey % 5 as eg": f"greatest(1, 1 + ck % 5 - case when {on('english')} then 1 else 0 end) as eg",
        "- 0.3::double + case when trust": "+ case when sk % 5 = 0 then -0.3::double else 0 end - 0.3::double + case when trust",
    }
    sql = _ANALYSIS
    for old, new in moved.items():
        assert old in sql, old
        sql = sql.replace(old, new)
    head = "select c_custkey as ck, s_suppkey as sk,"
    assert head in sql
    sql = sql.replace(head, "select ck, sk, scen,").replace("c_custkey", "ck").replace("s_suppkey", "sk")
    start = sql.index("from (select distinct")
    end = sql.index("),\ne as")
    pairs = sql[start + len("from ") : end].replace(" as ck", " as ck").strip()
    several = "(case when " + " then 1 else 0 end + case when ".join(_ON.values()) + " then 1 else 0 end) > 1"
    each = " union all ".join(f"select ck, sk, '{s}' as scen from p where ({c}) and {several}" for s, c in _ON.items())
    return f"with p as {pairs}, s as (select ck, sk, unnest(['baseline', 'all']) as scen from p union all {each}), " + sql[:start].strip().removeprefix("with ") + " from s" + sql[end:]


_BANDS = "['stable', 'match', 'reach', 'challenge', 'risk']"
_NAMES = {s: c for s, c in _ON.items()}


def _simulation_oracle() -> str:
    rank = lambda b: f"list_position({_BANDS}, {b})"
    improved = ", ".join(f"count(*) filter (coalesce({rank('b_' + s)}, 9) < coalesce({rank('before')}, 6)) as up_{s}" for s in _ON)
    alone = ", ".join(f"max(band) filter (scen = '{s}') as b_{s}" for s in _ON)
    counts = ", ".join(f"count(*) filter ({when} = '{b}') as {name}_{b}" for when, name in (("before", "baseline"), ("after", "simulated")) for b in scoring.BANDS)
    ups = ", ".join(f"case when {c} then {{'n': up_{s}, 'i': -{i}, 's': '{s}'}} end" for i, (s, c) in enumerate(_ON.items()))
    approach = lambda b: f"coalesce({_BANDS}[coalesce(min({rank(b)}) filter (target), min({rank(b)}))], 'limited')"
    return f"""{_scenario_sql().strip()},
u as (select ck, sk, max(sk % 4 = ck % 4) as target, max(band) filter (scen = 'baseline') as before, max(band) filter (scen = 'all') as after, {alone},
  bool_or(scen = 'all' and kind = 'ok' and eg >= 3 and 6.0 / scale * 100 >= 1.0) as w_e, bool_or(scen = 'all' and kind = 'ok' and sk % 5 = 0) as w_i, bool_or(i2s is not null) as has2 from b group by ck, sk),
t as (select ck, {counts}, count(*) filter (before is distinct from after) as changed, count(*) filter (after in ('stable', 'match') and coalesce(before not in ('stable', 'match'), true)) as moved_to_match_or_better,
  {approach('before')} as approach_before, {approach('after')} as approach_after, {improved}, bool_or(w_e) as w_e, bool_or(w_i) as w_i, bool_or(has2) as has2 from u group by ck),
z as (select *, list_filter([{ups}], lambda x: x is not null) as ups from t)
select ck as c_custkey, {", ".join(f"{n}_{b}" for n in ("baseline", "simulated") for b in scoring.BANDS)}, changed, moved_to_match_or_better, approach_before, approach_after,
  list_sort(ups, 'DESC')[1].s as most_efficient_subject, case when len(ups) > 1 then list_sort(ups, 'DESC')[1].n end as units_improved,
  array_to_string(list_filter([case when w_e then 'english' end, case when w_i then 'inquiry1' end, case when w_i and has2 then 'inquiry2' end], lambda x: x is not null), '|') as caution_subjects
from z"""


def _changes(k):
    """Changes of three to five subjects, or only of English for one examinee in ten."""
    d = simulation.change
    entry = lambda name, on, **values: F.when(on, F.struct(F.lit(name).alias("k"), d(**values).alias("v")))
    many, odd = k % 10 != 0, (k % 2 == 1) & (k % 10 != 0)
    rows = F.array_compact(
        F.array(
            entry("korean", odd, standard_delta=5, percentile_delta=3),
            entry("math", many, standard_delta=6, percentile_delta=4),
            entry("inquiry1", many, standard_delta=4, percentile_delta=9),
            entry("inquiry2", odd & (k % 11 != 0), standard_delta=2, percentile_delta=5),
            entry("english", k % 2 == 0, grade_delta=-1),
        )
    )
    return F.map_from_entries(rows)


def _simulation_candidates(spark, sf):
    risk = F.col("rule").withField("inquiry_policy.conversion_risk", F.col("s_suppkey") % 5 == 0)
    return _candidates(spark, sf, _rules(spark, sf).withColumn("rule", risk), _changes)


@query(_simulation_oracle())
def simulation_results(spark, sf):
    pairs = simulation.compared(_simulation_candidates(spark, sf), ["c_custkey"], "s_suppkey", target=F.col("s_suppkey") % 4 == F.col("c_custkey") % 4)
    return simulation.results(pairs, ["c_custkey"])


# --- rule documents ---


def _cases(key: str, n: int, by: dict[int, str], otherwise: str) -> str:
    return f"case {key} % {n} " + " ".join(f"when {i} then {v}" for i, v in by.items()) + f" else {otherwise} end"


# JSON text by the same expression in both engines; most parts have a document that doesn't fit in some way
_W = """'"weights":{"korean":0.' || (p_partkey % 9 + 1) || ',"math":0.4,"inquiry":0.3}'"""
_DOCUMENTS = {
    "formula": _cases(
        "p_partkey",
        13,
        {
            0: f"""'{{"totalScale":100,' || {_W}""",
            1: """'{"totalScale":100,"weights":{"korean":0.3,"inquiry":0.3}}'""",
            2: f"""'{{"totalScale":"100",' || {_W} || '}}'""",
            3: """'{"totalScale":100,"weights":{"korean":-0.3,"math":0.4,"inquiry":0.3}}'""",
            4: f"""'{{"totalScale":' || (p_partkey % 50 + 1) || ',"unknown":[1,{{"a":null}}],' || {_W} || '}}'""",
            5: f"""'{{"totalScale":100,' || {_W} || ',"alternatives":[{{' || {_W} || '}},{{' || {_W} || ',"subjectAdjustments":[{{"subject":"math","capAtMax":true}}]}}]}}'""",
            6: f"""'{{"totalScale":100,' || {_W} || ',"alternatives":[{{' || {_W} || '}},{{' || {_W} || ',"subjectAdjustments":[{{"subject":"math","multiplier":1.' || (p_partkey % 7) || '}}]}}]}}'""",
            7: f"""'{{"totalScale":100,"calculationMode":null,' || {_W} || '}}'""",
            8: f"""'{{"totalScale":100,' || {_W} || ',"selectionPolicy":{{"mode":"best_n_subjects","count":2,"subjects":["korean","math"],"rankWeights":[' || repeat('1,', CAST(p_partkey % 3 AS INT)) || '2]}}}}'""",
            9: f"""'{{"totalScale":100,' || {_W} || ',"selectionPolicy":{{"mode":"best_n_subjects","count":1,"subjects":["korean","math"],"requiredSubjects":["' || {_cases("p_partkey", 2, {0: "'math'"}, "'english'")} || '"]}}}}'""",
            10: f"""'{{"totalScale":100,' || {_W} || ',"calculationMode":"' || {_cases("p_partkey", 2, {0: "'weighted_sum'"}, "'median'")} || '"}}'""",
        },
        f"""'{{"totalScale":1000,' || {_W} || ',"scoreMaxes":{{"math":150}}}}'""",
    ),
    "english": _cases(
        "p_partkey",
        7,
        {
            0: """'{"mode":"ratio","byGrade":{"1":100}}'""",
            1: """'{"mode":"deduction","byGrade":{"10":1}}'""",
            2: """'{"mode":"ratio","weight":20,"byGrade":{"1":100,"2":9' || (p_partkey % 10) || '}}'""",
            3: """'{"mode":"addition","byGrade":{"1":"5"}}'""",
        },
        """'{"mode":"deduction","byGrade":{"1":0,"2":' || (p_partkey % 4) || '.5}}'""",
    ),
    "history": _cases("p_partkey", 5, {0: """'{"mode":"deduction"}'"""}, """'{"byGrade":{"1":0,"4":' || (p_partkey % 3) || '}}'"""),
    "inquiry": _cases(
        "p_partkey",
        6,
        {
            0: """'{"count":' || (p_partkey % 4) || ',"mode":"average"}'""",
            1: """'{"count":2,"mode":"sum","conversionTable":{"from":"percentile","byPercentile":{"' || (95 + p_partkey % 12) || '":70}}}'""",
        },
        """'{"count":2,"mode":"average","conversionRisk":' || (p_partkey % 4 = 0) || '}'""",
    ),
    "eligibility": _cases("p_partkey", 8, {0: """'{"maxHistoryGrade":4.5}'""", 1: "cast(null as varchar(9))", 2: """'{"maxHistoryGrade":' || (p_partkey % 12) || '}'"""}, "'{}'"),
}
_JSON = "with d as (select p_partkey, " + ", ".join(f"{sql} as {n}" for n, sql in _DOCUMENTS.items()) + " from part), j as (select p_partkey, " + ", ".join(f"try_cast({n} as json) as {n}" for n in _DOCUMENTS) + " from d)"
_NUM = "('UBIGINT', 'BIGINT', 'DOUBLE')"


def _is_number(path: str, test: str = "true", of: str = "formula") -> str:
    return f"coalesce(json_type({of}, '{path}') in {_NUM} and cast({of} ->> '{path}' as double) {test}, false)" if test != "true" else f"coalesce(json_type({of}, '{path}') in {_NUM}, false)"


def _all_weights(at: str) -> str:
    return " and ".join(_is_number(f"{at}.weights.{s}", ">= 0") for s in ("korean", "math", "inquiry"))


_FITS = f"""{_JSON}, a as (select *, json_type(formula, '$.alternatives') is null or (
    {_all_weights("$.alternatives[0]")} and {_all_weights("$.alternatives[1]")}
    and (json_type(formula, '$.alternatives[1].subjectAdjustments[0].multiplier') is not null or json_type(formula, '$.alternatives[1].subjectAdjustments[0].points') is not null)) as alternatives_fit,
  json_type(formula, '$.selectionPolicy') is null or (
    (json_type(formula, '$.selectionPolicy.rankWeights') is null or json_array_length(formula, '$.selectionPolicy.rankWeights') = cast(formula ->> '$.selectionPolicy.count' as int))
    and (json_type(formula, '$.selectionPolicy.requiredSubjects') is null or formula ->> '$.selectionPolicy.requiredSubjects[0]' in ('korean', 'math'))) as selection_fits from j),
f as (select *, formula is not null and {_is_number("$.totalScale", "> 0")} and {_all_weights("$")} and alternatives_fit and selection_fits
    and (json_type(formula, '$.calculationMode') is null or coalesce(formula ->> '$.calculationMode', '') in ('weighted_average', 'weighted_sum', 'normalized_sum')) as formula_fits,
  coalesce(len(list_filter(json_keys(english, '$.byGrade'), lambda g: length(g) <> 1 or json_type(english, '$.byGrade.' || g) not in {_NUM})) = 0, false) and (english ->> '$.mode' <> 'ratio' or {_is_number("$.weight", "> 0", "english")}) as english_fits,
  json_type(history, '$.byGrade') is not null as history_fits,
  {_is_number("$.count", "in (1, 2)", "inquiry")} and coalesce(len(list_filter(json_keys(inquiry, '$.conversionTable.byPercentile'), lambda g: cast(g as int) > 100)) = 0, true) as inquiry_fits,
  json_type(eligibility, '$.maxHistoryGrade') is null or (json_type(eligibility, '$.maxHistoryGrade') <> 'DOUBLE' and cast(eligibility ->> '$.maxHistoryGrade' as double) between 1 and 9) as eligibility_fits from a)
"""


@query(
    _FITS
    + """select p_partkey, formula_fits, english_fits, history_fits, inquiry_fits, eligibility_fits, ok as mapped, case when ok then cast(formula ->> '$.totalScale' as double) end as total_scale,
  case when ok then cast(formula ->> '$.weights.korean' as double) end as korean_weight, case when ok then json_array_length(formula, '$.alternatives')::int end as alternatives,
  case when ok then cast(formula ->> '$.alternatives[1].subjectAdjustments[0].multiplier' as double) end as multiplier, case when ok then cast(english ->> '$.byGrade."2"' as double) end as english_2,
  case when ok then formula ->> '$.calculationMode' end as calculation_mode, case when ok then cast(eligibility ->> '$.maxHistoryGrade' as int) end as max_history_grade
from (select *, formula_fits and english_fits and history_fits and inquiry_fits and eligibility_fits as ok from f)"""
)
def rule_documents(spark, sf):
    documents = table(spark, sf, "part").select("p_partkey", F.lit("standard").alias("score_type"), F.lit("verified").alias("verified_status"), *(F.expr(sql).alias(n) for n, sql in _DOCUMENTS.items()))
    rule = F.col("rule")
    second = F.try_element_at(F.try_element_at(rule["alternatives"], F.lit(2))["subject_adjustments"], F.lit(1))
    return ruledocs.mapped(documents, {n: n for n in _DOCUMENTS}).select(
        "p_partkey",
        *(f"{n}_fits" for n in _DOCUMENTS),
        rule.isNotNull().alias("mapped"),
        rule["total_scale"].alias("total_scale"),
        rule["weights"]["korean"].alias("korean_weight"),
        F.size(rule["alternatives"]).alias("alternatives"),
        second["multiplier"].alias("multiplier"),
        F.try_element_at(rule["english_policy"]["by_grade"], F.lit(2)).alias("english_2"),
        rule["calculation_mode"].alias("calculation_mode"),
        rule["eligibility"]["max_history_grade"].alias("max_history_grade"),
    )


# --- containment ---

_LINES = "select l_orderkey * 10 + l_linenumber as line, p_name || ' ' || p_brand || ' ' || p_type || ' ' || l_returnflag || ' ' || cast(l_quantity as int) || ' ' || cast(l_discount * 100 as int) as row_text from lineitem join part on l_partkey = p_partkey"
_WANTED = """select p_partkey, case when p_partkey % 50 <> 0 then p_name || case when p_partkey % 3 = 0 then '' else '  ' || p_brand end || case when p_partkey % 17 = 0 then '?' else '' end end as name,
  case p_partkey % 4 when 0 then 'A' when 1 then 'Z' end as grp, case when p_partkey % 7 > 0 then cast(p_size as double) end as quota, case when p_partkey % 5 > 0 then p_partkey % 11 + 0.02 end as rate from part"""


@query(f"""
with r as materialized ({_LINES}), w as ({_WANTED}), n as (select *, regexp_replace(coalesce(name, ''), '\\s+', '', 'g') as compact_name from w),
t as (select *, regexp_replace(row_text, '\\s+', '', 'g') as compact_text, list_transform(regexp_extract_all(row_text, '-?\\d+(?:\\.\\d+)?'), lambda x: cast(x as double)) as nums from r),
names as (select distinct compact_name from n where compact_name <> ''), hits as (select compact_name, line, row_text, nums from names join t on contains(compact_text, compact_name)),
m as (select p_partkey, compact_name, grp, quota, rate, row_text is not null and (grp is null or contains(row_text, grp)) as grouped, row_text is not null as there,
  concat_ws('|', case when quota is not null and len(list_filter(nums, lambda x: abs(x - quota) <= 0.001)) = 0 then 'quota' end, case when rate is not null and len(list_filter(nums, lambda x: abs(x - rate) <= 0.03)) = 0 then 'rate' end) as lacks
  from n left join hits using (compact_name)),
c as (select p_partkey, any_value(compact_name) as compact_name, any_value(quota) is null and any_value(rate) is null as nothing, bool_or(there) as there, bool_or(grouped) as grouped, count(*) filter (grouped and lacks = '') as ok from m group by p_partkey),
l as (select p_partkey, lacks from (select p_partkey, lacks, count(*) as k from m where grouped and lacks <> '' group by all) qualify row_number() over (partition by p_partkey order by k desc, lacks) = 1),
s as (select p_partkey, ok, lacks, case when compact_name = '' then 'missing_unit_name' when not there then 'unit_not_in_source_row' when not grouped then 'group_not_in_source_row' when nothing then 'missing_required_values' when ok > 0 then 'matched' else 'source_row_values_missing' end as status from c left join l using (p_partkey))
select p_partkey, status, case when status = 'matched' then ok end as matched_rows, case when status = 'source_row_values_missing' then lacks end as lacking from s
""")
def verified_outcomes(spark, sf):
    for name in ("lineitem", "part"):
        table(spark, sf, name).createOrReplaceTempView(name)
    rows, wanted = spark.sql(_LINES), spark.sql(_WANTED)
    needed = containment.required({"quota": (F.col("quota"), 0.001), "rate": (F.col("rate"), 0.03)})
    return containment.verified(wanted.withColumn("needed", needed), rows, key="p_partkey", group="grp")


@query("""
with n as (select distinct w from (select unnest(string_split(p_name || ' ' || lower(p_type), ' ')) as w from part)), d as (select doc_id, regexp_replace(text, '\\s+', '', 'g') as t from documents)
select w as needle, count(*) as documents, min(doc_id) as first_doc from n join d on contains(t, w) group by w
""")
def names_in_documents(spark, sf):
    names = table(spark, sf, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")).alias("needle"))
    texts = table(spark, sf, "documents").select("doc_id", compact(F.col("text")).alias("text"))
    return containment.contained(texts, names, key="doc_id").groupBy("needle").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


# --- the coverage matrix: all sources in one shuffle ---

_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
# counter -> condition on a line with its order; the same text is used by both engines
_LINE_COUNTERS = {
    "outcomes": "l_quantity > 5",
    "outcome_scores": "l_quantity > 5 and l_discount > 0.03",
    "quota_competition": "l_quantity > 5 and l_tax > 0.02",
    "medium_confidence": "l_quantity > 30",
    "low_confidence": "l_quantity between 6 and 15",
    "csat_rules": "l_returnflag = 'R'",
    "quota_drafts": "l_returnflag = 'A' and l_linestatus = 'F'",
    "screening_drafts": "l_returnflag = 'A' and l_linestatus = 'O'",
    "record_drafts": "l_returnflag = 'N' and l_quantity > 20",
    "eligibility_drafts": "l_returnflag = 'N' and l_quantity <= 20",
    "drafts_high_or_medium": "l_discount >= 0.06",
    "drafts_low_or_limited": "l_discount < 0.02",
}
_ORDER_COUNTERS = {"units": "true", "schedules": "o_orderstatus = 'F'", "queue_p0": "o_orderpriority = '1-URGENT'", "queue_p1": "o_orderpriority = '2-HIGH'", "queue_p2": "o_orderpriority = '3-MEDIUM'", "queue_p3": "o_orderpriority = '5-LOW'"}
_NATIONAL = "o_totalprice > 499000 and o_orderpriority = '1-URGENT'"
_CELL_COUNTS = {k: k for k in coverage.POINTS if k != "listed"}


def _coverage_oracle() -> str:
    line = ", ".join(f"count(*) filter ({c}) as {n}" for n, c in _LINE_COUNTERS.items())
    order = ", ".join(f"count(*) filter ({c}) as {n}" for n, c in _ORDER_COUNTERS.items())
    zero = ", ".join(f"coalesce({n}, 0) as {n}" for n in (*_LINE_COUNTERS, *(x for x in _ORDER_COUNTERS if x != "schedules"), "year_evidence", "collection_evidence", "academy_metrics"))
    return f"""
with o as (select *, year(o_orderdate) as y from orders), ol as (select o.o_custkey, year(l_shipdate) as y, lineitem.* from lineitem join o on l_orderkey = o_orderkey),
cells as (select c_custkey, unnest({YEARS}) as y, c_acctbal from customer),
a as (select o_custkey as c_custkey, y, {line} from ol group by all), b as (select o_custkey as c_custkey, y, {order}, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) as best_order from o group by all),
e as (select o_custkey as c_custkey, y, count(*) as year_evidence from (select distinct o_orderkey, o_custkey, unnest([y, y + 1, y]) as y from o where o_totalprice > 250000) group by all),
f as (select o_custkey as c_custkey, y - 1 as y, count(*) as collection_evidence from o where o_orderstatus = 'P' group by all),
g as (select o_custkey as c_custkey, y, count(*) as academy_metrics from ol where l_linenumber = 1 group by all),
m as (select c_custkey, y, string_agg(p, '|' order by k desc, p) as unit_groups from (select o_custkey as c_custkey, y, o_orderpriority as p, count(*) as k from o group by all) group by all),
national as (select distinct y, true as has from o where {_NATIONAL}),
j as (select c_custkey, y + 26 as year, case when (c_acctbal + y) % 7 >= 1 then 1 else 0 end as listed, {zero}, coalesce(schedules, 0) + case when has and coalesce(schedules, 0) = 0 then 1 else 0 end as schedules,
  case when has and coalesce(schedules, 0) = 0 then 1 else 0 end as national_schedules, coalesce(unit_groups, '') as unit_groups, best_order, c_custkey % 5 as n_nationkey
  from cells left join a using (c_custkey, y) left join b using (c_custkey, y) left join e using (c_custkey, y) left join f using (c_custkey, y) left join g using (c_custkey, y) left join m using (c_custkey, y) left join national using (y)),
s as (select *, case when listed = 0 then ['{coverage.UNLISTED}'] else list_filter([{", ".join(f"case when {k} = 0 and not {_CASES.get(k, 'false')} then '{v}' end" for k, v in coverage.FLAGS.items())}], lambda x: x is not null) end as flags,
  least({" + ".join(f"case when {k} > 0 then {v} else 0 end" for k, v in coverage.POINTS.items())}, 100) as score from j)
select c_custkey, year, {", ".join((*_LINE_COUNTERS, *_ORDER_COUNTERS, "year_evidence", "collection_evidence", "academy_metrics", "national_schedules"))}, unit_groups, best_order, score::int as score, array_to_string(flags, '|') as flags,
  case when score >= 80 and not list_contains(flags, 'missing_outcome_scores') and not list_contains(flags, 'missing_csat_rule_draft') then 'source_rich_review_ready' when score >= 60 then 'review_ready_partial' when score >= 35 then 'partial_evidence' else 'source_gap' end as tier from s
"""


@query(_coverage_oracle())
def coverage_audit(spark, sf):
    orders = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    lines = table(spark, sf, "lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("y", F.year("l_shipdate"))
    who, y = F.col("o_custkey"), F.col("y")
    sources = [
        matrix.Source(lines, who, y, {n: F.expr(c) for n, c in _LINE_COUNTERS.items()} | {"academy_metrics": F.col("l_linenumber") == 1}),
        matrix.Source(orders, who, y, {n: F.expr(c) for n, c in _ORDER_COUNTERS.items()}, {"unit_groups": (F.col("o_orderpriority"), _PRIORITIES)}, {"best_order": (F.struct(-F.col("o_totalprice"), "o_orderkey"), F.col("o_orderkey"))}),
        matrix.Source(orders.filter("o_totalprice > 250000"), who, F.array(y, y + 1, y), {"year_evidence": None}),
        matrix.Source(orders.filter("o_orderstatus = 'P'"), who, y - 1, {"collection_evidence": None}),
    ]
    scaffold = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.explode(F.array(*map(F.lit, YEARS))).alias("y"))
    cells = matrix.matrix(scaffold, "c_custkey", "y", sources)
    cells = matrix.filled(cells, "y", "schedules", orders.filter(_NATIONAL).select("y"), "national_schedules").withColumn("year", y + 26)
    counts = {"listed": F.when((F.col("c_acctbal") + y) % 7 >= 1, 1).otherwise(0)} | {k: F.col(k) for k in _CELL_COUNTS}
    excluded = F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("missing_schedule_draft"), F.lit("missing_csat_rule_draft"))).otherwise(F.array().cast("array<string>"))
    done = cells.withColumn("_flags", coverage.missing_flags(counts, F.col("year"), excluded)).withColumn("score", coverage.coverage_score(counts))
    names = (*_LINE_COUNTERS, *_ORDER_COUNTERS, "year_evidence", "collection_evidence", "academy_metrics", "national_schedules")
    return done.select("c_custkey", "year", *names, F.array_join("unit_groups", "|").alias("unit_groups"), "best_order", "score", F.array_join("_flags", "|").alias("flags"), coverage.coverage_tier(F.col("score"), F.col("_flags")).alias("tier"))


# --- rules of all shapes ---

_SHAPES_SQL = """
with c as (select c_custkey as ck, s_suppkey as sk, s_suppkey % 10 as shape, 100 + c_custkey % 50 as ks, 60 + c_custkey % 40 as kp, 95 + c_custkey * 7 % 55 as ms, 55 + c_custkey * 7 % 45 as mp, 50 + c_custkey * 3 % 25 as i1s, 50 + c_custkey * 3 % 50 as i1p,
    case when c_custkey % 11 <> 0 then 48 + c_custkey * 5 % 25 end as i2s, case when c_custkey % 11 <> 0 then 45 + c_custkey * 5 % 55 end as i2p, 1 + c_custkey % 5 as eg, 1 + c_custkey % 4 as hg, c_custkey % 2 = 1 as calculus, c_custkey % 3 <> 0 as sci1, case when c_custkey % 11 <> 0 then c_custkey % 2 = 0 end as sci2
  from (select distinct o_custkey as c_custkey, l_suppkey as s_suppkey from orders join lineitem on l_orderkey = o_orderkey)),
e as (select *, [0, 2, 6, 12, 20][eg]::double as ep, [100, 95, 88, 80, 70][eg]::double as er, case when hg = 4 then 2.0::double else 0.0::double end as hp, (i1s + i2s) / 2.0::double as inq,
  case when calculus then least(ms * 1.1::double, 200) else ms end as ms6, ((i1s + case when sci1 then 3 else 0 end) + (i2s + case when sci2 then 3 else 0 end)) / 2.0::double as inq6,
  case when i1p <= 90 and i2p <= 90 then (i1p * 0.7::double + i2p * 0.7::double) / 2 end as table5,
  least(mp * 0.1::double, 8) as f_math, case when sci1 then i1s * 0.05::double else 0 end + case when sci2 then i2s * 0.05::double else 0 end as f_inq from c),
v as (select *, case shape
    when 0 then ks * 1.0::double + ms * 1.2::double + inq * 0.5::double - ep - hp
    when 1 then (10 + ks / 200.0::double * 100) + ms / 200.0::double * 100 + inq / 200.0::double * 50 - ep - hp
    when 2 then case when inq is not null then (greatest(ms / 200.0::double * 100, o) * 60 + least(ms / 200.0::double * 100, o) * 40) / 100 / 100 * 1000 - hp end
    when 3 then (0.3::double * (ks / 200.0::double) + 0.4::double * (ms / 200.0::double) + 0.3::double * (greatest(i1s, coalesce(i2s, 0)) / 200.0::double)) / (0.3::double + 0.4::double + 0.3::double) * 1000 - ep - hp
    when 4 then (0.3::double * (ks / 200.0::double) + 0.4::double * (ms / 200.0::double) + 0.3::double * ((i1s + i2s) / 400.0::double)) / (0.3::double + 0.4::double + 0.3::double) * 1000 - ep - hp
    when 5 then (0.3::double * (ks / 200.0::double) + 0.4::double * (ms / 200.0::double) + 0.3::double * (table5 / 70.0::double)) / (0.3::double + 0.4::double + 0.3::double) * 1000 - ep - hp
    when 6 then (0.3::double * (ks / 200.0::double) + 0.4::double * (ms6 / 200.0::double) + 0.3::double * (inq6 / 200.0::double)) / (0.3::double + 0.4::double + 0.3::double) * 1000 - ep - hp
    when 7 then greatest(ks * 1.0::double + ms * 1.0::double + inq * 0.5::double, ks * 0.5::double + ms * 1.5::double + inq * 0.5::double) - ep - hp
    when 8 then (0.3::double * (ks / 200.0::double) + 0.4::double * (ms / 200.0::double) + 0.3::double * (inq / 200.0::double)) / (0.3::double + 0.4::double + 0.3::double) * 1000 - ep + (f_math + f_inq - hp)
    else (0.3::double * (ks / 200.0::double) + 0.4::double * (ms / 200.0::double) + 0.3::double * (inq / 200.0::double)) / (0.3::double + 0.4::double + 0.3::double) * 1000 - ep - hp end as raw,
  shape = 9 and (not calculus or hg > 3 or not (sci1 and coalesce(sci2, true))) as barred from (select *, greatest(ks / 200.0::double * 100, inq / 200.0::double * 100, er) as o from e)),
r as (select *, floor((case when shape = 7 and inq is null then null else raw end) * 100 + 0.5) / 100 as score, case when sk % 9 = 0 then null when shape in (0, 7) then 250.0::double + sk % 40 when shape = 1 then 120.0::double + sk % 40 else 500.0::double + sk % 100 end as ref from v),
g as (select *, floor((score - ref) * 100 + 0.5) / 100 as gap, case when barred then 'ineligible' when score is null then 'unsupported' when ref is null then 'insufficientData' else 'ok' end as kind, case when shape = 2 then 20 / (0.3::double + 0.4::double + 0.3::double + 20) * (12.0::double / 100) * 100 else 0.6::double end as spread,
  case when shape in (0, 7) then 600.0::double when shape = 1 then 260.0::double else 1000.0::double end as scale, (kp + mp + i1p + coalesce(i2p, 0)) / (case when i2p is null then 3 else 4 end)::double as mean from r),
x as (select *, case when shape in (0, 1, 7) then 6.0 / scale * 100 else spread end as sp from g),
a as (select *, gap / scale * 100 + (case when (sk % 30 - sk % 23) / (5 + sk % 23)::double <= -0.2 then -0.5::double when (sk % 30 - sk % 23) / (5 + sk % 23)::double >= 0.2 then 0.3::double else 0 end
  + case when (sk % 40) / (5 + sk % 30)::double >= 1 then 0.5::double else 0 end + case when 5 + sk % 30 < 10 then -0.5::double else 0 end + case when eg >= 3 and sp >= 1.0 then -0.5::double else 0 end) as z from x),
b as (select *, case when kind <> 'ok' then null when z >= 1.5 then 'stable' when z >= -0.5 then 'match' when z >= -1.5 then 'reach' when z >= -3 then 'challenge' else 'risk' end as band,
  mp >= mean + 2 as math_up, kp >= mean + 2 as korean_up, case when shape = 0 then 1.2 when shape = 1 then 100 when shape = 7 then 1.0 else 0.4 end >= 0.35 as math_heavy, case when shape = 0 then 1.0 when shape = 1 then 100 when shape = 7 then 1.0 else 0.3 end >= 0.35 as korean_heavy from a)
select ck as c_custkey, sk as s_suppkey, kind, case when kind = 'ok' then score end as converted_score, band,
  case when kind = 'ok' then concat_ws('|', case when math_up and math_heavy then 'math_weight_advantage' end, case when korean_up and korean_heavy then 'korean_weight_advantage' end, case when eg >= 2 and sp <= 0.5 then 'english_low_penalty_advantage' end,
    case when least(i1p, i2p) >= 85 and i2p is not null and abs(i1p - i2p) <= 5 then 'science_stable' end, case when band in ('stable', 'match') then 'standard_score_fit' end, case when math_up and math_heavy then 'explore_math_heavy' end, case when eg >= 3 and sp >= 1.0 then 'avoid_english_penalty' end,
    case when mp <= mean - 2 then 'simulate_math_up' end, case when i1p <= mean - 2 or coalesce(i2p <= mean - 2, false) then 'simulate_explore_up' end, 'compare_after_jinhak', case when band in ('reach', 'challenge') then 'build_application_plan' end) end as reasons,
  case when kind = 'ok' then concat_ws('|', case when eg >= 3 and sp >= 1.0 then 'english_penalty_risk' end, case when 5 + sk % 30 < 10 then 'small_quota_risk' end) end as warnings
from b
"""


def _shaped(k):
    """Rules of ten shapes by the unit's key: both sums, a selection, the ways to take inquiry, adjustments, alternatives, final points, eligibility."""
    shape, none, num = k % 10, F.lit(None), lambda x: F.lit(float(x))
    triple = lambda a, b, c: F.struct(num(a).alias("korean"), num(b).alias("math"), num(c).alias("inquiry"))
    grades = lambda *v: F.create_map(*(x for i, p in enumerate(v, 1) for x in (F.lit(i), num(p))))
    deduct, ratio = F.struct(F.lit("deduction").alias("mode"), grades(0, 2, 6, 12, 20).alias("b"), none.cast("double").alias("w"), none.cast("double").alias("s")), F.struct(F.lit("ratio").alias("mode"), grades(100, 95, 88, 80, 70).alias("b"), num(20).alias("w"), num(100).alias("s"))
    past = F.struct(F.lit("deduction").alias("mode"), grades(0, 0, 0, 2).alias("b"), none.cast("double").alias("w"), none.cast("double").alias("s"))
    table = F.map_from_arrays(F.sequence(F.lit(45), F.lit(90)), F.transform(F.sequence(F.lit(45), F.lit(90)), lambda x: x * F.lit(0.7)))
    inquiry = lambda count, mode, t=False: F.struct(F.lit(count).alias("count"), F.lit(mode).alias("mode"), none.cast("boolean").alias("r"), F.lit("percentile" if t else None).alias("f"), F.lit(70.0 if t else None).cast("double").alias("m"), (table if t else none.cast("map<int,double>")).alias("t"))
    condition = lambda subject, selections, category: [F.lit(subject).alias("subject"), (F.array(F.lit(selections)) if selections else none.cast("array<string>")).alias("a"), F.lit(category).cast("string").alias("b"), none.cast("int").alias("c")]
    adjusted = F.array(F.struct(*condition("math", "미적분", None), num(1.1).alias("m"), none.cast("double").alias("p"), F.lit(True).alias("cap")), F.struct(*condition("inquiry", None, "science"), none.cast("double").alias("m"), num(3).alias("p"), F.lit(False).alias("cap")))
    final = F.array(F.struct(*condition("math", None, None), F.lit("percentile").alias("f"), num(0.1).alias("m"), num(8).alias("x")), F.struct(*condition("inquiry", None, "science"), F.lit("standardScore").alias("f"), num(0.05).alias("m"), none.cast("double").alias("x")))
    names = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    selection = F.struct(F.lit(2).alias("count"), names("korean", "math", "english", "inquiry").alias("s"), names("math").alias("r"), F.array(num(60), num(40)).alias("w"), none.cast("array<struct<count:int,subjects:array<string>,required_subjects:array<string>,rank_weights:array<double>>>").alias("g"))
    leaf = lambda *w: scoring.alternative_struct(calculation_mode=F.lit("weighted_sum"), weights=triple(*w))
    return scoring.rule_struct(
        score_type=F.lit("standard"),
        verified_status=F.lit("verified"),
        total_scale=F.when(shape.isin(0, 7), num(600)).when(shape == 1, num(260)).otherwise(num(1000)),
        calculation_mode=F.when(shape.isin(0, 7), "weighted_sum").when(shape == 1, "normalized_sum"),
        weights=F.when(shape == 0, triple(1, 1.2, 0.5)).when(shape == 1, triple(100, 100, 50)).when(shape == 7, triple(1, 1, 0.5)).otherwise(triple(0.3, 0.4, 0.3)),
        subject_base_scores=F.when(shape == 1, F.struct(num(10).alias("korean"), none.cast("double").alias("math"), none.cast("double").alias("inquiry"))),
        selection_policy=F.when(shape == 2, selection),
        english_policy=F.when(shape == 2, ratio).otherwise(deduct),
        history_policy=past,
        inquiry_policy=F.when(shape == 3, inquiry(1, "best_one")).when(shape == 4, inquiry(2, "sum")).when(shape == 5, inquiry(2, "average", True)).otherwise(inquiry(2, "average")),
        subject_adjustments=F.when(shape == 6, adjusted),
        alternatives=F.when(shape == 7, F.array(leaf(1, 1, 0.5), leaf(0.5, 1.5, 0.5))),
        final_adjustments=F.when(shape == 8, final),
        eligibility=F.when(shape == 9, F.struct(names("미적분").alias("m"), F.lit("science").alias("c"), F.lit(3).alias("h"))),
    )


@query(_SHAPES_SQL)
def rule_shapes(spark, sf):
    c, k = F.col("c_custkey"), F.col("s_suppkey")
    shape = k % 10
    chosen = lambda name: F.when(name == "math", F.when(c % 2 == 1, "미적분").otherwise("확률과 통계")).when(name == "inquiry1", F.when(c % 3 != 0, "물리학Ⅰ").otherwise("생활과 윤리")).when(name == "inquiry2", F.when(c % 2 == 0, "화학Ⅱ").otherwise("경제"))
    cut = F.when(shape.isin(0, 7), 250.0 + k % 40).when(shape == 1, 120.0 + k % 40).otherwise(500.0 + k % 100)
    past = F.when(k % 9 != 0, F.struct(cut.alias("cut_score"), F.lit(80.0).alias("percentile_cut"), (k % 40).cast("int").alias("additional_pass")))
    rows = _candidates(spark, sf, _rules(spark, sf).withColumn("rule", _shaped(k)).withColumn("history", past)).withColumn("exam_type", F.lit("csat"))
    rows = rows.withColumn("subjects", F.transform_values("subjects", lambda name, v: F.struct(chosen(name).alias("selection"), v["standard"].alias("standard"), v["percentile"].alias("percentile"), v["grade"].alias("grade"))))
    return scoring.analyzed(rows).select("c_custkey", "s_suppkey", "kind", "converted_score", "band", F.array_join("reason_codes", "|").alias("reasons"), F.array_join("warnings", "|").alias("warnings"))


# --- audits ---


@query("""
with l as (select count(*) as rows, count(*) filter (o_orderkey is null) as line_orders_missing, count(*) filter (p_partkey is null) as line_parts_missing, count(*) filter (s_suppkey is null) as line_suppliers_missing,
  count(*) filter (l_quantity <= 0) as line_quantity_not_positive, count(*) filter (l_shipdate >= timestamp '2001-06-01') as line_late_rows from lineitem left join orders on l_orderkey = o_orderkey left join part on l_partkey = p_partkey left join (select * from supplier where s_acctbal >= 500) on l_suppkey = s_suppkey),
o as (select count(*) as rows, count(*) filter (c_custkey is null) as order_customers_missing, count(*) filter (o_orderstatus not in ('O', 'F', 'P')) as order_status_unknown, count(*) filter (o_totalprice > 450000) as order_high_totals from orders left join customer on o_custkey = c_custkey),
e as (select count(*) as rows, count(*) filter (json_type(try_cast(props as json), '$.k') is null) as event_props_without_k, count(*) filter (event_type = 'error') as event_errors from events),
m as (select list_filter([case when line_orders_missing > 0 then 'lineitem: missing orders: ' || line_orders_missing end, case when line_parts_missing > 0 then 'lineitem: missing parts: ' || line_parts_missing end, case when line_suppliers_missing > 0 then 'lineitem: missing suppliers: ' || line_suppliers_missing end,
  case when line_quantity_not_positive > 0 then 'lineitem: quantities not above 0: ' || line_quantity_not_positive end, case when order_customers_missing > 0 then 'orders: missing customers: ' || order_customers_missing end, case when order_status_unknown > 0 then 'orders: unknown states: ' || order_status_unknown end,
  case when event_props_without_k > 0 then 'events: properties without k: ' || event_props_without_k end], lambda x: x is not null) as errors,
  list_filter([case when line_late_rows > 0 then 'lineitem: rows of the second half of 2001 or later: ' || line_late_rows end, case when order_high_totals > 5 then 'orders: totals above 450000: ' || order_high_totals end, case when event_errors > 10 then 'events: errors: ' || event_errors end], lambda x: x is not null) as warnings,
  l.rows as line_rows, o.rows as order_rows, e.rows as event_rows, line_orders_missing, line_suppliers_missing, order_high_totals from l, o, e)
select case when len(errors) = 0 then 'ok' else 'failed' end as status, array_to_string(errors, '|') as errors, array_to_string(warnings, '|') as warnings, line_rows, order_rows, event_rows, line_orders_missing, line_suppliers_missing, order_high_totals from m
""")
def seed_audit(spark, sf):
    of = lambda name: table(spark, sf, name)
    ref, check = audits.Reference.of, audits.Check
    lines = [
        ref("line_orders_missing", "l_orderkey", of("orders"), "o_orderkey", "missing orders"),
        ref("line_parts_missing", "l_partkey", of("part"), "p_partkey", "missing parts"),
        ref("line_suppliers_missing", "l_suppkey", of("supplier").filter("s_acctbal >= 500"), "s_suppkey", "missing suppliers"),
        check("line_quantity_not_positive", F.col("l_quantity") <= 0, "quantities not above 0"),
        check("line_late_rows", F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp_ntz"), "rows of the second half of 2001 or later", "warning"),
    ]
    orders = [
        ref("order_customers_missing", "o_custkey", of("customer"), "c_custkey", "missing customers"),
        check("order_status_unknown", ~F.col("o_orderstatus").isin("O", "F", "P"), "unknown states"),
        check("order_high_totals", F.col("o_totalprice") > 450000, "totals above 450000", "warning", 5),
    ]
    events = [
        check("event_props_without_k", F.try_variant_get(F.try_parse_json("props"), "$.k", "variant").isNull(), "properties without k"),
        check("event_errors", F.col("event_type") == "error", "errors", "warning", 10),
    ]
    found = audits.report({"lineitem": (of("lineitem"), lines), "orders": (of("orders"), orders), "events": (of("events"), events)})
    counts = {"line_rows": F.col("rows")["lineitem"], "order_rows": F.col("rows")["orders"], "event_rows": F.col("rows")["events"]} | {n: F.col("invariants")[n] for n in ("line_orders_missing", "line_suppliers_missing", "order_high_totals")}
    return found.select("status", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"), *(c.alias(n) for n, c in counts.items()))


# --- unit clusters ---

_UNITS = "select p_partkey, p_brand as university, case when p_partkey % 3 = 0 then p_name else p_name || ' (' || lower(p_type) || ')' end as unit_name, p_name, 1993 + p_partkey % 11 as year, case p_partkey % 4 when 0 then 'A' when 1 then 'N' when 2 then 'R' end as grp, p_type from part"
_OUTCOMES = "select l_partkey as p_partkey, l_orderkey, l_linenumber, l_suppkey, l_discount > 0.08 as scored, l_tax > 0.07 as quota, cast(l_quantity as int) % 3 as metrics, l_returnflag || l_linestatus as availability, l_orderkey % 40 as url, 1995 + l_orderkey % 7 as year, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey as line from lineitem"


@query(f"""
with u as (select *, regexp_replace(unit_name, '[\\s()\\[\\]{{}}]+', '', 'g') as unit_key from ({_UNITS})), o as ({_OUTCOMES}),
s as (select p_partkey, count(*) as outcome_rows, count(*) filter (scored) as scored_rows, count(*) filter (quota) as quota_rows, sum(metrics) as metric_count from o group by 1),
t as (select university, unit_key, count(*) as unit_rows, coalesce(sum(outcome_rows), 0) as outcome_rows, coalesce(sum(scored_rows), 0) as scored_rows, coalesce(sum(quota_rows), 0) as quota_rows, coalesce(sum(metric_count), 0) as metric_count,
  count(distinct grp) as n_groups, count(distinct unit_name) as n_names from u left join s using (p_partkey) group by all),
ids as (select university, unit_key, string_agg(p_partkey, '|' order by p_partkey) as unit_ids from (select * from u qualify row_number() over (partition by university, unit_key order by p_partkey) <= 12) group by all),
names as (select university, unit_key, string_agg(unit_name || ':' || n, '|' order by n desc, f) as names from (select university, unit_key, unit_name, count(*) as n, min(p_partkey) as f from u group by university, unit_key, unit_name qualify row_number() over (partition by university, unit_key order by n desc, f) <= 2) group by all),
grps as (select university, unit_key, string_agg(grp || ':' || n, '|' order by n desc, f) as grps from (select university, unit_key, grp, count(*) as n, min(p_partkey) as f from u where grp is not null group by all) group by all),
ys as (select university, unit_key, list_sort(list_filter(list(distinct year), lambda y: y between 1995 and 2001)) as recent from u group by all),
j as (select u.university, u.unit_key, u.p_partkey as k, o.* exclude (p_partkey) from u join o using (p_partkey)),
urls as (select university, unit_key, string_agg(url, '|' order by f) as urls from (select university, unit_key, url, min((k, line)) as f from j group by university, unit_key, url qualify row_number() over (partition by university, unit_key order by f) <= 5) group by all),
av as (select university, unit_key, string_agg(availability || ':' || n, '|' order by n desc, f) as availability from (select university, unit_key, availability, count(*) as n, min((k, line)) as f from j group by university, unit_key, availability qualify row_number() over (partition by university, unit_key order by n desc, f) <= 3) group by all),
smp as (select university, unit_key, string_agg(l_suppkey, '|' order by y desc, f) as samples from (select university, unit_key, l_suppkey, max(year) as y, arg_min((k, line), (-year, k, line)) as f from j group by university, unit_key, l_suppkey qualify row_number() over (partition by university, unit_key order by y desc, f) <= 4) group by all)
select university, unit_key, unit_rows, outcome_rows::bigint as outcome_rows, scored_rows::bigint as scored_rows, quota_rows::bigint as quota_rows, metric_count::bigint as metric_count, unit_ids, names, coalesce(grps, '') as grps, coalesce(urls, '') as urls, coalesce(availability, '') as availability, coalesce(samples, '') as samples,
  array_to_string(recent, '|') as recent_years, array_to_string(list_filter({list(range(1995, 2002))}, lambda y: not list_contains(recent, y)), '|') as missing_years, case when len(recent) >= 5 then 'high' when len(recent) >= 3 then 'medium' else 'low' end as continuity,
  concat_ws('|', case when len(recent) >= 5 then 'has_recent_5plus_years' end, case when len(recent) = 7 then 'has_full_coverage' end, case when len(recent) < 7 then 'has_recent_year_gaps' end, case when scored_rows > 0 then 'has_score_outcomes' end, case when quota_rows > 0 then 'has_quota_competition' end,
    case when n_groups > 1 then 'has_multiple_recruitment_groups' end, case when n_names > 1 then 'has_name_variants' end) as flags,
  (case when len(recent) >= 5 then 80 when len(recent) >= 3 then 45 else 10 end + least(scored_rows * 3, 60) + least(metric_count, 40) + least(n_groups * 5, 20) + len(recent) * 8)::bigint as priority
from t left join ids using (university, unit_key) left join names using (university, unit_key) left join grps using (university, unit_key) left join ys using (university, unit_key) left join urls using (university, unit_key) left join av using (university, unit_key) left join smp using (university, unit_key)
""")
def unit_clusters(spark, sf):
    for name in ("lineitem", "part"):
        table(spark, sf, name).createOrReplaceTempView(name)
    L, one = clusters.Limited, F.lit(1)  # noqa: N806
    units, outcomes = spark.sql(_UNITS).withColumn("unit_key", group_key(F.col("unit_name"))), spark.sql(_OUTCOMES)
    found = clusters.clustered(
        units,
        outcomes,
        ["university", "unit_key"],
        "p_partkey",
        {"unit_rows": one},
        {"unit_ids": L(F.col("p_partkey"), 12), "names": L(F.col("unit_name"), 2, "often"), "grps": L(F.col("grp"), 10, "often"), "years": L(F.col("year"), 50)},
        {"outcome_rows": one, "scored_rows": F.col("scored").cast("int"), "quota_rows": F.col("quota").cast("int"), "metric_count": F.col("metrics")},
        {"urls": L(F.col("url"), 5), "availability": L(F.col("availability"), 3, "often"), "samples": L(F.col("l_suppkey"), 4, F.lpad((9999 - F.col("year")).cast("string"), 4, "0"))},
        ordinal="p_partkey",
        outcome_ordinal=F.col("line"),
    )
    done = clusters.judged(found, YEARS, years="years", scored="scored_rows", quota="quota_rows", metrics="metric_count", groups="grps_size", names="names_size")
    text = lambda c, counts: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["value"], x["n"]) if counts else x["value"]), "|"), F.lit("")).alias(c)
    return done.select(
        "university", "unit_key", "unit_rows", "outcome_rows", "scored_rows", "quota_rows", "metric_count", text("unit_ids", False), text("names", True), text("grps", True), text("urls", False), text("availability", True), text("samples", False),
        F.array_join("recent_years", "|").alias("recent_years"), F.array_join("missing_years", "|").alias("missing_years"), "continuity", F.array_join("flags", "|").alias("flags"), F.col("priority").cast("long").alias("priority"),
    )


# --- text guards, dates and quotas ---

_TERMS = {
    "licence": r"[Ll]icensed?|MIT|Apache",
    "mail": r"[a-z0-9._]+@[a-z0-9.]+",
    "link": r"https?://[a-z0-9./_-]+",
    "insult": r"idiot|loser|pathetic|disgusting",
    "table": r" \| ",
    "signs": r"\*\*\*|###|%%%|\$\$\$|&&&",
    "article": r"\b(?:the|der|die|les|las)\b",
    "number": r"[0-9]+(?:\.[0-9]+)?",
}
_RULES = [
    guards.Rule("licence_near_link", near=(guards.Near("licence", "link", 60),)),
    guards.Rule("contact", some=("mail", "link"), none=("licence",)),
    guards.Rule("junk_table", every=("table",), none=("article",)),
    guards.Rule("junk_signs", every=("signs",), none=("table",), also=lambda t: F.char_length(t) > 400),
    guards.Rule("insulting_prose", every=("insult", "article"), none=("signs", "table")),
    guards.Rule("numbers_only", every=("number",), none=("article", "licence")),
]


@query(f"""
with h as (select doc_id, text, list_distinct(regexp_extract_all(coalesce(text, ''), '({"|".join(f"(?:{p})" for p in _TERMS.values())})', 1)) as f from documents),
g as (select doc_id, text, list_filter([{", ".join(f"case when len(list_filter(f, lambda x: regexp_full_match(x, '{p}'))) > 0 then '{n}' end" for n, p in _TERMS.items())}], lambda x: x is not null) as groups from h)
select doc_id, array_to_string(groups, '|') as groups, case when list_contains(groups, 'licence') and list_contains(groups, 'link') and regexp_matches(text, '(?s)(?:{_TERMS["licence"]}).{{0,60}}(?:{_TERMS["link"]})') then 'licence_near_link'
  when (list_contains(groups, 'mail') or list_contains(groups, 'link')) and not list_contains(groups, 'licence') then 'contact' when list_contains(groups, 'table') and not list_contains(groups, 'article') then 'junk_table'
  when list_contains(groups, 'signs') and not list_contains(groups, 'table') and length(text) > 400 then 'junk_signs' when list_contains(groups, 'insult') and list_contains(groups, 'article') and not list_contains(groups, 'signs') and not list_contains(groups, 'table') then 'insulting_prose'
  when list_contains(groups, 'number') and not list_contains(groups, 'article') and not list_contains(groups, 'licence') then 'numbers_only' else 'clean' end as verdict from g
""")
def text_guards(spark, sf):
    return guards.guarded(table(spark, sf, "documents").select("doc_id", "text"), "text", _TERMS, _RULES).select("doc_id", F.array_join("groups", "|").alias("groups"), "verdict")


_NOTICES = """select o_orderkey, case o_orderkey % 5 when 4 then 'nothing dated, 33.5 of 120%' else '접수 ' || (year(o_orderdate) + 26) || '. ' || month(o_orderdate) || '.  ' || day(o_orderdate) || '. (월) 10:00 ~ ' || (1 + o_orderkey % 12) || '.' || (1 + o_orderkey % 28) || ', 발표 ' ||
  (1 + o_custkey % 12) || '월 ' || (1 + o_custkey % 28) || '일; 모집 ' || (o_custkey % 700) || ' 및 ' || (o_orderkey % 90) || ' / 13.' || (o_custkey % 10) || ' ' || (o_orderkey % 40) || '%' || ' 접수 ' || (year(o_orderdate) + 26) || '. ' || month(o_orderdate) || '. ' || day(o_orderdate) || '. (월) 10:00' end as notice,
  case when o_orderkey % 6 = 0 then (o_custkey % 900) || '|x|' || (o_orderkey % 3) || '|7' else '' end as given from orders"""


@query(f"""
with n as ({_NOTICES}),
d as (select o_orderkey, notice, given, array_to_string(list_transform(list_filter(['(' || regexp_extract(notice, '접수 (20[0-9]{{2}}\\. [0-9]+\\.  [0-9]+\\. \\(월\\) 10:00)', 1) || ')',
    '(' || regexp_extract(notice, '~ ([0-9]+\\.[0-9]+)', 1) || ')', '(' || regexp_extract(notice, '발표 ([0-9]+월 [0-9]+일)', 1) || ')'], lambda x: x <> '()'), lambda x: regexp_replace(x[2:-2], ' +', ' ', 'g')), '|') as dates from n),
q as (select *, list_filter(list_transform(string_split(given, '|'), lambda x: try_cast(x as int)), lambda x: x between 1 and 500) as own,
  list_filter(list_transform([regexp_extract(notice, '모집 ([0-9]+)', 1), regexp_extract(notice, '및 ([0-9]+)', 1)], lambda x: try_cast(x as int)), lambda x: x between 1 and 500) as picked,
  list_filter(list_transform([regexp_extract(notice, '발표 ([0-9]+)월', 1), regexp_extract(notice, '월 ([0-9]+)일', 1)], lambda x: try_cast(x as int)), lambda x: x is not null) as said from d),
u as (select o_orderkey, dates, case when len(own) > 0 then own when contains(notice, '모집') then list_concat(list_concat(list_concat(case when notice <> '' then [10] end, said), picked), [10]) else [] end as raw from q)
select o_orderkey, dates, array_to_string(list_filter(list_transform(range(1, len(raw) + 1), lambda i: case when list_position(raw, raw[i]) = i then raw[i] end), lambda x: x is not null), '|') as quotas from u
""")
def dates_and_quotas(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    notices, notice = spark.sql(_NOTICES), F.col("notice")
    numbers = texts.quota_numbers(notice, F.split("given", r"\|"), "모집")
    return notices.select("o_orderkey", F.array_join(texts.dates(notice), "|").alias("dates"), F.array_join(F.transform(numbers, lambda x: x.cast("string")), "|").alias("quotas"))


# --- listings with their ranks ---

_SYLLABLES = ("가", "각", "나 다", "나다", "힣", "Ab", "ab", "B", "é", "z", "1", "한국", "한 국")
_LIST = f"[{', '.join(repr(x) for x in _SYLLABLES)}]"
_NAMED = f"select s_suppkey, {_LIST}[s_suppkey % 13 + 1] || {_LIST}[s_suppkey * 5 % 13 + 1] as university, {_LIST}[s_suppkey * 7 % 13 + 1] || {_LIST}[s_suppkey // 13 % 13 + 1] as unit, case s_nationkey % 4 when 0 then 'core' when 1 then 'extended' end as tier, s_acctbal > 4000 as ready, s_nationkey // 5 as display from supplier"
_TIER_RANK = "coalesce(list_position(['core', 'extended'], tier) - 1, 2)"
_MATCH = "case when k = 'ab' then 0 when starts_with(k, 'ab') then 1 when contains(k, 'ab') then 2 end"


def _named(spark, sf):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    pick = lambda i: F.element_at(F.array(*map(F.lit, _SYLLABLES)), (i % 13 + 1).cast("int"))
    names = [F.concat(pick(k), pick(k * 5)).alias("university"), F.concat(pick(k * 7), pick(F.floor(k / 13))).alias("unit")]
    return table(spark, sf, "supplier").select("s_suppkey", *names, F.when(n % 4 == 0, "core").when(n % 4 == 1, "extended").alias("tier"), (F.col("s_acctbal") > 4000).alias("ready"), F.floor(n / 5).alias("display"))


@query(f"""
with u as ({_NAMED}), m as (select *, {_MATCH} as match from (select *, lower(regexp_replace(university, '[\\s()\\[\\]{{}}·.,-]+', '', 'g')) as k from u))
select 'units' as mode, s_suppkey, row_number() over (order by {_TIER_RANK}, not ready, display, university collate ko, unit collate ko, s_suppkey)::int as rank from u qualify rank <= 80
union all select 'universities', s_suppkey, row_number() over (order by match, {_TIER_RANK}, display, university collate ko, s_suppkey)::int from m where match is not null qualify row_number() over (order by match, {_TIER_RANK}, display, university collate ko, s_suppkey) <= 50
""")
def collated_listings(spark, sf):
    named = _named(spark, sf)
    tier = listing.rank_in(F.col("tier"), ("core", "extended"))
    units = listing.cut(named, listing.by_unit(tier, F.when(F.col("ready"), 0).otherwise(1), "display", ["university", "unit"], "s_suppkey"), 80)
    found = named.withColumn("match", texts.search_rank(F.lit("ab"), F.array("university"))).filter("match is not null")
    universities = listing.cut(found, listing.by_match("match", tier, "display", "university", "s_suppkey"), 50)
    return units.select(F.lit("units").alias("mode"), "s_suppkey", "rank").unionByName(universities.select(F.lit("universities").alias("mode"), "s_suppkey", "rank"))


def _ranked_sql(sql: str) -> str:
    """The listings' SQL with the row number of each cut in its own order."""
    head, _, body = sql.partition("select 'gap'")
    parts = re.split(r"\s*union all (?=select ')", "select 'gap' " + body.strip())
    numbered = [re.sub(r"^select ('\w+')(?: as mode)?, id from (.*)$", r"select \1 as mode, id, (row_number() over ())::int as rank from \2", p, flags=re.S) for p in parts]
    assert len(parts) == 8 and all("row_number()" in p for p in numbered)
    return head + " union all ".join(numbered)


@query(_ranked_sql(NAMES["listings"][1]))
def listing_ranks(spark, sf):
    parts = [listing.cut(df, order, most).select(F.lit(name).alias("mode"), F.col(key).alias("id"), "rank") for name, (df, order, key, most) in listing_parts(spark, sf).items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


# --- sheets of several blocks ---

_CELLS = """with n as (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as i from lineitem)
select l_suppkey as sheet, i as line, case when i % 9 = 1 and i % 4 > 0 then {array}('grade', case when i % 2 = 0 then 'S' || (l_partkey % 50) else '' end, '', '', 'T' || (l_partkey % 7), '', '')
  when i % 9 = 1 then {array}('grade', '', ' ') when i % 9 = 5 and i % 2 = 0 then {array}('', 'Korean' || (i % 3), '', '', '', case when i % 4 = 0 then 'Math' else '' end, '', '')
  when i % 9 = 6 and i % 2 = 1 then {array}('', 'score', 'm', 'f', '', 'score', 'm', 'f') when i % 9 = 8 and i % 5 = 0 then {array}('total', '1', '2') when i % 9 = 7 and i % 7 = 0 then {array}('', ' ', '')
  else {array}(cast(cast(l_quantity as int) % 12 as varchar(9)), cast(l_partkey % 150 as varchar(9)), case when l_partkey % 3 = 0 then '1,' || (100 + l_orderkey % 800) else '' end, case when l_tax > 0.03 then '12.5' else '' end, cast(100 + l_orderkey % 40 as varchar(9)), case when l_partkey % 2 = 0 then '77' else 'x' end) end as cells from n"""
_DUCK_CELLS, _SPARK_CELLS = _CELLS.format(array="list_value"), _CELLS.format(array="array")
_AT = "nullif(trim(cells[{}]), '')"


def _whole_sql(x: str) -> str:
    return f"try_cast(case when regexp_full_match(replace({x}, ',', ''), '[+-]?[0-9]+') then replace({x}, ',', '') end as int)"


@query(f"""
with g as ({_DUCK_CELLS}), h as (select *, case when {_AT.format(1)} = 'grade' then line end as mark, case when {_AT.format(1)} = 'grade' then list_filter(list_transform(range(2, len(cells) + 1), lambda i: {{'col': i, 'name': trim(cells[i])}}), lambda b: b.name <> '') end as bs from g),
c as (select *, last_value(mark ignore nulls) over w as header_row, last_value(bs ignore nulls) over w as own from h window w as (partition by sheet order by line rows between unbounded preceding and 1 preceding)),
x as (select sheet, line, header_row, cells, unnest(own) as b, {_whole_sql(_AT.format(1))} as grade from c where mark is null and header_row is not null),
r as (select sheet, line, header_row, b.name as name, grade, {_AT.format("b.col")} as cut, {_AT.format("b.col + 1")} as takers, {_AT.format("b.col + 2")} as ratio from x where grade between 1 and 9)
select sheet, line, header_row, name, grade, cut, {_whole_sql('takers')} as takers, try_cast(ratio as double) as ratio from r where cut is not null or takers is not null or ratio is not null
""")
def sheet_grade_cuts(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    return grids.grade_cuts(spark.sql(_SPARK_CELLS.replace("varchar(9)", "string")), "sheet", "line", "cells", "grade")


@query(f"""
with g as ({_DUCK_CELLS}), a as (select *, lag(cells) over (partition by sheet order by line) as above from g),
h as (select *, list_filter(list_transform(range(1, len(cells) + 1), lambda i: {{'col': i, 'name': nullif(trim(above[i]), ''), 'ok': trim(cells[i]) = 'score' and coalesce(trim(cells[i + 1]), '') = 'm'}}), lambda b: b.ok) as bs,
  list_contains(list_transform(cells, lambda x: trim(x)), 'score') or len(list_filter(cells, lambda x: trim(x) <> '')) = 0 or coalesce(trim(cells[1]), '') = 'total' as ends from a),
m as (select *, case when len(bs) > 0 then {{'row': line, 'bs': bs}} when ends then {{'row': null, 'bs': null}} end as state, len(bs) > 0 or ends as is_mark from h),
c as (select *, last_value(case when is_mark then line end ignore nulls) over w as at from m window w as (partition by sheet order by line rows between unbounded preceding and 1 preceding)),
x as (select c.sheet, c.line, c.cells, unnest(m.bs) as b from c join m on m.sheet = c.sheet and m.line = c.at where not c.is_mark and len(m.bs) > 0),
r as (select sheet, line, b.name as name, {", ".join(f"{_whole_sql(_AT.format(f'b.col + {i}'))} as {n}" for i, n in enumerate(("score", "first", "second", "both", "running")))} from x where b.name is not null)
select * from r where score is not null
""")
def sheet_distributions(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    return grids.distributions(spark.sql(_SPARK_CELLS.replace("varchar(9)", "string")), "sheet", "line", "cells", "score", "m", "total")


# --- the promotion queue ---

_COMMON = ("artifact", "id", "entity", "year", "strength", "confidence", "candidate_confidence", "flags", "quality", "year_status", "area_flag", "match_status", "has_score", "has_quota", "recent_count", "review_score")
_ARTIFACTS = {
    "outcomes": ("lineitem", {"id": "l_orderkey * 10 + l_linenumber", "year": "year(l_shipdate) + 23", "confidence": "case when l_quantity > 40 then 'high' when l_quantity > 20 then 'medium' when l_quantity < 5 then 'limited' else 'low' end", "has_score": "l_discount > 0.04", "has_quota": "l_tax > 0.03", "flags": "case when l_returnflag = 'R' then 'scale_review_required|ok' else '' end"}),
    "units": ("orders", {"id": "o_orderkey", "year": "case when o_orderpriority <> '5-LOW' then year(o_orderdate) + 22 end", "match_status": "case o_orderstatus when 'P' then 'ambiguous' when 'F' then 'matched_by_unv_cd' end", "candidate_confidence": "case when o_totalprice < 100000 then 'low' end"}),
    "csat_rule_drafts": ("events", {"id": "event_id", "year": "2018 + user_id % 12", "strength": "case event_type when 'view' then 'high' when 'click' then 'medium' when 'error' then 'limited' else '' end", "flags": "case when value > 90 then 'has_noise_signals|has_table' when value > 70 then 'low_structured_text|x' else 'has_table' end", "quality": "case when value < 10 then 'ocr_text|fine|title_like' else '' end", "year_status": "case when user_id % 9 = 0 then 'unknown' end", "area_flag": "case when user_id % 8 = 0 then 'source_area_review' else '' end"}),
    "unit_clusters": ("part", {"id": "p_partkey", "recent_count": "case when p_size % 9 < 8 then p_size % 9 end", "flags": "case when p_size = 7 then 'full_recent_2021_2027_coverage' else 'missing_years' end"}),
    "outcome_series": ("part", {"id": "p_partkey", "recent_count": "p_size % 8", "flags": "case when p_brand = 'Brand#3' then 'converted_score_scale_review_required' else '' end"}),
    "office_evidence": ("supplier", {"id": "s_suppkey", "review_score": "case when s_acctbal > 1000 then cast(floor(s_acctbal / 50) as int) end", "entity": "'AdmissionRule'"}),
    "policy_evidence": ("customer", {"id": "c_custkey", "entity": "case c_mktsegment when 'BUILDING' then 'AdmissionSchedule' when 'MACHINERY' then 'HistoricalOutcome' when 'HOUSEHOLD' then 'GradeCutReference' when 'FURNITURE' then 'ExamScoreReference' end", "year": "2019 + c_nationkey % 10", "confidence": "case when c_acctbal > 5000 then 'medium' end"}),
    "universities": ("nation", {"id": "n_nationkey"}),
    "other": ("customer", {"id": "c_custkey", "confidence": "case when c_acctbal > 8000 then 'high' when c_acctbal > 2000 then '' end", "candidate_confidence": "case when c_acctbal < 4000 then 'medium' else 'limited' end"}),
}
_TYPES_OF = {"year": "int", "recent_count": "int", "review_score": "int", "has_score": "boolean", "has_quota": "boolean", "id": "bigint"}


def _artifact_sql(name: str, text: str) -> str:
    source, own = _ARTIFACTS[name]
    columns = [f"cast({own.get(c, 'null') if c != 'artifact' else repr(name)} as {_TYPES_OF.get(c, text)}) as {c}" for c in _COMMON]
    return f"select {', '.join(columns)} from {source}"


def _queue_oracle() -> str:
    from tidemark.plans import promotion as p

    rows = " union all ".join(_artifact_sql(n, "varchar") for n in _ARTIFACTS)
    now = "coalesce(year between 2021 and 2027, false)"
    weak = "('limited', 'low')"
    points = lambda c, t: "case " + " ".join(f"when {c} = '{k}' then {v}" for k, v in t.items()) + " else 0 end"
    return f"""
with r as ({rows}), f as (select * exclude (flags, quality), list_filter(string_split(coalesce(flags, ''), '|'), lambda x: x <> '') as flags, list_filter(string_split(coalesce(quality, ''), '|'), lambda x: x <> '') as quality from r),
b as (select *, list_filter(list_concat(list_concat(list_concat([case when year_status = 'unknown' then 'unknown_admission_year' end, nullif(area_flag, '')], list_filter(flags, lambda x: regexp_matches(x, '{p.DRAFT_BLOCKERS}'))), list_filter(quality, lambda x: regexp_matches(x, '{p.QUALITY_BLOCKERS}'))),
  [case when match_status in ('unmatched_or_ambiguous', 'ambiguous') then 'unmatched_or_ambiguous_university' end, case when confidence in {weak} then confidence || '_confidence' end, case when candidate_confidence in {weak} then candidate_confidence || '_candidate_confidence' end]), lambda x: x is not null) as raw from f),
t as (select *, case when artifact = 'universities' then 'p0' when artifact = 'units' then case when {now} then 'p0' else 'p2' end
  when artifact = 'unit_clusters' then case when list_contains(flags, 'full_recent_2021_2027_coverage') or coalesce(recent_count >= 5, false) then 'p0' when coalesce(recent_count > 0, false) then 'p1' else 'p2' end
  when artifact = 'outcomes' then case when has_score and has_quota and {now} then 'p0' when has_score and {now} then 'p1' else 'p2' end
  when artifact = 'outcome_series' then case when list_contains(flags, 'converted_score_scale_review_required') then 'p1' when coalesce(recent_count >= 5, false) then 'p0' when coalesce(recent_count > 0, false) then 'p1' else 'p2' end
  when entity in ('GradeCutReference', 'StandardScoreDistributionReference') then case when {now} then 'p0' else 'p2' end when entity in ('ExamScoreReference', 'ExamScoreReferenceEvidence') then case when {now} then 'p1' else 'p2' end
  when artifact = 'csat_rule_drafts' then case when list_contains(raw, 'unknown_admission_year') or list_contains(flags, 'has_noise_signals') then case when {now} then 'p2' else 'p3' end
    when strength in ('high', 'medium') then case when {now} then 'p0' else 'p1' end when strength in ('low', 'limited') and {now} then 'p2' else 'p3' end
  when artifact = 'office_evidence' then case when coalesce(review_score >= 100, false) then 'p1' else 'p2' end when artifact = 'policy_evidence' then case when coalesce(entity in ('AdmissionRule', 'AdmissionSchedule'), false) then 'p1' else 'p2' end
  when coalesce(coalesce(nullif(confidence, ''), candidate_confidence) in ('high', 'medium'), false) then 'p1' else 'p2' end as tier from b)
select artifact, id, tier, array_to_string(list_filter(list_transform(range(1, len(raw) + 1), lambda i: case when list_position(raw, raw[i]) = i then raw[i] end), lambda x: x is not null), '|') as blockers,
  coalesce(review_score, {points('tier', p.TIER_POINTS)} + case when {now} then 10 else 0 end + {points('strength', p.STRENGTH_POINTS)} + {points('confidence', p.CONFIDENCE_POINTS)} + case when has_score then 10 else 0 end + case when has_quota then 10 else 0 end) as score from t
"""


@query(_queue_oracle())
def promotion_queue(spark, sf):
    from tidemark.plans import promotion

    for source in {s for s, _ in _ARTIFACTS.values()}:
        table(spark, sf, source).createOrReplaceTempView(source)
    rows = spark.sql(" union all ".join(_artifact_sql(n, "string") for n in _ARTIFACTS))
    lists = {c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: x != "") for c in ("flags", "quality")}
    return promotion.queue(rows.withColumns(lists)).select("artifact", "id", "tier", F.array_join("blockers", "|").alias("blockers"), "score")


_TARGETS = """select o_orderkey, case o_custkey % 3 when 0 then 'AdmissionRule' when 1 then 'HistoricalOutcome' else 'AdmissionUnit' end as target, case when o_orderpriority = '1-URGENT' and o_totalprice > 300000 then 'rule_schedule_2027' else 'other' end as lane,
  case o_orderstatus when 'F' then 'adiga' else 'office' end as provider, case o_orderkey % 4 when 0 then 'pdf_text_manifest' when 1 then 'raw_binary' when 2 then 'raw_text' else 'source_text' end as kind, o_totalprice > 200000 as has_quota, o_orderpriority <> '2-HIGH' as has_paths from orders"""


@query(f"""
select o_orderkey, case when lane = 'rule_schedule_2027' or target = 'AdmissionRule' then 'admission_rule_2027_formula_human_review_required' when target = 'HistoricalOutcome' and kind = 'pdf_text_manifest' then 'office_pdf_outcome_column_reconstruction_required'
  when target = 'HistoricalOutcome' and kind = 'raw_binary' then 'office_workbook_outcome_strict_mismatch' when target = 'AdmissionUnit' and provider = 'adiga' and kind = 'raw_text' then case when not has_quota then 'adiga_admission_unit_identity_only_missing_quota' else 'admission_unit_source_text_strict_row_mismatch' end
  when target = 'AdmissionUnit' and kind = 'source_text' then case when not has_quota then 'admission_unit_source_text_missing_quota' when not has_paths then 'admission_unit_source_text_missing_source_paths' else 'admission_unit_source_text_strict_row_mismatch' end else 'unclassified_pending_review' end as class from ({_TARGETS})
""")
def residual_classes(spark, sf):
    from tidemark.plans.promotion import residual_class

    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql(_TARGETS).select("o_orderkey", residual_class(*(F.col(c) for c in ("target", "lane", "provider", "kind", "has_quota", "has_paths"))).alias("class"))
