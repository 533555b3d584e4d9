"""Rule documents: JSON text to rules, null where anything doesn't fit.

A shape says what a JSON value must be; `fits` makes one boolean column of it for a
VARIANT column, however deep it nests: objects look into their fields, lists hold all
their items to one shape, records all keys and values. As in the documents' own
rules, unknown fields are allowed, an optional field may be absent but not null, and
numbers aren't read from strings. A rule is mapped only if all its documents fit, so
that a unit with a broken rule counts as unsupported and isn't scored by half.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.plans import scoring

Fits = Callable[[Column], Column]


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def number(*, least: float | None = None, above: float | None = None, most: float | None = None, whole: bool = False) -> Fits:
    def fits(v: Column) -> Column:
        x = F.try_variant_get(v, "$", "double")
        ok = _kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        for limit, test in ((least, lambda n: x >= n), (above, lambda n: x > n), (most, lambda n: x <= n)):
            if limit is not None:
                ok = ok & test(limit)
        return _sure(ok & (x == F.floor(x)) if whole else ok)

    return fits


def one_of(*values: str | int) -> Fits:
    if isinstance(values[0], str):
        return lambda v: _sure((_kind(v) == "STRING") & F.try_variant_get(v, "$", "string").isin(*values))
    return lambda v: number(whole=True)(v) & _sure(F.try_variant_get(v, "$", "double").isin(*map(float, values)))


def text(least: int = 0) -> Fits:
    return lambda v: _sure((_kind(v) == "STRING") & (F.char_length(F.try_variant_get(v, "$", "string")) >= least))


def flag() -> Fits:
    return lambda v: _sure(_kind(v) == "BOOLEAN")


def listing(item: Fits, least: int = 0, most: int | None = None) -> Fits:
    def fits(v: Column) -> Column:
        items = F.try_variant_get(v, "$", "array<variant>")
        size = F.size(items)
        return _sure(_kind(v).startswith("ARRAY") & (size >= least) & (F.lit(True) if most is None else size <= most) & F.forall(items, item))

    return fits


def record(key: str, value: Fits, least: int = 0, key_fits: Callable[[Column], Column] | None = None) -> Fits:
    """An object whose keys match the pattern `key` and whose values all fit."""

    def fits(v: Column) -> Column:
        entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        one = lambda e: e["key"].rlike(key) & value(e["value"]) & (F.lit(True) if key_fits is None else key_fits(e["key"]))
        return _sure(_kind(v).startswith("OBJECT") & (F.size(entries) >= least) & F.forall(entries, one))

    return fits


@dataclass
class Fields:
    """An object's fields; `also` are conditions on the object beyond its fields."""

    needed: dict[str, Fits]
    optional: dict[str, Fits] = field(default_factory=dict)
    also: tuple[Callable[[Column], Column], ...] = ()

    def __call__(self, v: Column) -> Column:
        ok = _kind(v).startswith("OBJECT")
        for name, fits in self.needed.items():
            x = at(v, name)
            ok = ok & x.isNotNull() & fits(x)
        for name, fits in self.optional.items():
            x = at(v, name)
            ok = ok & (x.isNull() | fits(x))
        for test in self.also:
            ok = ok & test(v)
        return _sure(ok)


def at(v: Column, path: str, kind: str = "variant") -> Column:
    """The value at a path of field names: null if absent; a JSON null is a value."""
    return F.try_variant_get(v, f"$.{path}", kind)


def _strings(v: Column, path: str) -> Column:
    return F.coalesce(at(v, path, "array<string>"), F.array().cast("array<string>"))


def _with(needs: str, other: str) -> Callable[[Column], Column]:
    """The first field only together with the other."""
    return lambda v: at(v, needs).isNull() | at(v, other).isNotNull()


# --- fixed values: shapes of the documents ---
SCORE_TYPES = ("standard", "percentile", "mixed", "custom")
STATUSES = ("draft", "parsed", "verified", "live", "deprecated")
_SELECTABLE, _ADJUSTED = ("korean", "math", "english", "inquiry"), ("korean", "math", "inquiry")
_count = one_of(1, 2, 3, 4)
_by_grade = record(r"^\d$", number())
_triple = lambda fits: Fields({}, dict.fromkeys(_ADJUSTED, fits))
_weights = Fields(dict.fromkeys(_ADJUSTED, number(least=0)))
_mode = one_of("weighted_average", "weighted_sum", "normalized_sum")
_condition = {"requiredSelections": listing(text(), 1), "requiredInquiryCategory": one_of("science", "social"), "requiredInquiryCategoryCount": one_of(1, 2)}
_category_pair = _with("requiredInquiryCategoryCount", "requiredInquiryCategory")
_subject_adjustment = Fields({"subject": one_of(*_ADJUSTED)}, {**_condition, "multiplier": number(above=0), "points": number(), "capAtMax": flag()}, (lambda v: at(v, "multiplier").isNotNull() | at(v, "points").isNotNull(), _category_pair))
_final_adjustment = Fields({"subject": one_of(*_ADJUSTED), "pointsFrom": one_of("standardScore", "percentile"), "multiplier": number(above=0)}, {**_condition, "maxPoints": number(above=0)}, (_category_pair,))
_spec = {"count": _count, "subjects": listing(one_of(*_SELECTABLE), 1, 4)}
_required_fit = (
    lambda v: F.size(_strings(v, "requiredSubjects")) <= at(v, "count", "int"),
    lambda v: F.size(F.array_except(_strings(v, "requiredSubjects"), _strings(v, "subjects"))) == 0,
)
_ranks_fit = lambda v: at(v, "rankWeights").isNull() | (F.size(at(v, "rankWeights", "array<variant>")) == at(v, "count", "int"))
_ranks = listing(number(above=0), 1, 4)
_required = listing(one_of(*_SELECTABLE), 1, 4)
_group = Fields({**_spec, "rankWeights": _ranks}, {"requiredSubjects": _required}, (_ranks_fit, *_required_fit))
_selection = Fields({"mode": one_of("best_n_subjects"), **_spec}, {"requiredSubjects": _required, "rankWeights": _ranks, "groups": listing(_group, 1, 4)}, (_ranks_fit, *_required_fit))
_input = Fields({"kind": one_of("national_max_standard_score", "conversion_table", "other")}, {"subjects": listing(one_of(*_ADJUSTED), 1, 3), "label": text(1), "availability": one_of("post_csat", "manual", "unavailable")})
_component = Fields({"kind": one_of("student_record", "practical", "interview", "essay", "document", "other"), "weight": number(least=0)}, {"label": text(1), "required": flag()})
ENGLISH = Fields({"mode": one_of("deduction", "addition", "ratio"), "byGrade": _by_grade}, {"weight": number(least=0), "scoreMax": number(above=0)}, (lambda v: (at(v, "mode", "string") != "ratio") | (F.coalesce(at(v, "weight", "double"), F.lit(0.0)) > 0),))
HISTORY = Fields({"byGrade": _by_grade}, {"mode": one_of("deduction", "addition")})
_conversion = Fields({"from": one_of("percentile"), "byPercentile": record(r"^\d{1,3}$", number(), 1, lambda k: k.cast("int") <= 100)}, {"scoreMax": number(above=0)})
INQUIRY = Fields({"count": one_of(1, 2), "mode": one_of("average", "best_one", "sum")}, {"conversionTable": _conversion, "conversionRisk": flag()})
ELIGIBILITY = Fields({}, {"requiredMathSelections": listing(text()), "requiredInquiryCategory": one_of("science", "social"), "maxHistoryGrade": number(least=1, most=9, whole=True)})
_common = {
    "csatWeight": number(least=0), "calculationMode": _mode, "subjectScoreTypes": _triple(one_of("standardScore", "percentile")), "scoreMaxes": _triple(number(above=0)), "subjectBaseScores": _triple(number(least=0)), "selectionPolicy": _selection,
    "subjectAdjustments": listing(_subject_adjustment, 1, 8), "finalAdjustments": listing(_final_adjustment, 1, 8), "requiredInputs": listing(_input, 1, 8), "externalComponents": listing(_component, 1, 8),
}
_alternative = Fields({"weights": _weights}, {**_common, "totalScale": number(above=0), "englishPolicy": ENGLISH, "historyPolicy": HISTORY, "inquiryPolicy": INQUIRY, "eligibility": ELIGIBILITY})
FORMULA = Fields({"totalScale": number(above=0), "weights": _weights}, {**_common, "alternatives": listing(_alternative, 1, 8)})
DOCUMENTS = {"formula": FORMULA, "english": ENGLISH, "history": HISTORY, "inquiry": INQUIRY, "eligibility": ELIGIBILITY}
# --- end of fixed values ---

# types as the documents name the fields, in the order of a rule's own; a cast from one to the other renames
_TRIPLE, _NAMES = "struct<korean:double,math:double,inquiry:double>", "struct<korean:string,math:string,inquiry:string>"
_WHEN = "subject:string,requiredSelections:array<string>,requiredInquiryCategory:string,requiredInquiryCategoryCount:int"
_CHOICE = "count:int,subjects:array<string>,requiredSubjects:array<string>,rankWeights:array<double>"


def _grades(policy: Column, path: str) -> Column:
    return F.transform_keys(at(policy, path, "map<string,double>"), lambda k, _: k.cast("int"))


def _policy(v: Column) -> Column:
    return F.when(v.isNotNull(), F.struct(at(v, "mode", "string").alias("mode"), _grades(v, "byGrade").alias("by_grade"), at(v, "weight", "double").alias("weight"), at(v, "scoreMax", "double").alias("score_max")))


def _inquiry(v: Column) -> Column:
    parts = [at(v, "count", "int"), at(v, "mode", "string"), at(v, "conversionRisk", "boolean"), at(v, "conversionTable.from", "string"), at(v, "conversionTable.scoreMax", "double"), _grades(v, "conversionTable.byPercentile")]
    return F.when(v.isNotNull(), F.struct(*(p.alias(n) for p, n in zip(parts, ("count", "mode", "conversion_risk", "table_from", "table_max", "table"), strict=True))))


def _leaves(v: Column, english: Column, history: Column, inquiry: Column) -> dict[str, Column]:
    """The fields that a formula and an alternative share."""
    kinds = lambda path: F.transform(at(v, path, "array<variant>"), lambda x: at(x, "kind", "string"))
    return {
        "total_scale": at(v, "totalScale", "double"),
        "calculation_mode": at(v, "calculationMode", "string"),
        "weights": at(v, "weights", _TRIPLE),
        "subject_score_types": at(v, "subjectScoreTypes", _NAMES),
        "subject_score_maxes": at(v, "scoreMaxes", _TRIPLE),
        "subject_base_scores": at(v, "subjectBaseScores", _TRIPLE),
        "subject_adjustments": at(v, "subjectAdjustments", f"array<struct<{_WHEN},multiplier:double,points:double,capAtMax:boolean>>"),
        "final_adjustments": at(v, "finalAdjustments", f"array<struct<{_WHEN},pointsFrom:string,multiplier:double,maxPoints:double>>"),
        "required_inputs": kinds("requiredInputs"),
        "external_components": kinds("externalComponents"),
        "selection_policy": at(v, "selectionPolicy", f"struct<{_CHOICE},groups:array<struct<{_CHOICE}>>>"),
        "english_policy": _policy(english),
        "history_policy": _policy(history),
        "inquiry_policy": _inquiry(inquiry),
    }


def parsed(documents: dict[str, Column]) -> dict[str, Column]:
    """The documents as VARIANT, null where the text isn't JSON; no eligibility is an empty one."""
    return {n: F.try_parse_json(F.coalesce(c, F.lit("{}")) if n == "eligibility" else c) for n, c in documents.items()}


def fitting(variants: dict[str, Column]) -> dict[str, Column]:
    """Whether each document fits its shape."""
    return {n: _sure(v.isNotNull() & DOCUMENTS[n](v)) for n, v in variants.items()}


def rule(score_type: Column, verified_status: Column, variants: dict[str, Column], fine: Column) -> Column:
    """The rule of fitting documents; null where `fine` isn't true or one of the two codes is unknown."""
    formula = variants["formula"]
    own = _leaves(formula, variants["english"], variants["history"], variants["inquiry"])
    of = lambda x: _leaves(x, at(x, "englishPolicy"), at(x, "historyPolicy"), at(x, "inquiryPolicy"))
    own["alternatives"] = F.transform(at(formula, "alternatives", "array<variant>"), lambda x: F.struct(*(c.alias(n) for n, c in of(x).items())))
    own["eligibility"] = at(variants["eligibility"], "requiredMathSelections", "array<string>"), at(variants["eligibility"], "requiredInquiryCategory", "string"), at(variants["eligibility"], "maxHistoryGrade", "int")
    own["eligibility"] = F.struct(*own["eligibility"])
    known = _sure(score_type.isin(*SCORE_TYPES) & verified_status.isin(*STATUSES))
    return F.when(known & fine, scoring.rule_struct(score_type=score_type, verified_status=verified_status, **own))


def mapped(rows, documents: dict[str, str], *, score_type: str = "score_type", verified_status: str = "verified_status", into: str = "rule"):
    """rows with `<document>_fits` for each document and the rule, from columns of JSON text (document: column)."""
    variants = {f"_v_{n}": v for n, v in parsed({n: F.col(c) for n, c in documents.items()}).items()}
    own = {n: F.col(f"_v_{n}") for n in documents}
    # generators keep parsing and checks from being copied into every column that reads them
    df = rows.withColumn("_p", F.explode(F.array(F.struct(*(v.alias(n) for n, v in variants.items()))))).select("*", "_p.*").drop("_p")
    df = df.withColumn("_f", F.explode(F.array(F.struct(*(f.alias(f"{n}_fits") for n, f in fitting(own).items()))))).select("*", "_f.*").drop("_f")
    fine = F.lit(True)
    for n in documents:
        fine = fine & F.col(f"{n}_fits")
    return df.withColumn(into, rule(F.col(score_type), F.col(verified_status), own, fine)).drop(*variants)
