"""Rule evaluation: rules become Column expressions in one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinledger.functions.conditions import rule_condition
from twinledger.functions.values import (
    Val,
    apply_pre_actions,
    path_segments,
    side_pre_actions,
    strip_blank,
    text_of,
    value_at_path,
    values_differ,
    violates_operator,
)
from twinledger.model import (
    BUSINESS_RULE_DIFF,
    FIELD_MISMATCH,
    RULESET_DIFF_COLUMNS,
    ConfigError,
    Rule,
)

MATCHED = "_matchedRuleIds"
_DIFF_STRUCT = T.StructType([T.StructField(name, T.StringType()) for name in RULESET_DIFF_COLUMNS])


@dataclass(frozen=True)
class CompiledRule:
    """A predicate and, for rules that emit one, the difference struct."""

    rule: Rule
    matches: Column
    diff: Column | None = None


def _text(value: str | None) -> Column:
    cleaned = (value or "").strip()
    return F.lit(cleaned or None).cast("string")


def _pair_val(pairs: DataFrame, side: str) -> Val:
    return Val(F.col(side), pairs.schema[side].dataType)


def diff_struct(**values: Column) -> Column:
    """A thirteen-column difference; unnamed columns are null."""
    null = F.lit(None).cast("string")
    return F.struct(*[values.get(name, null).cast("string").alias(name) for name in RULESET_DIFF_COLUMNS])


def _pair_columns() -> dict[str, Column]:
    return {name: F.col(name) for name in ("compareScopeId", "objectType", "primaryId")}


def field_comparison_rule(pairs: DataFrame, rule: Rule) -> CompiledRule:
    """Violated comparison of two fields, after per-side conversions."""
    settings = rule.settings()
    path1, path2 = settings.get("file1FieldPath"), settings.get("file2FieldPath")
    path1, path2 = path1 or path2, path2 or path1
    if not path1:
        raise ConfigError(f"Rule {rule.rule_id} has no field path")
    actions = side_pre_actions(settings.get("preActions") or settings.get("preAction"))
    raw1 = value_at_path(_pair_val(pairs, "file1"), path1)
    raw2 = value_at_path(_pair_val(pairs, "file2"), path2)
    side1, side2 = apply_pre_actions(raw1, actions["file1"]), apply_pre_actions(raw2, actions["file2"])
    operator = settings.get("operator")
    if (operator or "").strip().lower() == "strict":
        violated = values_differ(side1, side2)
    else:
        violated = violates_operator(side1, side2, operator)
    field = (rule.field or ".".join(path_segments(path1))).strip()
    diff = diff_struct(
        diffType=F.lit(FIELD_MISMATCH), **_pair_columns(), field=F.lit(field),
        file1Value=strip_blank(text_of(side1)), file2Value=strip_blank(text_of(side2)),
        ruleId=_text(rule.rule_id), severity=_text(rule.severity),
        message=_text(rule.message or f"{field} differs between file 1 and file 2"),
    )
    return CompiledRule(rule, violated, diff)


def business_rule(pairs: DataFrame, rule: Rule, condition: Column) -> CompiledRule:
    """A condition that emits its own kind of difference."""
    diff = diff_struct(
        diffType=_text(rule.diff_type or BUSINESS_RULE_DIFF), **_pair_columns(),
        ruleId=_text(rule.rule_id), severity=_text(rule.severity), message=_text(rule.message),
    )
    return CompiledRule(rule, F.coalesce(condition, F.lit(False)), diff)


def _compile_one(df: DataFrame, rule: Rule) -> CompiledRule | str:
    if rule.kind == "FIELD_COMPARISON":
        return field_comparison_rule(df, rule)
    if rule.function is not None:
        condition = rule.function(df)
    elif not (rule.text or "").strip():
        return f"Rule {rule.rule_id} has no ruleLogic or ruleText and was skipped."
    else:
        condition = rule_condition(rule.text, df.schema)
        if condition is None:
            return f"Rule {rule.rule_id} ruleText could not be parsed and was skipped: {rule.text}"
    if rule.kind in ("BUSINESS_RULE", "FUNCTION"):
        return business_rule(df, rule, condition)
    return CompiledRule(rule, F.coalesce(condition, F.lit(False)))


def compile_rules(df: DataFrame, rules: list[Rule]) -> tuple[list[CompiledRule], list[str]]:
    """Rules that analyse against ``df``, in order, and a warning for each other one."""
    compiled, warnings = [], []
    for rule in sorted((r for r in rules if r.enabled), key=lambda r: (r.sequence, r.rule_id)):
        try:
            outcome = _compile_one(df, rule)
            if isinstance(outcome, CompiledRule):
                probe = [outcome.matches] + ([] if outcome.diff is None else [outcome.diff])
                df.select(*probe).schema  # analysis only, no job
        except (PySparkException, ConfigError, ValueError, TypeError, AttributeError) as problem:
            outcome = f"Rule {rule.rule_id} failed to compile and was skipped: {str(problem).splitlines()[0]}"
        if isinstance(outcome, str):
            warnings.append(outcome)
        else:
            compiled.append(outcome)
    return compiled, warnings


def _matched_ids(compiled: list[CompiledRule]) -> Column:
    """Ids of the rules that hold.  Plain array functions keep code generation."""
    flags = [F.when(c.matches, F.lit(c.rule.rule_id)).otherwise(F.lit("")) for c in compiled]
    return F.array_remove(F.array_distinct(F.array(*flags)), "")


def as_facts(df: DataFrame) -> DataFrame:
    """A single scalar column becomes a fact with one key, ``value``."""
    if len(df.columns) == 1 and not isinstance(df.schema[0].dataType, T.StructType):
        return df.toDF("value")
    return df


def execute_rules(df: DataFrame, rules: list[Rule], return_all: bool = False) -> tuple[DataFrame, list[str]]:
    """Facts with the ids of the rules they match; matched facts only, or all."""
    facts = as_facts(df)
    compiled, warnings = compile_rules(facts, rules)
    if not compiled:
        raise ConfigError("The rule set has no executable active rules")
    marked = facts.withColumn(MATCHED, _matched_ids(compiled))
    if not return_all:
        marked = marked.filter(_any(compiled))
    return marked, warnings


def _any(compiled: list[CompiledRule]) -> Column:
    hit = F.lit(False)
    for c in compiled:
        hit = hit | c.matches
    return hit


def rule_fire_counts(marked: DataFrame) -> DataFrame:
    """Activations per rule."""
    return (
        marked.select(F.explode(MATCHED).alias("ruleId"))
        .groupBy("ruleId").agg(F.count(F.lit(1)).alias("fired"))
    )


def diff_rows(df: DataFrame, compiled: list[CompiledRule]) -> DataFrame:
    """All differences the rules emit, several per pair if several rules hold.

    Pairs without any hit leave before the array is built, so the explode only
    touches the rows that matter.
    """
    emitting = [c for c in compiled if c.diff is not None]
    if not emitting:
        return df.limit(0).select(*[F.lit(None).cast("string").alias(n) for n in RULESET_DIFF_COLUMNS])
    items = F.array(*[F.when(c.matches, c.diff) for c in emitting])
    return (
        df.filter(_any(emitting)).select(F.explode(items).alias("diff"))
        .filter(F.col("diff").isNotNull()).select("diff.*")
    )


def silent_matches(pairs: DataFrame, compiled: list[CompiledRule]) -> DataFrame:
    """Pairs that matched a rule while no rule emitted a difference for them."""
    quiet = [c for c in compiled if c.diff is None]
    loud = [c for c in compiled if c.diff is not None]
    return pairs.filter(_any(quiet) & ~_any(loud)).select("compareScopeId", "primaryId")


def silent_warnings(pairs: DataFrame, compiled: list[CompiledRule], rule_set_id: str | None) -> DataFrame:
    """One warning per silent pair, as rows: their number grows with the data."""
    unknown = F.lit("(unknown)")
    return silent_matches(pairs, compiled).select(
        F.concat(
            F.lit(f"RuleSet {rule_set_id} matched compareScope="), F.coalesce("compareScopeId", unknown),
            F.lit(" primaryId="), F.coalesce("primaryId", unknown), F.lit(" but emitted no diff rows."),
        ).alias("warning")
    )


def execute_pair_rules(pairs: DataFrame, rules: list[Rule]) -> tuple[DataFrame, list[CompiledRule], list[str]]:
    """Difference rows of all rules over all pairs, plus compile warnings."""
    compiled, warnings = compile_rules(pairs, rules)
    return diff_rows(pairs, compiled), compiled, warnings


def classify_cascade(df: DataFrame, rules: list[tuple[Column, str]], out: str, default: str | None = None) -> DataFrame:
    """The first matching rule sets the status; a status already set is kept."""
    branches = [F.when(F.coalesce(condition, F.lit(False)), F.lit(value)) for condition, value in rules]
    current = [F.col(out)] if out in df.columns else []
    return df.withColumn(out, F.coalesce(*current, *branches, F.lit(default).cast("string")))
