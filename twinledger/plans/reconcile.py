"""End-to-end reconciliations over two frames or two files."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.functions.ids import (
    IdSpec,
    join_record_root,
    normalizer_code,
    parse_id_spec,
    split_expression,
)
from twinledger.model import (
    FILE_1,
    FILE_2,
    MISSING_IN_1,
    MISSING_IN_2,
    CompareScope,
    ConfigError,
    MappingMember,
    Rule,
    RunResult,
    SideConfig,
)
from twinledger.operators import compare as C
from twinledger.operators import rules as R
from twinledger.operators.jsonschema import file_errors
from twinledger.operators.records import extract_data
from twinledger.operators.skew import fits_broadcast
from twinledger.sources.csvsplit import scan_csv_split
from twinledger.sources.files import file_type, run_type, scan_json
from twinledger.sources.jsonsplit import scan_json_split


def reconcile_ids(a: DataFrame, b: DataFrame) -> RunResult:
    """Ids on one side only, as two frames, with their counts."""
    ids = C.presence(a, b)
    numbers = C.diff_summary(ids).first()
    only = {
        "left": ids.filter("n_left > 0 AND n_right = 0").select(C.KEY),
        "right": ids.filter("n_right > 0 AND n_left = 0").select(C.KEY),
    }
    summary = {
        "onlyInDf1Count": numbers["only_in_file1"],
        "onlyInDf2Count": numbers["only_in_file2"],
        "differenceCount": numbers["missing_total"],
    }
    return RunResult(only, summary)


# --- sides -------------------------------------------------------------------


def side_id_spec(side: SideConfig, kind: str, where: str, warnings: list[str]) -> IdSpec:
    """Id path and normaliser of a side, with the warnings configuration deserves."""
    expr, inline = split_expression(side.id_expression)
    if not expr:
        raise ConfigError(f"{where} is missing primaryIdExpression")
    inline_code, code = normalizer_code(inline), normalizer_code(side.id_normalizer)
    if code and inline_code and code != inline_code:
        warnings.append(f"{where} normalizer {code} overrides inline normalizer {inline_code}")
    if kind == "JSON":
        expr = join_record_root(side.record_root, expr)
    elif (side.record_root or "").strip():
        warnings.append(f"{where} ignores recordRootExpression for CSV input")
    return parse_id_spec(expr, kind, code or inline_code)


def read_side(
    spark: SparkSession, path: str, side: SideConfig, where: str, warnings: list[str],
    has_header: bool = True, json_lines: bool = False,
) -> tuple[DataFrame, str]:
    """``(compare_id, data)`` of a file and the type it was read as."""
    kind, guessed = file_type(side.file_type, path)
    if kind not in ("CSV", "JSON"):
        raise ConfigError(f"{where} resolved unsupported file type {kind}. Supported values: CSV, JSON")
    if guessed:
        warnings.append(f"File type auto-detected as CSV for {path.rstrip('/').rsplit('/', 1)[-1]}")
    spec = side_id_spec(side, kind, where, warnings)
    if kind == "CSV":
        raw = scan_csv_split(spark, path, has_header)
    else:
        raw = scan_json(spark, path, json_lines=True) if json_lines else scan_json_split(spark, path)
    return extract_data(raw, spec, side.label), kind


def _label(side: SideConfig, fallback: str) -> str:
    return (side.label or "").strip() or (side.system or "").strip() or fallback


def advisory_errors(
    spark: SparkSession, path: str, side: SideConfig, kind: str, label: str, json_lines: bool = False
) -> DataFrame | None:
    """All schema violations of a JSON side, ``(message)``; they are reported, the run goes on.

    A report that shows the first few takes ``limit(jsonschema.MAX_ERRORS)`` of them.
    """
    if side.schema is None or kind != "JSON":
        return None
    found = file_errors(spark, path, side.schema, json_lines).orderBy("file", "index", "pos")
    return found.select(F.concat(F.lit(f"{label}: "), F.col("message")).alias("message"))


def _all_errors(parts: list[DataFrame | None]) -> DataFrame | None:
    given = [p for p in parts if p is not None]
    return given[0] if len(given) == 1 else given[0].union(given[1]) if given else None


# --- presence only -----------------------------------------------------------


def reconcile_unified(
    data1: DataFrame, data2: DataFrame, label1: str = "File 1", label2: str = "File 2",
    hot_rows: int = C.HOT_ROWS,
) -> RunResult:
    """Presence comparison; ids may repeat and every record of a missing id shows.

    Totals count ids.  ``missing_rows`` counts the emitted records, which is
    larger when a missing id repeats.
    """
    ids = C.presence(data1.select(C.KEY), data2.select(C.KEY)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        numbers = C.diff_summary(ids).first()
        settled = C.settle(ids, hot_rows)
    finally:
        ids.unpersist()
    diffs = C.missing_on_both_sides(data1, data2, settled, label1, label2, True, hot_rows, _small(numbers))
    summary = {
        "totalDifferences": numbers["missing_total"],
        "onlyInFile1Count": numbers["only_in_file1"],
        "onlyInFile2Count": numbers["only_in_file2"],
        "rowCount": numbers["missing_rows"],
    }
    return RunResult(diffs, summary)


def reconcile_unified_files(
    spark: SparkSession, path1: str, path2: str, side1: SideConfig, side2: SideConfig,
    has_header: bool = True, json_lines: bool = False,
) -> RunResult:
    """``reconcile_unified`` over two CSV or JSON files."""
    warnings: list[str] = []
    label1, label2 = _label(side1, "File 1"), _label(side2, "File 2")
    data1, kind1 = read_side(spark, path1, side1, label1, warnings, has_header, json_lines)
    data2, kind2 = read_side(spark, path2, side2, label2, warnings, has_header, json_lines)
    result = reconcile_unified(data1, data2, label1, label2)
    result.warnings = warnings
    result.validation_errors = _all_errors([
        advisory_errors(spark, path, side, kind, label, json_lines)
        for path, side, kind, label in ((path1, side1, kind1, label1), (path2, side2, kind2, label2))
    ])
    result.summary["reconciliationType"] = run_type(kind1, kind2)
    return result


def mapping_side(
    members: list[MappingMember], system: str, mapping_id: str, warnings: list[str], **overrides
) -> SideConfig:
    """The side a mapping member describes; explicit overrides win."""
    found = next((m for m in members if m.system.strip() == system.strip()), None)
    if found is None:
        raise ConfigError(f"Mapping {mapping_id} does not include system {system}")
    expr, inline = split_expression(found.id_expression or "id")
    inline_code, code = normalizer_code(inline), normalizer_code(found.id_normalizer)
    if code and inline_code and code != inline_code:
        warnings.append(
            f"Mapping member normalizer {code} overrides inline normalizer {inline_code} for system {system}"
        )
    return SideConfig(
        id_expression=expr or "id",
        id_normalizer=code or inline_code,
        file_type=overrides.get("file_type") or found.file_type,
        label=overrides.get("label") or found.label or found.system,
        system=found.system,
    )


def reconcile_by_mapping(
    mapping_id: str, members: list[MappingMember], df1: DataFrame, df2: DataFrame,
    system1: str, system2: str, label1: str | None = None, label2: str | None = None,
    type1: str | None = None, type2: str | None = None, issues: DataFrame | None = None,
) -> RunResult:
    """Resolve both systems of a mapping, extract their ids, compare presence.

    ``issues`` is the mapping's ``mapping_readiness``: any row stops the run.
    """
    if not members:
        raise ConfigError(f"No mapping members found for mapping {mapping_id}")
    if issues is not None:
        # One mapping has a few members, each with two issues at most.
        found = sorted(row["issue"] for row in issues.select("issue").distinct().collect())
        if found:
            raise ConfigError(f"Mapping {mapping_id} is not runnable until every system member references a saved schema. " + " ".join(found))
    warnings: list[str] = []
    sides = [
        mapping_side(members, system, mapping_id, warnings, label=label, file_type=kind)
        for system, label, kind in ((system1, label1, type1), (system2, label2, type2))
    ]
    frames, kinds = [], []
    for side, df in zip(sides, (df1, df2)):
        kind, guessed = file_type(side.file_type, None)
        if guessed:
            warnings.append(f"File type auto-detected as CSV for {side.system} because mapping {mapping_id} has none")
        spec = parse_id_spec(side.id_expression, kind, side.id_normalizer)
        frames.append(extract_data(df, spec, side.label))
        kinds.append(kind)
    result = reconcile_unified(frames[0], frames[1], sides[0].label, sides[1].label)
    result.warnings = warnings
    result.summary["reconciliationType"] = run_type(*kinds)
    return result


# --- rule sets ---------------------------------------------------------------


def _repeated(ids: DataFrame, column: str) -> DataFrame:
    """The first five repeated ids of a side, as examples for a message."""
    repeated = ids.filter(F.col(column) > 1)
    return repeated.select(C.KEY, F.col(column).alias("row_count")).orderBy(C.KEY).limit(5)


def _require_unique(ids: DataFrame, scope: CompareScope, label1: str, label2: str) -> None:
    for column, side, label in (("n_left", FILE_1, label1), ("n_right", FILE_2, label2)):
        examples = C.duplicate_examples(_repeated(ids, column))
        if examples:
            raise ConfigError(C.duplicate_message(scope.label, side, label, examples))


def _small(numbers) -> bool:
    """Are the missing ids of both sides, as counted, fit to broadcast."""
    return fits_broadcast(numbers["missing_total"], numbers["missing_bytes"])


def _duplicate_warnings(ids: DataFrame, scope: CompareScope, label1: str, label2: str) -> list[str]:
    warnings = []
    for column, side, label in (("n_left", FILE_1, label1), ("n_right", FILE_2, label2)):
        examples = C.duplicate_examples(_repeated(ids, column))
        if examples:
            warnings.append(
                f"Compare scope '{scope.label}' {side} ({label}) collapsed duplicate primaryId values "
                f"for base diff only because this RuleSet run has no active rules: {examples}."
            )
    return warnings


def base_diff(
    data1: DataFrame, data2: DataFrame, scope: CompareScope,
    allow_duplicates: bool = False, build_pairs: bool = True, picked: bool | None = None,
) -> RunResult:
    """Missing rows of both sides, matched pairs and their counts.

    ``picked`` settles how the missing records are fetched (True: by a
    broadcast of their ids); without it the ids' counted size decides.

    Ids must be unique, or are collapsed to one record each.  One narrow pass
    over the ids proves uniqueness, gives the totals and tells how large the
    set of missing ids is, which picks the way their records are fetched.
    """
    label1, label2 = _label(scope.side1, "File 1"), _label(scope.side2, "File 2")
    warnings: list[str] = []
    ids = C.presence(data1.select(C.KEY), data2.select(C.KEY)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        numbers = C.diff_summary(ids).first()
        repeated = bool(numbers["duplicated_in_file1"] or numbers["duplicated_in_file2"])
        if repeated and not allow_duplicates:
            _require_unique(ids, scope, label1, label2)
        if repeated:
            warnings = _duplicate_warnings(ids, scope, label1, label2)
        settled = C.settle(ids)
    finally:
        ids.unpersist()
    small = _small(numbers) if picked is None else picked
    missing = C.missing_on_both_sides(data1, data2, settled, label1, label2, small=small)
    if repeated:
        # Only records of missing ids are reported, so only those collapse:
        # per id the record whose JSON text sorts first.
        same = [c for c in missing.columns if c != "data"]
        missing = missing.groupBy(*same).agg(F.min("data").alias("data")).select(*missing.columns)
    pairs = None
    if build_pairs:
        one = C.collapse_duplicates(data1) if numbers["duplicated_in_file1"] else data1
        two = C.collapse_duplicates(data2) if numbers["duplicated_in_file2"] else data2
        pairs = C.matched_pairs(one, two, scope.scope_id, scope.object_type)
    summary = {
        "missingInFile1Count": numbers["only_in_file2"],
        "missingInFile2Count": numbers["only_in_file1"],
        "differenceCount": numbers["missing_total"],
        "matchedPairCount": numbers["matched"],
    }
    return RunResult(missing, summary, warnings, pairs=pairs, small=small)


def ruleset_diffs(
    data1: DataFrame, data2: DataFrame, scope: CompareScope, with_payload: bool = True
) -> tuple[DataFrame, list[R.CompiledRule], list[str]]:
    """All difference rows of two unique sides, from one shuffle and one pass.

    Missing rows and rule differences are entries of the same exploded array,
    so neither side is read or joined a second time.
    """
    label1, label2 = _label(scope.side1, "File 1"), _label(scope.side2, "File 2")
    facts = C.tag_sides(data1, data2).select(
        F.lit(scope.scope_id).cast("string").alias("compareScopeId"),
        F.lit(scope.object_type).cast("string").alias("objectType"),
        "primaryId", "file1", "file2", "in1", "in2",
    )
    pair_view = facts.select("compareScopeId", "objectType", "primaryId", "file1", "file2")
    compiled, warnings = R.compile_rules(pair_view, scope.active_rules())
    paired = F.col("in1") & F.col("in2")
    entries = [
        R.CompiledRule(c.rule, paired & c.matches, c.diff) for c in compiled if c.diff is not None
    ]
    for diff_type, absent, payload, here, there in (
        (MISSING_IN_2, "in2", "file1", label1, label2),
        (MISSING_IN_1, "in1", "file2", label2, label1),
    ):
        diff = R.diff_struct(
            diffType=F.lit(diff_type), compareScopeId=F.col("compareScopeId"), objectType=F.col("objectType"),
            primaryId=F.col("primaryId"), presentIn=F.lit(here), missingIn=F.lit(there),
            data=F.to_json(payload) if with_payload else F.lit(None),
            message=F.lit(f"Present in {here}, missing in {there}"),
        )
        entries.append(R.CompiledRule(Rule("missing"), ~F.col(absent), diff))
    return R.diff_rows(facts, entries), compiled, warnings


def reconcile_ruleset(
    data1: DataFrame, data2: DataFrame, scope: CompareScope, count: bool = True, picked: bool | None = None
) -> RunResult:
    """Base differences plus rule differences in the thirteen-column layout.

    ``picked`` settles the way, which changes no row: True picks the missing
    records by a broadcast of their ids, False takes all rows from one full
    outer join.  Without it the counted size of the missing ids decides.

    Without active rules duplicates collapse and no pairs are built.  Rules
    that fail to compile are dropped with a warning; base differences stay.
    """
    active = scope.active_rules()
    if not active:
        base = base_diff(data1, data2, scope, allow_duplicates=True, build_pairs=False)
        diffs = C.to_ruleset_diff(base.diffs, scope.scope_id, scope.object_type)
        summary = dict(base.summary, missingObjectDifferenceCount=base.summary["differenceCount"],
                       ruleDifferenceCount=0, ruleCount=0, firedRuleCount=0)
        return RunResult(diffs, summary, base.warnings)

    base = base_diff(data1, data2, scope, picked=picked)
    if base.small:
        # Few ids are missing: their records are picked by a broadcast, and
        # only the fields the rules read go through the pair join.
        rows, compiled, warnings = R.execute_pair_rules(base.pairs, active)
        diffs = C.union_diffs(C.to_ruleset_diff(base.diffs, scope.scope_id, scope.object_type), rows)
    else:
        diffs, compiled, warnings = ruleset_diffs(data1, data2, scope)
    if not compiled:
        warnings.append(
            f"RuleSet {scope.rule_set_id} compare scope '{scope.label}' rule execution failed; preserved base "
            f"missing-object diffs. Error: RuleSet {scope.rule_set_id} has no executable active rules"
        )
    missing = base.summary["differenceCount"]
    summary = {
        "missingInFile1Count": base.summary["missingInFile1Count"],
        "missingInFile2Count": base.summary["missingInFile2Count"],
        "missingObjectDifferenceCount": missing,
        "matchedPairCount": base.summary["matchedPairCount"],
        "ruleCount": len(active),
    }
    if count:
        rule_rows, fired = _rule_totals(base.pairs, compiled)
        summary["ruleDifferenceCount"] = rule_rows
        summary["firedRuleCount"] = fired
        summary["differenceCount"] = missing + rule_rows
    return RunResult(diffs, summary, warnings, pairs=base.pairs, small=base.small)


def _rule_totals(pairs: DataFrame, compiled: list[R.CompiledRule]) -> tuple[int, int]:
    """Emitted differences and activations, from one slim aggregate."""
    if not compiled:
        return 0, 0
    one = pairs.agg(
        *[F.count_if(c.matches).alias(f"r{i}") for i, c in enumerate(compiled)]
    ).first()
    per_rule = [one[f"r{i}"] for i in range(len(compiled))]
    emitted = sum(n for n, c in zip(per_rule, compiled) if c.diff is not None)
    return emitted, sum(per_rule)


def reconcile_ruleset_files(
    spark: SparkSession, path1: str, path2: str, scope: CompareScope,
    has_header: bool = True, json_lines: bool = False,
) -> RunResult:
    """``reconcile_ruleset`` over two CSV or JSON files."""
    warnings: list[str] = []
    frames, kinds = [], []
    for path, side, code in ((path1, scope.side1, FILE_1), (path2, scope.side2, FILE_2)):
        where = f"Compare scope '{scope.label}' {code}"
        data, kind = read_side(spark, path, side, where, warnings, has_header, json_lines)
        frames.append(data)
        kinds.append(kind)
    result = reconcile_ruleset(frames[0], frames[1], scope)
    result.warnings = warnings + result.warnings
    result.validation_errors = _all_errors([
        advisory_errors(spark, path, side, kind, _label(side, fallback), json_lines)
        for path, side, kind, fallback in zip((path1, path2), (scope.side1, scope.side2), kinds, ("File 1", "File 2"))
    ])
    result.summary["reconciliationType"] = run_type(*kinds)
    return result
