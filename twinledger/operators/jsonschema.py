"""JSON-schema jobs over datasets: infer, merge, flatten, validate, find paths."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinledger.model import ConfigError

# Error cap of a report, root and item names.
MAX_ERRORS = 100
DRAFT = "http://json-schema.org/draft-07/schema#"
ITEM_NAME = "[0]"

CATALOG = "path string, type string"
ITEM = object()
"""The step from an array to its items; other steps are property names."""


def json_type(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    for kinds, name in ((int, "integer"), (float, "number"), (str, "string"), (list, "array")):
        if isinstance(value, kinds):
            return name
    return "object"


def parsed(text: str | None) -> tuple[object] | None:
    """The document of a text, boxed; None when the text is no JSON or nests beyond what the parser takes."""
    try:
        return None if text is None else (json.loads(text),)
    except (ValueError, RecursionError):
        return None


def unreadable(df: DataFrame, col: str) -> DataFrame:
    """The rows whose text is given but no JSON; inference and merging pass them over."""
    return df.filter(F.col(col).isNotNull() & F.try_parse_json(F.col(col)).isNull())


def rendered(steps: tuple, root: str = "$") -> str:
    """A JSON path of steps; names with path signs are quoted."""
    return root + "".join("[*]" if s is ITEM else f".{_quote(s)}" for s in steps)


def _quote(key: str) -> str:
    return f"['{key}']" if any(c in key for c in ".[]'") else key


# --- inference ---------------------------------------------------------------


def places(document: object) -> Iterator[tuple[int, int, object, object, tuple]]:
    """Every value of a document as ``(place, parent place, step, value, steps)``, parents first, to any depth."""
    waiting: list[tuple[int, object, object, tuple]] = [(-1, None, document, ())]
    place = -1
    while waiting:
        parent, step, value, steps = waiting.pop()
        place += 1
        yield place, parent, step, value, steps
        inner = value.items() if isinstance(value, dict) else ((ITEM, v) for v in value) if isinstance(value, list) else ()
        waiting += [(place, s, v, (*steps, s)) for s, v in reversed(list(inner))]


def _per_batch(df: DataFrame, col: str, observe: Callable[[object, set], None], schema: str) -> DataFrame:
    """Distinct rows a helper collects from the documents of each Arrow batch."""
    names = [field.split()[0] for field in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: set = set()
            for text in batch[col]:
                found = parsed(text)
                if found is not None:
                    observe(found[0], seen)
            yield pd.DataFrame(sorted(seen), columns=names)

    return df.select(col).mapInPandas(run, schema)


def infer_schema(df: DataFrame, col: str, strict: bool = False) -> DataFrame:
    """What a JSON column contains, from every document.

    Normally ``(path, type)`` pairs: array elements share the path ``[*]`` and
    types unite.  Each batch emits distinct pairs, so the shuffle carries a
    few rows per task however large the column is.  ``strict`` keeps each
    distinct shape whole, as ``(schema_text)``.  Texts that are no JSON are
    passed over; ``unreadable`` lists them.
    """
    if strict:
        return _per_batch(df, col, lambda d, seen: seen.add((json.dumps(strict_schema(d), sort_keys=True),)), "schema_text string").distinct()
    return _per_batch(df, col, lambda d, seen: seen.update((rendered(p[4]), json_type(p[3])) for p in places(d)), CATALOG).distinct()


def strict_schema(document: object) -> dict:
    """Schema of one document: every key required, nothing else allowed.

    Values are closed from the last to the first, so each one finds the
    schemas of what it contains ready.
    """
    inner: dict[int, list[tuple[object, dict]]] = {}
    closed: dict = {}
    for place, parent, step, value, _ in reversed(list(places(document))):
        held = inner.pop(place, [])[::-1]
        closed = {"type": json_type(value)}
        if isinstance(value, dict):
            closed["properties"] = dict(held)
            if held:
                closed.update(required=[k for k, _ in held], additionalProperties=False)
        elif isinstance(value, list):
            kinds = list({json.dumps(k, sort_keys=True): k for _, k in held}.values())
            closed["items"] = {"anyOf": kinds} if len(kinds) > 1 else kinds[0] if kinds else {}
        inner.setdefault(parent, []).append((step, closed))
    return closed


def united_types(types: set[str]) -> list[str]:
    """Sorted types; integer gives way to number."""
    return sorted(types - ({"integer"} if "number" in types else set()))


def assemble_schema(catalog: list[tuple[str, str]]) -> dict:
    """The nested draft-07 schema of a small ``(path, type)`` catalog."""
    types: dict[str, set[str]] = {}
    children: dict[str, dict[str, str]] = {}
    for path, kind in catalog:
        types.setdefault(path, set()).add(kind)
    for path in types:
        if path.endswith("[*]"):
            continue
        parent, _, key = path.rpartition(".")
        if path.endswith("']"):
            start = path.index(".['") if path.count(".['") == 1 else path.rindex(".['")
            parent, key = path[:start], path[start + 3:-2]
        if parent:
            children.setdefault(parent, {})[key] = path

    def build(path: str) -> dict:
        kinds = set(types.get(path, ()))
        parts: list[dict] = []
        scalars = united_types(kinds - {"object", "array"})
        if "object" in kinds:
            parts.append({"type": "object",
                          "properties": {k: build(p) for k, p in sorted(children.get(path, {}).items())}})
        if "array" in kinds:
            parts.append({"type": "array", "items": build(f"{path}[*]") if f"{path}[*]" in types else {}})
        if not parts:
            return {"type": scalars[0] if len(scalars) == 1 else scalars}
        if len(parts) == 1 and set(scalars) <= {"null"}:
            names = [parts[0]["type"]] + scalars
            return dict(parts[0], type=names[0] if len(names) == 1 else names)
        if scalars:
            parts.append({"type": scalars[0] if len(scalars) == 1 else scalars})
        return {"anyOf": parts}

    return build("$")


def merge_schemas(schemas: DataFrame, col: str = "schema_text") -> DataFrame:
    """Field catalog of many schemas: per path the united types. References stay as they are."""

    def observe(schema: object, seen: set) -> None:
        for node in nodes(schema, branches=("anyOf",), references=False):
            named = node.schema.get("type")
            kinds = named if isinstance(named, list) else [named] if named else []
            if not kinds and "anyOf" not in node.schema:
                kinds = ["object"] if isinstance(node.schema.get("properties"), dict) else ["array"] if "items" in node.schema else []
            seen.update((rendered(node.steps), str(kind)) for kind in kinds)

    return unite_catalog(_per_batch(schemas, col, observe, CATALOG))


def unite_catalog(pairs: DataFrame) -> DataFrame:
    """``(path, types)`` with comma-joined sorted types; number absorbs integer."""
    kinds = F.collect_set("type")
    united = F.when(F.array_contains(kinds, "number"), F.array_remove(kinds, "integer")).otherwise(kinds)
    return pairs.groupBy("path").agg(F.array_join(F.array_sort(united), ",").alias("types"))


# --- one walk through a schema -----------------------------------------------


@dataclass(frozen=True)
class Node:
    """A subschema, its reference followed: where it stands and whether its parent requires it."""

    steps: tuple
    schema: dict
    required: bool


def _pointed(root: object, pointer: str) -> object:
    """What a local JSON pointer leads to, or None."""
    for step in pointer.removeprefix("#").split("/")[1:]:
        name = step.replace("~1", "/").replace("~0", "~")
        if isinstance(root, list) and name.isdigit() and int(name) < len(root):
            root = root[int(name)]
        else:
            root = root.get(name) if isinstance(root, dict) else None
    return root


def _followed(root: object, node: object, open_: frozenset = frozenset()) -> tuple[object, frozenset]:
    """The schema behind local references and the references passed; None where they turn in a circle."""
    while isinstance(node, dict) and str(node.get("$ref", "")).startswith("#"):
        if node["$ref"] in open_:
            return None, open_
        target = _pointed(root, node["$ref"])
        if target is None:
            break
        open_, node = open_ | {node["$ref"]}, target
    return node, open_


def nodes(root: object, branches: tuple[str, ...] = ("anyOf", "oneOf", "allOf"), references: bool = True, first_branch: bool = False) -> Iterator[Node]:
    """Every subschema reachable by properties, items and branches, parents first, to any depth.

    A branch stands where its owner stands.  A reference that is already open
    on the way to it isn't entered again, so recursive schemas end.  With
    ``first_branch`` a schema without properties of its own takes those of the
    first branch that has some, and other branches are left out.
    """
    waiting: list[tuple[tuple, object, bool, frozenset]] = [((), root, True, frozenset())]
    while waiting:
        steps, node, required, open_ = waiting.pop()
        if references:
            node, open_ = _followed(root, node, open_)
        if not isinstance(node, dict):
            continue
        yield Node(steps, node, required)
        owner = node
        options = [o for word in branches for o in (node.get(word) if isinstance(node.get(word), list) else [])]
        if first_branch:
            if not isinstance(node.get("properties"), dict):
                owner = next((o for o in options if isinstance(o, dict) and isinstance(o.get("properties"), dict)), node)
            options = []
        named = owner.get("properties") if isinstance(owner.get("properties"), dict) else {}
        needed = node.get("required") if isinstance(node.get("required"), list) else []
        items = node.get("items")
        items = items if isinstance(items, list) else [items]
        inner = [((*steps, k), child, k in needed, open_) for k, child in named.items()]
        inner += [((*steps, ITEM), child, False, open_) for child in (items[:1] if first_branch else items)]
        inner += [(steps, o, required, open_) for o in options]
        waiting += reversed(inner)


# --- flattening and paths ----------------------------------------------------


def flat_fields(schema: dict) -> Iterator[tuple[str, str, str, bool, int]]:
    """``(path, name, type, required, depth)`` of every field, parents first."""
    for node in nodes(schema, first_branch=True):
        if node.steps:
            names = [ITEM_NAME if s is ITEM else s for s in node.steps]
            kind = node.schema.get("type") or ("any" if node.schema.get("anyOf") else "string")
            yield ".".join(names), names[-1], kind if isinstance(kind, str) else json.dumps(kind), node.required, len(names)


FIELDS = "fieldPath string, fieldName string, type string, required boolean, depth int"


def _per_schema(schemas: DataFrame, id_col: str, text_col: str, rows: Callable, fields: str) -> DataFrame:
    """Several rows per stored schema; an unreadable text yields none.

    A catalog is a small table and comes in few splits, its texts take long:
    they are dealt over all shuffle partitions.
    """
    out = T.StructType([schemas.schema[id_col]] + T._parse_datatype_string(fields).fields)
    names = out.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for key, text in zip(batch[id_col], batch[text_col]):
                told = parsed(text)
                if told is not None and isinstance(told[0], dict):
                    found.extend((key, *row) for row in rows(told[0]))
            yield pd.DataFrame(found, columns=names)

    tasks = int(schemas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return schemas.select(id_col, text_col).repartition(tasks).mapInPandas(run, out)


def flatten_schema(schemas: DataFrame, id_col: str = "schema_id", text_col: str = "schema_text") -> DataFrame:
    """Field rows of every schema in a catalog."""
    return _per_schema(schemas, id_col, text_col, flat_fields, FIELDS)


def json_paths(schema: dict) -> Iterator[tuple[str, str]]:
    """``(path, name)`` of every property through items, references and all branches."""
    ends = {n.steps for n in nodes(schema) if n.steps and n.steps[-1] is not ITEM}
    yield from sorted(("$" + "".join("[*]" if s is ITEM else f".{s}" for s in steps), steps[-1]) for steps in ends)


def schema_paths(schemas: DataFrame, id_col: str = "schema_id", text_col: str = "schema_text") -> DataFrame:
    """``(schema id, jsonPath, fieldName)`` of every stored schema."""
    return _per_schema(schemas, id_col, text_col, json_paths, "jsonPath string, fieldName string")


def resolve_key_paths(paths: DataFrame, key: str, id_col: str = "schema_id") -> DataFrame:
    """All paths of a property name; ``resolved`` is set when there is just one."""
    if key.startswith("$"):
        return paths.select(id_col).distinct().select(
            id_col, F.lit(key).alias("jsonPath"), F.lit(key).alias("resolved")
        )
    hits = paths.filter(F.col("fieldName") == key)
    counted = hits.groupBy(id_col).agg(F.countDistinct("jsonPath").alias("_n"))
    return hits.join(counted, id_col).select(
        id_col, "jsonPath", F.when(F.col("_n") == 1, F.col("jsonPath")).alias("resolved")
    ).distinct()


def member_path(col: Column) -> Column:
    """Path form of a stored id expression; a bare name stays a name."""
    base = F.trim(F.substring_index(F.trim(col), "|", 1))
    starred = F.replace(F.regexp_replace(base, r"\[\d+\]", "[*]"), F.lit(".[*]"), F.lit("[*]"))
    segments = F.regexp_replace(F.regexp_replace(starred, r"\s*\.[.\s]*", "."), r"^\.|\.$", "")
    rooted = F.concat(F.when(segments.startswith("["), "$").otherwise("$."), segments)
    nested = F.contains(starred, F.lit(".")) | F.contains(starred, F.lit("["))
    return F.nullif(F.when(starred.startswith("$") | ~nested, starred).otherwise(rooted), F.lit(""))


def path_in_schema(
    members: DataFrame, paths: DataFrame, member_col: str = "member_id", schema_col: str = "schema_id",
    expr_col: str = "id_expression",
) -> DataFrame:
    """Adds ``in_schema``: does the member's id path exist in its schema.

    Array marks may be left out of the member's path but not invented.  The
    join is an equality on the path without marks; the marks are then checked
    by a pattern built from the schema's own path.
    """

    def unmarked(col: Column) -> Column:
        return F.replace(col, F.lit("[*]"), F.lit(""))

    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = members.select(member_col, schema_col, expr_col).repartition(tasks).select(
        member_col, schema_col, member_path(F.col(expr_col)).alias("_want"))
    # Never null: a filter on null keys would be planned before the members are dealt out, with all the patterns it takes.
    none, rooted, bare = F.lit(0), F.lit(1), F.lit(2)
    asked = wanted.withColumn("_kind", F.when(F.col("_want").isNull(), none).when(F.col("_want").startswith("$"), rooted).otherwise(bare)).withColumn(
        "_key", F.coalesce(F.when(F.col("_kind") == rooted, unmarked(F.col("_want"))).otherwise(F.col("_want")), F.lit("")))
    escaped = F.regexp_replace(F.col("jsonPath"), r"([\\^$.|?+(){}])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.replace(escaped, F.lit("[*]"), F.lit(r"(\[\*\])?")), F.lit("$"))
    # Paths and names in one list, so that the schemas are read once.
    kinds = F.array(
        F.struct(rooted.alias("_kind"), unmarked(F.col("jsonPath")).alias("_key"), pattern.alias("_pattern")),
        F.struct(bare.alias("_kind"), F.col("fieldName").alias("_key"), F.lit(None).cast("string").alias("_pattern")),
    )
    told = paths.select(schema_col, F.explode(kinds).alias("_told")).select(schema_col, "_told.*").distinct()
    found = (
        asked.join(told.hint("merge"), [schema_col, "_kind", "_key"]).filter((F.col("_kind") == bare) | F.expr("_want RLIKE _pattern")).select(member_col)
        .distinct().withColumn("in_schema", F.lit(True))
    )
    return members.join(found, member_col, "left").withColumn("in_schema", F.coalesce("in_schema", F.lit(False)))


# --- validation --------------------------------------------------------------

_EMPTY = "CAST(ARRAY() AS ARRAY<STRING>)"


def _member(value: Column, key: str) -> Column:
    """An object's member, null if absent.  Paths have no escapes, so a name with both quotes, or none at all, is looked up as a map's key."""
    for quote in "'\"":
        if key and quote not in key:
            return F.try_variant_get(value, f"$[{quote}{key}{quote}]", "variant")
    return F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(key))


def _with_shape(value: Column, check: Callable[[Column, Column], Column]) -> Column:
    """Evaluate ``check(value, shape)`` with both bound once per value.

    A lambda variable holds them: without it every mention of a nested value
    would walk down from the document again.
    """
    bound = F.struct(value.alias("value"), F.schema_of_variant(value).alias("shape"))
    return F.flatten(F.transform(F.array(bound), lambda b: check(b.getField("value"), b.getField("shape"))))


def _is_type(value: Column, shape: Column, name: str) -> Column:
    plain = shape.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | shape.rlike(r"^DECIMAL\(\d+,0\)$")
    # 1e2 is an integer too: a number without a fraction, however it is written
    number = F.try_variant_get(value, "$", "double")
    integer = plain | (shape.isin("DOUBLE", "FLOAT") & (number == F.rint(number)))
    return {
        "object": shape.startswith("OBJECT"),
        "array": shape.startswith("ARRAY"),
        "string": shape == "STRING",
        "boolean": shape == "BOOLEAN",
        "null": shape == "VOID",
        "integer": integer,
        "number": plain | shape.startswith("DECIMAL") | shape.isin("DOUBLE", "FLOAT"),
    }.get(name, F.lit(False))


def _errors_when(condition: Column, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(condition, F.lit(False)), F.array(text)).otherwise(F.expr(_EMPTY))


@dataclass(frozen=True)
class _Scope:
    """The whole schema and the references open on the way to a part of it."""

    root: dict
    open: frozenset = frozenset()


def _part(schema: object, scope: _Scope) -> tuple[object, _Scope]:
    """The subschema behind references; one that refers to itself can't be compiled."""
    found, open_ = _followed(scope.root, schema, scope.open)
    if found is None:
        raise ConfigError("The schema refers to itself; recursive schemas aren't supported")
    return found, _Scope(scope.root, open_)


def validation_errors(value: Column, schema: dict, scope: _Scope | None = None, where: str = "$") -> Column:
    """Messages (array of strings) for a VARIANT value under a draft-07 schema.

    Everything is decided while compiling except the value itself: the result
    is one expression over the parsed document, evaluated by the JVM.
    """
    resolved, scope = _part(schema, _Scope(schema) if scope is None else scope)
    if resolved is False:
        return F.array(F.lit(f"{where}: no value is allowed"))
    if not isinstance(resolved, dict) or not resolved:
        return F.expr(_EMPTY)
    return _with_shape(value, lambda v, shape: _errors(v, shape, resolved, scope, where))


def _fits(value: Column, schema: object, scope: _Scope) -> Column:
    return F.size(validation_errors(value, schema, scope)) == 0


def _exact(number: int | float | Decimal) -> Column | None:
    """A schema's number as DECIMAL, or None when that can't hold it."""
    told = Decimal(repr(number)) if isinstance(number, float) else Decimal(number)
    if not told.is_finite() or told.adjusted() >= 20 or told.as_tuple().exponent < -18:
        return None
    return F.lit(format(told, "f")).cast("decimal(38,18)")


def _related(value: Column, bound: int | float, relation: Callable[[Column, Column], Column]) -> Column:
    """A relation of a number to a schema's number: exact where both fit a DECIMAL, else as doubles."""
    rough = relation(F.try_variant_get(value, "$", "double"), F.lit(float(bound)))
    limit = _exact(bound)
    if limit is None:
        return rough
    fine = F.try_variant_get(value, "$", "decimal(38,18)")
    told = Decimal(repr(bound)) if isinstance(bound, float) else Decimal(bound)
    kind = f"decimal(38,{max(0, -told.as_tuple().exponent)})"
    # a whole number too long for 18 fraction digits is compared with as many as the schema's number has
    long = F.try_variant_get(value, "$", kind)
    whole = F.schema_of_variant(value).rlike(r"^DECIMAL\(\d+,0\)$") & long.isNotNull()
    return F.when(fine.isNotNull(), relation(fine, limit)).when(whole, relation(long, F.lit(format(told, "f")).cast(kind))).otherwise(rough)


def _errors(value: Column, shape: Column, schema: dict, scope: _Scope, where: str) -> Column:
    checks: list[Column] = []
    text = F.try_variant_get(value, "$", "string")
    is_text, is_number = _is_type(value, shape, "string"), _is_type(value, shape, "number")

    named = schema.get("type")
    if named is not None:
        kinds = named if isinstance(named, list) else [named]
        allowed = F.lit(False)
        for kind in kinds:
            allowed = allowed | _is_type(value, shape, kind)
        checks.append(_errors_when(~allowed, f"{where}: expected {' or '.join(kinds)}"))
    if "const" in schema:
        checks.append(_errors_when(~_equals(value, shape, schema["const"]), f"{where}: must be the constant value"))
    if isinstance(schema.get("enum"), list):
        member = F.lit(False)
        for option in schema["enum"]:
            member = member | _equals(value, shape, option)
        checks.append(_errors_when(~member, f"{where}: is not one of the allowed values"))
    for word, bad in (
        ("minimum", lambda n, b: n < b), ("maximum", lambda n, b: n > b),
        ("exclusiveMinimum", lambda n, b: n <= b), ("exclusiveMaximum", lambda n, b: n >= b),
        ("multipleOf", lambda n, b: F.try_mod(n, b) != 0),
    ):
        bound = schema.get(word)
        if isinstance(bound, (int, float)) and not isinstance(bound, bool):
            checks.append(_errors_when(is_number & _related(value, bound, bad), f"{where}: violates {word} {bound}"))
    for word, bad in (("minLength", lambda n: F.length(text) < n), ("maxLength", lambda n: F.length(text) > n)):
        if isinstance(schema.get(word), int):
            checks.append(_errors_when(is_text & bad(schema[word]), f"{where}: violates {word} {schema[word]}"))
    if isinstance(schema.get("pattern"), str):
        checks.append(_errors_when(is_text & ~text.rlike(schema["pattern"]), f"{where}: does not match pattern"))

    checks += _object_checks(value, shape, schema, scope, where)
    checks += _array_checks(value, shape, schema, scope, where)
    for option in schema.get("allOf", []):
        checks.append(validation_errors(value, option, scope, where))
    if "if" in schema and ("then" in schema or "else" in schema):
        met, unmet = (validation_errors(value, schema[w], scope, where) if w in schema else F.expr(_EMPTY) for w in ("then", "else"))
        checks.append(F.when(_fits(value, schema["if"], scope), met).otherwise(unmet))
    for word in ("anyOf", "oneOf"):
        if isinstance(schema.get(word), list):
            fits = [F.when(_fits(value, o, scope), 1).otherwise(0) for o in schema[word]]
            good = sum(fits[1:], fits[0])
            wrong = good == 0 if word == "anyOf" else good != 1
            checks.append(_errors_when(wrong, f"{where}: does not match {word}"))
    if "not" in schema:
        checks.append(
            _errors_when(_fits(value, schema["not"], scope), f"{where}: matches a forbidden schema")
        )
    return F.concat(*checks) if checks else F.expr(_EMPTY)


def _equals(value: Column, shape: Column, literal: object) -> Column:
    """Equality of structures: members in any order, numbers by value, at every level."""
    kind = json_type(literal)
    if kind in ("object", "array"):
        if kind == "object":
            parts = F.try_variant_get(value, "$", "map<string,variant>")
            pairs = [(_member(value, k), v) for k, v in literal.items()]
        else:
            parts = F.try_variant_get(value, "$", "array<variant>")
            pairs = [(F.get(parts, i), v) for i, v in enumerate(literal)]
        same = _is_type(value, shape, kind) & (F.size(parts) == len(literal))
        for part, wanted in pairs:
            same = same & _equals(part, F.schema_of_variant(part), wanted)
        return F.coalesce(same, F.lit(False))
    if kind == "null":
        return _is_type(value, shape, "null")
    if kind in ("integer", "number"):
        return _is_type(value, shape, "number") & _related(value, literal, lambda n, b: n == b)
    return _is_type(value, shape, kind) & (F.try_variant_get(value, "$", kind) == F.lit(literal))


def _object_checks(value: Column, shape: Column, schema: dict, scope: _Scope, where: str) -> list[Column]:
    checks = []
    is_object = _is_type(value, shape, "object")
    members = F.try_variant_get(value, "$", "map<string,variant>")
    names = F.map_keys(members)
    properties = schema.get("properties") or {}
    required = schema.get("required") or []
    for key in dict.fromkeys([*required, *properties]):
        message = F.array(F.lit(f"{where}: required property '{key}' not found")) if key in required else F.expr(_EMPTY)
        child, inside = _part(properties.get(key, {}), scope)
        at = f"{where}.{key}"

        def member(v: Column, s: Column) -> Column:
            found = _errors(v, s, child, inside, at) if isinstance(child, dict) and child else validation_errors(v, child, inside, at)
            return F.when(v.isNull(), message).otherwise(found)

        # The member is looked up once, for its presence and its own checks.
        errors = _with_shape(_member(value, key), member)
        checks.append(F.when(is_object, errors).otherwise(F.expr(_EMPTY)))

    def each(keys: Column, work: Callable[[Column], Column]) -> None:
        checks.append(F.when(is_object, F.flatten(F.transform(keys, work))).otherwise(F.expr(_EMPTY)))

    patterns = schema.get("patternProperties") or {}
    for pattern, child in patterns.items():
        each(F.filter(names, lambda k: k.rlike(pattern)), lambda k: validation_errors(F.element_at(members, k), child, scope, f"{where}.*"))
    extra = schema.get("additionalProperties", True)
    if extra is not True:
        keys = F.array_except(names, F.array(*[F.lit(k) for k in properties]) if properties else F.expr(_EMPTY))
        for pattern in patterns:
            keys = F.filter(keys, lambda k: ~k.rlike(pattern))
        if extra is False:
            each(keys, lambda k: F.array(F.concat(F.lit(f"{where}: property '"), k, F.lit("' is not allowed"))))
        else:
            each(keys, lambda k: validation_errors(F.element_at(members, k), extra, scope, f"{where}.*"))
    if "propertyNames" in schema:
        each(names, lambda k: validation_errors(k.cast("variant"), schema["propertyNames"], scope, f"{where} (property name)"))
    for key, need in (schema.get("dependencies") or {}).items():
        has = is_object & F.array_contains(names, F.lit(key))
        if isinstance(need, list):
            for other in need:
                checks.append(_errors_when(has & ~F.array_contains(names, F.lit(other)), f"{where}: property '{key}' needs property '{other}'"))
        else:
            checks.append(F.when(F.coalesce(has, F.lit(False)), validation_errors(value, need, scope, where)).otherwise(F.expr(_EMPTY)))
    checks += _size_checks(is_object, F.size(names), schema, ("minProperties", "maxProperties"), where)
    return checks


def _size_checks(applies: Column, size: Column, schema: dict, words: tuple[str, str], where: str) -> list[Column]:
    """A lower and an upper bound of a number of parts."""
    return [
        _errors_when(applies & bad, f"{where}: violates {word} {schema[word]}")
        for word, bad in zip(words, (size < schema.get(words[0], 0), size > schema.get(words[1], 0))) if isinstance(schema.get(word), int)
    ]


def _array_checks(value: Column, shape: Column, schema: dict, scope: _Scope, where: str) -> list[Column]:
    checks = []
    is_array = _is_type(value, shape, "array")
    elements = F.try_variant_get(value, "$", "array<variant>")

    def each(items: Column, child: object) -> None:
        errors = F.flatten(F.transform(items, lambda item: validation_errors(item, child, scope, f"{where}[*]")))
        checks.append(F.when(is_array, errors).otherwise(F.expr(_EMPTY)))

    items = schema.get("items", True)
    if isinstance(items, list):
        for position, item_schema in enumerate(items):
            item = F.get(elements, F.lit(position))
            errors = validation_errors(item, item_schema, scope, f"{where}[{position}]")
            checks.append(F.when(is_array & item.isNotNull(), errors).otherwise(F.expr(_EMPTY)))
        if schema.get("additionalItems", True) is not True:
            each(F.slice(elements, F.lit(len(items) + 1), F.greatest(F.size(elements), F.lit(0))), schema["additionalItems"])
    elif items is not True and items != {}:
        each(elements, items)
    if schema.get("uniqueItems") is True:
        texts = F.transform(elements, lambda item: F.to_json(item))
        checks.append(_errors_when(is_array & (F.size(F.array_distinct(texts)) < F.size(texts)), f"{where}: items repeat"))
    if "contains" in schema:
        checks.append(_errors_when(is_array & ~F.exists(elements, lambda item: _fits(item, schema["contains"], scope)), f"{where}: no item is as required"))
    return checks + _size_checks(is_array, F.size(elements), schema, ("minItems", "maxItems"), where)


def item_schema(schema: dict) -> dict:
    """Schema of one record when the stored schema describes an array of them."""
    kinds = schema.get("type")
    kinds = kinds if isinstance(kinds, list) else [kinds]
    if "array" in kinds or "items" in schema:
        items = schema.get("items")
        if not isinstance(items, dict):
            return {}
        definitions = {k: schema[k] for k in ("definitions", "$defs") if k in schema}
        return {**items, **definitions}
    return schema


def record_errors(df: DataFrame, col: str, schema: dict, index_col: str) -> DataFrame:
    """Every violation as ``(index, message)``; unreadable text is one violation."""
    return _violations(df.select(F.col(index_col).alias("index"), F.try_parse_json(F.col(col)).alias("_doc")), schema)


def file_errors(spark: SparkSession, path: str, schema: dict, json_lines: bool = False) -> DataFrame:
    """``record_errors`` of JSON files, with each one's ``file``; items of a file are numbered from 0."""
    if not json_lines:
        raw = spark.read.option("singleVariantColumn", "_doc").json(path, multiLine=True).select("_doc", F.col("_metadata.file_path").alias("file"))
        elements = F.try_variant_get("_doc", "$", "array<variant>")
        return _violations(raw.select("file", F.posexplode(F.coalesce(elements, F.array("_doc"))).alias("index", "_doc")), schema)
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # A line's number: its place in its block of the file, and the lines of the blocks before (one row per block).
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("lines"))
    earlier = F.sum("lines").over(Window.partitionBy("file").orderBy("block")) - F.col("lines")
    numbered = lines.join(blocks.select("file", "block", "first", earlier.alias("earlier")), ["file", "block"])
    documents = numbered.filter(F.trim("value") != "").select(
        "file", (F.col("at") - F.col("first") + F.col("earlier")).alias("index"), F.try_parse_json("value").alias("_doc"))
    return _violations(documents, schema)


def _violations(documents: DataFrame, schema: dict) -> DataFrame:
    errors = F.when(F.col("_doc").isNull(), F.array(F.lit("$: not valid JSON"))).otherwise(
        validation_errors(F.col("_doc"), item_schema(schema))
    )
    kept = [c for c in documents.columns if c != "_doc"]
    return documents.select(*kept, F.posexplode(errors).alias("pos", "_error")).select(
        *kept, "pos",
        F.concat(F.lit("Item "), F.col("index").cast("string"), F.lit(": "), F.col("_error")).alias("message"),
    )


def validate_records(
    df: DataFrame, col: str, schema: dict, index_col: str, max_errors: int = MAX_ERRORS
) -> DataFrame:
    """The first ``max_errors`` violations in record order (a reporting limit); ``record_errors`` has them all."""
    limit = max_errors if max_errors > 0 else MAX_ERRORS
    return record_errors(df, col, schema, index_col).orderBy("index", "pos").limit(limit)


def validation_summary(
    df: DataFrame, col: str, schema: dict, index_col: str, max_errors: int = MAX_ERRORS
) -> dict:
    """``valid``, ``count`` of reported errors, ``truncated`` when there are more."""
    limit = max_errors if max_errors > 0 else MAX_ERRORS
    found = validate_records(df, col, schema, index_col, limit + 1).count()
    return {"valid": found == 0, "count": min(found, limit), "truncated": found > limit}
