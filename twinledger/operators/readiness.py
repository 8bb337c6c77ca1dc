"""Is a saved mapping runnable: members checked against stored schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinledger.functions.values import norm_text
from twinledger.operators.jsonschema import member_path, path_in_schema, schema_paths


def mapping_readiness(members: DataFrame, schemas: DataFrame, tenant: str | None) -> DataFrame:
    """One row per problem: ``(member_id, issue)``; a ready member has none.

    ``members``: ``member_id, system_label, schema_name, id_expression``.
    ``schemas``: ``schema_name`` (unique), ``companyUserGroupId, schema_text``.
    """
    saved = schemas.select(
        F.col("schema_name"), F.col("companyUserGroupId").alias("_owner"),
        norm_text(F.col("schema_text"), True).alias("_text"), F.lit(True).alias("_saved"),
    )
    asked = members.select(
        "member_id", "system_label",
        norm_text(F.col("schema_name"), True).alias("schema_name"),
        norm_text(F.col("id_expression"), True).alias("id_expression"),
    )
    paths = schema_paths(schemas.select("schema_name", "schema_text"), "schema_name")
    checked = path_in_schema(asked, paths, "member_id", "schema_name", "id_expression")
    row = checked.join(saved, "schema_name", "left")

    label, name = F.col("system_label"), F.col("schema_name")
    active = (tenant or "").strip()
    owned = F.coalesce(F.col("_owner") == F.lit(active), F.lit(False)) if active else F.lit(False)
    shown = member_path(F.coalesce("id_expression", F.lit("")))

    def issue(*parts) -> Column:
        return F.concat(label, *[F.lit(p) if isinstance(p, str) else p for p in parts])

    schema_issue = (
        F.when(name.isNull(), issue(" is missing a saved schema."))
        .when(F.col("_saved").isNull(), issue(" schema '", name, "' is not saved."))
        .when(~owned, issue(" schema '", name, "' is not available in your active tenant."))
        .when(F.col("_text").isNull(), issue(" schema '", name, "' does not contain schema text."))
        .when(
            ~F.col("in_schema"),
            issue(" id field '", F.coalesce(shown, F.lit("null")), "' is not present in schema '", name, "'."),
        )
    )
    id_issue = F.when(F.col("id_expression").isNull(), issue(" is missing an id field expression."))
    return row.select("member_id", F.explode(F.array(id_issue, schema_issue)).alias("issue")).filter(
        F.col("issue").isNotNull()
    )
