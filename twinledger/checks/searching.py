"""Keyword search and the cycle check."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinledger.checks import tables as t
from twinledger.checks.registry import query
from twinledger.operators.graph import bom_cycle_split
from twinledger.operators.search import relevance_search


def _norm(expression: str) -> str:
    return f"trim(regexp_replace(lower(trim({expression})), '[^a-z0-9]+', ' ', 'g'))"


_SCORE_SQL = f"""WITH n AS (SELECT doc_id, {_norm("source")} AS l, {_norm("lang")} AS d, {_norm("source || ' ' || lang")} AS a, {_norm("text")} AS c FROM documents),
s AS (SELECT doc_id, c, l, d,
  CASE WHEN l = 'show src1 the en' THEN 160 ELSE 0 END + CASE WHEN contains(l, 'show src1 the en') THEN 100 ELSE 0 END
  + CASE WHEN contains(d, 'show src1 the en') THEN 55 ELSE 0 END + CASE WHEN contains(a, 'show src1 the en') THEN 35 ELSE 0 END
  + CASE WHEN contains(c, 'show src1 the en') THEN 45 ELSE 0 END
  + (SELECT sum(CASE WHEN contains(l, w) THEN 30 ELSE 0 END + CASE WHEN contains(d, w) THEN 16 ELSE 0 END
       + CASE WHEN contains(c, w) THEN 14 ELSE 0 END + CASE WHEN contains(a, w) THEN 8 ELSE 0 END)
     FROM (VALUES ('show'), ('src1'), ('the'), ('en')) v(w))
  + CASE WHEN contains(l, 'src1') OR contains(c, 'src1') THEN 20 ELSE 0 END
  + CASE WHEN contains(l, 'en') OR contains(c, 'en') THEN 20 ELSE 0 END AS score
  FROM n)
SELECT doc_id, CAST(score AS INTEGER) AS score FROM s
WHERE score > 0 AND (contains(c, 'src1') OR contains(l, 'src1') OR contains(d, 'src1') OR contains(c, 'en') OR contains(l, 'en') OR contains(d, 'en'))"""


def _documents(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").withColumn("alias", F.concat_ws(" ", "source", "lang"))


@query("relevance_search", _SCORE_SQL)
def relevance(spark, sf_dir):
    return relevance_search(
        _documents(spark, sf_dir), "Show src1, the EN!", "source", "lang", "alias", "text", None, "doc_id", size=None
    ).select("doc_id", "score")


@query("relevance_search_page", f"""SELECT x.doc_id, x.score FROM ({_SCORE_SQL}) x JOIN documents USING (doc_id)
ORDER BY x.score DESC, source, doc_id LIMIT 20 OFFSET 20""")
def relevance_page(spark, sf_dir):
    return relevance_search(
        _documents(spark, sf_dir), "Show src1, the EN!", "source", "lang", "alias", "text", None, "doc_id", page=1
    ).select("doc_id", "score")


def _bom(spark, sf_dir):
    """Every part names one component in its own block of eight, so cycles of all small sizes occur."""
    part = t.table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return part.select(
        F.concat(F.lit("P"), key.cast("string")).alias("product-sku"),
        F.when(F.col("p_brand") != "Brand#3", F.concat(
            F.lit("P"), (key - key % 8 + F.col("p_size") % 8).cast("string"))).alias("product-sku-to"),
        F.when(F.col("p_type") == "PROMO", "PRODUCT_ACCESSORY").otherwise("PRODUCT_COMPONENT").alias("assoc"),
    )


_BOM_SQL = """WITH RECURSIVE e AS (
  SELECT 'P' || p_partkey AS src, 'P' || (p_partkey - p_partkey % 8 + p_size % 8) AS dst FROM part
  WHERE p_brand <> 'Brand#3' AND p_type <> 'PROMO'),
r(src, dst, path, n) AS (SELECT src, dst, src || ' -> ' || dst, 1 FROM e
  UNION ALL SELECT r.src, e.dst, r.path || ' -> ' || e.dst, n + 1 FROM r JOIN e ON r.dst = e.src WHERE r.src <> r.dst AND n < 9),
c AS (SELECT src, path FROM r WHERE src = dst AND path <> src || ' -> ' || src),
m AS (SELECT c1.src, min(c2.src) AS first FROM c c1 JOIN r ON r.src = c1.src JOIN c c2 ON c2.src = r.dst GROUP BY c1.src),
g AS (SELECT m.first, string_agg(m.src, ', ' ORDER BY m.src) AS names FROM m GROUP BY m.first),
x AS (SELECT e.src, e.dst, CASE WHEN e.src = e.dst THEN 'Self relationship on ' || e.src
          WHEN m.first IS NOT NULL THEN 'Cycle among ' || g.names || ' (path: ' || c.path || ')' END AS text
      FROM e LEFT JOIN m ON m.src = e.src LEFT JOIN g ON g.first = m.first LEFT JOIN c ON c.src = m.first)"""


@query("bom_cycle_split", _BOM_SQL + """
SELECT src AS parent, dst AS component, CASE WHEN text IS NULL THEN 'importable' ELSE 'problem' END AS output,
       CASE WHEN text IS NULL THEN NULL WHEN src = dst THEN 'Self relationship' ELSE 'Cyclic relationship' END AS error_reason,
       text AS cycle_description FROM x""")
def bom(spark, sf_dir):
    split = bom_cycle_split(_bom(spark, sf_dir), assoc_col="assoc", assoc_type="PRODUCT_COMPONENT")
    null = F.lit(None).cast("string")
    ends = [F.col("`product-sku`").alias("parent"), F.col("`product-sku-to`").alias("component")]
    fine = split.importable.select(*ends, F.lit("importable").alias("output"), null.alias("error_reason"),
                                   null.alias("cycle_description"))
    return fine.union(split.problems.select(*ends, F.lit("problem"), "error_reason", "cycle_description"))


@query("bom_cycle_counts", _BOM_SQL + """
SELECT (SELECT count(*) FROM part) AS "totalRowCount", count(*) FILTER (text IS NULL) AS "importableRowCount",
       count(*) FILTER (text IS NOT NULL) AS "problemRowCount",
       (SELECT count(*) FROM part) - count(*) AS "skippedRowCount",
       count(DISTINCT text) AS "cycleCount" FROM x""")
def bom_counts(spark, sf_dir):
    counts = bom_cycle_split(_bom(spark, sf_dir), assoc_col="assoc", assoc_type="PRODUCT_COMPONENT").counts
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"`{k}` bigint" for k in counts))


@query("bom_cycle_paths", _BOM_SQL + """,
w AS (SELECT src AS cycle, string_split(path, ' -> ') AS p FROM c WHERE src IN (SELECT first FROM m)
  UNION ALL SELECT DISTINCT src, [src] || [src] FROM e WHERE src = dst AND src NOT IN (SELECT src FROM m))
SELECT cycle, unnest(range(0, len(p) - 1)) AS step, unnest(p[1:-2]) AS node FROM w""")
def bom_paths(spark, sf_dir):
    return bom_cycle_split(_bom(spark, sf_dir), assoc_col="assoc", assoc_type="PRODUCT_COMPONENT").paths
