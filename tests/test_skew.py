"""Hot keys take another way to the same result."""

from pyspark.sql import functions as F

from twinledger.operators import compare as C
from twinledger.operators import skew
from twinledger.operators.graph import bom_cycle_split
from twinledger.plans.reconcile import reconcile_ids, reconcile_unified


def side(spark, ids):
    return spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "compare_id string, n long").select(
        "compare_id", F.struct("n").alias("data"))


LEFT = ["hot"] * 60 + ["both"] * 40 + ["a", "b", "b", "c"]
RIGHT = ["both"] * 3 + ["c", "d", "cold"] + ["warm"] * 50


def test_hot_ids_keep_every_record(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    rows = [reconcile_unified(side(spark, LEFT), side(spark, RIGHT), "L", "R", hot_rows=n).diffs for n in (5, 10**6)]
    first, second = (sorted(map(tuple, r.collect())) for r in rows)
    assert first == second and len(first) == 60 + 3 + 52
    plan = rows[0]._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan or "broadcast" in plan


def test_totals_count_ids_and_rows(spark):
    s = reconcile_unified(side(spark, LEFT), side(spark, RIGHT)).summary
    assert s == {"totalDifferences": 6, "onlyInFile1Count": 3, "onlyInFile2Count": 3, "rowCount": 115}


def test_swapping_sides_swaps_counts(spark):
    a, b = side(spark, LEFT), side(spark, RIGHT)
    one, two = reconcile_ids(a, b).summary, reconcile_ids(b, a).summary
    assert one["onlyInDf1Count"] == two["onlyInDf2Count"] and one["differenceCount"] == two["differenceCount"]
    assert reconcile_ids(a, a).summary["differenceCount"] == 0
    ids = C.presence(a, b)
    assert C.matched_ids(a, b).count() + C.only_in_left(a, b).count() == ids.filter("n_left > 0").count()


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "`product-sku` string, `product-sku-to` string")


BOM = [("A", "A"), ("B", "C"), ("C", "B"), ("D", "E"), ("E", "F"), ("F", "D"), ("X", "Y"), ("Y", "D"), ("F", "Z"),
       (None, "Q"), ("Q", " "), ("D", "E")]


def test_bom_split(spark):
    split = bom_cycle_split(edges(spark, BOM))
    problems = sorted((r[0], r[1], r["cycle_description"]) for r in split.problems.collect())
    pair, ring = "Cycle among B, C (path: B -> C -> B)", "Cycle among D, E, F (path: D -> E -> F -> D)"
    assert problems == [("A", "A", "Self relationship on A"), ("B", "C", pair), ("C", "B", pair), ("D", "E", ring), ("D", "E", ring),
                        ("E", "F", ring), ("F", "D", ring)]
    assert sorted(map(tuple, split.importable.collect())) == [("F", "Z"), ("X", "Y"), ("Y", "D")]
    assert split.counts == {"totalRowCount": 12, "importableRowCount": 3, "problemRowCount": 7, "skippedRowCount": 2,
                            "cycleCount": 3}
    assert sorted(map(tuple, split.groups.collect())) == [
        ("A", "A"), ("B", "B"), ("C", "B"), ("D", "D"), ("E", "D"), ("F", "D")]


def test_bom_with_hot_nodes_and_large_cycles(spark):
    star = [("hub", f"n{i}") for i in range(30)] + [(f"n{i}", "hub") for i in range(15)]
    plain = bom_cycle_split(edges(spark, star + BOM))
    hot = bom_cycle_split(edges(spark, star + BOM), hot_rows=4)
    assert plain.counts == hot.counts and hot.counts["problemRowCount"] == 37
    assert sorted(map(tuple, plain.groups.collect())) == sorted(map(tuple, hot.groups.collect()))
    texts = {r[0] for r in hot.problems.filter("`product-sku` = 'hub'").select("cycle_description").collect()}
    names = ", ".join(sorted(["hub", *(f"n{i}" for i in range(15))]))
    assert texts == {f"Cycle among {names} (path: hub -> n0 -> hub)"}
    short = bom_cycle_split(edges(spark, star + BOM), spelled=3).problems.select("cycle_description").distinct().collect()
    assert {r[0] for r in short} == {"Cycle among 16 nodes, first hub", "Self relationship on A", "Cycle among B, C (path: B -> C -> B)",
                                     "Cycle among D, E, F (path: D -> E -> F -> D)"}


def test_large_and_small_missing_sets_agree(spark, monkeypatch):
    from twinledger.model import CompareScope, Rule, SideConfig
    from twinledger.plans.reconcile import reconcile_ruleset

    rule = Rule("N", 1, "FIELD_COMPARISON", expression={"file1FieldPath": "n", "file2FieldPath": "n"})
    scope = CompareScope("S", SideConfig("id", label="L"), SideConfig("id", label="R"), rules=(rule,))
    a, b = side(spark, "abcdef"), side(spark, "xbcyfz")
    small = reconcile_ruleset(a, b, scope)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    large = reconcile_ruleset(a, b, scope)
    rows = [sorted(map(str, r.diffs.collect())) for r in (small, large)]
    assert small.small and not large.small
    assert rows[0] == rows[1] and len(rows[0]) == 6 + 1
    assert small.summary == large.summary and small.summary["differenceCount"] == 7


def test_unlinked_executions_do_not_share_a_key(spark):
    from twinledger.operators.history import execution_history_enrich

    executions = spark.createDataFrame([("e1", "r1", None, None), ("e2", None, None, None), ("e3", "r1", "own/x.json", None),
                                        ("e4", "r9", " ", "kept.json"), ("e5", "r2", "a", "b")],
                                       "id string, reconciliationRunResultId string, resultDataManagerPath string, resultFileName string")
    results = spark.createDataFrame([("r1", "runs/r1/out.json"), ("r2", "runs\\r2")],
                                    "reconciliationRunResultId string, resultDataManagerPath string")
    found = {r["id"]: (r["resultDataManagerPath"], r["resultFileName"]) for r in execution_history_enrich(executions, results).collect()}
    assert found == {"e1": ("runs/r1/out.json", "out.json"), "e2": (None, None), "e3": ("own/x.json", "out.json"),
                     "e4": (None, "kept.json"), "e5": ("a", "b")}


def test_missing_rows_are_joined_over_all_partitions(spark):
    """Merged by size, a task held all ids of that size in sorts and hash tables."""
    a, b = side(spark, LEFT + [None]), side(spark, RIGHT + [None])
    ids = C.presence(a.select("compare_id"), b.select("compare_id"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = C.missing_on_both_sides(a, b, ids, "L", "R")
        assert rows.rdd.getNumPartitions() >= 16
        assert sorted((r.id, r.type) for r in rows.collect()) == sorted(
            [("hot", "MISSING_IN_FILE_2")] * 60 + [("a", "MISSING_IN_FILE_2")] + [("b", "MISSING_IN_FILE_2")] * 2
            + [("d", "MISSING_IN_FILE_1"), ("cold", "MISSING_IN_FILE_1")] + [("warm", "MISSING_IN_FILE_1")] * 50)
        repeated = spark.createDataFrame([("a",), ("a",)], "compare_id string")
        assert C.missing_diff_rows(a, repeated, "M", "L", "R", C.hot_ids(ids)).count() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
