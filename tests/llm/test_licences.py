"""Licence scans: sentences, order, SQL."""

import duckdb
import pytest

import verify
from llm import licences
from llm.queries import ORACLE

MIT = licences.SENTENCES


def scan(spark, *texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, licence string")
    return [r.licences for r in licences.scan(docs).orderBy("doc_id").collect()]


def test_sentences_and_order(spark):
    grant, notice, as_is = (MIT[k] for k in ("mit-grant", "mit-notice", "mit-as-is"))
    wrapped = notice.replace("permission notice", "permission\n  notice")
    assert scan(
        spark, None, "", "no licence here. at all", "Words.\nReleased under the MIT License.", "RELEASED  under the mit license!",
        f"{grant}\n\n{wrapped}\n\n{as_is}", f"{notice} {grant}", f"{as_is}", "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "x " * 100_000 + ". Licensed under CC BY 4.0.",
    ) == [[], [], [], ["MIT"], ["MIT"], ["MIT"], [], [], ["Apache-2.0", "CC-BY-NC-4.0"], ["CC-BY-4.0"]]


def test_comments_and_long_gaps(spark):
    lines = lambda mark: f"\n{mark}\n".join(f"{mark} " + MIT[k].replace(", ", f",\n{mark} ") for k in ("mit-title", "mit-grant", "mit-notice"))
    gap = MIT["gpl-free"].replace("free software", "free" + " " * 5000 + "software") + "\n\n" + MIT["gpl-hope"]
    assert scan(spark, f"/*\n{lines(' *')}\n */\nint x;", lines("#"), lines("//"), gap) == [["MIT"], ["MIT"], ["MIT"], ["GPL-3.0-or-later"]]


def test_names(spark):
    docs = spark.createDataFrame([("Known words here.", "mine", "own")], "text string, licences string, sentence_ids string")
    got = licences.scan(docs, sentences={"a_b": "Known words here.", "axb": "Other words."}, rules=[("X", ["a_b"]), ("Y", ["axb"]), ("Z", ["axb", "a_b"])])
    assert got.first().asDict() == {"text": "Known words here.", "licences": "mine", "sentence_ids": "own", "sentence_ids_": ["a_b"], "licences_": ["X"]}
    only = licences.scan(docs.select(docs.text.alias("t")), "t", sentences={"a_b": "Other words.", "axb": "Known words here."}, rules=[("X", ["a_b"])])
    assert only.first().licences == []


def test_unknown_sentence_is_an_error(edge):
    with pytest.raises(ValueError, match="unknown sentence"):
        licences.scan(edge, rules=[("X", ["nothing"])])


def test_edges(edge, nothing):
    got = licences.scan(edge)
    assert got.count() == edge.count() and got.columns[: len(edge.columns)] == edge.columns and licences.scan(nothing).count() == 0


def test_plan_is_native(sample):
    plan = licences.scan(sample)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_agree_with_sql(spark, sample, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{table}.parquet')")
    report = verify.compare(spark, con, name, "/root/testdata/sf0.001")
    assert report.startswith("ok"), report


def test_every_sentence_and_rule_fires_on_its_real_text(spark):
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(MIT.values())], "doc_id int, text string")
    assert [r.sentence_ids for r in licences.scan(docs).orderBy("doc_id").collect()] == [[n] for n in MIT]
    for got, (licence, _) in zip(scan(spark, *["\n\n".join(MIT[n] for n in needed) for _, needed in licences.RULES]), licences.RULES, strict=True):
        assert licence in got


def test_standard_files(spark):
    wrapped = lambda k: MIT[k].replace(", ", ",\n")
    mit = f"MIT License\n\nCopyright (c) 2024 Name\n\n{wrapped('mit-grant')}\n\n{wrapped('mit-notice')}"
    gpl = f"A program\n\n{MIT['gpl-free'].replace(' and', chr(10) + 'and')}\n\n{MIT['gpl-hope']}"
    assert scan(spark, mit, gpl, "// code\n// SPDX-License-Identifier: Apache-2.0\n\nint main;", "SPDX-License-Identifier: none") == [
        ["MIT"], ["GPL-3.0-or-later"], ["Apache-2.0"], []]
