"""Language mixtures: held-out accuracy, several languages, edges."""

from pyspark.sql import functions as F

from llm import language


def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, language.train(language.training_rows(docs))


def test_held_out_accuracy(spark):
    docs, model = learned(spark)
    told = language.identify(docs, model, keep=["doc_id", "lang"]).where(language.held_out(F.col("doc_id"))).collect()
    assert len(told) > 100 and sum(r.lang == r.lang_pred for r in told) > 0.97 * len(told)
    assert all(0 <= r.score <= 1 for r in told)


def test_mixture_of_two_languages(spark):
    docs, model = learned(spark)
    text = {r.lang: r.text for r in docs.where("n_chars between 1500 and 3000").groupBy("lang").agg(F.max("text").alias("text")).collect()}
    two = spark.createDataFrame([(1, text["de"][:1500] + text["es"][:900])], "doc_id long, text string")
    got = language.identify(two, model).first()
    assert got.lang_pred == "de" and set(got.languages) == {"de", "es"} and 0.45 < got.score < 0.8


def test_edges(spark, edge, nothing):
    _, model = learned(spark)
    names = ("told", "share", "found")
    for r in language.identify(edge, model, names=names).collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.told == "und") == (not letters) and (r.share > 0) == letters and bool(r.found) == letters
    assert language.identify(nothing, model).count() == 0
    odd = spark.createDataFrame([(1, "12 34 %%"), (2, "x"), (3, None)], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language.identify(odd, model).orderBy("doc_id").collect()] == [True, False, True]


def test_nothing_to_learn_from(spark, edge):
    blank = edge.withColumn("lang", F.lit(None).cast("string"))
    model = language.train(language.training_rows(blank))
    assert {r.told for r in language.identify(blank, model, names=("told", "share", "found")).collect()} == {"und"}
    assert language.keep_known(blank).count() == blank.count()


def test_stage_drops_only_what_has_no_language(spark):
    docs, _ = learned(spark)
    odd = spark.createDataFrame([(-1, "12 34", "en", "s", 5), (-2, None, None, "s", 0)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    got = language.keep_known(docs.unionByName(odd))
    assert got.schema == docs.schema and got.count() == docs.count() and got.where("doc_id < 0").count() == 0
