"""Small tables on which the queries of the fourth round's findings failed."""

from pyspark.sql import functions as F

from quillon.llm import pii
from quillon.operators import filters as X
from quillon.operators import postings as P
from quillon.operators import text as T
from quillon.plans import QUERIES
from quillon.sources import readers as R

c = F.col


def test_exported_csv_tells_empty_text_from_null(spark, tmp_path):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, " "), (4, '"\n'), (5, "a")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, QUERIES["src_14_export_csv"](spark, str(tmp_path)).collect())) == [(1, ""), (2, None), (3, " "), (4, "  "), (5, "a")]
    odd = [(1, "\\N"), (2, "\\\\N"), (3, "\\"), (4, "x\\N"), (5, None), (None, "\\Nx"), (6, 'a"b')]
    R.export_rows(spark.createDataFrame(odd, "doc_id long, text string"), f"{tmp_path}/out", "csv")
    assert sorted(map(tuple, R.read_exported(spark, f"{tmp_path}/out", "doc_id long, text string").collect()), key=str) == sorted(odd, key=str)


def test_questions_meet_documents_where_they_are_read(spark):
    docs = spark.createDataFrame([(1, "SOLARpanel"), (1, "SOLARpanel"), (None, "x" * 300 + "windmill" + "y" * 70), (3, None), (4, "")], "doc_id long, text string")
    questions = spark.createDataFrame([("a", "solar panels"), ("b", "of the"), ("c", "windmill wind?"), ("d", None)], "item_id string, text string")
    found = X.matching_questions(docs, questions)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "a"), (1, "a"), (1, "b"), (1, "b"), (None, "b"), (None, "c"), (3, "b"), (4, "b")], key=str)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # nothing of the documents is shuffled


def test_postings_are_made_where_texts_lie_and_read_by_the_rarest_word(spark, tmp_path):
    docs = spark.range(3000).select(c("id").alias("doc_id"), F.concat(F.lit("common word "), F.when(c("id") % 500 == 7, "rare ").otherwise(""), F.repeat(F.lit("tail "), (c("id") % 3).cast("int"))).alias("text"))
    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    words = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,)], "t array<string>")
    assert [r.n and [tuple(x) for x in r.n] for r in words.select(P._counted(c("t")).alias("n")).collect()] == [[("a", 1), ("b", 2)], None, None]
    written, plans = P.written, {}
    P.written = lambda df, name: plans.setdefault(name, text(df)) and written(df, name)
    try:
        for state in (docs.withColumn("text", F.concat("text", F.lit("old"))), docs):
            P.sync_postings(state, f"{tmp_path}/index", part_docs=100)
        asked = spark.createDataFrame([(1, "common rare"), (2, "common word"), (3, "common absent")], "query_id long, text string")
        found, blocks = P.search_postings(spark, f"{tmp_path}/index", asked)
        assert sorted(tuple(r) for r in found.select("query_id", "doc_id", "rank").collect()) == sorted(tuple(r) for r in T.bm25(docs, asked).select("query_id", "doc_id", "rank").collect())
    finally:
        P.written = written
    assert "gone" in plans["query-terms"] and "explode(ids" not in plans["query-terms"]  # lists are not taken apart to count the dead
    assert "array_contains(few" in plans["early-scores"]
    places = spark.read.parquet(f"{tmp_path}/index/postings").where("term = 'rare' and gen = 2").count()
    assert {r.query_id: r.read for r in blocks.collect()}[1] <= 2 * places * 2


def test_trees_learn_from_every_span_of_every_document(spark):
    text = "a " + " b ".join(f"user{i}.x@mail{i}.example.com" for i in range(5))
    rows = spark.createDataFrame([(1, text)], "h long, text string").withColumn("base", pii.base_spans(c("text"), "email"))
    one = spark.createDataFrame([(1, text[: text.index(" b ")])], "h long, text string").withColumn("base", pii.base_spans(c("text"), "email"))
    per_span = pii.examples(one).where("label = 1 and at = 1").count()
    assert per_span > 0 and pii.examples(rows).where("label = 1 and at = 1").count() >= 5 * per_span
    many = spark.range(400).select(c("id").alias("doc_id"), F.concat(F.lit("write to user"), "id", F.lit(".x@mail.example.com now")).alias("text"))
    many = many.withColumn("base", pii.base_spans(c("text"), "email"))
    assert pii.fit(many, 1_000_000_000)[0] is not None  # a large table is not thinned out
