"""Near-duplicate stage: rows as documents, clashing names; hot keys of joins back."""

from pyspark.sql import functions as F

from tidelog.llm import common, simhash


def test_rows_with_one_id_are_documents_of_their_own(spark):
    texts = [(4, "ß é 漢字"), (4, "other text"), (4, "other text"), (None, "alone"), (None, None), (None, "alone"), (7, "alone"), (1, ""), (2, None)]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in texts], "doc_id long, text string, kept_id int, kept_hash string")
    got = simhash.keep_one(docs, by_row=True)
    assert got.columns == docs.columns
    # One row for each different text: the smallest id, a null one last; empty and null texts are one group.
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [("1", ""), ("4", "other text"), ("4", "ß é 漢字"), ("7", "alone")]
    assert simhash.keep_one(docs.limit(0), by_row=True).count() == 0


def test_join_back_splits_hot_keys(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, -1)], "k long, id long"))
    table = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = common.join_back(rows, table, "k", counts)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(table, "k").collect()))
