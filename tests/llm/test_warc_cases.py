"""WARC: odd ids, repeated rows, a payload that very many pages share, read tasks, and the plan of small groups."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import simhash, warc


def test_null_ids_repeated_rows_and_string_ids(spark):
    rows = [(None, "u", "same"), (None, "u", "same"), (3, "u", "same"), (3, "v", "same"), (1, "u", "same"), (None, "u", "lone")]
    for kind, of in (("long", lambda x: x), ("string", lambda x: None if x is None else f"p{x}")):
        pages = spark.createDataFrame([(of(i), u, h, 1) for i, u, h in rows], f"page_id {kind}, url string, html string, offset int")
        got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.read(warc.write(warc.plan_records(pages))).collect())
        assert got == Counter({(of(3), "response", None): 2, (None, "revisit", of(3)): 2, (of(1), "revisit", of(3)): 1, (None, "response", None): 1})


def test_one_payload_of_many_pages_and_several_read_tasks(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.when(F.col("id") % 3 > 0, "x" * 50).otherwise(F.md5(F.col("id").cast("string"))).alias("html")).repartition(4)
    index = warc.write(warc.plan_records(pages))
    read = warc.read(index, stretch=1 << 17)
    assert read.rdd.getNumPartitions() == -(-index.agg(F.sum("length")).first()[0] // (1 << 17)) > 3
    assert {(r.record_type, r["count"]) for r in read.groupBy("record_type").count().collect()} == {("response", 1001), ("revisit", 1999)}
    assert {r[0] for r in read.where("record_type = 'revisit'").select("refers_to").distinct().collect()} == {2999}


def test_pages_are_not_shuffled_for_small_groups(spark):
    pages = spark.createDataFrame([(i, "u", "same" if i < 4 else f"p{i}") for i in range(50)], "page_id long, url string, html string")
    plan = warc.plan_records(pages)
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()


def test_unfinished_components_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    with pytest.raises(RuntimeError, match="rounds"):
        simhash.components(chain, rounds=1)
    assert {r.root for r in simhash.components(chain).collect()} == {0}
