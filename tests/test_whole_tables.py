"""Queries cover their whole tables."""

import inspect

import pytest
from pyspark.sql import functions as F

from tidemark.operators import learning as L
from tidemark.plans import catalog
from tidemark.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_every_label_is_left_out_once(spark):
    got = {r.group: r.n for r in catalog.QUERIES["logreg_leave_one_out"](spark, SF).collect()}
    want = {r.label: r.n for r in table(spark, SF, "embeddings").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_every_vector_asks_for_its_similar_ones(spark):
    """Only keys that 100 divides were queries."""
    got = catalog.QUERIES["pair_similarity"](spark, SF).groupBy("query").count().collect()
    assert {r.query: r["count"] for r in got} == {r.vec_id: 3 for r in table(spark, SF, "embeddings").select("vec_id").collect()}


def test_starts_and_rounds_are_the_reference_s():
    assert inspect.signature(L.clusters).parameters["starts"].default == 10
    assert inspect.signature(L.classifier).parameters["rounds"].default == 1000


@pytest.mark.parametrize("name", ["middle_item", "roi_filter"])
def test_no_key_becomes_one_array(spark, name):
    assert "collect_list" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()


@pytest.mark.parametrize(("stream", "plain", "name"), [("stream_foreground", "foreground", "embeddings"), ("stream_interpolation", "interp_join", "events"), ("stream_segments", "segments", "events")])
def test_streams_read_tables_of_many_unordered_files(spark, tmp_path, stream, plain, name):
    """A table that is a folder was found by no stream; files beyond the first eight came late."""
    sf = str(tmp_path)
    table(spark, SF, name).repartition(11).write.parquet(f"{sf}/{name}.parquet")
    one, two = (catalog.QUERIES[q](spark, sf) for q in (plain, stream))
    one, two = (sorted(map(tuple, d.select(*two.columns).collect()), key=repr) for d in (one, two))
    assert len(one) > 100 and one == two
