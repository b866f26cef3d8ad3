"""URL rules, WARC, main text, quality rules, toxicity and the pipeline."""

import base64
import hashlib
import importlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, quality, queries, site_style, toxicity, url_rules, warc

SMALL = "/root/testdata/sf0.001"
URLS = [
    None, "", "no scheme", "http://a.ORG/x", "https://example.org/es/1?q#f", "http://sub.Example.org/en/12", "http://example.org/en/2", "ftp://de.com/de/x", "http://x.com/fr/", "http://com/fr/a",
    "http://notorg/", "http://org", "http://org/", "http://x.com?u=http://y.org/", "http://evil.com#/fr/", "a://b.org/://c.com/de/", "http://x.com/FR/", "http://.org/", "http://x.com/de/\nmore",
]


def brute_rule(url, rules, default="allow"):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, default))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_url_rules_by_one_cascade_and_by_shards(spark, limit):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[:5])] + [(None, "http://a.org/", "y")], "page_id long, url string, rule string")
    nulls = [(None, "/", "block"), ("org", None, "block"), ("org", "/", None), ("org", "/x", "maybe")]
    rules = spark.createDataFrame(queries.URL_RULES + nulls, "host string, path string, verdict string")
    got = url_rules.judge(pages, rules, max_filter_bytes=limit).select("page_id", "host", "path", "rule", "verdict").collect()
    want = [(r.page_id, *brute_rule(r.url, queries.URL_RULES)) for r in pages.collect()]
    assert Counter(map(tuple, got)) == Counter(want)


def test_url_rules_of_a_long_list_and_of_none(spark):
    rules = [(f"h{i}.net", f"/p{i % 7}/", "block" if i % 3 else "allow") for i in range(400)]
    urls = [f"http://w.h{i}.net/p{i % 5}/x" for i in range(900)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), bits_per_key=2).collect()
    assert Counter((r.page_id, r.rule, r.verdict) for r in got) == Counter((i, *brute_rule(u, rules)[2:]) for i, u in enumerate(urls))
    none = url_rules.judge(pages, spark.createDataFrame([], "host string, path string, verdict string"))
    assert none.where("rule IS NULL AND verdict = 'allow'").count() == 900
    assert url_rules.judge(pages.limit(0), spark.createDataFrame(rules[:3], "host string, path string, verdict string")).count() == 0


def test_warc_round_trip_and_selection(spark):
    html = ["<p>one</p>", "", None, "<p>one</p>", "two\r\n\r\nlines", "<p>one</p>", "ü🙂", ""]
    pages = spark.createDataFrame([(i, f"http://a.b/{i}", h, 1) for i, h in enumerate(html)] + [(8, None, "x" * 200_000, 1)], "page_id long, url string, html string, digest int")
    index = warc.write(warc.plan_records(pages))
    rows = {r.page_id: r for r in warc.read(index).collect()}
    source = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    last = {}
    for k, v in source.items():
        last[v] = max(k, last.get(v, -1))
    for k, v in source.items():
        r, keeper = rows[k], last[v]
        assert (r.payload_bytes, r.payload_digest) == (len(v), base64.b32encode(hashlib.sha1(v).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if keeper == k else ("revisit", keeper))
        assert r.payload == (v if keeper == k else None)
    some = warc.read(index.where("page_id IN (4, 8)"), gap=0).collect()
    assert {r.page_id for r in some} == {4, 8}
    assert warc.read(warc.write(warc.plan_records(pages.limit(0)))).count() == 0


def test_ranges_share_reads():
    assert warc.ranges([(0, 10), (10, 5), (40, 5), (400, 90)], 30, 100) == [(0, 0, 45), (3, 400, 90)]


PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li>Home</li></ul></nav><div class="ad">Buy {n}</div>
<article><h1>Head&amp;line {n}</h1><p>First  <b>bold</b> text {n}<br>goes on<p>Second &lt;p&gt; {n}</p><script>x("</p>")</script><section class="comments"><p>Nice {n}</p></section></article>
<div class="box">Always the same words</div><footer>&copy; {n}</footer></body></html>"""


def test_main_text_of_one_page():
    assert site_style.main_text(PAGE.format(n=7)) == "Head&line 7\nFirst bold text 7 goes on\nSecond <p> 7"
    assert site_style.main_text("") == "" and site_style.main_text("plain words") == "plain words"


def test_style_tree_removes_what_recurs(spark):
    page = "<html><body><div class='story'>Story {n} has words of its own</div><div class='box'>Always the same words</div></body></html>"
    pages = spark.createDataFrame([(i, "http://one.host/", page.format(n=i)) for i in range(20)] + [(90, "http://two.host/", page.format(n=9)), (91, None, None), (92, "", "")], "page_id long, url string, html string")
    by = {r.page_id: r.text for r in site_style.extract(pages).collect()}
    assert by[3] == "Story 3 has words of its own" and by[90] == "Story 9 has words of its own\nAlways the same words"
    assert by[91] == by[92] == ""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    joined = {r.page_id: r.text for r in site_style.extract(pages).collect()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joined == by
    copies = spark.createDataFrame([(i, "http://one.host/", PAGE.format(n=1)) for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in site_style.extract(copies).collect()} == {site_style.main_text(PAGE.format(n=1))}


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    again = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_quality_measures_and_policies(spark):
    texts = [None, "", " \n ", "a b c a b c", "x y z w x y", "line one\nline one\n\nline two\n line one", "# $$$ <b>", "日本 🙂 é\x0b\x0c\x1f q", "word " * 60, " ".join(f"w{i}" for i in range(80)), "long" * 9000]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)] + [(None, "a b c", 5, "x")], "doc_id long, text string, n_words int, fail_bits string")
    got = {r.doc_id: r for r in quality.ledger(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(t or ""), i
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [9]
    parts = {r.rule: (r.failed, r.failed_alone) for r in quality.ablations(quality.ledger(docs)).collect()}
    assert parts["few_words"][0] == 10 and parts["repeated_words"][1] == 1
    assert quality.ledger(docs.limit(0)).count() == 0


def test_quality_needs_no_python(spark):
    docs = common.table(spark, SMALL, "documents")
    plan = quality.filter_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange|Join", plan)


def test_identity_terms_alone_do_not_make_a_text_toxic():
    toxic = [f"you {w} fool muslims are scum {i}" for i, w in enumerate(["stupid", "rotten", "vile"] * 20)]
    clean = [f"we met {w} friends at the harbour {i}" for i, w in enumerate(["old", "good", "new"] * 40)]
    fair = toxicity.fit_texts(toxic + clean, [1] * 60 + [0] * 120, {0: 1.0, 1: 1.0}, fairness=50.0)
    free = toxicity.fit_texts(toxic + clean, [1] * 60 + [0] * 120, {0: 1.0, 1: 1.0}, fairness=0.0)
    assert abs(fair.word_weight("muslims")) < abs(free.word_weight("muslims"))
    assert fair.word_weight("scum") > fair.word_weight("harbour")


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    r = queries.QUERIES["op10_toxicity"](spark, sf).join(common.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    pos, neg = [x.score for x in r if x.toxic], [x.score for x in r if not x.toxic]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.93
    assert all((x.score >= 0.3) == bool(x.predicted) for x in r)


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, "fool " * 5000), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    none = toxicity.fit(docs, labels)
    assert max(r.score for r in toxicity.score(docs, none).collect()) < 1e-12
    one = toxicity.ToxicityModel(math.inf)
    assert {r.predicted for r in toxicity.score(docs, one).collect()} == {1}
    assert toxicity.reject(docs, none).count() == 4 and toxicity.reject(docs, one).count() == 0
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_pipeline_stages_by_brute_force(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = common.table(spark, SMALL, "documents")
    by = dict(pipeline.STAGES)
    calm, _ = common.materialize(by["toxicity"](spark, docs, SMALL), "t")
    assert calm.columns == docs.columns and 0 < calm.count() < docs.count()
    good, _ = common.materialize(by["quality rules"](spark, calm, SMALL), "q")
    passed = {r.doc_id for r in calm.collect() if (lambda m: m[0] >= 50 and 100 * m[4] <= 50 * m[0])(brute_quality(r.text or ""))}
    assert {r.doc_id for r in good.collect()} <= passed
    lone, _ = common.materialize(by["simhash near-dedup"](spark, good, SMALL), "s")
    from .test_near_copies import brute_kept  # the stage takes five words and a similarity of 0.8

    assert {r.doc_id for r in lone.collect()} == brute_kept(sorted((r.doc_id, r.text or "") for r in good.collect()))
    packed = by["packing"](spark, lone, SMALL)
    assert packed.select("doc_id").distinct().count() == lone.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    source = common.table(spark, SMALL, "documents")
    plain = " ".join(f"harbour{k} tide{k}" for k in range(60))
    odd = [(None, plain), (1_000_001, None), (1_000_002, ""), (1_000_003, plain), (1_000_003, plain), (1_000_004, plain + " end"), (1_000_005, " ".join(f"long{k}" for k in range(90_000)))]
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], source.schema)
    docs = source.union(rows).withColumns({"n_words": F.lit("x"), "score": F.lit(1), "fail_bits": F.lit(2), "__best": F.lit(3), "fp": F.lit(4), "component_id": F.lit(5)})
    for _, stage in pipeline.STAGES[:-1]:
        docs, _ = common.materialize(stage(spark, docs, SMALL), "odd")
    assert docs.columns[:5] == source.columns and docs.columns[-1] == "component_id"
    kept = Counter(r.doc_id for r in docs.select("doc_id").collect() if r.doc_id is None or r.doc_id > 1_000_000)
    assert kept == Counter({None: 1, 1_000_003: 2, 1_000_005: 1})  # no words: rejected; a near copy of a lesser id: gone; repeated rows: one document
    packed = pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.where("doc_id = 1000005").agg(F.sum("length") == F.first("doc_tokens")).first()[0]
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
