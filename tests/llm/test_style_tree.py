"""The style tree against a brute-force twin, and what it changes on pages with recurring branches."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm import site_style

WORDS = "tide harbour gull sand rope mast salt wave moon reef".split()


def site(n=40, seed=3):
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) + str(rng.randrange(999)) for _ in range(k))
    pages = []
    for i in range(n):
        paragraphs = "".join(f"<p>{say(12)}</p>" for _ in range(rng.randrange(1, 5)))
        pages.append(f"<body><div>{say(8)}</div><article><h1>{say(3)}</h1>{paragraphs}<p>Sign the petition of our town</p><div class='box'>You may also like</div></article><div class='end'>All hands</div></body>")
    return pages + pages[:5] + ["<body><p>Alone</p></body>"]


def frame(spark, pages, host="http://one.host/"):
    return spark.createDataFrame([(i, host, h, "x", 1) for i, h in enumerate(pages)], "page_id long, url string, html string, host string, code int")


def brute_tree(pages, threshold=0.2, leaf_threshold=0.05, decay=0.9, prior=2.0):
    """Codes of low nodes and leaves of one host's pages, by plain loops."""
    distinct = {}
    for page in pages:
        nodes, blocks = site_style.parse(page)
        styles, texts = defaultdict(set), defaultdict(set)
        for n in nodes:
            if not n.noise:
                styles[n.chain].add(tuple(c for k, c in enumerate(n.children) if not k or n.children[k - 1] != c))
        for k, t in blocks:
            if not nodes[k].noise:
                texts[nodes[k].chain].add(t)
        distinct[tuple((nodes[k].chain, t) for k, t in blocks if not nodes[k].noise)] = styles, texts
    low = set()
    for chain in {c for _, texts in distinct.values() for c in texts}:
        shown = Counter(frozenset(styles[chain]) for styles, _ in distinct.values() if chain in styles)
        said = Counter(t for _, texts in distinct.values() for t in texts.get(chain, ()))
        m = sum(shown.values())
        base = math.log(m + prior)
        presentation = -sum(k / m * math.log(k / m) for k in shown.values()) / base if m > 1 else 1.0
        content = 1 - sum(map(math.log, said.values())) / len(said) / base
        if (1 - decay) * presentation + decay * content < threshold:
            low.add(chain)
        else:
            low |= {site_style.leaf(chain, t) for t, k in said.items() if k > 1 and 1 - math.log(k) / base < leaf_threshold}
    return low


def test_low_branches_equal_brute_force(spark):
    pages = site()
    counts = site_style.feature_counts(frame(spark, pages))
    got = {r.code for r in site_style.low_branches(counts, site_style.importance(counts)).collect()}
    assert got == brute_tree(pages) and len(got) == 3
    for few in (pages[:1], pages[:4], pages[:9]):
        counts = site_style.feature_counts(frame(spark, few))
        assert {r.code for r in site_style.low_branches(counts, site_style.importance(counts)).collect()} == brute_tree(few)


def test_recurring_branches_go_in_articles_and_outside(spark):
    pages = site()
    low = brute_tree(pages)
    got = {r.page_id: r.text for r in site_style.extract(frame(spark, pages)).collect()}
    assert got == {i: site_style.main_text(h, low) for i, h in enumerate(pages)}
    assert all("petition" not in t and "also like" not in t and "hands" not in t for t in got.values())
    assert sum(t != site_style.main_text(h) for t, h in zip(got.values(), pages, strict=True)) >= 40
    lines = [line for t in got.values() for line in t.split("\n")]
    assert len(lines) > 100 and got[len(pages) - 1] == "Alone"


def test_near_copies_of_an_article_keep_what_they_share(spark):
    parts = [f"<p>Paragraph {k} of an article that is copied a lot</p>" for k in range(5)]
    copies = [f"<body><article>{''.join(parts)}<p>Seen {i} times</p></article></body>" for i in range(20)]
    texts = [r.text for r in site_style.extract(frame(spark, site(40) + copies)).where("page_id >= 46").collect()]
    assert len(texts) == 20 and all(t.count("Paragraph") == 5 for t in texts)


def test_repeated_rows_and_clashing_columns(spark):
    pages = frame(spark, site(12))
    twice = pages.union(pages).withColumn("text", F.lit(None).cast("string")).withColumn("__html", F.lit(1))
    once = {(r.page_id, r.text) for r in site_style.extract(pages).collect()}
    rows = site_style.extract(twice).collect()
    assert len(rows) == 2 * len(once) and {(r.page_id, r.text) for r in rows} == once
    assert site_style.extract(pages.limit(0)).count() == 0


def test_other_text_stays():
    for inner in ("<div class='legal'>Act 5</div>", "<div class='tags'>Act 5</div>", "<math>Act 5</math>", "<label>Act 5</label>", "<fieldset>Act 5</fieldset>", "<svg><text>Act 5</text></svg>"):
        assert "Act 5" in site_style.main_text(f"<body><article><p>The law says</p>{inner}</article></body>"), inner
