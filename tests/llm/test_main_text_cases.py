"""Main text: copies of a page, names that sound like noise, articles beside the main text."""

from tidemark.llm import site_style


def pages_of(spark, html):
    return spark.createDataFrame([(i, "http://one.host/", h) for i, h in enumerate(html)], "page_id long, url string, html string")


def test_copies_of_a_page_count_once(spark):
    lists = "<body><div class='ad'>Buy {n}</div><article><h1>Head</h1><ul><li>Flour<li>Sugar</ul><table><tr><td>Oven<td>200 degrees</table><div>Mix well</div></article></body>"
    bare = "<body><div><p>One {k} of its own</p></div><div class='box'>Always the same words</div></body>"
    rows = [lists.format(n=i) for i in range(20)] + [bare.format(k="page")] * 40 + [bare.format(k=f"story {i}") for i in range(12)]
    got = {r.page_id: r.text for r in site_style.extract(pages_of(spark, rows)).collect()}
    assert {got[i] for i in range(20)} == {"Head\nFlour\nSugar\nOven\n200 degrees\nMix well"}
    assert {got[i] for i in range(20, 60)} == {"One page of its own"} and got[65] == "One story 5 of its own"
    copies = pages_of(spark, [bare.format(k="page")] * 40)
    assert {r.text for r in site_style.extract(copies).collect()} == {"One page of its own\nAlways the same words"}


def test_names_that_hold_the_main_text_are_no_noise():
    text = "<p>Long main text of the page</p>"
    for name in ("class='has-sidebar'", "id='no-sidebar-content'", "class='legal'", "class='search-results'", "class='widget-content'", "class='x widget'"):
        for inner in (text, f"<article>{text}</article>", f"<main>{text}</main>"):
            assert site_style.main_text(f"<body><div class='ad'>Buy</div><div {name}>{inner}<div class='share'>Share</div></div></body>") == "Long main text of the page", (name, inner)
        assert site_style.main_text(f"<body><article><section {name}>{text}</section></article></body>") == "Long main text of the page"
    noise = "<div class='sidebar'>Side</div><div id='comments'>A comment that is much longer than all of the article</div>"
    assert site_style.main_text(f"<body><article>{text}{noise}</article>{noise}</body>") == "Long main text of the page"
    assert site_style.main_text(f"<body><div>{text}</div>{noise}</body>") == "Long main text of the page"


def test_a_teaser_article_does_not_replace_the_main_text():
    teaser, text = "<article>Read on</article>", "<p>Long main text of the page, and more of it</p>"
    assert site_style.main_text(f"<body><main>{text}{teaser}</main><div>Else</div></body>") == "Long main text of the page, and more of it\nRead on"
    assert site_style.main_text(f"<body><div>{text}</div>{teaser}</body>") == "Long main text of the page, and more of it\nRead on"
    assert site_style.main_text(f"<body><article>{text}</article><div>Else</div></body>") == "Long main text of the page, and more of it"
