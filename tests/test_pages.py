"""Blocks of web pages, streams and odd inputs on small fixtures."""

import time

from pyspark.sql import functions as F

from lectern.operators import blocks, identity, page_tree, pages

LONG = "A sentence that is long enough to stay in the article, whatever the rules of short texts say about it."
HTML = f"""<html><head><title> The page </title><meta name="author" content="A. Writer"><script>var t="</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="ad">{LONG}</div>
<article><h1>Head</h1><p>{LONG}<p>Short.</p><p>Read more about all of this on our other pages.</p><h2>Key points</h2><p>{LONG}</p><h3>Deeper</h3><p>{LONG}</p><h2>After</h2>
<ul><li>One</li><li>Two</li></ul><p><a href="javascript:x()">{LONG}</a></p><table><tr><td>a</td><td>b</td></tr></table></article><blink>{LONG}</blink></body></html>"""


def test_page_blocks(spark):
    frame = spark.createDataFrame([(1, HTML), (2, None), (3, "")], "page_id long, html string")
    rows = pages.judged_blocks(frame).orderBy("block").collect()
    assert {r.page_id for r in rows} == {1}
    found = [(r.tag, r.content[:8], r.reason) for r in rows]
    assert found == [
        ("div", "Home", "structural"), ("div", LONG[:8], "promotion"), ("h1", "Head", None), ("p", LONG[:8], None), ("p", "Short.", "low-text-density"), ("p", "Read mor", "boilerplate-pattern"), ("h2", "Key poin", "summary-section"),
        ("p", LONG[:8], "summary-section"), ("h3", "Deeper", "summary-section"), ("p", LONG[:8], "summary-section"), ("h2", "After", None), ("li", "One", None), ("li", "Two", None), ("p", LONG[:8], "high-link-density"), ("tr", "a | b", "small-table"), ("div", LONG[:8], None),
    ]
    one = frame.where("page_id = 1").select(*pages.metadata(), pages.unsafe_tags().alias("tags"), pages.has_script_link().alias("link")).first()
    assert (one.title, one.author, one.image, one.tags, one.link) == ("The page", "A. Writer", None, "blink,body,head,html,meta,script,title", True)
    assert pages.removals(frame.where("false")).collect() == []


def test_hashes_and_matches(spark):
    row = spark.range(1).select(identity.string_hash(F.lit("ab")).alias("a"), identity.string_hash(F.lit("")).alias("b"), identity.string_hash(F.lit(None).cast("string")).alias("c"), identity.text_hash(F.lit("")).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ("2e9", "0", None, format(5381 * 4096 + 52711, "016x"))
    matches = spark.createDataFrame([(1, 3, 5), (1, 5, 7)], "doc_id long, start_word long, end_word long")
    words = spark.createDataFrame([(1, 4), (1, 5), (1, 6), (1, 8)], "doc_id long, word long")
    assert sorted(tuple(r) for r in blocks.matches_at(words, matches).collect()) == [(1, 4, 0, False), (1, 5, 0, False), (1, 6, 1, False)]


PARTS = [f"Part {i}: {LONG}" for i in range(8)]
FRAME = f"""<body><div id="top"><a href="/a">First link of the frame</a> <a href="/b">and the second link of it</a></div><div class="teasers"><p>Another story, which has a teaser of more than twenty letters.</p></div>
<div class="story-body"><h1>Title</h1><h4>Small heading</h4>{"".join(f"<p>{p}</p>" for p in PARTS)}</div><div class="below"><p>One more teaser, of a story that is not this one at all.</p></div></body>"""


def of(spark, html, how=pages.judged_blocks):
    return how(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("block").collect()


def test_end_tags_may_be_left_out(spark):
    rows = of(spark, f"<p class='share'>Share this<p>{LONG}<ul><li class=ad>Ad<li>{LONG}<li>Three</ul><table><tr><td>{LONG}<td>{LONG}<tr><td>c<td>d</table><p>One<div>{LONG}</div><dl><dt>Term<dd>{LONG}</dl>")
    assert [(r.tag, r.content, r.reason) for r in rows] == [
        ("p", "Share this", "promotion"), ("p", LONG, None), ("li", "Ad", "promotion"), ("li", LONG, None), ("li", "Three", None), ("tr", f"{LONG} | {LONG}", None), ("tr", "c | d", None),
        ("p", "One", "low-text-density"), ("div", LONG, None), ("dt", "Term", None), ("dd", LONG, None),
    ]
    nested = of(spark, "<ul><li>One<ul><li>Inner</ul><li>Two</ul><table><tr><td>x<table><tr><td>y</table><td>z</table>")
    assert [(r.tag, r.content) for r in nested][:3] == [("li", "One"), ("li", "Inner"), ("li", "Two")]


def test_long_pages_take_linear_time():
    n = 20_000
    for html in ("<p>text " * n, "<li>item " * n, "<div>" * n + "x" * 100, "<b>bold <p>text " * n, "<table>" + "<tr><td>a<td>b" * n, "</p>" * n, "<a href=x>link " * n, "<span class=icon>x</span>" * n):
        began = time.time()
        page_tree.read_page(html)
        assert time.time() - began < 20, html[:20]


def test_main_content(spark):
    text = of(spark, FRAME, lambda p: pages.articles(p).withColumn("block", F.lit(0)))[0].text
    assert text == "Small heading " + " ".join(PARTS)
    short = "<body><div><p>A first paragraph that is long enough.</p></div><div><p>A second paragraph that is long enough.</p></div></body>"
    assert "first" in of(spark, short, lambda p: pages.articles(p).withColumn("block", F.lit(0)))[0].text, "under 500 characters all is kept"
    named = f"<body><div class='content'>{'<p>' + LONG + '</p>' * 1}{''.join(f'<p>Comment, comment, comment {i}: {LONG}</p>' for i in range(9))}</div><article>{''.join(f'<p>{p}</p>' for p in PARTS)}</article></body>"
    assert of(spark, named, lambda p: pages.articles(p).withColumn("block", F.lit(0)))[0].text == " ".join(PARTS)
    ranks = of(spark, FRAME)
    assert max(len(r.inside) for r in ranks) <= 5 and all(1 in r.inside for r in ranks if r.content.startswith("Part"))


def test_markup_is_normalised(spark):
    inner = (
        f'<b class="x">bold</b> and <i>leaning</i> <a href="/u?a=1&amp;b=2" class="y">link</a> <a href="#">none</a> <a href="javascript:x()">script</a> <span class="fw-bold">strong</span> <span style="font-style: italic">em</span> '
        f'<span data-x="emphasis">data</span> <span class="icon-star">gone</span><span>plain</span> one<br>line  <mark>kept</mark> <font color=red>font</font> 1 &lt; 2 <span class="badge"><b>deep</b></span>{LONG}'
    )
    row = of(spark, f"<h1>Gone</h1><h5>Heading</h5><p>{inner}</p><pre><code class='a language-py'>x  =\n  1 <b>b</b> + some more code</code></pre>", pages.article_rows)
    assert [(r.type, r.level) for r in row] == [("heading", 3), ("paragraph", None), ("code", None)]
    assert row[1].markup == (
        f'<strong>bold</strong> and <em>leaning</em> <a href="/u?a=1&amp;b=2">link</a> none script <strong>strong</strong> <em>em</em> <em>data</em> plain one line <mark>kept</mark> font 1 &lt; 2 {LONG}'
    )
    assert row[1].content == f"bold and leaning link none script strong em data plain one line kept font 1 < 2 {LONG}"
    assert row[2].markup == '<code class="language-py">x  =\n  1 <strong>b</strong> + some more code</code>' and row[2].content == "x  =\n  1 b + some more code"


def test_tables_and_early_removals(spark):
    big = f"<table><tr><th>Head<td>{LONG}</tr><tr><td>{LONG}<td></tr></table>"
    assert [(r.content, r.reason) for r in of(spark, big + "<table><tr><td>a<td>b</table>")] == [(f"Head | {LONG}", None), (f"{LONG} |", None), ("a | b", "small-table")]
    html = "".join(f"<{x}>{LONG}</div>" for x in ("div class=vjs-big", "div class=gdpr-x", "div role=slider", "div data-ad=1", "div width=5", "div style='font-size: 9px'", "div style='line-height:9px'"))
    assert [r.reason for r in of(spark, html)] == ["pre-clean"] * 4 + ["tiny"] * 2 + [None]
    log = of(spark, f"<nav id=top class='a b'><p>{LONG}</p></nav><p>Short</p>", pages.removal_log)
    assert [(r.reason, r.selector, r.preview) for r in log] == [("structural", "nav#top.a.b", LONG[:50]), ("low-text-density", "p", "Short")]


def test_pages_of_one_file_are_read_by_many_tasks(spark):
    """pages of one partition are dealt before they are read; what goes by itself is shuffled no more, unless it is a heading."""
    frame = spark.range(0, 64, 1, 1).selectExpr("id as page_id", "concat('<p>A paragraph of page ', id, ', which is long enough to stay.</p><p>Short</p>') as html")
    assert pages.page_blocks(frame).select(F.spark_partition_id()).distinct().count() > 1
    shown = pages.article_rows(frame)._jdf.queryExecution().executedPlan().toString()
    read = shown.index("MapInArrow")
    assert shown.count("Exchange", 0, read) == 1 and "REPARTITION_BY_NUM" in shown[read:] and "low-text-density" in shown[shown.index("Exchange") : read]


def test_headings_that_go_still_bound_summaries(spark):
    html = f"<p>{LONG}</p><div class=ad><h2>Key points</h2></div><p>In the summary: {LONG}</p><h3>Deeper</h3><p>Also in it: {LONG}</p><nav><h2>Menu</h2></nav><p>After: {LONG}</p>"
    want = [r.content for r in of(spark, html) if r.reason is None]
    assert want == [LONG, f"After: {LONG}"] and [r.content for r in of(spark, html, pages.article_rows)] == want


def test_known_elements_say_the_same():
    for attrs in ((), (("class", "Story-Body ad"), ("id", "x")), (("style", "display: none"),), (("class", None), ("hidden", None))):
        for tag in ("div", "nav", "span"):
            assert page_tree._known_element(tag, attrs) == page_tree._element(tag, attrs) and page_tree._element(tag, attrs)[0] == page_tree.reason_of(tag, dict(attrs))
    long = "".join(f"<p class='share{i} {'x' * 300}'>{LONG}</p>" for i in range(3))
    before = page_tree._known_element.cache_info().currsize
    assert all(b[3] == "promotion" for b in page_tree.read_page(long)) and page_tree._known_element.cache_info().currsize == before
