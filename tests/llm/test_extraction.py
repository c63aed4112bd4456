from trialstats.llm import extraction as E

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></ul></nav><div class="ad">Buy %d</div>
<div id="cookie-notice">We use cookies</div><article><h1>Head %d</h1><p><b>One&nbsp;two &lt;3<br><p>Three <i>fo</i>ur.</p>
<div class="comments"><p>first!</p></div><form><input value=x> <label>Mail</label></form><p>Last &copy %d</article>
<aside>Side</aside><section class="related posts">More</section><footer>&copy; x</footer></body></html>"""


def test_article_of_a_page():
    text = E.main_text(PAGE % (1, 2, 3), set(), set())
    assert text == "Head 2 One two <3 Three four. Last © 3"


def test_without_article_the_template_text_goes(spark):
    shell = "<html><body><div class=top>Our shop since 1990</div><div class=c><p>Unique words {0} here</p><p>and {0} more</p></div><div class=end>All rights</div></body></html>"
    pages = spark.createDataFrame(
        [(i, f"http://h.example/{i}", shell.format(f"n{i}")) for i in range(9)] + [(99, "http://one.example/", shell.format("z"))],
        "page_id long, url string, html string")
    got = {r.page_id: r.text for r in E.extract(pages).collect()}
    assert got[3] == "Unique words n3 here and n3 more"
    assert got[99] == "Our shop since 1990 Unique words z here and z more All rights"  # a single page has no template
    known = {r.host: r for r in E.templates(pages).collect()}
    assert set(known) == {"h.example"}
    assert E.nested(known["h.example"].slots) == {
        "/html", "/html/body", "/html/body/div.top", "/html/body/div.c", "/html/body/div.end"}  # the two p are a class of one token


def test_given_pages_keep_the_article_only(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    import html as h
    import re
    for r in E.extract(pages).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", html[r.page_id], re.S)[1]
        assert r.text == " ".join(h.unescape(re.sub("<[^>]*>", " ", inner)).split())


def test_odd_pages(spark):
    rows = [(1, None, None), (None, "x", ""), (2, "http://a/b", "<p>open <b>text"), (2, "http://a/b", "<p>open <b>text"),
            (3, "http://a/c", "plain & simple"), (4, "http://a/d", "<div" + "x" * 50), (5, "http://a/e", "<!-- never closed"),
            (6, "http://a/f", "<p>" * 3000 + "deep"), (7, "http://a/g", "<div>" * 90000 + "deep" + "</x></b>" * 9000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "'h' as host")
    got = sorted(((r.page_id, r.text) for r in E.extract(pages).collect()), key=str)
    want = [(1, ""), (None, ""), (2, "open text"), (2, "open text"), (3, "plain & simple"), (4, ""), (5, ""), (6, "deep"), (7, "deep")]
    assert got == sorted(want, key=str)
    assert E.extract(pages.limit(0)).count() == 0


def test_modifier_words_do_not_silence_an_article():
    for shell in ('<div class="overflow-hidden">{}</div>', '<div class="with-sidebar">{}</div>', '<div id="form-wrapper">{}</div>',
                  '<div class="sidebar">{}</div>'):
        page = shell.format('<article class="post has-comments"><div class="article-header"><h1>Head</h1></div><p>Body</p>'
                            '<div class="comments">first!</div></article><div class="site-header">Shop</div>')
        assert E.main_text(page, set(), set()) == "Head Body"
    cards = '<div class="related"><article>Card</article></div>'
    assert E.main_text(f"<main><p>Body</p></main>{cards}", set(), set()) == "Body"
    assert E.main_text('<div class="content-nav-free">Text</div><div id="cookieNotice">No</div><p>x <span class="hidden">y</span></p>',
                       set(), set()) == "Text x"


def test_pages_without_article_on_a_host_with_articles(spark):
    new = "<html><body><div class=top>Our shop</div><article><p>New {0}</p></article></body></html>"
    old = "<html><body><div class=top>Our shop</div><div class=post><p>Old {0}</p></div></body></html>"
    pages = spark.createDataFrame(
        [(i, f"http://h.example/{i}", (old if i % 3 == 0 else new).format(f"n{i}")) for i in range(9)],
        "page_id long, url string, html string")
    got = {r.page_id: r.text for r in E.extract(pages).collect()}
    assert got == {i: f"{'Old' if i % 3 == 0 else 'New'} n{i}" for i in range(9)}


def test_repeated_text_goes_only_where_the_template_nests(spark):
    shell = "<html><body><div class=top>Our shop</div>{}</body></html>"
    same = "<div class=x><div class=y>First shared</div><div class=y>Second shared</div></div>"
    bodies = [same, same, "<div class=x><div class=y>Third</div></div><div class=x></div><div class=x></div>", "<div class=w>Fourth</div>"]
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", shell.format(b)) for i, b in enumerate(bodies)],
                                  "page_id long, url string, html string")
    known = E.templates(pages).first()
    assert len(known.repeated) == 3 and E.nested(known.slots) == {"/html", "/html/body", "/html/body/div.top"}
    got = {r.page_id: r.text for r in E.extract(pages).collect()}  # neither div.x nor div.y is in a class of its host
    assert got == {0: "First shared Second shared", 1: "First shared Second shared", 2: "Third", 3: "Fourth"}
