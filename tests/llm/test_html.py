from collections import Counter

import pytest

from heatloom.llm import wrappers

PAGES = "page_id long, url string, html string, host string, wrapper string, row string, blocks string, main_text string"

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">menu {n}</a></li><li><a href='/b'>x</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy {n}</div>
<article><h1>Title&amp;more {n}</h1><p>First   <b>bold</b>te&eacute;xt {n}<p>Second &lt;b&gt; para {n}<br></p>
<ul><li>one of {n}</li><li>two {n}</li></ul><form><input name="q">Search</form><div class="comments"><p>reader {n}</p></div></article>
<aside><p>side {n}</p></aside><footer>&copy; {n}</footer></body></html>"""
WANT = "Title&more {n}\nFirst boldteéxt {n}\nSecond <b> para {n}\none of {n}\ntwo {n}"
EMPTY = "host string, pages long, wrapper string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "a", "b", "c", "d", "e") for i, u, h in rows], PAGES)


def run(spark, rows, known=None):
    pages = frame(spark, rows)
    found = wrappers.main_text(pages, wrappers.infer_wrappers(pages) if known is None else known)
    assert set(found.columns) == {"page_id", "url", "host", "wrapper", "row", "blocks", "main_text"}
    got = found.collect()
    assert all((r["host"], r["wrapper"], r["row"], r["blocks"]) == ("a", "b", "c", "d") for r in got)
    return {r["page_id"]: r["main_text"] for r in got}


def test_articles(spark):
    rows = [(i, "https://a.example/" + str(i), PAGE.format(n=i)) for i in range(8)]
    rows += [(20, None, None), (21, "x", ""), (22, "http://b.example", "just text\n & more"), (23, "http://a.example/9", PAGE.format(n=9)[: PAGE.index("<ul><li>one") + 20])]
    rows += [(24, "http://c.example", "<div>" * 300 + "deep" + "</div>" * 300), (25, "http://c.example/2", "<p>" + "long " * 50_000)]
    found = run(spark, rows)
    assert len(found) == len(rows)
    assert all(found[i] == WANT.format(n=i) for i in range(8))
    assert found[20] == found[21] == "" and found[22] == "just text & more"
    assert found[23].startswith("Title&more 9\nFirst boldteéxt 9\nSecond <b> para") and found[24] == "deep"
    assert found[25] == ("long " * 50_000).strip()


def test_pages_of_no_articles_drop_what_never_changes(spark):
    page = '<body><div id="top"><p>Our site, since 1999</p></div><div id="links"><p><a href="/">home</a> <a href="/x">news of today {n}</a></p></div><div id="text"><p>Story {n}</p><p>More {n}</p></div></body>'
    for pages in (3, 6):
        found = run(spark, [(i, "http://d.example/", page.format(n=i)) for i in range(pages)])
        assert found == {i: f"Story {i}\nMore {i}" for i in range(pages)}


def test_the_wrapper_decides_inside_articles(spark):
    """With the wrapper exactly the planted template blocks go; without it they stay."""
    page = "<article><h1>Title {n}</h1><p>Body of {n}</p><h2>Sign up</h2><p>Our letter is free.</p>{odd}<h2>Summary</h2><p>End of {n}</p></article>"
    odd = {2: "<table><tr><td>a table of one page only</td></tr></table>", 4: "<p>Our letter is free. Twice.</p>"}
    rows = [(i, "http://d.example/", page.format(n=i, odd=odd.get(i, ""))) for i in range(7)]
    extra = {2: "\na table of one page only", 4: "\nOur letter is free. Twice."}
    found = run(spark, rows)
    assert found[0] == "Title 0\nBody of 0\nSummary\nEnd of 0"
    assert found[2] == "Title 2\nBody of 2\na table of one page only\nSummary\nEnd of 2"
    assert found[4] == "Title 4\nBody of 4\nOur letter is free. Twice.\nSummary\nEnd of 4"
    bare = run(spark, rows, spark.createDataFrame([], EMPTY))
    assert bare == {i: f"Title {i}\nBody of {i}\nSign up\nOur letter is free.{extra.get(i, '')}\nSummary\nEnd of {i}" for i in range(7)}


def test_template_counts_against_brute_force(spark):
    """A text is template if it fills its slot on most of the different pages, and on three at least; it goes if on most pages
    its container holds nothing else. Alone among the article's own texts it stays."""
    import random

    pick = random.Random(5)
    kinds = {"a": "section", "b": "div", "c": "figure"}
    pages = [[f"own {i}", "alone", *[(k, "note" if pick.random() < 0.8 else f"other {i}") for k in kinds if pick.random() < 0.75]] for i in range(9)]
    markup = lambda x: f"<p>{x}</p>" if isinstance(x, str) else f"<{kinds[x[0]]}><p>{x[1]} {x[0]}</p></{kinds[x[0]]}>"
    rows = [(i, "http://e.example/", "<article>" + "".join(map(markup, p)) + "</article>") for i, p in enumerate(pages)]
    counts = Counter(x for p in pages for x in p if isinstance(x, tuple))
    goes = {x for x, n in counts.items() if x[1] == "note" and n >= 3 and 2 * n > len(pages)}
    assert 0 < len(goes) < 3
    want = {i: "\n".join(x if isinstance(x, str) else f"{x[1]} {x[0]}" for x in p if x not in goes) for i, p in enumerate(pages)}
    assert run(spark, rows) == want


def test_mixed_templates_and_copies(spark):
    """Pages without an article element on a host that has some, and copied pages, keep their texts."""
    rows = [(i, "http://a.example/", PAGE.format(n=i)) for i in range(4)]
    rows += [(10 + i, "http://a.example/", f"<body><div><p>Plain {i} page</p></div></body>") for i in range(2)]
    rows += [(20 + i, None, f"<article><p>No host {i}</p></article>") for i in range(2)] + [(30 + i, None, f"<p>Bare {i}</p>") for i in range(2)]
    rows += [(40 + i, "http://copy.example/", "<body><div><p>The same page.</p><p>Six times.</p></div></body>") for i in range(6)]
    found = run(spark, rows)
    assert {found[10], found[11]} == {"Plain 0 page", "Plain 1 page"} and found[21] == "No host 1" and found[30] == "Bare 0"
    assert all(found[40 + i] == "The same page.\nSix times." for i in range(6)) and found[2] == WANT.format(n=2)


def test_nothing_of_the_article_is_lost(spark):
    page = (
        '<article><h1>T {n}</h1><p title=don\'t>Unquoted {n}</p><h2 id="search-methods">Methods {n}</h2><p class="alert">Alert {n}</p>'
        '<section id="related-work"><p>Work {n}</p></section><div class="header"><p>Lead {n}</p></div><p>A <button>press</button> word {n}</p>'
        "<p>x &lt; y <math><mi>z</mi></math></p>" + "<div>" * 70 + "<p>Deep {n}</p>" + "</div>" * 70 + "<p>After {n}</p></article>"
    )
    found = run(spark, [(i, "http://f.example/", page.format(n=i) + "<p>out</p>") for i in range(2)])
    assert found[1] == "T 1\nUnquoted 1\nMethods 1\nAlert 1\nWork 1\nLead 1\nA word 1\nx < y z\nDeep 1\nAfter 1"


def test_a_class_is_only_a_vote(spark):
    """A container named like a menu stays if it holds most of the text."""
    page = '<body><div class="menu-planner"><p>All of the long text {n} is in here</p></div><div class="ads"><p>Buy {n}</p></div></body>'
    assert run(spark, [(i, "http://g.example/", page.format(n=i)) for i in range(2)]) == {i: f"All of the long text {i} is in here" for i in range(2)}


def wrapper(page):
    return wrappers.skeleton(wrappers.parse(page))


def test_wrapper_is_an_expression():
    """Repeated siblings become a group, what a page lacks becomes optional, all pages fit."""
    whole = wrappers.merge(wrapper("<ul><li>x</li><li>y</li></ul><p>t</p>"), wrapper("<h2>k</h2><ul><li>z</li></ul>"))
    assert wrappers.as_expression(whole) == "<#root>(<h2>#text</h2>)?<ul>(<li>#text</li>)+</ul>(<p>#text</p>)?</#root>"
    again = wrappers.from_json(wrappers.to_json(whole))
    assert wrappers.as_expression(again) == wrappers.as_expression(whole)
    pair = "<dl>" + "<dt>a</dt><dd>b</dd>" * 5 + "</dl>"
    assert wrappers.as_expression(wrapper(pair)) == "<#root><dl>(<dt>#text</dt>)+(<dd>#text</dd>)+</dl></#root>"


def test_wrappers_stay_small():
    """Ids and classes that differ from page to page do not let a wrapper grow without bound."""
    whole = None
    for i in range(60):
        parts = "".join(f'<h{1 + (i + j) % 5} id="s{i}-{j}" class="c{chr(97 + (i * 7 + j) % 26)}{chr(97 + i % 26)}">h</h{1 + (i + j) % 5}><p>x</p>' for j in range(80))
        own = wrapper(f"<article>{parts}</article>")
        whole = own if whole is None else wrappers.merge(whole, own)
    assert len(wrappers.to_json(whole)) < 10_000
    for deep in ("<nav>", "<div>", "<nav><p>"):
        assert wrappers.page_blocks(deep * 5000 + "x", wrapper("<p>x"))[1] in ([], [(-1, -1, -1, 0, False, -1, -1, "x")])


def test_partial_wrappers_give_the_same_texts(spark):
    rows = [(i, f"http://{'ab'[i % 2]}.example/{i}", PAGE.format(n=i)) for i in range(40)]
    pages = frame(spark, rows)
    fan, wrappers.FAN = wrappers.FAN, 3
    try:
        known = wrappers.infer_wrappers(pages.repartition(13))
    finally:
        wrappers.FAN = fan
    assert sorted((r["host"], r["pages"]) for r in known.collect()) == [("a.example", 20), ("b.example", 20)]
    assert run(spark, rows, known) == {i: WANT.format(n=i) for i in range(40)}


def test_empty_pages(spark):
    assert run(spark, []) == {}


def texts_of(spark, pages):
    rows = spark.createDataFrame([(i, "http://h.example/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["main_text"] for r in wrappers.main_text(rows, wrappers.infer_wrappers(rows)).collect()}


def test_labels_of_varying_tables_and_lists_stay(spark):
    """A constant label beside a varying value is no template: neither a cell nor a term nor a source line goes alone."""
    page = "<article><h1>City {0}</h1><table><tr><th>Year</th><th>Population</th></tr><tr><td>200{0}</td><td>{0}1234</td></tr></table><p>Source: census.</p><dl><dt>Mayor</dt><dd>M{0}</dd></dl></article>"
    found = texts_of(spark, [page.format(i) for i in range(6)])
    assert all(found[i].split("\n") == [f"City {i}", "Year", "Population", f"200{i}", f"{i}1234", "Source: census.", "Mayor", f"M{i}"] for i in range(6))


def test_a_quote_that_a_few_pages_share_stays(spark):
    quote = "<blockquote>To be, or not to be.</blockquote>"
    found = texts_of(spark, [f"<article><h1>Page {i}</h1><p>Words {i} here.</p>{quote if i < 3 else ''}</article>" for i in range(50)])
    assert all(("To be, or not to be." in found[i]) == (i < 3) for i in range(50))


def test_scores_that_repeat_stay(spark):
    found = texts_of(spark, [f"<body><h1>Match {i}</h1><p>Final score</p><p>0-0</p></body>" for i in range(6)])
    assert all(found[i] == f"Match {i}\nFinal score\n0-0" for i in range(6))


@pytest.mark.parametrize("name", ['div class="share-price"', 'section class="comment-on-ruling"', 'table class="ad-revenue"', 'div class="notice-of-motion"', 'div id="menu-of-the-day"'])
def test_class_names_with_other_words_do_not_vote(spark, name):
    inner = "<tr><td>Number {}</td></tr>" if name.startswith("table") else "Number {}"
    found = texts_of(spark, [f"<article><h1>T{i}</h1><p>{'word ' * 30}{i}</p><{name}>{inner.format(i)}</{name.split()[0]}></article>" for i in range(6)])
    assert all(f"Number {i}" in found[i] for i in range(6))


@pytest.mark.parametrize("name", ['class="ad"', 'class="share-buttons"', 'class="newsletter-signup box"', 'class="cookie-notice"', 'id="comments"', 'id="comment-list"', 'class="comments-area"'])
def test_boxes_beside_the_article_go(spark, name):
    found = texts_of(spark, [f"<article><h1>T{i}</h1><p>{'word ' * 30}{i}</p><div {name}><p>reader {i} says hi</p></div></article>" for i in range(6)])
    assert all("says hi" not in found[i] and f"word {i}" in found[i] for i in range(6))


def test_a_group_that_all_pages_share_goes(spark):
    """No class, no element name: the wrapper's slots alone say that the box is the template's, inside an article too."""
    page = "<article><h1>T{0}</h1><div><p>Get our letter</p><p>every week</p></div><p>Body {0} with words.</p></article>"
    found = texts_of(spark, [page.format(i) for i in range(6)])
    assert all(found[i] == f"T{i}\nBody {i} with words." for i in range(6))
    few = texts_of(spark, [page.format(i) for i in range(2)])
    assert all("Get our letter" in t for t in few.values())
