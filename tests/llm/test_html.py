import json
import re

from weftspark.llm.html import TEXT, Matcher, Wrapper, align, cores, extract, fold, tokens, wrappers

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><p>Site</p></header><nav><ul><li><a href="/a">One</a></li><li><a>Two</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<aside>Side</aside><article><h1>Head &amp; Tail</h1><p><b>First   line
here.<br><p>Second &lt;p&gt; one.</p><div class="ad">Buy</div><form><input><p>Mail</p></form><ul><li>x<li>y</ul></article>
<section id="comments"><p>Nice post</p></section><footer>&copy; me</footer></body>"""
WANT = "Head & Tail\nFirst line here.\nSecond <p> one.\nx\ny"


def flat(items, n=2):
    """A regular expression for a wrapper, over shapes that end in a semicolon."""
    return "".join(re.escape(i) + ";" if isinstance(i, str) else f"(?:{flat(i[1])}){i[0]}" for i in items)


def stream(page):
    return [s for s, _ in tokens(page)]


def test_streams_match_the_wrapper_they_were_folded_into():
    for page in (PAGE, "<ul>" + "<li>a</li>" * 9 + "</ul>", "<p>a<p>b<p>c", "a", ""):
        assert re.fullmatch(flat(fold(stream(page))), "".join(s + ";" for s in stream(page)))
    assert fold(stream("<ul>" + "<li>a</li>" * 5 + "</ul>")) == ["ul", ["+", ["li", TEXT, "/li"]], "/ul"]


def test_alignment_finds_optional_and_repeated_groups():
    a = fold(stream("<div><h1>a</h1><p>b</p></div>"))
    b = fold(stream("<div><p>b</p><p>c</p><p>d</p></div>"))
    both = align(a, b)
    assert cores(both) == [["p", TEXT, "/p"]]
    for page in ("<div><h1>a</h1><p>b</p></div>", "<div><p>b</p><p>c</p></div>", "<div><h1>z</h1><p>b</p><p>c</p></div>"):
        assert re.fullmatch(flat(both), "".join(s + ";" for s in stream(page)))
    assert align(a, a) == a


def test_text_of_a_page():
    assert Wrapper(fold(stream(PAGE))).text(tokens(PAGE)) == WANT
    assert Wrapper([]).text(tokens(PAGE)) == WANT


def test_table_and_odd_rows(spark, sf):
    df = spark.createDataFrame(
        [(1, "http://a.b/x", PAGE, "c"), (1, "http://a.b/x", PAGE, "c"), (2, None, None, "c"), (3, "http://a.b/y", "", "d"), (None, "nothing", "just text <", "e")],
        "page_id long, url string, html string, text string",
    )
    rows = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in extract(df).collect())
    assert rows[1][2] == rows[2][2] == WANT and rows[1][3] == len(WANT)
    assert rows[0] == (0, "nothing", "just text <", 11) and rows[3][1:] == (None, "", 0) and rows[4][2] == ""
    assert extract(df.limit(0)).count() == 0
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        import html as h

        parts = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", body)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)
    for r in wrappers(pages).collect():
        assert "article" in json.dumps(json.loads(r.wrapper))


# A host without an element or a class word that would tell its menu, notice and advert from its text.
PLAIN = "<html><body><div><a>Home</a> <a>News</a></div><ul><li><a>{0} one</a></li><li><a>{0} two</a></li></ul><div><h2><a>Title {0}</a></h2><p>Text {0}, long enough to be one.</p><p>More <a>of</a> {0}.</p></div><div>We use biscuits.</div></body></html>"
LEFT = "Title {0}\nText {0}, long enough to be one.\nMore of {0}."


def test_the_hosts_pages_decide_what_elements_do_not_tell(spark):
    kinds = ["a", "b", "c", "d"]
    rows = [(i, "http://plain.x/", PLAIN.format(k)) for i, k in enumerate(kinds)] + [(9, "http://lone.x/", PLAIN.format("z"))]
    # Copies of one page don't make its text the template's.
    rows += [(20 + i, "http://copies.x/", "<div><p>One and the same.</p></div>") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in extract(df).collect()}
    assert [got[i] for i in range(4)] == [LEFT.format(k) for k in kinds]
    assert "We use biscuits." in got[9] and "z one" not in got[9]  # one page can't vary, but has a repeated group of links
    assert all(got[20 + i] == "One and the same." for i in range(5))


def test_a_wrong_or_empty_wrapper_gives_another_text(spark):
    df = spark.createDataFrame([(i, "http://plain.x/", PLAIN.format(k)) for i, k in enumerate("abc")], "page_id long, url string, html string")
    right = Wrapper(*json.loads(wrappers(df).first().wrapper))
    page = tokens(PLAIN.format("a"))
    assert right.text(page) == LEFT.format("a")
    assert Wrapper([]).text(page) != LEFT.format("a") != Wrapper(fold(stream("<p>a")), [-2]).text(page)


def test_streams_fill_the_slots_of_their_wrapper():
    both = align(fold(stream("<div><h1>a</h1><p>b</p></div>")), fold(stream("<div><p>b</p><p>c</p></div>")))
    m = Matcher(both)
    assert m.slots == 2
    assert m.fills(stream("<div><h1>z</h1><p>b</p><p>c</p></div>")) == [0, 1, 1]
    assert m.fills(stream("<div><p>b</p></div>")) == [1]
    assert m.fills(stream("<div><b>b</b></div>")) is None


def test_every_page_matches_its_hosts_wrapper(spark, sf):
    host = re.compile("//([^/?#]*)")
    found = {r.host: Matcher(json.loads(r.wrapper)[0]) for r in wrappers(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        assert found[host.search(r.url)[1].lower()].fills(stream(r.html)) is not None
