import html
import re

from feedlens.llm import html_tree


def text(page, low=()):
    return html_tree._Page(page).text(set(low))


def test_article_without_its_surroundings():
    page = """<!doctype html><html><head><title>t</title><style>a{}</style><script>if (a < b) document.write("</p><p>no")</script></head>
    <body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
    <div class="layout with-sidebar"><article><h1>A &amp; B</h1><p>One<b>two</b> three<br>four
    <p>caf&eacute; &#8364;&#x41; &nbsp; x&amp <!-- not <p>this -->end<div class="ad-slot">buy</div><form><input>mail</form>
    <ul><li>i<li>j</ul><table><tr><td>k<td>l</table><section id="comments"><article><p>first!</p></article></section></article>
    <aside>more</aside><div id="cookie-notice">cookies</div></div><footer>&copy; x</footer></body></html>"""
    assert text(page) == "A & B Onetwo three four café €A x& end i j k l"


def test_broken_markup():
    assert text("") == "" and text("   ") == ""
    assert text("just text &lt;b&gt;") == "just text <b>"
    assert text("<nav>menu<article><p>body") == "body"
    assert text("<p>a<b>c</p><p>d</b>e</div></section>f") == "ac de f"
    assert text("<article><p>a <!-- open comment <p>gone") == "a"
    assert text("<article><p>a</p><script>never closed <p>gone") == "a"
    assert text('<article><a href="x>a</a><p>1 < 2 and <3') == "a 1 < 2 and <3"
    assert text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 2000) == "deep"
    assert len(text("<article><p>" + "word " * 200_000)) == 999_999


def test_class_names_do_not_drop_the_article():
    assert text('<div class="sidebar-right menu-page"><main><p>kept</p></main><div class="menu">gone</div></div>') == "kept"
    assert text('<div class="comments"><article>gone</article></div><div><p>kept</p></div>') == "kept"


def test_layouts_that_hold_the_article():
    assert text('<form id="aspnetForm"><div>menu</div><article><p>kept</p></article></form><p>x</p>') == "kept"
    assert text('<body><div>skip</div><form action="x"><div><p>Long text of the page</p><button>mail</button></div></form>') == "skip Long text of the page"
    assert text("<p>Long text of the page</p><form>mail</form>") == "Long text of the page"
    assert text('<article class="post comments-open"><p>kept</p><div class="comments">gone</div></article>') == "kept"
    assert text('<div class="has-comments"><article>kept</article><section id="comments"><article>gone</article></section></div>') == "kept"
    assert text('<div class="discussion"><article>kept</article></div>') == "kept"
    assert text('<aside><form><p>a</p></form><article>kept</article></aside><p>b</p>') == "kept"
    assert text("<div><p>Long text of the page</p></div><aside><article>teaser</article></aside>") == "Long text of the page"
    assert text("<main><p>Main text</p><article>teaser</article></main><p>x</p>") == "Main text teaser"
    assert text("<main><p>Main text</p></main><article>teaser</article><p>x</p>") == "Main text teaser"


def test_elements_never_ended():
    for tag in ("object", "video", "audio", "canvas", "svg", "math", "template"):
        assert text(f"<div><p>a</p><{tag} x='1'></div><p>b</p>") == "a b"
        assert text(f"<article><{tag}><p>a</p></article>") == "a"
        assert text(f"<p>a</p><div><{tag}></div><p>b</p><{tag}><p>c</p></{tag}><p>d</p>") == "a b d"
    assert text("<p>a</p><svg/><p>b</p><script src='x'/><p>c</p>") == "a b c"
    assert text("<p>a</p><svg><title>t</title><g><path/><text>no</text></g></svg><p>b</p>") == "a b"


def pages(n, host="a.example.com"):
    return [(i, f"http://{host}/{i}", f'<html><body><div class="top">Welcome to our site</div><div class="story"><p>Story {i} of the day {i * 7}</p>'
             f'<p>Second {i}</p></div><div class="end">All rights</div></body></html>') for i in range(n)]


def run(spark, rows, schema="page_id long, url string, html string, n_chars string"):
    df = spark.createDataFrame([(*r, "x") for r in rows], schema)
    return {r["page_id"]: (r["text"], r["n_chars"]) for r in html_tree.extract(df).collect()}


def test_repeated_branches_go(spark):
    rows = pages(20) + [(100, "http://b.example.com/1", pages(1)[0][2]), (101, None, None), (102, None, ""), (None, "http://a.example.com/x", "<p>odd")]
    got = run(spark, rows)
    for i in range(20):
        t = f"Story {i} of the day {i * 7} Second {i}"
        assert got[i] == (t, len(t))
    assert got[100][0] == "Welcome to our site Story 0 of the day 0 Second 0 All rights"  # the only page of its host
    assert got[101] == got[102] == ("", 0) and got[None] == ("odd", 3)


def test_entropy_is_that_of_occurrences(spark):
    df = spark.createDataFrame(pages(16), "page_id long, url string, html string")
    from feedlens.llm.urlfilter import url_host
    from pyspark.sql import functions as F
    nodes = html_tree.style_nodes(df, url_host(F.col("url"))).collect()
    assert sorted(round(r["importance"], 3) for r in nodes if r["seen"] == 16) == [0.0, 0.0, 0.9, 0.9, 0.9]
    assert [round(r["importance"], 3) for r in nodes if r["seen"] == 32] == [0.9]


def test_copies_of_a_page_keep_their_text(spark):
    """Most pages of the host are copies of one, the others have the same tags; also without a URL."""
    copy = pages(1)[0][2].replace("Story 0", "Copied story")
    for url in ("http://c.example.com/x", None):
        rows = [(1000 + i, url, copy) for i in range(170)] + [(i, url, page) for i, _, page in pages(30)]
        got = run(spark, rows)
        for i in range(170):
            assert got[1000 + i][0] == "Copied story of the day 0 Second 0"
        for i in range(30):
            assert got[i][0] == f"Story {i} of the day {i * 7} Second {i}"
    only = run(spark, [(i, "http://d.example.com/", copy) for i in range(20)])
    assert {t for t, _ in only.values()} == {"Welcome to our site Copied story of the day 0 Second 0 All rights"}


def site(n, host):
    """Few different texts in blocks that say of themselves nothing, or only that they are an article."""
    by = ("Anna", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gus", "Hal", "Ida", "Jo")
    rows = []
    for i in range(n):
        cells = "".join(f"<tr><td>{'no' if (i >> k) % 10 == 0 else 'yes'}</td></tr>" for k in range(3))
        body = (f'<div class="story"><h2>Summary</h2><p class="by">By {by[i % 10]}</p><p>Story {i}</p><table>{cells}</table></div>'
                f'<div class="hint">{"Special offer" if i % 10 == 3 else "Usual offer"}</div>')
        rows.append((i, f"http://{host}/{i}", f"<body><div>Welcome</div>{body}</body>"))
        rows.append((n + i, f"http://{host}/a{i}", f"<body><article><h2>Verdict</h2><p class='all'>Good</p><!-- {i} --><p>Test {i}</p></article></body>"))
    return rows


def test_size_of_the_site_does_not_matter(spark):
    small, large = run(spark, site(10, "s.example.com")), run(spark, site(10_000, "s.example.com"))
    for i in range(10):
        cells = " ".join("no" if (i >> k) % 10 == 0 else "yes" for k in range(3))
        t = f"Summary By {('Anna', 'Ben', 'Cleo', 'Dan', 'Eva', 'Finn', 'Gus', 'Hal', 'Ida', 'Jo')[i]} Story {i} {cells}"
        t += " Special offer" if i == 3 else ""  # a text of its own in a branch that mostly repeats
        assert small[i][0] == large[i][0] == t
        assert small[10 + i][0] == large[10_000 + i][0] == f"Verdict Good Test {i}"


def test_items_of_one_page_are_no_template(spark):
    got = run(spark, [(1, "http://l.example.com/", '<body><p class="x">yes</p>' + '<p class="x">no</p>' * 30 + "</body>")])
    assert got[1][0] == "yes" + " no" * 30
    got = run(spark, [(1, "http://l.example.com/", '<p class="x">no</p>' * 30)])
    assert got[1][0] == " ".join(["no"] * 30)


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_given_pages(spark):
    """Their articles hold headings and paragraphs only; taken here by plain cutting."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_tree.extract(df).collect():
        article = r["html"].split("<article>")[1].split("</article>")[0].replace("<b>", "").replace("</b>", "")
        assert r["text"] == " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", article)).split())


def test_names_of_wrappers_do_not_drop_the_page():
    for wrapper in ('<div class="wrapper no-sidebar">', '<div id="page" class="has-header">', '<div id="search-results">', '<div class="site menu-closed">',
                    '<div class="category-social">', '<div class="ad-free-content">', "<fieldset>", '<div class="banner"><div class="related">'):
        assert text(f"<body>{wrapper}<h1>Title</h1><p>The text of the page</p></body>") == "Title The text of the page", wrapper
    assert text('<div class="page"><p>The whole long text of the page</p><div class="sidebar">gone</div><div class="related-posts">gone</div></div>') == "The whole long text of the page"


def test_the_head_of_an_article_stays():
    assert text('<article><div class="entry-header"><h1>Title</h1></div><p>kept</p><div class="header">gone</div><div class="share">gone</div></article>') == "Title kept"
    assert text('<div class="header"><h1>Site</h1></div><article><p>kept</p></article>') == "kept"


def test_long_and_deep_pages_take_linear_time():
    import time
    cases = ["<div>x" * 150_000, "<div>" * 100_000 + "<td>a</td>" * 100_000, "<div>x" * 20_000 + "<article>y</article>" * 20_000, "<b>" * 100_000 + "<p>x" * 100_000,
             "<table>" + "<div>" * 80_000 + "<td>x</td>" * 80_000, "<td><table>" + "<div>" * 80_000 + "<td>x</td>" * 80_000, "<div>" * 100_000 + "</i>" * 200_000, "<a><div>x</div>" * 60_000]
    for page in cases:
        start = time.process_time()
        p = html_tree._Page(page)
        p.branches()
        p.text({1: 1})
        assert time.process_time() - start < 20 * len(page) / 1e6 + 1, page[:40]


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, "http://a.b/", "<p>x</p>", "h", "l")], "page_id long, url string, html string, _st_host string, _st_low string")
    r = html_tree.extract(df).first()
    assert (r["text"], r["_st_host"], r["_st_low"]) == ("x", "h", "l")


def plain_tree(rows):
    """Host -> style path -> (importance, commonest content), from plain nested lists; class names only, no rules of markup."""
    import math
    import xml.etree.ElementTree as ET
    from collections import Counter
    seen = {}
    for host, page in set(rows):
        def walk(e, path):
            path = f"{path}/{e.tag}.{e.get('class', '')}"
            texts, shape = [" ".join(e.text.split())] if e.text and e.text.strip() else [], [e.tag]
            for c in e:
                t, s = walk(c, path)
                texts += t
                shape.append(s)
            if texts:
                content.setdefault(path, []).append(tuple(texts))
                shapes.setdefault(path, []).append(str(shape))
            return texts, shape
        content, shapes = {}, {}
        walk(ET.fromstring(page), "")
        for path in content:
            c, s = seen.setdefault((host, path), (Counter(), Counter()))
            c[tuple(content[path])] += 1
            s[tuple(shapes[path])] += 1
    out = {}
    for key, (c, s) in seen.items():
        n = sum(c.values())
        h = lambda x: min(1.0, math.log2(n / max(x.values())))
        out[key] = (n, html_tree.CONTENT_WEIGHT * h(c) + (1 - html_tree.CONTENT_WEIGHT) * h(s), max(c, key=c.get))
    return out


def test_tree_equals_a_plain_one_and_alone_removes_text(spark):
    """A small site whose boilerplate has no telling names: importances of all branches as by a plain merge of the trees, and what these say is removed."""
    import random
    from collections import Counter

    from feedlens.llm.urlfilter import url_host
    from pyspark.sql import functions as F
    rng = random.Random(8)
    rows = []
    for i in range(60):
        host = f"h{i % 3}.example.com"
        top = "Our site" if rng.random() < .95 else f"Special {i}"
        aside = "".join(f"<p>{x}</p>" for x in rng.sample(["one", "two", "three"], 1 if i % 3 else 2))
        rows.append((host, f'<html><body><div class="k1"><p>{top}</p></div><div class="k2"><p>Story {i}</p><div class="k3">{aside}</div></div><div class="k4">The end</div></body></html>'))
    rows += rows[:9]  # copies count once
    df = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(rows)], "page_id long, url string, html string")
    want = plain_tree(rows)
    got = html_tree.style_nodes(df, url_host(F.col("url"))).collect()
    count = lambda xs: Counter((h, n, round(v, 6)) for h, n, v in xs)
    assert count((r["host"], r["pages"], r["importance"]) for r in got) == count((h, n, v) for (h, _), (n, v, _) in want.items())
    low = {(h, p.rsplit("/", 1)[1]): c for (h, p), (n, v, c) in want.items() if n >= html_tree.MIN_SEEN and v < html_tree.LEAST_IMPORTANCE}
    assert {p for _, p in low} >= {"div.k1", "div.k4"}
    for r in html_tree.extract(df).collect():
        host = rows[r["page_id"]][0]
        page = rows[r["page_id"]][1]
        top = page.split('"k1"><p>')[1].split("</p>")[0]
        plain = html_tree._Page(page).text({})
        assert plain.endswith(" The end") and plain.startswith(top)  # by markup alone it stays
        expected = plain[:-len(" The end")]
        if low.get((host, "div.k1")) == ((top,),):
            expected = expected[len(top) + 1:]
        assert r["text"] == expected
