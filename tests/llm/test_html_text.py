import random

from courtspark.llm import html_text as H


def table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(800):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 12))] for _ in range(2))
        got = H.shared_lines(a, b)
        rest = iter(b)
        assert len(got) == table(a, b) and all(any(x == y for y in rest) for x in [a[i] for i in got])
    assert H.shared_lines(list(range(3000)), list(range(1, 3001))) == list(range(1, 3000))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header>top</header><nav><ul><li>menu</ul></nav><!-- note --><div class="ad">buy</div><div id="cookie-notice">ok?</div>
<article><header><h1>Head&amp;line</h1></header><p><b>First&nbsp;
 line<br><p>Second &lt;line&gt; &am</p><form>f</form><ul><li>one<li>two</ul><div class="comments"><p>reader</p></div><aside>side</aside></article>
<footer>&copy; site</footer></body></html>"""


def test_blocks_of_an_article():
    assert [x for q, x in H.blocks(PAGE) if q == "article"] == ["Head&line", "First line", "Second <line> &am", "one", "two"]
    assert H.blocks(PAGE[: PAGE.index("</article>")])[-1] == ("article", "two")
    assert H.blocks(None) == H.blocks("") == H.blocks("<p> <br>") == []
    assert H.blocks("a < b<p>c<!-- open") == [("", "a < b"), ("", "c")]
    assert len(H.blocks("<p>x" * 50_000)) == 50_000


def site(k, body):
    return f"<div>Site name</div><div>Latest</div>{''.join(f'<p>{x}</p>' for x in body)}<div>All rights</div>"


def test_pages(spark):
    r = random.Random(2)
    bodies = {k: [f"{r.random()} words" for _ in range(8)] for k in range(6)}
    rows = [(k, f"http://h.org/a/{k}", site(k, bodies[k])) for k in range(6)]
    rows += [(10, "http://h.org/a/3", site(3, bodies[3])), (11, None, None), (12, "http://one.org/x", "<p>alone</p>"), (13, "no url", "<p>q</p>"), (14, "http://h.org/a/2b", PAGE), (14, "http://h.org/a/2b", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS host", "3 AS `at`")
    got = H.extract(df).collect()
    text = {x.page_id: x.text for x in got}
    for k in range(6):
        assert text[k] == "\n".join(bodies[k])
    assert text[10] == "\n".join(bodies[3])
    assert text[11] == "" and text[12] == "alone" and text[13] == "q" and text[14].startswith("Head&line\nFirst line")
    assert len(got) == len(rows) and all(x.n_chars == len(x.text) for x in got)
    assert H.extract(df.limit(0)).count() == 0


def test_copies_lose_nothing():
    lines = ["a", "b", "c", "d"]
    assert H.shared_with_neighbour("h", "/x/1", lines, [("h", "/x/1", lines)]) == []
    assert H.shared_with_neighbour("h", "/x/1", lines, [("h", "/x/1", lines), ("h", "/x/2", ["a", "q"])]) == [0]
    assert H.shared_with_neighbour("h", "/x/1", lines, [("g", "/x/1", ["a"])]) == []
    assert H.shared_with_neighbour("h", "/x/1", lines, [("h", "/y/1", ["a"]), ("h", "/x/2", ["d"])]) == [3]


def test_lines_of_the_site_inside_main(spark):
    r = random.Random(3)
    bodies = [[f"{r.random()} words" for _ in range(8)] for _ in range(5)]
    rows = [(k, f"http://m.org/a/{k}", f"<div>top {k}</div><main>{site(k, bodies[k])}</main>") for k in range(5)]
    rows.append((5, "http://m.org/a/5", f"<main><article>{site(5, bodies[0])}</article></main>"))
    text = {x.page_id: x.text for x in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(text[k] == "\n".join(bodies[k]) for k in range(5))
    assert text[5] == "\n".join(["Site name", "Latest", *bodies[0], "All rights"])


def test_lines_of_the_site_inside_articles(spark):
    r = random.Random(4)
    bodies = [[f"{r.random()} words" for _ in range(8)] for _ in range(6)]
    bodies[2][3] = bodies[3][3] = "a passage that two articles share"
    story = lambda k: f"<article><h1>Title {k}</h1><p>Share this story</p>{''.join(f'<p>{x}</p>' for x in bodies[k])}<p>Sign up</p></article>"
    rows = [(k, f"http://n.org/a/{k}", f"<div>Sign up</div><div>top {k}</div>{story(k)}") for k in range(6)]
    rows += [(10, "http://n.org/a/3", rows[3][2]), (11, "http://two.org/a/1", story(0)), (12, "http://two.org/a/2", story(1))]
    text = {x.page_id: x.text for x in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(text[k] == "\n".join([f"Title {k}", *bodies[k]]) for k in range(6)) and text[10] == text[3]
    assert text[11] == "\n".join(["Title 0", "Share this story", *bodies[0], "Sign up"])


def test_copies_of_an_article_are_no_second_page():
    a, b = list("abcdef"), list("aghijk")
    every = frozenset(range(6))
    shared = lambda *others: H.shared_with_neighbour("h", "/x", a, [("h", f"/x/{i}", o) for i, o in enumerate(others)], inside=every)
    assert shared(b) == [] and shared(b, b[:5] + ["z"]) == [] and shared(b, list("abcdez")) == []
    assert shared(b, list("alm")) == [0] and shared(list("abcdez"), b, list("an")) == [0]
