"""HTML extraction: templates, broken markup, style-tree importance."""

import pytest

from tidemark.llm import html_tree as h

PAGES = [
    ("<nav><a>Home</a></nav><article><h1>T</h1><p>One <b>two</b>\n three.<p>Four&amp;five<br>six</article><footer>f</footer>", "T One two three. Four&five six"),
    ("<html><body class='has-sidebar'><header>Site</header><main><div class='breadcrumbs'>a / b</div><p>Text <i>in</i>line</p><aside>no</aside><form>x</form></main><div id='comments'><article>bad</article></div></body></html>", "Text inline"),
    ("<div class=ad>buy</div><div class='post-content'><p>A</p><script>var x='<p>no</p>'</script><p>B</p><div class='share-buttons'>s</div></div><div class='cookie-notice'>c</div>", "A B"),
    ("<article><header><h1>Head</h1></header><p>x<!-- no <p>y --></p><section class='comments'><p>c</p></section><footer>by me</footer></article><article class='related'>r</article>", "Head x"),
    ("<p>plain <a href='a>b'>link</a> &nbsp; &#233;&lt;3", "plain link é<3"),
    ("no markup at all, 1 < 2", "no markup at all, 1 < 2"),
    ("<style>p{}</style><title>t</title><div role=navigation>n</div><div hidden>h</div><div style='display: none'>d</div><p>k</p>", "k"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"),
    ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
    ("<article><p>cut off in a tag <b", "cut off in a tag"),
    ("", ""),
    (None, ""),
    ("<<>></p></div></article>x", "<<>> x"),
]


@pytest.mark.parametrize("source,text", PAGES)
def test_text(source, text):
    assert h.main_text(h.parse(source or ""), {}, 1) == text


def test_deep_and_long():
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert h.main_text(h.parse(deep), {}, 1) == "x"
    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    assert len(h.main_text(h.parse(long), {}, 1).split()) == 20_000


def test_hosts():
    assert [h.host(u) for u in ("http://A.b:80/x", "https://u@c.d?q", "//e.f/", None, "nonsense")] == ["a.b", "c.d", "e.f", "", ""]


def site(n, host="site.example"):
    """Pages without article elements whose frame has no telling names."""
    return [(i, f"http://{host}/{i}", f"<body><div class=xa>Same words everywhere</div><div class=xb><p>Story {i} tells {i * 7}</p><p>And {i * i} more</p></div><div class=xc>All rights of the house</div></body>", "other") for i in range(n)]


SCHEMA = "page_id long, url string, html string, HTML string"


def test_importance_removes_what_every_page_repeats(spark):
    out = {r["page_id"]: r["text"] for r in h.extract(spark.createDataFrame(site(12), SCHEMA)).collect()}
    assert out == {i: f"Story {i} tells {i * 7} And {i * i} more" for i in range(12)}


def test_copies_of_an_article_keep_their_text(spark):
    rows = [(i, "http://a.example/", "<nav>n</nav><article><h1>T</h1><p>same text</p></article>", None) for i in range(20)]
    out = h.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 20 and {r["text"] for r in out} == {"T same text"}


def test_odd_rows(spark):
    rows = [(None, None, None, None), (1, None, "<p>a", None), (1, None, "<p>a", None), (2, "http://x.example", "", None), (3, "not a url", "\0<p>\0b", None)]
    out = sorted((str(r["page_id"]), r["text"].replace("\0", ""), r["n_chars"]) for r in h.extract(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [x[:2] for x in out] == [("1", "a"), ("1", "a"), ("2", ""), ("3", "b"), ("None", "")]
    assert h.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_composite():
    tree = [{"path": 1, "parent": 0, "importance": 0.0}, {"path": 2, "parent": 1, "importance": 1.0}, {"path": 3, "parent": 1, "importance": 0.0}]
    out = h.composite(tree)
    assert out[2] == 1 and out[3] == 0 and out[1] == pytest.approx(0.45)


def test_all_main_containers_are_kept():
    several = "<div class=post><p>one</p></div><div class=ad>no</div><section id=story><p>two</p></section><div class=entry><div class=content>three</div></div>"
    assert h.main_text(h.parse(several), {}, 1) == "one two three"
    footer = "<div class=content><p>text</p></div><footer><div class=content>small print</div></footer><div class=sidebar><div class=post>teaser</div></div>"
    assert h.main_text(h.parse(footer), {}, 1) == "text"
    assert h.main_text(h.parse("<main>a</main><p>x</p><main>b</main><div role=main>c</div>"), {}, 1) == "a b c"


def test_importance_decides_among_main_containers(spark):
    rows = [(i, "http://a.example/", f"<div class=content>same on every page</div><div class=story><p>Story {i}</p></div><div class=post><p>More {i}</p></div>", None) for i in range(12)]
    out = {r["page_id"]: r["text"] for r in h.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {i: f"Story {i} More {i}" for i in range(12)}


def test_rare_section_of_a_large_host(spark):
    rows = [(i, "http://big.example/", f"<body><div class=xa><p>Words {i}</p></div></body>", None) for i in range(600)]
    rows += [(600 + i, "http://big.example/", f"<body><div class=ya>Same in this section</div><div class=yb><p>Story {i}</p></div></body>", None) for i in range(4)]
    out = {r["page_id"]: r["text"] for r in h.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [out[600 + i] for i in range(4)] == [f"Story {i}" for i in range(4)] and out[5] == "Words 5"


def test_small_hosts_and_copies(spark):
    page = "<article><p>text {0}</p><div class=xz>Same below every text</div></article>"
    rows = [(i, "http://small.example/", page.format(i), None) for i in range(3)] + [(10 + i, "http://copies.example/", page.format(0), None) for i in range(12)]
    out = {r["page_id"]: r["text"] for r in h.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {i: f"text {i}" for i in range(3)} | {10 + i: "text 0 Same below every text" for i in range(12)}


def test_a_nul_is_text():
    assert h.main_text(h.parse("<article><p>a<b>\0</b>c</p></article>"), {}, 1) == "a\0c"
