import pytest

from vitrine.llm.html_text import Page, extract

CASES = [
    ("<article><h1>T</h1><p>a <b>b</b>c\n d<p>e</article>", "T a bc d e"),
    ("<nav>menu</nav><article>x<aside>no</aside><div class='comments'>no</div>y</article><footer>f</footer>", "x y"),
    ("<body><div class=ad>buy</div><div id='cookie-notice'>ok?</div><p>text<form>name<input></form>", "text"),
    ("<p>1 &lt; 2 &amp; 3 &#8364;&nbsp;x &copy;</p>", "1 < 2 & 3 € x ©"),
    ("<article><script>var t='</p>';</script>a<style>p{}</style><!-- <p>no</p> -->b</article>", "ab"),
    ("<p title=\"a>b\">q<br>r", "q r"),
    ("<ul><li>1<li>2</ul><table><tr><td>a<td>b<tr><td>c</table>", "1 2 a b c"),
    ("<p>3 < 4 and 5 > 4", "3 < 4 and 5 > 4"),
    ("<div hidden>no</div><div style='display: none'>no</div>yes", "yes"),
    ("just words", "just words"),
    ("", ""),
    ("<article></article>", ""),
    ("<p>cut <a href='x", "cut"),
    ("<div class='has-sidebar wide'>yes</div><div class='left sidebar'>no</div>", "yes"),
    ("<div class='pagesMenu'>no</div><div class='address'>yes</div>", "yes"),
]


@pytest.mark.parametrize("source, expected", CASES)
def test_page(source, expected):
    assert Page(source).text() == expected


def test_tree_removes_what_a_host_repeats(spark):
    rows = [(i, "http://h.example/p", f"<body><div class=x1>same words</div><div class=x2>own words {i}</div></body>") for i in range(12)]
    rows += [(100, "http://other.example/", "<body><div class=x1>same words</div></body>")]
    rows += [(101 + i, "http://h.example/q", "<article>same article</article>") for i in range(8)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"own words {i}" for i in range(12))
    assert got[100] == "same words" and got[101] == "same article"


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "no url", "<p>a</p>", None), (3, "http://h/", "", "y"), (4, "http://H:80/", "<p>é" + "w " * 50_000, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.text[:3], r.n_chars) for r in extract(pages).collect())
    assert got == [("1", "", 0), ("1", "", 0), ("3", "", 0), ("4", "éw ", 100_000), ("None", "a", 1)]
    assert extract(pages.where("page_id = 77")).count() == 0


def extracted(spark, sources):
    rows = [(i, f"http://h.example/{i}", s) for i, s in enumerate(sources)]
    return {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_wrapper_does_not_take_its_text_along(spark):
    got = extracted(spark, [f"<div id=wrap>Welcome<div class=c>own words {i}</div><div class=r>same</div></div>" for i in range(20)])
    assert got == {i: f"Welcome own words {i}" for i in range(20)}


def test_copies_count_once(spark):
    got = extracted(spark, [f"<div class=c>words {max(i, 90)}</div>" for i in range(100)])
    assert got == {i: f"words {max(i, 90)}" for i in range(100)}


@pytest.mark.parametrize("tag", ["article", "main"])
def test_repeated_block_in_main_part(spark, tag):
    got = extracted(spark, [f"<{tag}><h1>Title {i}</h1><p>text {i}</p><div class=about>about us, always</div></{tag}>" for i in range(20)])
    assert got == {i: f"Title {i} text {i}" for i in range(20)}
