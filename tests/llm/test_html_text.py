import pytest
from pyspark.sql import functions as F

from inkgrid.llm.html_text import extract_main_text, main_text

LONG = "This paragraph is long enough to be told from menus by its share of text, as articles are."


@pytest.mark.parametrize(("html", "text"), [
    (None, ""),
    ("", ""),
    ("plain text", "plain text"),
    ("<p>a &amp; b&nbsp;&#8211; c\n\t d</p>", "a & b – c d"),
    (f"<nav><a>x</a></nav><article><h1>T</h1><p>{LONG}<p>Be.</article><footer>f</footer>", f"T\n\n{LONG}\n\nBe."),
    (f"<article><p><b>Open<br><p>{LONG}</p></article>", f"Open\n\n{LONG}"),
    (f"<article><p>{LONG}</p><div class='comments'><p>{LONG} Nice!</p></div><p>End.</p></article>", f"{LONG}\n\nEnd."),
    (f"<div id=cookie-notice><p>{LONG}</p></div><main><p>{LONG}</p></main>", LONG),
    (f"<aside><p>{LONG}</p></aside><article><p>Short.</p></article>", "Short."),
    ("<article><h1>Only a title</h1></article>", "Only a title"),
    (f"<script>var t='</p>{LONG}'</script><style>p{{}}</style><article>x {LONG}<script>1</script> y</article>", f"x {LONG} y"),
    (f"<form><input value=x><p>{LONG}</p></form><article><ul><li>one<li>two</ul><p>{LONG}</article>", f"one\n\ntwo\n\n{LONG}"),
    (f"<article><header><h1>T</h1></header><p>{LONG}</p><footer>f</footer></article>", f"T\n\n{LONG}"),
    (f"<article><p>{LONG}</p></article><article><p>{LONG}</p></article>", f"{LONG}\n\n{LONG}"),
    (f"<article><p>an <a href=x>inline</a> <span class='ad'>buy</span>link, {LONG}</p></article>", None),
    ("<nav>all menu</nav>", ""),
    ("<article><p>never closed & <b>broken", "never closed & broken"),
    ("<<<>>><p", None),
])
def test_pages(html, text):
    got = main_text(html)
    assert text is None or got == text
    assert "buy" not in got


def test_pages_without_article_keep_the_dense_region():
    menu = "".join(f"<div><a href=/{i}>item {i}</a></div>" for i in range(30))
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(6))
    text = main_text(f"<body>{menu}<div>{body}</div>{menu}</body>")
    assert all(f"{LONG} {i}" in text for i in range(6)) and text.count("item") <= 4


def test_whole_and_long_pages():
    text = main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>")
    assert text == "\n\n".join([LONG] * 20_000)
    assert len(main_text("<article><p>" + "w " * 500_000)) == 999_999
    assert main_text("<div>" * 3_000 + "deep" + "</div>" * 3_000) == "deep"


def test_frames(spark):
    pages = spark.createDataFrame([(1, "u", f"<article>{LONG}</article>"), (1, "u", f"<article>{LONG}</article>"), (None, None, None)], "page_id long, url string, html string")
    out = extract_main_text(pages.withColumn("text", F.lit("old")))
    assert out.columns == ["page_id", "url", "html", "text"]
    assert sorted(row["text"] for row in out.collect()) == ["", LONG, LONG]
    assert extract_main_text(pages.limit(0)).count() == 0
