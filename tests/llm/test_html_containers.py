import pytest

from inkgrid.llm.html_text import main_text

MENU = "".join(f"<div><a href=/{i}>item {i}</a></div>" for i in range(12))


def words(n, i):
    return (f"w{i} " + "text " * n)[: n - 1] + "."


@pytest.mark.parametrize("lengths", [
    (50, 300, 280, 60, 70, 90, 80, 900, 700),
    (50, 120, 110, 130, 2500, 2200, 120, 110, 100, 140, 120),
    (60, 400, 420, 380, 390, 410),
    (40, 30, 4000, 35, 20),
])
@pytest.mark.parametrize("page", [
    "<body>{menu}<div>{blocks}</div>{menu}</body>",
    "<div><ul>{menu}</ul><section>{blocks}</section></div>",
    "{menu}{blocks}{menu}",
    "<body><div class='nav'>{menu}</div><div class='content with-sidebar'>{blocks}</div></body>",
    "<body class=x><div id=page-sidebar><main>{blocks}</main></div></body>",
    "<body><div class=share-page>{blocks}</div></body>",
])
def test_uneven_paragraphs_stay_whole(page, lengths):
    texts = [words(n, i) for i, n in enumerate(lengths)]
    blocks = f"<h1>{texts[0]}</h1>" + "".join(f"<p>{text}</p>" for text in texts[1:])
    got = main_text(page.format(menu=MENU, blocks=blocks)).split("\n\n")
    assert [line for line in got if not line.startswith("item")] == texts
    assert len(got) - len(texts) <= 6


def test_asides_in_the_container_go():
    text = words(900, 0)
    got = main_text(f"<div><h2>Head</h2><p>{text}</p><div class=sidebar>beside {text}</div><div hidden>x</div><p>End.</p></div>")
    assert got.split("\n\n") == ["Head", text, "End."]
    assert main_text(f"<div class=comments><main><p hidden>{text}</p><p>Seen.</p></main></div>") == "Seen."


def test_many_and_deep_elements():
    assert main_text("<div>" * 3_000 + f"<p>a</p><p>{words(500, 0)}</p><p>b</p>" + "</div>" * 3_000).count("\n\n") == 2
    assert main_text("<div>" + "<div><p>short.</p></div>" * 30_000 + "</div>").count("\n\n") == 29_999


def test_text_beside_blocks_is_not_left_for_the_page():
    text = words(600, 0)
    got = main_text(f"<body><div>Foot note.</div><div>{text}<p>{text}</p><p>End.</p></div><div>Imprint of us.</div>" + MENU * 3)
    assert "End." in got and "Imprint" not in got
