from pyspark.sql import functions as F

from tests.helpers import read, tables
from inkgrid.operators.geometry import (
    assign_lines,
    build_lines,
    cell_text,
    group_cells,
    label_value_pairs,
    page_text,
)
from inkgrid.functions.tokens import is_money
from inkgrid.operators.headers import detect_headers, with_header
from inkgrid.plans.layouts import Layout


def _lines(spark, centres, tolerance=6.0):
    page = [(c - 5.0, [(f"w{i}", 10.0 * i)]) for i, c in enumerate(centres)]
    words, _ = tables(spark, {"d": [page]})
    rows = assign_lines(words, tolerance).orderBy("word_seq").collect()
    return [r.line_no for r in rows]


def _anchored(centres, tolerance):
    """Brute force: a line starts when the centre leaves its first word's tolerance."""
    out, ref, line = {}, None, -1
    for i, c in sorted(enumerate(centres), key=lambda p: (p[1], p[0])):
        if ref is None or abs(c - ref) > tolerance:
            ref, line = c, line + 1
        out[i] = line
    return [out[i] for i in range(len(centres))]


def test_drifting_baseline_uses_first_word_as_reference(spark):
    assert _lines(spark, [100.0, 104.0, 108.0]) == [0, 0, 1]


def test_lines_equal_brute_force(spark):
    import random

    rng = random.Random(7)
    for spread in (30, 120, 600):
        centres = [100.0 + rng.randrange(spread * 4) / 4 for _ in range(80)]
        assert _lines(spark, centres) == _anchored(centres, 6.0)


def test_tolerance_comes_from_median_height(spark):
    # height 10 gives 6.0; a page of equal centres is one line in order of x0
    words, _ = tables(spark, {"d": [[(50, [("b", 40), ("a", 10)]), (55, [("c", 80)]), (70, [("z", 5)])]]})
    got = build_lines(words).orderBy("line_no").select("text", "top", "bottom").collect()
    assert [tuple(r) for r in got] == [("a b c", 50.0, 65.0), ("z", 70.0, 80.0)]
    assert page_text(build_lines(words)).first().text == "a b c\nz"


def _layout(*titles):
    return Layout(99, "x", "t", titles, "none")


def _header(spark, titles, lines):
    from inkgrid.operators.headers import attach_page_width, match_headers

    words, pages = tables(spark, {"d": [lines]})
    layout = _layout(*titles)
    matched = match_headers(attach_page_width(build_lines(words), pages), (layout,))
    return matched, layout, detect_headers(matched, (layout,)).collect()


def test_ranges_come_from_the_header(spark):
    _, _, got = _header(
        spark, ("Dia", "Entrada", "Saida"), [(50, [("Dia", 100), ("Entrada", 200), ("Saida", 300)])]
    )
    cols = got[0].cols
    assert (cols[0].x0, cols[1].x0, cols[1].x1, cols[2].x1) == (0.0, 157.5, 267.5, 595.0)


def test_cells_by_centre_and_last_column_to_the_edge(spark):
    matched, layout, _ = _header(
        spark,
        ("Dia", "Jornada", "Entrada", "Qtde"),
        [
            (50, [("Dia", 100), ("Jornada", 180), ("Entrada", 280), ("Qtde", 400)]),
            (70, [("2", 105), ("08:00", 185), ("09:03", 285), ("00:13", 440)]),
        ],
    )
    row = with_header(matched, layout).where("top > header.header_top").select(
        *[cell_text(F.col("words"), F.col("header.cols"), k) for k in range(4)]
    )
    assert tuple(row.first()) == ("2", "08:00", "09:03", "00:13")


def test_header_tolerates_damage_but_not_absence(spark):
    damaged = [(50, [("Data", 15), ("Entl", 95), ("Sail", 131), ("Sai?", 184)])]
    _, _, got = _header(spark, ("Data", "Ent1", "Sai1", "Sai2"), damaged)
    assert [c.name for c in got[0].cols] == ["Data", "Ent1", "Sai1", "Sai2"]
    _, _, got = _header(spark, ("DIA", "Saída"), [(50, [("dia", 15), ("saida", 95)])])
    assert got
    _, _, got = _header(spark, ("Data", "Ent1"), [(50, [("Data", 15), ("Observacao", 95)])])
    assert not got
    _, _, got = _header(spark, ("Dia", "Entrada", "Saida"), [(50, [("Dia", 15), ("Entrada", 95)])])
    assert not got


def test_best_line_wins_and_first_of_equals(spark):
    lines = [
        (50, [("Data", 15), ("Ento", 95)]),
        (90, [("Data", 15), ("Ent1", 95)]),
        (130, [("Data", 15), ("Ent1", 95)]),
    ]
    _, _, got = _header(spark, ("Data", "Ent1"), lines)
    assert got[0].header_top == 90


def test_pairs_and_cells(spark):
    def pairs(text):
        df = spark.createDataFrame([(text.split(),)], "t array<string>")
        return [tuple(p) for p in df.select(label_value_pairs(F.col("t"), is_money)).first()[0]]

    assert pairs("Base INSS : 1.967,07 F.G.T.S. do Mes : 157,37") == [
        ("Base INSS", "1.967,07"), ("F.G.T.S. do Mes", "157,37"),
    ]
    assert pairs("Base IRRF : 1.790,04 Base 13o.: sobra") == [("Base IRRF", "1.790,04"), ("Base 13o.", "")]
    assert pairs("Assinado por: fulano") == []
    assert pairs("10,00 a: 5,00 6,00 b:") == [("10,00 a", "5,00"), ("6,00 b", "")]
    assert pairs(": 5,00 a: 6,00") == [("a", "6,00")]

    words, _ = tables(spark, {"d": [[(50, [("Base", 10), ("INSS", 35), ("FGTS", 200)])]]})
    got = build_lines(words).select(group_cells(F.col("words"))).first()[0]
    assert [(c.label, c.centre) for c in got] == [("Base INSS", 32.5), ("FGTS", 210.0)]


def test_page_of_touching_words_takes_seconds(spark):
    import time

    n = 100_000
    words = spark.range(n).select(
        F.lit("d").alias("doc_id"), F.lit(1).alias("page"), F.col("id").cast("int").alias("word_seq"), F.lit("w").alias("text"),
        (F.col("id") % 12 * 10.0).alias("x0"), (F.col("id") % 12 * 10.0 + 8).alias("x1"),
        (F.col("id") * 0.75).alias("top"), (F.col("id") * 0.75 + 10.0).alias("bottom"),
    )
    start = time.time()
    got = assign_lines(words).groupBy("line_no").agg(F.count("*").alias("n"), F.min("word_seq").alias("first"))
    rows = sorted(tuple(r) for r in got.collect())
    assert time.time() - start < 40
    # tolerance 6.0 holds nine words of 0.75 each, the first included
    assert rows == [(k, min(9, n - 9 * k), 9 * k) for k in range(-(-n // 9))]


def test_words_of_a_line_are_made_before_they_are_collected(spark):
    """A list aggregate interprets what it is given; a column made below it is compiled."""
    words, _ = tables(spark, {"d": [[(10, [("Ação", 10), ("b", 60)])]]})
    lines = build_lines(words)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(_member#" in plan and [r.ntext for r in lines.collect()] == ["acao b"]


def test_page_is_collected_once_and_parted_in_its_row(spark):
    """Lines need no window and no sort over words, nor a second grouping by line."""
    words, _ = tables(spark, {"d": [[(10, [("a", 10), ("b", 60)])]]})
    plan = build_lines(words)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate [") == 1


def test_median_of_an_even_number_of_heights_and_words_without_a_place(spark):
    place = [(10.0, 14.0, 0), (10.5, 30.5, 1), (17.0, 21.0, 2), (17.1, 37.1, 3), (None, None, 4)]
    words = spark.createDataFrame(
        [("d", 1, k, f"w{k}", 10.0 * k, 10.0 * k + 5, top, bottom) for top, bottom, k in place],
        "doc_id string, page int, word_seq int, text string, x0 double, x1 double, top double, bottom double",
    )
    # heights 4, 4, 20, 20: 7.2 points; centres 12, 19, 20.5, 27.1: without a place first, then one segment cut by a fold
    got = {r.word_seq: (r.line_no, r.line_pos) for r in assign_lines(words).collect()}
    assert got == {4: (0, 0), 0: (1, 0), 2: (1, 1), 1: (2, 0), 3: (2, 1)}


def _reads(words, **more):
    rows = build_lines(words, **more).orderBy("doc_id", "page", "line_no").collect()
    return [(r.doc_id, r.page, r.line_no, r.text, r.ntext, [tuple(w) for w in r.words]) for r in rows]


def test_words_move_as_runs_whatever_their_order_and_texts(spark):
    """A run travels as columns, its texts as one; texts with a blank, NULL texts and words of many pages by turns stay whole."""
    texts = ["Ação", "b c", "", "x", None, "\x1f", "É", " "]
    rows = [
        (doc, page, k, texts[(k + (page or 0)) % 8], 30.0 * k, 30.0 * k + 9, 10.0, 20.0 + k)
        for k in range(8) for doc in ("a", "b", None) for page in (1, 2, None)
    ]
    form = "doc_id string, page int, word_seq int, text string, x0 double, x1 double, top double, bottom double"
    words = spark.createDataFrame([r for r in rows if r[1] is not None], form)
    got = _reads(words)
    assert [g[:3] for g in got] == [(d, p, 0) for d in (None, "a", "b") for p in (1, 2)]
    folded = {"Ação": "acao", "É": "e", " ": "", None: None}
    for _, page, _, text, ntext, members in got:
        own = [texts[(k + page) % 8] for k in range(8)]
        assert [m[0] for m in members] == own and [m[1] for m in members] == [folded.get(t, t) for t in own]
        assert text == " ".join(t for t in own if t is not None) and members[3][2:] == (90.0, 99.0, 94.5)
    assert _reads(words.orderBy("doc_id", "page", "word_seq").coalesce(1), partitions=3) == got
    # a page that is NULL is a page of its own
    assert assign_lines(spark.createDataFrame(rows, form)).count() == len(rows)
    assert assign_lines(words).columns == [*words.columns, "line_no", "line_pos"]


def test_words_of_a_page_move_as_one_row(spark):
    from inkgrid.operators.geometry import page_runs

    words, _ = tables(spark, {"d": [[(10.0 * k, [("a", 10), ("b", 60)]) for k in range(50)]] * 3})
    assert words.count() == 300 and page_runs(words.drop("confidence").coalesce(1)).count() == 3


def test_moved_lines_are_the_same(spark):
    from inkgrid.operators.geometry import move_lines

    words, _ = tables(spark, {"d": [[(10, [("Ação", 10), ("b c", 60)]), (40, [("x", 5), ("y", 50)])], [(10, [("z", 1)])]]})
    lines = build_lines(words).withColumn("words", F.transform("words", lambda w: w.withField("text", F.upper(w["text"]))))
    moved = move_lines(lines, 3)
    assert moved.dtypes == lines.dtypes and moved.rdd.getNumPartitions() == 3
    assert sorted(map(str, moved.collect())) == sorted(map(str, lines.collect()))
