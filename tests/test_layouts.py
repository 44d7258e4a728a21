import os

from pyspark.sql import functions as F

from inkgrid import fixed
from inkgrid.plans import layouts, payslip, timecard
from inkgrid.plans import transcribe as plan
from inkgrid.plans.transcribe import choose, transcribe, release_transcription
from inkgrid.operators import findings
from inkgrid.operators.choice import score_layouts
from tests.helpers import read, tables


def spread(text, *xs):
    """Words of a line at given left edges."""
    return list(zip(text.split(), xs))


def run(text, x0=10.0, gap=5.0):
    """Words of a line set one after another."""
    out = []
    for word in text.split():
        out.append((word, x0))
        x0 += 5.0 * len(word) + gap
    return out


CONT = [
    (20, run("SIPON Mes/Ano : 7 / 2012")),
    (50, spread("Dia Semana Jornada Entrada Saida Ocorrencia Qtde", 10, 60, 120, 190, 260, 330, 420)),
    (64, spread("resto 10:00", 60, 190)),
    (78, spread("2 SEG 08:00 09:03 14:05 HE 00:13", 10, 60, 120, 190, 260, 330, 420)),
    (92, spread("15:12 18:36", 190, 260)),
    (106, spread("2 19:00", 10, 190)),
    (120, spread("3 TER FOLGA", 10, 60, 190)),
    (134, spread("40 09:99", 10, 190)),
]


def days(df):
    return [
        (r.page, r.day_pos, r.date_raw, [(p.kind, p.time_raw, p.time_hhmm) for p in r.punches])
        for r in df.orderBy("doc_id", "page", "day_pos").collect()
    ]


def test_continuation(spark):
    unread = [(20, run("Mes/Ano : 17 / 2012"))] + CONT[1:2] + [(78, spread("5 09:03", 10, 190))]
    matched, pages = read(spark, {"d": [CONT, unread, [(20, run("capa"))]]})
    got = days(timecard.continuation_days(matched))
    assert got == [
        (1, 0, "02/07/2012", [("IN", "09:03", "09:03"), ("OUT", "14:05", "14:05"), ("IN", "15:12", "15:12"), ("OUT", "18:36", "18:36"), ("IN", "19:00", "19:00")]),
        (1, 1, "03/07/2012", [("IN", "09:99", "09:??")]),
        (2, 0, "5", [("IN", "09:03", "09:03")]),
    ]
    value = timecard.nest_timecards(timecard.continuation_days(matched), pages).first().value
    assert [len(p.days) for p in value.pages] == [2, 1, 0]


TAB_X = [15, 95, 131, 184, 220, 256, 292, 328, 364, 400, 440, 480, 520, 560]
TAB = [
    (20, run("CARTAO DE PONTO")),
    (50, spread("Data Entl Sail Ent2 Sai? Ent3 Sai3 Ent4 Sai4 H.Ext Atraso Falta Ad.Not Abono", *TAB_X)),
    (70, spread("16/12/2019 SEG 07:00d 12:00d 07:00", 15, 70, 95, 131, 400)),
    (84, spread("25/12/2019 NATAL", 15, 95)),
    (98, spread("28/12/2019 23:00€ +03:00d", 15, 95, 131)),
    (112, spread("rodape 07:00", 15, 95)),
]


def test_tabular(spark):
    matched, _ = read(spark, {"d": [TAB]}, width=620.0)
    assert days(timecard.tabular_days(matched)) == [
        (1, 0, "16/12/2019", [("IN", "07:00d", "07:00"), ("OUT", "12:00d", "12:00")]),
        (1, 1, "25/12/2019", []),
        (1, 2, "28/12/2019", [("IN", "23:00?", "23:00"), ("OUT", "+03:00d", "03:00")]),
    ]


INT = [
    (20, run("Relatório Mensal Mês/Ano: 05/2010")),
    (50, spread("Dia Entrada Saida Intervalo Intervalo Intervalo ATN", 10, 80, 150, 220, 320, 420, 520)),
    (70, spread("17 12:00 - 18:15 15:00-15:15 2,0", 10, 80, 118, 150, 220, 520)),
    (84, spread("18QUA 08:56- 17:58 12:00 13:00 13:10", 10, 80, 150, 216, 243, 270)),
    (98, spread("19 Feriado", 10, 80)),
]


def test_interval(spark):
    matched, _ = read(spark, {"d": [INT]})
    assert days(timecard.interval_days(matched)) == [
        (1, 0, "17/05/2010", [("IN", "12:00", "12:00"), ("OUT", "18:15", "18:15"), ("OUT", "15:00", "15:00"), ("IN", "15:15", "15:15")]),
        (1, 1, "18/05/2010", [("IN", "08:56", "08:56"), ("OUT", "17:58", "17:58"), ("OUT", "12:00", "12:00"), ("IN", "13:00", "13:00"), ("IN", "13:10", "13:10")]),
        (1, 2, "19/05/2010", []),
    ]


def entries(df):
    return [
        (
            r.page, r.entry_no, r.month, r.year,
            [tuple(f) for f in r.fields],
            [tuple(b) for b in r.bases],
        )
        for r in df.orderBy("doc_id", "page", "entry_no").collect()
    ]


MONTHLY = [
    (20, run("Período : 10/2019 Pág: 1")),
    (34, run("Salário Base : 1.678,61 Grupo : F")),
    (50, spread("Cod. Descrição Unidade Proventos Descontos", 10, 60, 200, 300, 400)),
    (64, spread("0105 Dias Trabalhados 30,00 1.678,61", 10, 60, 85, 210, 300)),
    (78, spread("/314 Contr. 9,00 1O7,03", 10, 60, 210, 405)),
    (92, spread("0200 Aviso", 10, 60)),
    (106, spread("Total 1.967,07 859,46", 10, 300, 405)),
    (120, spread("Líqüido 1.107,61", 10, 350)),
    (134, run("Base I.N.S.S. : 1.967,07 F.G.T.S. do Mês : 157,37")),
    (148, run("Base 13o.: Base FGTS: 1.967,07")),
    (162, run("Assinado por: Fulano")),
]


def test_monthly(spark):
    matched, pages = read(spark, {"d": [MONTHLY, [(20, run("Período : 11/2019"))], [(20, run("nada"))]]})
    assert entries(payslip.monthly_entries(matched, pages)) == [
        (
            1, 0, "10", "2019",
            [("0105", "Dias Trabalhados", "30,00", "1.678,61"), ("/314", "Contr.", "9,00", "1?7,03")],
            [
                ("Total Proventos", "1.967,07"), ("Total Descontos", "859,46"), ("Líqüido", "1.107,61"),
                ("Base I.N.S.S.", "1.967,07"), ("F.G.T.S. do Mês", "157,37"),
                ("Base 13o.", ""), ("Base FGTS", "1.967,07"),
            ],
        ),
        (2, 0, "11", "2019", [], []),
        (3, 0, "", "", [], []),
    ]


def _receipt(title_top):
    t = title_top
    return [
        (t, run("Recibo de Pagamento")),
        (t + 14, spread("NOVEMBRO MENSAL", 10, 120)),
        (t + 28, spread("2016 x", 10, 120)),
        (t + 50, spread("Descrição Qtde Valor Descrição Qtde Valor", 10, 140, 200, 290, 420, 480)),
        (t + 64, spread("SALARIO 30 953,36 INSS 200,43", 10, 140, 195, 290, 475)),
        (t + 78, spread("ASS MEDICA AMIL 5,00", 290, 310, 400, 475)),
        (t + 92, run("OTAL DE PROVENTOS 2.227,04 TOTAL DE DESCONTOS 211,43")),
        (t + 106, run("LÍQUIDO A RECEBER 2.015,61")),
        (t + 120, [("Base", 10), ("INSS", 35), ("Base", 150), ("FGTS", 175), ("FGTS", 300), ("Mes", 325)]),
        (t + 134, [("1.300,00", 10), ("2.227,04", 150), ("178,16", 300)]),
    ]


def test_receipt(spark):
    matched, pages = read(spark, {"d": [_receipt(10) + _receipt(200)]})
    got = entries(payslip.receipt_entries(matched, pages))
    assert got == [
        (
            1, 0, "11", "2016",
            [("", "SALARIO", "30", "953,36"), ("", "INSS", "", "200,43"), ("", "ASS MEDICA AMIL", "", "5,00")],
            [
                ("TOTAL DE PROVENTOS", "2.227,04"), ("TOTAL DE DESCONTOS", "211,43"),
                ("LÍQUIDO A RECEBER", "2.015,61"), ("Base INSS", "1.300,00"),
                ("Base FGTS", "2.227,04"), ("FGTS Mes", "178,16"),
            ],
        )
    ]


def test_damaged_months(spark):
    docs = {k: [[(10, run(text))]] for k, text in {
        "a": "SETEMBRO/2019", "b": "PUTUBRO / 2016/", "c": "PEEMBRO/2016", "d": "maior 12", "e": "nada",
    }.items()}
    matched, _ = read(spark, docs)
    got = {r.doc_id: (r.month, r.year) for r in payslip.fuzzy_months(matched).collect()}
    assert got == {"a": ("09", "2019"), "b": ("10", "2016"), "c": ("09", "2016"), "d": ("05", "")}


def test_tied_months_are_found(spark):
    docs = {"tie": [[(10, run("PEEMBRO/2016"))]], "one": [[(10, run("SETEMBRO/2016"))]], "none": [[(10, run("nada"))]]}
    matched, pages = read(spark, docs)
    out = payslip.number_entries(payslip.receipt_entries(matched, pages, month_ties=True))
    rows = findings.summarise_nested_entries(out, "month_ties")
    got = {r.doc_id: r.codes for r in findings.payslip_findings(rows).collect()}
    empty = fixed.EMPTY_PAGE[0]
    assert got == {"tie": [empty, findings.TIED_MONTH[0]], "one": [empty], "none": [empty]}
    assert {r.doc_id: (r.month, r.month_ties) for r in out.collect()} == {
        "tie": ("09", ["09", "12"]), "one": ("09", []), "none": ("", []),
    }
    # off unless asked for
    assert "month_ties" not in payslip.receipt_entries(matched, pages).columns
    assert [r.codes for r in findings.payslip_findings(rows.drop("month_ties")).collect()] == [[empty]] * 3


BLOCKS = [
    (10, run("Declaração Remuneração")),
    (20, run("Mês/Ano: 08/2018 Folha: MES")),
    (50, spread("Verba Nome Base Valor", 10, 60, 250, 400)),
    (64, spread("010 VENCIMENTO PADRAO-VP 3.059,94", 10, 60, 115, 400)),
    (78, spread("803 PREVI PESSOAL 6.188,63 -433,20", 10, 60, 90, 250, 400)),
    (92, run("Remuneração Ref.: 5.017,04 Retidos: 0,00")),
    (120, run("Mês/Ano: 08/2018 Folha: ACERTO")),
    (134, spread("058 HORA JULHO/18 -12,89", 10, 60, 250, 400)),
    (148, spread("192 AD.TEMP/COMI 5,00", 10, 60, 400)),
    (162, spread("193 5,00", 10, 400)),
]


def test_blocks(spark):
    matched, pages = read(spark, {"d": [BLOCKS, [(10, run("nada"))]]})
    assert entries(payslip.block_entries(matched, pages)) == [
        (1, 0, "08", "2018", [("010", "VENCIMENTO PADRAO-VP", "", "3.059,94"), ("803", "PREVI PESSOAL", "6.188,63", "-433,20")],
         [("Remuneração Ref.", "5.017,04"), ("Retidos", "0,00")]),
        (1, 1, "08", "2018", [("058", "HORA", "JULHO/18", "-12,89"), ("192", "AD.TEMP/COMI", "", "5,00")], []),
        (2, 0, "", "", [], []),
    ]


LEDGER = [
    (10, run("FICHA FINANCEIRA")),
    (20, run("Folha Normal")),
    (30, run("Mês: abr-17")),
    (44, spread("REMUNERAÇÃOMES 969,73 290 VA Func 0 30,67 BASEINSS 1.260,65", 10, 120, 200, 230, 245, 300, 320, 360, 420)),
    (58, spread("91Hr Adic 146,67 290,92 511 INSS 0 100,85 FGTS 100,85", 10, 40, 90, 140, 200, 230, 300, 320, 360, 420)),
    (72, spread("TOT.REND 1.620,65 TOTALDESC 228,10 LIQUIDO 1.392,55", 10, 120, 230, 320, 360, 420)),
    (86, run("Folha Normal")),
    (100, run("Mês: mai-17")),
    (114, spread("40Reembolso 5,00 300 X 1,00", 10, 120, 200, 230, 320)),
]


def test_ledger(spark):
    matched, pages = read(spark, {"d": [LEDGER], "few": [[(30, run("Mês: mai-17"))]]})
    assert entries(payslip.ledger_entries(matched, pages)) == [
        (
            1, 0, "04", "2017",
            [("", "REMUNERAÇÃOMES", "", "969,73"), ("290", "VA Func", "0", "30,67"),
             ("91", "Hr Adic", "146,67", "290,92"), ("511", "INSS", "0", "100,85")],
            [("BASEINSS", "1.260,65"), ("FGTS", "100,85"), ("TOT.REND", "1.620,65"), ("TOTALDESC", "228,10"), ("LIQUIDO", "1.392,55")],
        ),
        (1, 1, "05", "2017", [("40", "Reembolso", "", "5,00"), ("300", "X", "", "1,00")], []),
        (1, 0, "", "", [], []),
    ]


def _damaged(lines, **swaps):
    return [(top, [(swaps.get(text, text), x) for text, x in words]) for top, words in lines]


def test_damaged_amounts_are_kept_with_a_mark(spark):
    swaps = {"-433,20": "-4E3,20", "5.017,04": "5.O17,04", "3.059,94": "abc,de", "228,10": "22B,10", "146,67": "l46,67"}
    matched, pages = read(spark, {"blk": [_damaged(BLOCKS, **swaps)], "led": [_damaged(LEDGER, **swaps)]})
    of = lambda doc: (matched.where(F.col("doc_id") == doc), pages.where(F.col("doc_id") == doc))
    blocks = payslip.block_entries(*of("blk"), strict=False)
    first = entries(blocks)[0]
    # the damaged value stays the value and the legible amount before it the reference; what has no shape goes
    assert first[4] == [("803", "PREVI PESSOAL", "6.188,63", "-4?3,20")]
    assert first[5] == [("Remuneração Ref.", "5.?17,04"), ("Retidos", "0,00")]
    ledger = payslip.ledger_entries(*of("led"), strict=False)
    first = entries(ledger)[0]
    assert first[4][2] == ("91", "Hr Adic", "?46,67", "290,92") and ("TOTALDESC", "22?,10") in first[5]
    left = {
        (r.doc_id, r.amount, r.n_read, r.n_kept)
        for doc, out in (("blk", blocks), ("led", ledger)) for r in payslip.amount_balance(of(doc)[0], out).collect() if r.n_read != r.n_kept
    }
    # a field without a label is not kept: one word of the block page
    assert left == {("blk", "5,00", 2, 1)}
    # strict builders lose them, and their balance says what is theirs
    strict = payslip.block_entries(*of("blk"))
    assert entries(strict)[0][4] == [("803", "PREVI PESSOAL", "", "6.188,63")]
    assert all(r.n_kept <= r.n_read for r in payslip.amount_balance(of("blk")[0], strict, strict=True).collect())


def test_choice_and_whole_corpus(spark):
    docs = {
        "cont": [CONT], "tab": [TAB], "int": [INT], "mon": [MONTHLY], "rec": [_receipt(10)],
        "blk": [BLOCKS], "led": [LEDGER], "none": [[(10, run("texto qualquer"))]],
        "led2": [[(10, run("x FICHA"))], [(10, run("FINANCEIRA y"))]],
        "plain": [CONT[1:]],
    }
    words, pages = tables(spark, docs, width=620.0)
    kind = lambda d: fixed.TIMECARD if d in ("cont", "tab", "int", "plain") else fixed.PAYSLIP
    documents = spark.createDataFrame([(d, kind(d)) for d in docs], "doc_id string, doc_type string")
    out = transcribe(words, pages, documents)
    choice = {r.doc_id: (r.layout, r.score, r.error) for r in out["choice"].collect()}
    assert choice == {
        "cont": ("ts_continuation", 1.0, None), "tab": ("ts_tabular", 1.0, None),
        "int": ("ts_interval", 1.0, None), "mon": ("ps_monthly", 1.0, None),
        "rec": ("ps_receipt", 1.0, None), "blk": ("ps_blocks", 1.0, None),
        "led": ("ps_ledger", 1.0, None), "none": (None, None, fixed.MSG_UNKNOWN_LAYOUT),
        "led2": ("ps_ledger", 0.7, None), "plain": ("ts_continuation", 0.7, None),
    }
    days_of = {r.doc_id: r.n for r in out["days"].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert days_of == {"cont": 2, "tab": 3, "int": 3, "plain": 2}
    got = {r.doc_id: (r.n, r.f) for r in out["entries"].groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum(F.size("fields")).alias("f")).collect()}
    assert got == {"mon": (1, 2), "rec": (1, 3), "blk": (2, 4), "led": (2, 6), "led2": (2, 0)}
    # the stored lines keep their partitioning: no exchange lies above them
    plan = out["days"]._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "hashpartitioning" not in plan
    folder = out["days"].inputFiles()[0].split("fits=")[0]
    release_transcription(out)
    release_transcription(out)
    assert not os.path.exists(folder.removeprefix("file://"))


def test_page_of_another_layout_inside_a_document(spark):
    """Its lines lie in another folder of the store and are read all the same."""
    other = [(10, run("Recibo de Pagamento")), *[(20 + 10 * k, run(f"0{k}/01/2024 08:00")) for k in range(1, 3)]]
    words, pages = tables(spark, {"d": [TAB, MONTHLY, other, TAB]}, width=620.0)
    documents = spark.createDataFrame([("d", fixed.TIMECARD)], "doc_id string, doc_type string")
    out = transcribe(words, pages, documents)
    assert sorted({r.page for r in out["days"].collect()}) == [1, 4]
    assert out["choice"].first().layout == "ts_tabular"
    release_transcription(out)


def test_wrong_type_does_not_compete(spark):
    matched, _ = read(spark, {"d": [TAB]}, width=620.0)
    documents = spark.createDataFrame([("d", fixed.PAYSLIP)], "doc_id string, doc_type string")
    assert choose(matched, documents).first().layout is None
    scores = {r.layout: r.score for r in score_layouts(matched).collect()}
    assert scores["ts_tabular"] == 1.0 and scores["ps_monthly"] == 0.0


def test_ledger_title_over_any_number_of_pages(spark):
    def page(*texts):
        return [(20.0 + 14 * k, [(text, 10.0)]) for k, text in enumerate(texts)]

    docs = {
        "blank": [page("x", "ficha"), [], page("financeira", "y")],
        "three": [page("x", "fic"), page("hafin"), [], page("anceira", "y")],
        "letters": [page(c) for c in "fichafinanceira"],
        "apart": [page("x", "ficha"), page("z", "y"), page("financeira")],
        "backwards": [page("financeira", "x"), page("y", "ficha")],
    }
    matched, pages = read(spark, docs)
    scores = {r.doc_id: r.score for r in score_layouts(matched).where("layout = 'ps_ledger'").collect()}
    assert {k: v > 0 for k, v in scores.items()} == {"blank": True, "three": True, "letters": True, "apart": False, "backwards": False}
    words, pages = tables(spark, docs)
    kinds = spark.createDataFrame([(k, "holerite") for k in docs], "doc_id string, doc_type string")
    choice = {r.doc_id: r for r in transcribe(words, pages, kinds, max_pages=10)["choice"].collect()}
    assert choice["letters"].error == "O PDF tem 15 páginas e o limite é 10." and choice["letters"].layout is None
    assert choice["three"].error is None and choice["three"].layout == "ps_ledger"


def test_whole_corpus_with_damaged_amounts(spark):
    """The switch reaches every payslip builder, and strict reading stays the default."""
    swaps = {"953,36": "9S3,36", "2.227,04": "2.2Z7,04", "-433,20": "-4E3,20", "290,92": "29O,92"}
    docs = {"rec": [_damaged(_receipt(10), **swaps)], "blk": [_damaged(BLOCKS, **swaps)], "led": [_damaged(LEDGER, **swaps)]}
    words, pages = tables(spark, docs, width=620.0)
    documents = spark.createDataFrame([(d, fixed.PAYSLIP) for d in docs], "doc_id string, doc_type string")
    marked = {}
    for strict in (True, False):
        out = transcribe(words, pages, documents, strict=strict)
        rows = out["entries"].select("doc_id", F.explode(F.concat("fields.value", "bases.value")).alias("v")).where("v LIKE '%?%'").collect()
        marked[strict] = sorted((r.doc_id, r.v) for r in rows)
        release_transcription(out)
    assert marked[True] == []
    assert marked[False] == [("blk", "-4?3,20"), ("led", "29?,92"), ("rec", "2.2?7,04"), ("rec", "2.2?7,04"), ("rec", "9?3,36")]


def test_months_ask_python_once_and_lines_move_once(spark):
    """Before, a filter on the month found asked Python twice, and receipts moved by page after titles and after months."""
    matched, pages = read(spark, {"r": [[(10, run("JULHO 2018 MENSAL")), (30, run("OUTRO agosto/2019"))]]})
    months = payslip.fuzzy_months(matched)
    assert [tuple(r) for r in months.collect()] == [("r", 1, "07", "2018")]

    def planned(df):
        return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()

    assert planned(months)[0].count("ArrowEvalPython") == 1
    plan = planned(payslip.receipt_entries(matched, pages))[1]
    # from the gathered lines down to the titles
    above = plan[plan.index("collect_list") : plan.rindex("ArrowEvalPython")]
    assert above.count("Exchange hashpartitioning") == 1


def test_partitions_of_words_follow_the_pages(spark, monkeypatch):
    monkeypatch.setattr(plan, "PAGES_PER_TASK", 2)
    words, pages = tables(spark, {f"d{i}": [CONT] for i in range(24)})
    matched = plan.matched_lines(words, pages)
    assert matched.rdd.getNumPartitions() == 12
    assert matched.count() == 24 * len(CONT)
    few = tables(spark, {"d": [CONT]})[1]
    assert plan.page_partitions(few) == spark.sparkContext.defaultParallelism


def test_lines_of_builders_move_once_into_partitions_that_follow_the_pages(spark, monkeypatch):
    monkeypatch.setattr(plan, "PAGES_PER_TASK", 2)
    words, pages = tables(spark, {f"d{i}": [CONT] for i in range(24)})
    lines = plan.builder_lines(words, pages, (layouts.CONTINUATION,))
    built = timecard.DAY_BUILDERS[layouts.CONTINUATION.layout_id](lines)
    above = built._jdf.queryExecution().executedPlan().toString().partition("ArrowEvalPython")[0]
    assert above.count("Exchange hashpartitioning") == 1 and ", 12), REPARTITION_BY_NUM" in above
    read_before = timecard.DAY_BUILDERS[layouts.CONTINUATION.layout_id](plan.matched_lines(words, pages, (layouts.CONTINUATION,)))
    assert days(built) == days(read_before) != []
    ledger = plan.builder_lines(words, pages, (layouts.LEDGER,))._jdf.queryExecution().optimizedPlan().toString()
    assert ledger.count("RepartitionByExpression") == 1
