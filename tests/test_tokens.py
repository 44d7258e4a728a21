import pytest
from pyspark.sql import functions as F

from inkgrid.functions import tokens
from inkgrid.functions.similarity import ratio, title_similarity
from inkgrid.functions.text import normalize_text


def _map(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.r for r in df.select("i", fn(F.col("t")).alias("r")).orderBy("i").collect()]


CLOCKS = {
    "12:00": ("12:00", "12:00"),
    "07:00d": ("07:00d", "07:00"),
    "+03:00d": ("+03:00d", "03:00"),
    "9:03": ("9:03", "09:03"),
    "23:59c": ("23:59c", "23:59"),
    "23:00€": ("23:00?", "23:00"),
    "0?:25": ("0?:25", "??:25"),
    "O7:00": ("?7:00", "??:00"),
    "25:00": ("25:00", "??:00"),
    "12:75": ("12:75", "12:??"),
    "0?:2?": ("0?:2?", "??:??"),
    "12:00:": ("12:00?", "12:00"),
    "1:234": ("1:23?", "01:23"),
    "++1:00": ("+?1:00", "??:00"),
    "SEG": None, "NATAL": None, "ATESTADO": None, "08:34:23": None, "1:2": None, "": None,
    "1.234,56": None, "+:00": None, ":00": None, "+": None, "123:00": None, "1:2:": None,
}


def test_clock_vectors(spark):
    got = _map(spark, tokens.read_clock, list(CLOCKS))
    for token, want, read in zip(CLOCKS, CLOCKS.values(), got):
        assert (read and (read.raw, read.norm)) == want, token
        if read:
            assert read.uncertain == ("?" in read.raw + read.norm)


MONEY = {
    "2.389,77": "2.389,77", "-433,20": "-433,20", "0,00": "0,00", "1.100,00": "1.100,00",
    "953,36": "953,36", "2.3?9,77": "2.3?9,77", "2.3O9,77": "2.3?9,77",
    "SETEMBRO/2019": None, "1/1": None, "09/09/2019": None, "10:07:11": None, "abc,de": None,
    "-,00": None, ",00": None, "1,2,33": None, "12,3": None, "a1,23": "?1,23", "aab1,23": None,
    "1,.3": "1,?3", "10,.3": "10,?3",
}


def test_money_vectors(spark):
    got = _map(spark, tokens.read_money, list(MONEY))
    assert {t: (r and r.raw) for t, r in zip(MONEY, got)} == MONEY


def test_money_to_decimal(spark):
    got = _map(spark, tokens.money_to_decimal, ["2.389,77", "-433,20", "2.3?9,77"])
    assert [g and str(g) for g in got] == ["2389.77", "-433.20", None]


def test_months(spark):
    one = lambda fn, *v: [r and tuple(r) for r in _map(spark, fn, v)]
    assert one(tokens.read_month_year, "Mes/Ano : 7 / 2012", "13/2012", "x") == [("7", "2012"), None, None]
    assert one(tokens.read_month_abbreviated, "Mês:  abr-17", "Mes: MAI/2018", "xyz-17", "") == [
        ("04", "2017"), ("05", "2018"), None, None,
    ]


def test_dates(spark):
    texts = ["21/05/2019", "38/07/2019", "31/04/2019", "29/02/2019", "2?/05/2019", "01/07/12", "5", "1/1/0", "1/1/12345"]
    got = _map(spark, tokens.parse_date, texts)
    assert [g and g.isoformat() for g in got] == [
        "2019-05-21", None, None, None, None, "0012-07-01", None, None, None,
    ]
    assert _map(spark, tokens.date_shape, texts) == [True, True, True, True, False, True, False, True, True]


def test_small_readers(spark):
    assert _map(spark, tokens.split_interval, ["08:56-", "09:52-16:07", "–", "09:00"]) == [
        ["08:56"], ["09:52", "16:07"], [], ["09:00"],
    ]
    assert _map(spark, tokens.day_prefix, ["18QUA", "32", "x1", "7"]) == [18, None, None, 7]
    assert _map(spark, tokens.day_digits, ["18QUA", "32", "07", "99999999999"]) == [None, None, 7, None]
    assert [tuple(r) for r in _map(spark, tokens.split_code, ["40Reembolso", "290", "VA", "1234x"])] == [
        ("40", "Reembolso"), ("290", ""), ("", "VA"), ("", "1234x"),
    ]
    assert _map(spark, tokens.is_total_label, ["TOT.RENDIMENTOS", "TOTAL DESCONTOS", "Tot x", "VA"]) == [
        True, True, False, False,
    ]
    assert _map(spark, tokens.total_kinds, ["otal de proventos 1 total de descontos 2", "x"]) == [
        ["TOTAL DE PROVENTOS", "TOTAL DE DESCONTOS"], [],
    ]


def test_normalize(spark):
    assert _map(spark, normalize_text, [" Descrição ", "SAÍDA", "é", "Nº", "Líqüido"]) == [
        "descricao", "saida", "e", "no", "liquido",
    ]


def test_similarity(spark):
    df = spark.createDataFrame([("entl", "ent1"), ("sai?", "sai2"), ("a", "a"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(title_similarity("a", "b")).collect()] == [0.75, 0.75, 1.0, None]
    assert ratio("peembro", "setembro") == ratio("peembro", "dezembro") == pytest.approx(0.8)


def test_plausible_never_rejects_a_match(spark):
    import random

    from inkgrid.functions.similarity import plausible

    rng = random.Random(3)
    titles = ["dia", "entrada", "ent1", "descricao", "cod.", "intervalo", "setembro"]
    words = []
    for title in titles:
        for _ in range(150):
            w = list(title)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(w) + 1)
                if rng.random() < 0.5 and w:
                    w[k % len(w)] = rng.choice("abcdeox1?")
                else:
                    w.insert(k, rng.choice("abcdeox1?"))
            words.append("".join(w))
    for title, threshold in [(t, 0.7) for t in titles[:6]] + [("setembro", 0.75)]:
        got = _map(spark, lambda c: plausible(c, title, threshold), words)
        for word, ok in zip(words, got):
            assert ok or ratio(word, title) < threshold, (word, title)


def test_month_of_equals_brute_force(spark):
    import random
    from difflib import SequenceMatcher

    from inkgrid import fixed
    from inkgrid.functions.similarity import _months_of, plausible_month

    rng = random.Random(11)
    words = ["peembro", "putubro", "maior", "mensal", "recebe"]
    for month in fixed.MONTH_NAMES:
        for _ in range(60):
            w = list(month)
            for _ in range(rng.randrange(5)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = rng.choice(["", "x", "0", "e", "br"])
                w = w or ["x"]
            words.append("".join(w))

    def brute(name):
        if len(name) < 4:
            return ()
        scores = [SequenceMatcher(None, name, m).ratio() for m in fixed.MONTH_NAMES]
        best = max(scores)
        return tuple(k for k, s in enumerate(scores, 1) if s == best) if best >= fixed.MONTH_THRESHOLD else ()

    assert [_months_of(w) for w in words] == [brute(w) for w in words]
    assert _months_of("peembro") == (9, 12) and _months_of("mensal") == ()
    for word, ok in zip(words, _map(spark, plausible_month, words)):
        assert ok or not brute(word), word


def test_similarity_can_be_filtered_whatever_folds_the_word(spark):
    from inkgrid.functions import text
    from inkgrid.functions.similarity import title_similarity

    words = spark.createDataFrame([("Éntrada",), ("ﬁm 각",), (None,), ("saída",)], "w string")
    for fold in (text.normalize_word, text.normalize_text, text.normalize_name):
        ratio = title_similarity(fold(F.col("w")), F.lit("entrada"))
        assert [r.w for r in words.where(ratio >= 0.6).collect()] == ["Éntrada"]
        kept = words.select("w", ratio.alias("r")).distinct().where("r >= 0.5")
        assert sorted(r.w for r in kept.collect()) == ["saída", "Éntrada"]
        both = kept.join(words.withColumn("again", ratio), "w").where("again < 1")
        assert [r.w for r in both.collect()] == ["saída"]


def test_blanks_around_plain_text_go_like_those_around_any(spark):
    texts = [" \t\n\x0b\f\rA b\r\f\x0b\n\t ", "", " ", "\x1fx\x1f", "a \n b", "\n", "É \n", "  Ação\t"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(normalize_text(F.col("t"))).collect()
    assert [r[0] for r in got] == ["a b", "", "", "\x1fx\x1f", "a \n b", "", "e", "acao"]
