import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.llm import private, queries
from inkgrid.llm.texts import document_texts
from suite import adapters
from tests.llm.tables import documents, odd_texts, prose, rng

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = list(PATTERNS)


def holds(kind, span):
    digits = [int(c) for c in span if c in "0123456789"]
    if kind == "ip":
        return all(int(part) <= 255 for part in span.split("."))
    if kind == "card":
        twice = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def base_by_hand(text):
    spans = [
        (m.start(), BASE.index(kind), m.end())
        for kind, pattern in PATTERNS.items() for m in re.finditer(pattern, text) if holds(kind, m.group())
    ]
    return [(BASE[kind], start, end) for start, kind, end in sorted(spans)]


def base_found(text):
    found = sorted((f.start, f.kind, f.end) for f in private.candidates(text) if f.base)
    return [(private.KINDS[kind], start, end) for start, kind, end in found]


def cpf(r):
    digits = [r.randint(0, 9) for _ in range(9)]
    for n in (10, 11):
        digits.append(sum(d * w for d, w in zip(digits, range(n, 1, -1))) * 10 % 11 % 10)
    d = "".join(map(str, digits))
    return f"{d[:3]}.{d[3:6]}.{d[6:9]}-{d[9:]}"


def planted(r, i):
    """A payslip's text, its private spans as (kind, text), and texts that look alike but are not private."""
    name = f"{r.choice(private.GIVEN_NAMES)} da Silva Souza"
    number, phone = cpf(r), f"({r.choice(('11', '21', '41'))}) 9{r.randint(1000, 9999)}-{r.randint(1000, 9999)}"
    wrong = "111.222.333-4" + "05"[number.endswith("0")]
    text = "\n".join([
        "RECIBO DE PAGAMENTO", f"Nome: {name} CPF: {number}", f"Fone {phone}", f"Total: Industria Ltda {wrong}/A",
        prose(r), f"Contato: joao{i} (arroba) empresa.com.br", f"token = \"{'%x' % r.getrandbits(120)}\" versao 900.1.2.{i}",
    ])
    return text, {("person", name), ("cpf", number), ("phone", phone), ("email", f"joao{i} (arroba) empresa.com.br")}


TRICKY = [
    "a@b.c@d.e x@y", "@@@a@b.co@", "a..b@c-d.e.f, .@a.b %@%", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255 0001.0255.3.4.",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "4111  1111 1111 1111", "1-2 3-4", "+1 (171) 555-2028 4111111111111111",
    "+1234567890 +12 +1()() 5 +1+1-1", "+" * 50, "@" * 3000, "a" * 3000 + "@", "1." * 3000, "1 " * 3000, "+1" + " " * 3000,
    "é4111111111111111é 日1.2.3.4日", "a@b.c.d.e-", "x@-.-", "٣٤@x.y ٣.٣.٣.٣",
]


def test_base_spans_equal_plain_patterns():
    r = rng(41)
    texts = TRICKY + ["".join(r.choices("aA1é.@+-() 45%_\n", k=60)) for _ in range(4_000)]
    texts += ["".join(r.choices("0123456789 -.+", k=80)) for _ in range(2_000)]
    for text in texts:
        assert base_found(text) == base_by_hand(text), text


def test_long_texts_take_linear_time():
    for part in ("a", "@", "1", "1.", "1 ", "+1 ", "a@", "a@b ", "(at) ", "Ana ", "nome: ", "Aa "):
        private.candidates(part * (300_000 // len(part)))


def test_counted_estimates_equal_those_of_single_rows():
    """EM over counts of equal votes is EM over all candidates."""
    source = np.random.default_rng(5)
    truth = source.random(600) < 0.3
    cast = np.where(source.random((600, 6)) < 0.8, np.where(truth, 1, -1)[:, None], source.integers(-1, 2, (600, 6)))
    unique, place = np.unique(cast, axis=0, return_inverse=True)
    prior, reliability = private.estimate(unique, np.bincount(place).astype(float))
    single_prior, single = private.estimate(cast, np.ones(600))
    assert np.isclose(prior, single_prior) and np.allclose(reliability, single)
    judged = private.posterior(cast, prior, reliability) > 0.5
    assert (judged == truth).mean() > 0.95 and abs(prior - 0.3) < 0.05
    assert (reliability[:, 1, 2] > 0.7).all() and (reliability[:, 0, 0] > 0.7).all()


@pytest.fixture(scope="module")
def texts_and_truth():
    r = rng(42)
    return [planted(r, i) for i in range(120)]


def test_finds_planted_data_of_unseen_texts(spark, texts_and_truth):
    learned, held_out = texts_and_truth[:80], texts_and_truth[80:]
    model = private.fit_private_model(documents(spark, [(i, t, "pt") for i, (t, _) in enumerate(learned)]))
    assert ((0 < model.prior) & (model.prior < 1)).all()
    table = documents(spark, [(i, t, "pt") for i, (t, _) in enumerate(held_out)]).withColumn("Private_Spans", F.lit(1))
    out = private.find_private_spans(table, model)
    seen = Counter()
    for row in out.withColumn("clean", private.redacted(F.col("text"), F.col("private_spans"))).collect():
        text, truth = held_out[row["doc_id"]]
        found = {(s["kind"], text[s["start"] : s["end"]]) for s in row["private_spans"]}
        seen.update(caught=len(found & truth), missed=len(truth - found), wrong=len(found - truth))
        assert all(span not in row["clean"] for _, span in found)
    assert seen["caught"] / (seen["caught"] + seen["missed"]) >= 0.95 and seen["wrong"] <= 0.05 * seen["caught"], seen


def test_model_does_not_depend_on_files(spark, texts_and_truth):
    table = documents(spark, [(i, t, "pt") for i, (t, _) in enumerate(texts_and_truth)])
    one, other = (private.fit_private_model(table.repartition(n)) for n in (1, 7))
    assert np.array_equal(one.prior, other.prior) and np.allclose(one.weights, other.weights, atol=1e-9)


def test_query_equals_contract(spark, tmp_path, texts_and_truth):
    texts = [t for t, _ in texts_and_truth[:20]] + odd_texts() + TRICKY + [None, "same a@b.cd", "same a@b.cd"]
    documents(spark, [(i, t, "en") for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {row["doc_id"]: row for row in queries.op11_private_data(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        base = base_by_hand(text or "")
        shown = [f"{k}:{a}:{b}" for k, a, b in base]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(k == b[0] for b in base) for k in BASE]
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert [s for s in spans if s in set(shown)] == shown
        places = [(int(s.split(":")[1]), private.KINDS.index(s.split(":")[0])) for s in spans]
        assert places == sorted(places)
    assert got[len(texts) - 1]["spans"] == got[len(texts) - 2]["spans"] == "email:5:11"


def test_no_candidates_no_rows_and_transcribed_pages(spark):
    empty = documents(spark, [])
    model = private.fit_private_model(empty)
    assert private.find_private_spans(empty, model).count() == 0
    pages = document_texts(adapters.a1_words(spark, "/root/testdata/sf0.001"), adapters.a1_pages(spark, "/root/testdata/sf0.001"))
    found = private.find_private_spans(pages, private.fit_private_model(pages)).collect()
    assert len(found) == pages.count() > 100
    for row in found:
        assert [(s["kind"], s["start"], s["end"]) for s in row["private_spans"] if s["base"]] == base_by_hand(row["text"])
