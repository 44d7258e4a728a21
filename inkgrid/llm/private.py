"""Personal data in transcribed texts, by weak supervision.

Time cards and payslips name real people, with taxpayer numbers, telephones and bank details. Marked texts to learn from do
not exist, so labelers vote instead:

1. *Candidates*: spans of fixed base patterns, which always stay, and of looser ones (written-out addresses, national
   telephones, numbers within a rejected run of digits, taxpayer numbers, names of persons).
2. *Labelers* vote +1 (private), -1 (not) or 0 (no opinion) on each candidate: two regex labelers (form, check digits), a
   gazetteer, and three of context (cue words before, marks of an amount, edges).
3. *Expectation-maximisation*, kind by kind, estimates how each labeler votes on private and on other spans, and how
   many are private. Only counts of equal vote rows leave the tasks: at most ``3 ** 6`` for a kind, whatever the corpus.
4. *Final classifier*: a logistic regression on coarse features of the span itself learns the estimated probabilities;
   only counts of equal feature rows are collected, whose number is bounded by the features' ranges. It decides about all
   candidates that are no base spans.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import kept

KINDS = ("email", "ip", "card", "phone", "cpf", "person")
LABELERS = ("form", "check", "gazetteer", "cue", "amount", "edges")

# --- fixed values: base patterns ----------------------------------------------------------------
# email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   found from its at sign, in linear time
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"[A-Za-z0-9-]++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# --- fixed values: gazetteers and cue words ------------------------------------------------------
TOP_DOMAINS = frozenset("com org net edu gov br de es fr it pt uk us eu info io".split())
AREA_CODES = frozenset(
    "11 12 13 14 15 16 17 18 19 21 22 24 27 28 31 32 33 34 35 37 38 41 42 43 44 45 46 47 48 49 51 53 54 55 61 62 63 64"
    " 65 66 67 68 69 71 73 74 75 77 79 81 82 83 84 85 86 87 88 89 91 92 93 94 95 96 97 98 99".split()
)
GIVEN_NAMES = (
    "Adriana Alessandra Alexandre Aline Amanda Ana Anderson André Antônia Antônio Beatriz Bruna Bruno Camila Carla Carlos"
    " Cláudia Cristiane Daniel Daniela Diego Eduardo Eliane Fábio Felipe Fernanda Fernando Francisca Francisco Gabriel"
    " Gabriela Guilherme Gustavo Helena Isabel Jéssica João Joaquim Jorge José Josefa Juliana Júlio Larissa Leandro"
    " Letícia Lucas Luciana Luís Luiz Manoel Marcelo Márcia Márcio Marcos Maria Mariana Mário Mateus Paula Paulo Patrícia"
    " Pedro Rafael Raimundo Renata Renato Ricardo Roberto Rodrigo Rosângela Sandra Sebastião Sérgio Silvia Simone Sônia"
    " Tatiane Thiago Vanessa Vera Vinícius Vitória Viviane".split()
)
COMPANY_WORDS = frozenset("ltda eireli me sa comercio industria servicos banco hospital prefeitura sindicato total".split())
PARTICLES = frozenset("da de do das dos e".split())
CUES = {
    "email": frozenset("email mail correio contato".split()),
    "ip": frozenset("ip host servidor server".split()),
    "card": frozenset("cartao card visa mastercard credito debito karte carte tarjeta".split()),
    "phone": frozenset("fone telefone tel telephone phone celular whatsapp contato ramal fax".split()),
    "cpf": frozenset("cpf contribuinte".split()),
    "person": frozenset("nome funcionario funcionaria empregado empregada colaborador colaboradora trabalhador trabalhadora"
                        " name employee".split()),
}
OTHER_CUES = frozenset("token hash sha id versao version pedido protocolo processo nota codigo serie secret key".split())
FOREIGN_CUES = [OTHER_CUES.union(*(CUES[k] for k in KINDS if k != kind)) for kind in KINDS]
ALL_CUES = OTHER_CUES.union(*CUES.values())

# --- looser patterns -----------------------------------------------------------------------------
WRITTEN_EMAIL = re.compile(
    r"(?<![\w.%+-])[A-Za-z0-9._%+-]++\x20?(?:\((?:at|arroba)\)|\[(?:at|arroba)\])\x20?[A-Za-z0-9-]++"
    r"(?:\x20?(?:\.|\((?:dot|ponto)\)|\[(?:dot|ponto)\])\x20?[A-Za-z0-9-]++)+", re.I
)
TIGHT_PHONE = re.compile(
    r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,5}){2,3}(?![0-9])"
)
NATIONAL_PHONE = re.compile(r"(?<![\w+.(-])(?:\([1-9][0-9]\)|[1-9][0-9])[\x20-]?9?[0-9]{4}-[0-9]{4}(?![\w-])")
CPF = re.compile(r"(?<![\w.-])(?:[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}|[0-9]{11})(?![\w-])")
DIGITS = re.compile(r"[0-9]++")
CAPITAL = r"[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ]++"
NAME = re.compile(rf"{CAPITAL}(?:\x20(?:(?:d[aeo]s?|e|D[AEO]S?|E)\x20)?{CAPITAL})++")
NAMED = re.compile(
    r"\b(?:nome|funcion[áa]ri[oa]|empregad[oa]|colaborador(?:a)?|trabalhador(?:a)?|name|employee)\x20?:\x20?", re.I
)
WORD = re.compile(r"[^\W\d_]+")


def folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


KNOWN_NAMES = frozenset(map(folded, GIVEN_NAMES))
FIRST_NAME = re.compile(r"\b(?:" + "|".join(sorted({n for g in GIVEN_NAMES for n in (g, g.upper())})) + r")\x20(?=[A-ZÀ-Þde])")


def digits_of(text: str) -> str:
    return "".join(DIGITS.findall(text))


def luhn(digits: str) -> bool:
    twice = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def cpf_holds(digits: str) -> bool:
    """Both check digits of a taxpayer number, weights falling to 2, remainder of 11."""
    def check(n: int) -> int:
        rest = sum(int(d) * w for d, w in zip(digits[:n], range(n + 1, 1, -1))) * 10 % 11
        return rest % 10
    return len(digits) == 11 and len(set(digits)) > 1 and digits[9:] == f"{check(9)}{check(10)}"


@dataclass(frozen=True)
class Found:
    kind: int
    start: int
    end: int
    base: bool


def card_holds(digits: str) -> bool:
    return 14 <= len(digits) <= 19 and luhn(digits)


def matches(text: str) -> Iterator[Found]:
    """Spans of the base patterns (``base``) and, as candidates, what looks like one but fails its test."""
    at, done, free = text.find("@"), 0, 0
    while at >= 0:
        # the run of characters before the sign, back to the last match or sign
        start = at - len(text[free:at]) + len(text[free:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield Found(0, start, done, True)
        elif start < at and (host := HOST.match(text, at + 1)):
            yield Found(0, start, host.end(), False)
        free = max(at + 1, done)
        at = text.find("@", free)
    if not DIGITS.search(text):
        return
    for m in IP.finditer(text):
        # long parts are over 255 whatever they say, unless zeros lead
        yield Found(1, *m.span(), all(len(p.lstrip("0")) < 4 and int(p[-3:]) < 256 for p in m.group().split(".")))
    for m in CARD.finditer(text):
        if len(m.group()) >= 12:
            digits = digits_of(m.group())
            if card_holds(digits):
                yield Found(2, *m.span(), True)
            elif len(digits) >= 12:
                yield from within_run(m)
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(digits_of(m.group())) <= 15:
            yield Found(3, *m.span(), True)
        elif inner := TIGHT_PHONE.match(text, m.start()):
            yield Found(3, *inner.span(), False)


def within_run(run: re.Match[str]) -> Iterator[Found]:
    """Numbers as long as a card's within a run of digits that is none as a whole: groups by themselves, or four fours."""
    groups = [m.span() for m in DIGITS.finditer(run.string, *run.span())]
    for i, (start, end) in enumerate(groups):
        if 14 <= end - start <= 19:
            yield Found(2, start, end, False)
        elif [b - a for a, b in groups[i : i + 4]] == [4, 4, 4, 4] and card_holds(
            "".join(run.string[a:b] for a, b in groups[i : i + 4])
        ):
            yield Found(2, start, groups[i + 3][1], False)


def looser(text: str) -> Iterator[Found]:
    """Candidates that no base pattern describes."""
    if "(" in text or "[" in text:
        yield from (Found(0, *m.span(), False) for m in WRITTEN_EMAIL.finditer(text))
    yield from (Found(3, *m.span(), False) for m in NATIONAL_PHONE.finditer(text))
    for m in CPF.finditer(text):
        if m.end() - m.start() == 14 or "cpf" in text[max(0, m.start() - 12) : m.start()].lower():
            yield Found(4, *m.span(), False)
    starts = {m.end() for m in NAMED.finditer(text)} if ":" in text else set()
    starts |= {m.start() for m in FIRST_NAME.finditer(text)}
    end = 0
    for start in sorted(starts):
        if start >= end and (m := NAME.match(text, start)):
            end = m.end()
            if stop := name_end(m):
                yield Found(5, start, stop, False)


def name_end(name: re.Match[str]) -> int:
    """Where a name ends that runs up to the next cue word; 0 if less than two words are left."""
    words = []
    for word in WORD.finditer(name.string, *name.span()):
        if folded(word.group()) in ALL_CUES:
            break
        words.append(word)
    while words and folded(words[-1].group()) in PARTICLES:
        words.pop()
    return words[-1].end() if len(words) > 1 else 0


def candidates(text: str) -> list[Found]:
    """Base spans, and other candidates that overlap no base span of their kind."""
    found = list(matches(text))
    base = sorted((f for f in found if f.base), key=lambda f: (f.kind, f.start))
    rest = {f for f in [*found, *looser(text)] if not f.base}
    taken: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for kind in range(len(KINDS)):
        spans = [(f.start, f.end) for f in base if f.kind == kind]
        taken[kind] = (np.array([s for s, _ in spans]), np.array([e for _, e in spans]))

    def free(f: Found) -> bool:
        starts, ends = taken[f.kind]
        i = int(np.searchsorted(starts, f.end)) - 1
        return i < 0 or ends[i] <= f.start

    return base + sorted(filter(free, rest), key=lambda f: (f.start, f.kind, f.end))


# --- labelers ------------------------------------------------------------------------------------


def sign(test: bool) -> int:
    return 1 if test else -1


def checked(kind: int, span: str) -> int:
    """Check digits and ranges."""
    if kind == 1:
        return sign(all(len(p.lstrip("0")) < 4 and int(p[-3:]) < 256 for p in span.split(".")))
    if kind == 2:
        return sign(card_holds(digits_of(span)))
    if kind == 3:
        return sign(10 <= len(digits_of(span)) <= 15)
    if kind == 4:
        return sign(cpf_holds(digits_of(span)))
    return 0


def listed(kind: int, span: str) -> int:
    """Gazetteers of domains, issuers, dialling codes, names."""
    if kind == 0:
        return sign(re.split(r"[^A-Za-z0-9]+", span)[-1].lower().rstrip("0123456789-") in TOP_DOMAINS)
    if kind == 1:
        return sign(span.split(".")[0] not in ("0", "00", "000", "255"))
    if kind == 2:
        return sign(digits_of(span)[0] in "23456")
    if kind == 3:
        return 1 if span[0] == "+" and span[1] != "0" else sign(digits_of(span)[:2] in AREA_CODES)
    if kind == 5:
        words = [folded(w) for w in WORD.findall(span)]
        return -1 if COMPANY_WORDS & set(words) else int(words[0] in KNOWN_NAMES)
    return 0


def cued(kind: int, before: str) -> int:
    """The last four words on the line before the span."""
    words = {folded(w) for w in WORD.findall(before.rpartition("\n")[2])[-4:]}
    if words & CUES[KINDS[kind]]:
        return 1
    return -1 if words & FOREIGN_CUES[kind] else 0


def edged(text: str, start: int, end: int) -> int:
    """Whether the span stands free of letters, digits and signs of code."""
    glued = "\"'=_/\\#@&"
    before, after = text[start - 1 : start], text[end : end + 1]
    return sign(not any(c.isalnum() or c in glued for c in (before, after) if c))


def votes(text: str, found: Found) -> tuple[int, ...]:
    span = text[found.start : found.end]
    before, after = text[max(0, found.start - 48) : found.start], text[found.end : found.end + 4]
    money = bool(re.search(r"[$€£]\s?$", before) or re.match(r",\d\d|\s?%", after))
    return (
        sign(found.base or found.kind > 3 or found.kind == 3 and span[0] != "+"), checked(found.kind, span),
        listed(found.kind, span), cued(found.kind, before), -int(money), edged(text, found.start, found.end),
    )


# --- features of the final classifier ---------------------------------------------------------------

#: How many values each feature has.
RANGES = (3, 3, 3, 2, 8, 4, 6)


def features(text: str, found: Found, cast: tuple[int, ...]) -> tuple[int, ...]:
    """Check, gazetteer and cue, edges, number of digits, separators, length: each one of a few values."""
    span = text[found.start : found.end]
    digits, marks = len(digits_of(span)), sum(not c.isalnum() for c in span)
    return (
        cast[1] + 1, cast[2] + 1, cast[3] + 1, (cast[5] + 1) // 2, min(digits // 3, 7), min(marks, 3),
        min(len(span).bit_length(), 6) - 1,
    )


def one_hot(kind: int, values: Iterable[int]) -> list[int]:
    """Indices of a kind's features that are 1."""
    offsets = np.cumsum((0, *RANGES[:-1]))
    first = kind * (sum(RANGES) + 1)
    return [first, *(first + 1 + int(o) + v for o, v in zip(offsets, values))]


DIMS = len(KINDS) * (sum(RANGES) + 1)


@dataclass
class PrivateModel:
    """``prior[kind]``, ``reliability[kind, labeler, class, vote + 1]`` and the classifier's ``weights``."""

    prior: np.ndarray
    reliability: np.ndarray
    weights: np.ndarray
    _known: dict[tuple[int, ...], float] = field(default_factory=dict)

    def score(self, kind: int, values: tuple[int, ...]) -> float:
        """P(private) of a span with these features; there are few different ones."""
        key = (kind, *values)
        if key not in self._known:
            self._known[key] = float(1 / (1 + np.exp(-self.weights[one_hot(kind, values)].sum())))
        return self._known[key]


#: Votes that each labeler is taken to have cast before any is seen, for other and for private spans.
BEFORE = np.array([[6.0, 3.0, 1.0], [1.0, 3.0, 6.0]])


def posterior(cast: np.ndarray, prior: float, reliability: np.ndarray) -> np.ndarray:
    """P(private) of rows of votes, by labelers that err independently."""
    at = np.arange(len(LABELERS))
    logs = np.log(reliability)
    private = np.log(prior) + logs[at, 1, cast + 1].sum(axis=1)
    other = np.log(1 - prior) + logs[at, 0, cast + 1].sum(axis=1)
    return 1 / (1 + np.exp(np.clip(other - private, -500, 500)))


def estimate(cast: np.ndarray, count: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Share of private spans and labelers' behaviour (labeler, class, vote + 1) from counted rows of votes."""
    reliability = np.tile(BEFORE / 10, (len(LABELERS), 1, 1))
    prior = 0.5
    for _ in range(rounds):
        private = posterior(cast, prior, reliability)
        before, prior = prior, float((count @ private + 1) / (count.sum() + 2))
        for labeler in range(len(LABELERS)):
            for side, share in enumerate((1 - private, private)):
                seen = np.bincount(cast[:, labeler] + 1, count * share, minlength=3) + BEFORE[side]
                reliability[labeler, side] = seen / seen.sum()
        if abs(prior - before) < 1e-12:
            break
    return prior, reliability


def fit_logistic(rows: list[list[int]], count: np.ndarray, share: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of greatest penalised likelihood for counted rows of a share of private ones, by Newton's method."""
    x = np.zeros((len(rows), DIMS))
    for row, ones in zip(x, rows):
        row[ones] = 1
    weights = np.zeros(DIMS)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ weights))
        gradient = x.T @ (count * (share - p)) - penalty * weights
        bend = (x * (count * p * (1 - p))[:, None]).T @ x + penalty * np.eye(DIMS)
        step = np.linalg.solve(bend, gradient)
        weights += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-10:
            break
    return weights


def fit_private_model(texts: DataFrame) -> PrivateModel:
    """Reliabilities and classifier from all of ``texts`` (``text``); no marks are needed.

    Every candidate of every text counts. Tasks count equal rows of votes and features themselves, so neither a hot key
    nor a long text gathers anywhere; the counts are written once and read for the votes, then for the features.
    """
    votes_of, features_of = [f"v{i}" for i in range(len(LABELERS))], [f"f{i}" for i in range(len(RANGES))]
    names = ["kind", *votes_of, *features_of]

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[tuple[int, ...]] = Counter()
        for batch in batches:
            for text in batch["text"]:
                for found in candidates(text or ""):
                    cast = votes(text, found)
                    seen[(found.kind, *cast, *features(text, found, cast))] += 1
        if seen:
            yield pd.DataFrame([(*row, n) for row, n in seen.items()], columns=[*names, "n"])

    form = ", ".join(f"{name} int" for name in names) + ", n long"
    counts = kept(texts.select("text").mapInPandas(counted, form).groupBy(*names).agg(F.sum("n").alias("n")))
    prior, reliability = np.full(len(KINDS), 0.5), np.tile(BEFORE / 10, (len(KINDS), len(LABELERS), 1, 1))
    # at most 3 ** 6 rows for each kind
    cast = counts.groupBy("kind", *votes_of).agg(F.sum("n").alias("n")).toPandas().sort_values(["kind", *votes_of])
    for kind, rows in cast.groupby("kind"):
        prior[kind], reliability[kind] = estimate(rows[votes_of].to_numpy(), rows["n"].to_numpy(float))
        cast.loc[rows.index, "private"] = posterior(rows[votes_of].to_numpy(), prior[kind], reliability[kind])
    if cast.empty:
        return PrivateModel(prior, reliability, np.zeros(DIMS))
    judged = F.broadcast(texts.sparkSession.createDataFrame(cast.drop(columns="n")))
    shares = counts.join(judged, ["kind", *votes_of]).groupBy("kind", *features_of).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("private")).alias("private")
    )
    # at most as many rows as the ranges of the features allow
    learned = shares.toPandas().sort_values(["kind", *features_of])
    rows = [one_hot(row[0], row[1:]) for row in learned[["kind", *features_of]].to_numpy()]
    count = learned["n"].to_numpy(float)
    return PrivateModel(prior, reliability, fit_logistic(rows, count, learned["private"].to_numpy() / count))


def spans_of(text: str | None, model: PrivateModel, threshold: float) -> list[tuple[str, int, int, bool, float]]:
    """(kind, start, end, base, score) of one text, by start, then kind as listed, then end."""
    kept_spans: list[tuple[int, int, int, bool, float]] = []
    added: list[tuple[float, Found]] = []
    for found in candidates(text or ""):
        score = model.score(found.kind, features(text, found, votes(text, found)))
        if found.base:
            kept_spans.append((found.start, found.kind, found.end, True, score))
        elif score >= threshold:
            added.append((score, found))
    # of added spans of a kind that overlap, the likelier stays, then the earlier and longer
    ends: dict[int, list[tuple[int, int]]] = {}
    for score, found in sorted(added, key=lambda a: (a[1].kind, a[1].start, -a[0], -a[1].end)):
        last = ends.setdefault(found.kind, [])
        if not last or last[-1][1] <= found.start:
            last.append((found.start, found.end))
            kept_spans.append((found.start, found.kind, found.end, False, score))
    return [(KINDS[kind], start, end, base, score) for start, kind, end, base, score in sorted(kept_spans)]


def find_private_spans(texts: DataFrame, model: PrivateModel, threshold: float = 0.5) -> DataFrame:
    """``texts`` with ``private_spans``: array of struct(kind, start, end, base, score), by start, then kind.

    ``texts`` has ``doc_id`` and ``text``, one row per transcribed document; other columns stay, an old ``private_spans``
    gives way. Offsets are code points, the end is exclusive. Base spans always stand (leftmost, not overlapping within a
    kind); others from a score of ``threshold``. NULL and empty texts have no spans. Rows are judged one by one, whole:
    repeated rows agree, empty tables stay empty.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<kind: string, start: int, end: int, base: boolean, score: double>>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("kind", "start", "end", "base", "score")
        for batch in batches:
            yield pd.Series([[dict(zip(names, s)) for s in spans_of(text, shared.value, threshold)] for text in batch])

    return texts.withColumn("private_spans", judge("text"))


def listed_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first stands for both."""

    def step(done: Column, span: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, span["start"] - done["at"])
        piece = F.concat(done["out"], gap, F.lit("["), span["kind"], F.lit("]"))
        later = F.struct(piece.alias("out"), span["end"].alias("at"))
        longer = F.struct(done["out"].alias("out"), F.greatest(done["at"], span["end"]).alias("at"))
        return F.when(span["start"] >= done["at"], later).otherwise(longer)

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    rest = lambda end: F.concat(end["out"], F.substring(text, end["at"] + 1, F.char_length(text)))
    return F.aggregate(spans, start, step, rest)
