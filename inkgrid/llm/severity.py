"""How severe the language of a transcribed text is: cumulative-link ordinal regression.

Findings of this library have an ordered severity (none, yellow, red); so have texts here. One weight per sparse
feature (words and word beginnings, hashed) is shared by all thresholds: P(grade > k) = sigmoid(w.x - threshold k),
thresholds ascending. The expected severity is the sum of these probabilities.

The model is fitted on a bounded sample of graded texts (``max_rows``); every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import drawn_labels
from inkgrid.llm.features import SparseRows, hashed_words

DIMS = 1 << 18


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class SeverityModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def over(self, texts: Iterable[str | None]) -> np.ndarray:
        """P(grade > k) of each text for each threshold k."""
        scores = []
        for text in texts:
            indices, values = hashed_words(text, DIMS)
            scores.append(self.weights[indices] @ values)
        return sigmoid(np.array(scores)[:, None] - self.thresholds[None, :])


def log_odds(rows: SparseRows, severe: np.ndarray) -> np.ndarray:
    """How much more often each feature stands in severe rows than in others, as a logarithm."""
    yes = np.bincount(rows.indices, severe[rows.row], minlength=DIMS)
    no = np.bincount(rows.indices, ~severe[rows.row], minlength=DIMS)
    return np.log((yes + 0.5) / (severe.sum() + 1)) - np.log((no + 0.5) / ((~severe).sum() + 1))


def fit_ordinal(
    rows: SparseRows, grades: np.ndarray, steps: int = 300, rate: float = 0.1, penalty: float = 1e-3,
    min_rows: int = 8,
) -> SeverityModel:
    """Weights and thresholds of greatest penalised likelihood, by AdaGrad over all rows at once.

    Feature values are scaled by the feature's log-odds of severe rows, so that what tells nothing learns nothing.
    """
    odds = log_odds(rows, grades > 0)
    # features of few rows would only learn these rows by heart
    common = (np.bincount(rows.indices, minlength=DIMS) >= min_rows)[rows.indices]
    row = rows.row[common]
    used, column = np.unique(rows.indices[common], return_inverse=True)
    values = rows.values[common] * odds[used][column]
    levels, n = int(grades.max()), len(grades)
    weights, history = np.zeros(len(used)), np.full(len(used), 1e-8)
    # thresholds as a first one and logarithms of the steps up, so that they ascend
    above = np.array([(grades > k).mean() for k in range(levels)]).clip(1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(-np.log(above / (1 - above)) + 1e-3 * np.arange(levels))
    first, ups = start[0], np.log(np.maximum(np.diff(start), 1e-2))
    bend = np.full(levels, 1e-8)
    for _ in range(steps):
        thresholds = first + np.concatenate([[0.0], np.cumsum(np.exp(ups))])
        score = np.bincount(row, weights[column] * values, minlength=n)
        # P(grade > k) with 1 below and 0 above all thresholds
        over = np.hstack([np.ones((n, 1)), sigmoid(score[:, None] - thresholds), np.zeros((n, 1))])
        at = np.arange(n)
        upper, lower = over[at, grades], over[at, grades + 1]
        share = np.maximum(upper - lower, 1e-9)
        slope_upper, slope_lower = upper * (1 - upper) / share, lower * (1 - lower) / share
        push = slope_upper - slope_lower
        gradient = np.bincount(column, push[row] * values, minlength=len(used)) / n - penalty * weights
        history += gradient**2
        weights += rate * gradient / np.sqrt(history)
        by_threshold = np.bincount(grades, slope_lower, minlength=levels + 1)[:levels] - np.bincount(
            grades, slope_upper, minlength=levels + 1
        )[1 : levels + 1]
        tail = np.cumsum(by_threshold[::-1])[::-1] / n
        step = np.concatenate([[tail[0]], tail[1:] * np.exp(ups)])
        bend += step**2
        moved = rate * step / np.sqrt(bend)
        first, ups = first + moved[0], ups + moved[1:]
    full = np.zeros(DIMS)
    full[used] = weights * odds[used]
    return SeverityModel(full, first + np.concatenate([[0.0], np.cumsum(np.exp(ups))]))


def severity_grades(rows: SparseRows, severe: np.ndarray) -> np.ndarray:
    """Grades 0 (not severe), 1 and 2 from yes/no marks: of the severe texts, those with more of the features that
    severe texts have far more often than others (a log-odds of 3 or more) than the median one get 2."""
    telling = (log_odds(rows, severe) >= 3) & (np.bincount(rows.indices, severe[rows.row], minlength=DIMS) >= 5)
    told = np.bincount(rows.row, telling[rows.indices], minlength=rows.n)
    return np.where(severe, np.where(told > np.median(told[severe]) if severe.any() else 0, 2, 1), 0)


def fit_severity(texts: DataFrame, grades: DataFrame, max_rows: int = 4_000) -> SeverityModel | None:
    """A model from ``texts`` (``doc_id``, ``text``) and ``grades`` (``doc_id``, and ``grade`` from 0 upwards or
    ``severe`` yes/no); None if all have one grade.

    About ``max_rows`` grades at most are used, drawn by a hash of the id, so no text is shuffled. Rows with NULL are left
    out; an id with several grades counts once for each.
    """
    mark = "grade" if "grade" in grades.columns else "severe"
    usable = grades.select("doc_id", F.col(mark).cast("int").alias("mark")).dropna()
    drawn = texts.select("doc_id", "text").dropna().join(drawn_labels(usable, max_rows), "doc_id").select("text", "mark")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [hashed_words(text, DIMS) for text in batch["text"]]
            indices, values = zip(*found) if found else ((), ())
            yield pd.DataFrame({"mark": batch["mark"], "indices": list(indices), "values": list(values)})

    sample = drawn.mapInPandas(featured, "mark int, indices array<int>, values array<float>").toPandas()
    if sample.empty or sample["mark"].nunique() < 2:
        return None
    rows = SparseRows.of(zip(sample["indices"], sample["values"]))
    marks = sample["mark"].to_numpy()
    grades = marks if mark == "grade" else severity_grades(rows, marks > 0)
    return fit_ordinal(rows, grades)


def score_severity(texts: DataFrame, model: SeverityModel | None) -> DataFrame:
    """``texts`` with ``expected_severity`` (double) and ``severe`` (boolean: some severity is more likely than none).

    Old columns of these names give way. NULL and empty texts have the severity of a text without features; without
    a model all have 0.0 and false. Rows are scored one by one, so repeated rows agree; empty tables stay empty.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected double, severe boolean")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            if model is None:
                yield pd.DataFrame({"expected": 0.0, "severe": False}, index=range(len(batch)))
                continue
            over = model.over(batch)
            yield pd.DataFrame({"expected": over.sum(axis=1), "severe": over[:, 0] > 0.5})

    scored = texts.withColumn("expected_severity", score("text"))
    fields = scored["expected_severity"]
    return scored.withColumns({"severe": fields["severe"], "expected_severity": fields["expected"]})
