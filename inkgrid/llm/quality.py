"""Quality of a transcribed text by co-training on two views of it.

One classifier sees how the text is written (``content_features``), the other only what is known of the document
without reading it: language, source and size (``metadata_features``). Both start from the same labelled rows. In
each round each of them labels the unlabelled rows it is surest of, and the *other* one learns from them. At the end
each view is calibrated on labelled rows neither has learned from, and the calibrated log-odds are combined; a view
that tells nothing gets little weight there.

Labels are a bounded sample (``max_labelled``, drawn by a hash of the id). All other texts are the unlabelled rows: their
features are written once, and each round Spark counts their scores and sums gradients and curvature over those that a
view has labelled. Texts of labelled rows, copies included, are none of them. Only sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import drawn_labels, kept
from inkgrid.llm.features import CONTENT_DIMS, METADATA_DIMS, content_features, metadata_features


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights (intercept last) of greatest penalised likelihood, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weights = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], penalty)
    keep[-1] = 1e-9
    for _ in range(steps):
        p = sigmoid(x @ weights)
        gradient = x.T @ (y - p) / len(y) - keep * weights
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x / len(y) + np.diag(keep)
        step = np.linalg.solve(curve, gradient)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def logits(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return x @ weights[:-1] + weights[-1]


@dataclass
class QualityModel:
    content: np.ndarray
    metadata: np.ndarray
    #: Slope and intercept of each view, then weights of both and intercept.
    calibration: tuple[np.ndarray, np.ndarray, np.ndarray]

    def score(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """Probability of good quality."""
        of_content, of_metadata, of_both = self.calibration
        views = np.column_stack([
            logits(logits(content, self.content)[:, None], of_content),
            logits(logits(metadata, self.metadata)[:, None], of_metadata),
        ])
        return sigmoid(logits(views, of_both))


#: Scores are counted by log-odds in steps of 1/100, from -40 to 40.
REACH, STEPS = 40, 100
#: Tasks that go through the unlabelled rows at most; each sends its sums to the driver.
TASKS = 96

Views = tuple[np.ndarray, np.ndarray]


def score_bins(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.floor((np.clip(logits(x, weights), -REACH, REACH) + REACH) * STEPS).astype(np.int64)


@dataclass
class Round:
    """What each view labels in a round: scores beyond a bin, and of the bin itself the rows with ties below a part."""

    weights: Views
    good: list[tuple[int, float]]
    bad: list[tuple[int, float]]


def given_marks(views: Views, ties: np.ndarray, rounds: list[Round]) -> tuple[list[np.ndarray], np.ndarray]:
    """The marks each view gave (-1 for none), and the rows still free."""
    free = np.ones(len(ties), dtype=bool)
    marks = [np.full(len(ties), -1), np.full(len(ties), -1)]
    for past in rounds:
        taken = np.zeros(len(ties), dtype=bool)
        for view in (0, 1):
            bins = score_bins(views[view], past.weights[view])
            (top, top_part), (low, low_part) = past.good[view], past.bad[view]
            good = free & ((bins > top) | (bins == top) & (ties < top_part))
            bad = free & ((bins < low) | (bins == low) & (ties < low_part))
            marks[view][good], marks[view][bad] = 1, 0
            taken |= good | bad
        free &= ~taken
    return marks, free


def counted(views: Views, ties: np.ndarray, rounds: list[Round], weights: Views) -> np.ndarray:
    """Free rows by score bin of each view, then the number of all rows."""
    _, free = given_marks(views, ties, rounds)
    size = 2 * REACH * STEPS + 1
    counts = [np.bincount(score_bins(views[v][free], weights[v]), minlength=size) for v in (0, 1)]
    return np.concatenate([*counts, [len(ties)]]).astype(float)


def newton_sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Gradient, curvature and number of rows, one after another."""
    x = np.hstack([x, np.ones((len(x), 1))])
    p = sigmoid(x @ weights)
    curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x
    return np.concatenate([x.T @ (y - p), curve.ravel(), [len(y)]])


def learned(views: Views, ties: np.ndarray, rounds: list[Round], weights: Views) -> np.ndarray:
    """Sums for both views, each over the rows that the other one labelled."""
    marks, _ = given_marks(views, ties, rounds)
    told = [marks[1 - v] >= 0 for v in (0, 1)]
    return np.concatenate([newton_sums(views[v][told[v]], marks[1 - v][told[v]], weights[v]) for v in (0, 1)])


Pool = Callable[[Callable[..., np.ndarray], list[Round], Views], np.ndarray]


def local_pool(views: Views) -> Pool:
    ties = (np.arange(len(views[0])) + 0.5) / max(1, len(views[0]))
    return lambda sums, rounds, weights: sums(views, ties, rounds, weights)


def spark_pool(rows: DataFrame) -> Pool:
    """Sums over ``tie`` (double), ``content`` (70 floats) and ``metadata`` (3 numbers of bins)."""

    def added(sums: Callable[..., np.ndarray], rounds: list[Round], weights: Views) -> np.ndarray:
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for batch in batches:
                if len(batch):
                    found = sums(unpacked(batch), batch["tie"].to_numpy(), rounds, weights)
                    total = found if total is None else total + found
            if total is not None:
                yield pd.DataFrame({"sums": [total.tobytes()]})

        parts = rows.coalesce(TASKS).mapInPandas(add, "sums binary").toLocalIterator()
        return sum((np.frombuffer(bytes(row["sums"])) for row in parts), np.zeros(1))

    return added


def packed(content: np.ndarray, metadata: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    return (
        [row.tobytes() for row in content.astype(np.float32)],
        [np.flatnonzero(row).astype(np.uint8).tobytes() for row in metadata],
    )


def unpacked(batch: pd.DataFrame) -> Views:
    content = np.frombuffer(b"".join(batch["content"]), dtype=np.float32).reshape(len(batch), CONTENT_DIMS).astype(float)
    metadata = np.zeros((len(batch), METADATA_DIMS))
    bins = np.frombuffer(b"".join(batch["metadata"]), dtype=np.uint8).reshape(len(batch), -1)
    np.put_along_axis(metadata, bins.astype(np.int64), 1.0, axis=1)
    return content, metadata


def surest(counts: np.ndarray, quota: float, bound: int) -> tuple[int, float]:
    """The bin down to which ``quota`` rows with the highest scores go, not below ``bound``, and the part of it that is in."""
    above = np.cumsum(counts[::-1])[::-1]
    over = np.flatnonzero(above > quota)
    at = int(over[-1]) if len(over) else -1
    if at < bound:
        return bound - 1, 0.0
    return at, float((quota - (above[at] - counts[at])) / counts[at])


def co_train(
    views: Views, y: np.ndarray, pool: Views | Pool, check: np.ndarray,
    rounds: int = 5, share: float = 0.02, sure: float = 0.95,
) -> QualityModel:
    """Classifiers of both views; ``check`` marks the labelled rows kept for calibration. From an empty pool nothing is learned.

    Each round a view hands over at most ``share`` of the pool, and only rows it is ``sure`` of. Of these the part
    with either label is that of the labelled rows. Where the pool has more rows than the labels, its rows weigh less, so
    that the weight of all it teaches does not depend on the size of the corpus.
    """
    pool = pool if callable(pool) else local_pool(pool)
    learn = ~check
    own, marks = [view[learn] for view in views], y[learn]
    prior = marks.mean()
    weights = tuple(fit_logistic(view, marks) for view in own)
    past: list[Round] = []
    size, bound = 2 * REACH * STEPS + 1, int(np.ceil((np.log(sure / (1 - sure)) + REACH) * STEPS))
    for _ in range(rounds):
        counts = pool(counted, past, weights)
        if len(counts) == 1:
            break
        n, by_view = counts[-1], (counts[:size], counts[size : 2 * size])
        most = int(share * n)
        quota = [max(1, round(most * part)) for part in (prior, 1 - prior)]
        good = [surest(by_view[v], quota[0], bound) for v in (0, 1)]
        bad = [surest(by_view[v][::-1], quota[1], bound) for v in (0, 1)]
        past.append(Round(weights, good, [(size - 1 - at, part) for at, part in bad]))
        weights = fit_with_pool(own, marks, pool, past, weights, min(1.0, len(marks) / n))
    told = [logits(views[view][check], weights[view])[:, None] for view in (0, 1)]
    single = [fit_logistic(column, y[check]) for column in told]
    both = fit_logistic(np.column_stack([logits(column, own) for column, own in zip(told, single)]), y[check])
    return QualityModel(weights[0], weights[1], (single[0], single[1], both))


def fit_with_pool(
    own: list[np.ndarray], y: np.ndarray, pool: Pool, past: list[Round], weights: Views, weight: float,
    penalty: float = 1e-3, steps: int = 25,
) -> Views:
    """As ``fit_logistic``, for both views at once over labelled rows and, by ``weight``, what the pool was given."""
    for _ in range(steps):
        sums, at, steps_made, after = pool(learned, past, weights), 0, [], []
        for view in (0, 1):
            k = len(weights[view])
            total = newton_sums(own[view], y, weights[view]) + weight * sums[at : at + k + k * k + 1]
            at += k + k * k + 1
            keep = np.full(k, penalty)
            keep[-1] = 1e-9
            curve = total[k:-1].reshape(k, k) / total[-1] + np.diag(keep)
            step = np.linalg.solve(curve, total[:k] / total[-1] - keep * weights[view])
            steps_made.append(np.abs(step).max())
            after.append(weights[view] + step)
        weights = (after[0], after[1])
        if max(steps_made) < 1e-4:
            break
    return weights


def both_views(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    content = np.array([content_features(text) for text in batch["text"]])
    metadata = np.array([metadata_features(*row) for row in zip(batch["lang"], batch["source"], batch["n_chars"])])
    return content, metadata


VIEW = ["text", "lang", "source", "n_chars"]


def views_of(rows: DataFrame) -> pd.DataFrame:
    """Marks and features of a bounded number of rows, on the driver."""

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                content, metadata = both_views(batch)
                yield pd.DataFrame({"mark": batch["mark"], "content": list(content), "metadata": list(metadata)})

    return rows.select("mark", *VIEW).mapInPandas(featured, "mark int, content array<double>, metadata array<double>").toPandas()


def pool_of(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Features of all ``texts`` but those of ``known`` (bounded), written once."""
    labelled = np.array([row[0] for row in known.select(F.xxhash64("text")).distinct().collect()], dtype=np.int64)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[~np.isin(batch["text_hash"].to_numpy(), labelled)]
            if len(batch):
                content, metadata = packed(*both_views(batch))
                yield pd.DataFrame({"tie": batch["tie"].to_numpy(), "content": content, "metadata": metadata})

    # ties are parted by document, so that copies of one text do not come all or none
    tie = (F.pmod(F.xxhash64("doc_id", F.lit("tie")), F.lit(1_000_003)) / 1_000_003).alias("tie")
    rows = texts.select(*VIEW, F.xxhash64("text").alias("text_hash"), tie)
    return kept(rows.mapInPandas(featured, "tie double, content binary, metadata binary"))


def fit_quality(texts: DataFrame, labels: DataFrame, max_labelled: int = 12_000) -> QualityModel | None:
    """A model from ``texts`` (``doc_id``, ``text``, ``lang``, ``source``, ``n_chars``) and ``labels`` (``doc_id``,
    ``quality`` 0/1); None where the labels have one class only or too few rows to check by.

    NULL labels and texts are left out. A document with several labels counts once for each.
    """
    full = texts.filter("text is not null").select("doc_id", *VIEW)
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("mark")).dropna()
    labelled = full.join(drawn_labels(marks, max_labelled), "doc_id")
    known = views_of(labelled)
    if known.empty:
        return None
    known = known.sort_values("mark", kind="stable", ignore_index=True)
    y = known["mark"].to_numpy(dtype=float)
    check = np.arange(len(known)) % 4 == 3
    if min(len(set(y[check])), len(set(y[~check]))) < 2:
        return None
    content, metadata = (np.vstack(known[c]) for c in ("content", "metadata"))
    return co_train((content, metadata), y, spark_pool(pool_of(full, labelled)), check)


def score_quality(texts: DataFrame, model: QualityModel | None) -> DataFrame:
    """``texts`` with ``quality_score`` (double, 0 to 1) and ``keep`` (boolean, 0.5 or more).

    Old columns of these names give way. NULL counts as an empty text, an unknown language, source or size. Without a
    model all texts have 0.5 and stay. Rows are scored one by one, so repeated rows agree; empty tables stay empty.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = shared.value
        for columns in batches:
            batch = pd.DataFrame(dict(zip(VIEW, columns)))
            if model is None or not len(batch):
                yield pd.Series([0.5] * len(batch), dtype=float)
            else:
                yield pd.Series(model.score(*both_views(batch)))

    scored = texts.withColumn("quality_score", score(*VIEW))
    return scored.withColumn("keep", F.col("quality_score") >= 0.5)
