"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.llm.common import hash_sample, text_or_empty
from quartier.session import materialise

#: Labelled rows that the fit uses at most (those of least hash), words that get a weight, rows a word must be in.
SAMPLE, WORDS, LEAST_ROWS = 20_000, 4_096, 5
STEPS, RATE, RIDGE = 300, 0.1, 1e-3

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """Distinct lower-cased letter runs of the whole text."""
    return set(_WORD.findall(text.lower()))


class OrdinalModel:
    """P(grade > j) = sigmoid(w . x - theta_j): one weight per word for all thresholds, which are in order."""

    def __init__(self, words: list[str], grades: int):
        self.index = {w: i for i, w in enumerate(words)}
        self.weights, self.theta = np.zeros(len(words)), np.linspace(1.0, 3.0, max(grades - 1, 1))

    def above(self, place: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(place[:, None] - self.theta[None, :], -40, 40)))

    def place(self, text: str) -> float:
        get = self.index.get
        return float(sum(self.weights[i] for w in words_of(text) if (i := get(w)) is not None))

    def fit(self, rows: np.ndarray, columns: np.ndarray, grade: np.ndarray) -> None:
        """Adam on the ridge-penalised likelihood; x holds 1 at (rows, columns)."""
        n, k = len(grade), len(self.theta)
        cuts = np.concatenate([self.theta[:1], np.log(np.expm1(np.maximum(np.diff(self.theta), 1e-3)))])
        params = np.concatenate([self.weights, cuts])
        m, v = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, STEPS + 1):
            w, cuts = params[: len(self.weights)], params[len(self.weights) :]
            gaps = np.logaddexp(0, cuts[1:])
            self.weights, self.theta = w, cuts[0] + np.concatenate([[0.0], np.cumsum(gaps)])
            place = np.bincount(rows, weights=w[columns], minlength=n)
            up = self.above(place)
            # P(grade) = F(grade) - F(grade + 1) with F(0) = 1 and F(k + 1) = 0
            f = np.hstack([np.ones((n, 1)), up, np.zeros((n, 1))])
            slope = f * (1 - f)
            at = np.arange(n)
            chance = np.maximum(f[at, grade] - f[at, grade + 1], 1e-12)
            d_place = -(slope[at, grade] - slope[at, grade + 1]) / chance / n
            d_theta = np.zeros(k + 2)
            np.add.at(d_theta, grade, slope[at, grade] / chance / n)
            np.add.at(d_theta, grade + 1, -slope[at, grade + 1] / chance / n)
            d_theta = d_theta[1:-1]
            d_cuts = np.concatenate([[d_theta.sum()], np.cumsum(d_theta[::-1])[::-1][1:] / (1 + np.exp(-cuts[1:]))])
            grad = np.concatenate([np.bincount(columns, weights=d_place[rows], minlength=len(w)) + RIDGE * w, d_cuts])
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            params = params - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights = params[: len(self.weights)]
        cuts = params[len(self.weights) :]
        self.theta = cuts[0] + np.concatenate([[0.0], np.cumsum(np.logaddexp(0, cuts[1:]))])


def sample_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` rows (doc_id, label): one for each labelled id, those of least hash."""
    rows = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    return hash_sample(rows, [F.col("doc_id")], sample)


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n, toxic = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch["text"], batch["label"], strict=True):
            found = words_of(text)
            n.update(found)
            if label > 0:
                toxic.update(found)
    if n:
        yield pd.DataFrame({"word": list(n), "n": list(n.values()), "toxic": [toxic[w] for w in n]})


def telling_words(labelled: DataFrame, words: int = WORDS) -> list[tuple[str, float]]:
    """(word, log-odds) of the words whose presence tells most about the label, by the likelihood-ratio statistic."""
    totals = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0)).alias("toxic")).first()
    n, toxic = totals["n"], totals["toxic"]
    if not toxic or toxic == n:
        return []
    counts = labelled.mapInPandas(_count_words, "word string, n long, toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("t"))
    rate = toxic / n
    gain = F.expr(f"(CASE WHEN t > 0 THEN t * ln(t / n / {rate!r}D) ELSE 0 END) + (CASE WHEN t < n THEN (n - t) * ln((n - t) / n / {1 - rate!r}D) ELSE 0 END)")
    top = counts.where(F.col("n") >= LEAST_ROWS).withColumn("gain", gain).orderBy(F.desc("gain"), "word").limit(words).collect()
    return [(r["word"], float(np.log((r["t"] + 0.5) / (r["n"] - r["t"] + 0.5)) - np.log(toxic / (n - toxic)))) for r in top]


def fit_toxicity(docs: DataFrame, labels: DataFrame, grades=(3, 6), sample: int = SAMPLE) -> OrdinalModel:
    """Fits on at most ``sample`` labelled rows (doc_id, label: 0 or more).

    A label above 1 is a grade as it stands. Labels of 0 and 1 are graded by severity: 0 is grade 0, and a 1 is
    graded by how many words of strong odds its text has, against the limits ``grades``. Ids and labels of the
    sample are broadcast (a few bytes for each of ``sample`` rows); the driver gets each sampled row's word numbers.
    """
    chosen = F.broadcast(sample_labels(labels, sample).withColumnRenamed("doc_id", "_llm_id"))
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_llm_id")).select(text_or_empty().alias("text"), "label")
    rows = materialise(rows)  # at most ``sample`` texts
    telling = telling_words(rows)
    model = OrdinalModel([w for w, _ in telling], 2 + len(grades))
    if not telling:
        return model
    strong = np.array([x > 3 for _, x in telling])
    index = model.index

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[i for w in words_of(t) if (i := index.get(w)) is not None] for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "columns": found})

    got = rows.mapInPandas(numbers, "label int, columns array<int>").toPandas()
    sizes = np.array([len(x) for x in got["columns"]])
    columns = np.concatenate([np.asarray(x, dtype=np.int64) for x in got["columns"]]) if len(got) else np.zeros(0, np.int64)
    at = np.repeat(np.arange(len(got)), sizes)
    label = got["label"].to_numpy()
    hits = np.bincount(at, weights=strong[columns], minlength=len(got))
    severity = np.where(label > 0, 1 + np.searchsorted(grades, hits, side="right"), 0) if label.max(initial=0) <= 1 else np.minimum(label, len(model.theta))
    model.fit(at, columns, severity.astype(np.int64))
    return model


def toxicity_grades(docs: DataFrame, model: OrdinalModel, name: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``name``: severity (expected grade), grade (likeliest), chance (of a grade above 0).

    Whole texts; null counts as empty and has no words. Where nothing was learned the severity is that of a text
    without words. Equal texts get equal results. No row is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("severity double, grade int, chance double")
    def graded(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in texts:
            up = own.above(np.array([own.place(t) for t in batch], dtype=float))
            f = np.hstack([np.ones((len(up), 1)), up, np.zeros((len(up), 1))])
            yield pd.DataFrame({"severity": up.sum(axis=1), "grade": (f[:, :-1] - f[:, 1:]).argmax(axis=1).astype(np.int32), "chance": up[:, 0]})

    return docs.withColumn(name, graded(text_or_empty()))
