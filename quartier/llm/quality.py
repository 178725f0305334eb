"""Quality scores: random Fourier features, ridge regression from partition-summed normal equations, isotonic calibration."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quartier.llm.common import id_text, text_or_empty
from quartier.session import materialise

#: Random features, seed, ridge, levels of raw scores that calibration tells apart, one calibration row in so many.
FEATURES, SEED, RIDGE, LEVELS, CALIBRATION = 192, 11, 1.0, 512, 4
N_STATISTICS = 16

_KIND = np.full(256, 5)  # 0 lower, 1 upper, 2 digit, 3 white, 4 stop . , 5 other ASCII, 6 beyond ASCII
for _i in range(256):
    _c = chr(_i)
    _KIND[_i] = 6 if _i >= 128 else 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c.isspace() else 4 if _c in ".,;:" else 5


def statistics(text: str) -> np.ndarray:
    """N_STATISTICS numbers about a whole text; an empty text has zeros."""
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    out = np.zeros(N_STATISTICS)
    if not len(raw):
        return out
    counts = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=7)
    share = counts[counts > 0] / len(raw)
    words, lines = text.split(), text.split("\n")
    n = max(len(words), 1)
    seen = Counter(words)
    again = list(map(eq, words, words[1:]))
    filled = [x for x in lines if x]
    out[:7] = kinds / len(raw)
    out[7] = np.log1p(len(words))
    out[8] = np.log1p(sum(map(len, words)) / n)
    out[9] = len(seen) / n
    out[10] = sum(again) / n
    out[11] = max(seen.values(), default=0) / n
    out[12] = -(share * np.log2(share)).sum()
    out[13] = np.log1p(len(lines))
    out[14] = 1 - len(set(filled)) / max(len(filled), 1)
    out[15] = len(set(compress(words, again))) / n
    return out


@F.pandas_udf(ArrayType(DoubleType()))
def text_statistics(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([statistics(t) for t in batch])


class QualityModel:
    """Ridge regression on random Fourier features of standardised statistics, then a monotone step table."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        # frequencies of a Gaussian kernel whose width is the root of the dimension
        self.frequency = rng.normal(size=(len(mean), FEATURES)) / np.sqrt(len(mean))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.mean, self.scale = mean, scale
        self.weights = np.zeros(FEATURES + 1)
        self.raw, self.chance = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.frequency + self.phase), np.ones((len(z), 1))])

    def level(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(self.features(stats) @ self.weights * LEVELS), -LEVELS, 2 * LEVELS).astype(np.int64)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.level(stats), self.raw, self.chance), 0, 1)


def isotonic(level: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (centre, share) of blocks whose shares rise with the level; the shares are smoothed by half a row."""
    blocks: list[list[float]] = []
    for x, g, c in zip(level, good, n, strict=True):
        blocks.append([x * c, g, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], (b[:, 1] + 0.5) / (b[:, 2] + 1)


def _stack(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()) if len(column) else np.zeros((0, N_STATISTICS))


def fit_quality(labelled: DataFrame) -> QualityModel:
    """Fits on all rows of ``labelled`` (doc_id, stats, label): most for the ridge scores, some for their calibration.

    Each task sums the normal equations of its rows; the cells are added by key and reach the driver as one
    matrix, whatever the number of rows. Calibration gets one row per level. Without rows every score is 0.5.
    """
    both = materialise(labelled.select("stats", F.col("label").cast("double").alias("label"), (F.crc32(F.concat(F.lit("c"), id_text()).cast("binary")) % CALIBRATION == 0).alias("held")))
    sums = both.select(*[F.struct(F.avg(F.col("stats")[i]).alias("m"), F.stddev_pop(F.col("stats")[i]).alias("s")).alias(f"c{i}") for i in range(N_STATISTICS)]).first()
    if sums["c0"]["m"] is None:
        return QualityModel(np.zeros(N_STATISTICS), np.ones(N_STATISTICS))
    model = QualityModel(np.array([x["m"] for x in sums]), np.array([max(x["s"], 1e-6) for x in sums]))
    size = FEATURES + 2

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for batch in batches:
            z = np.hstack([model.features(_stack(batch["stats"])), batch[["label"]].to_numpy()])
            total += z.T @ z
        if total.any():
            yield pd.DataFrame({"cell": np.arange(size * size), "v": total.ravel()})

    got = both.where("NOT held").mapInPandas(cells, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    if not len(got):
        return model
    total = np.zeros(size * size)
    total[got["cell"].to_numpy()] = got["v"].to_numpy()
    total = total.reshape(size, size)
    ridge = np.eye(size - 1) * RIDGE
    ridge[-1, -1] = 1e-6  # the constant is free
    model.weights = np.linalg.solve(total[:-1, :-1] + ridge, total[:-1, -1])

    def levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"level": model.level(_stack(batch["stats"])), "label": batch["label"]})

    fitted = both.where("held").mapInPandas(levels, "level long, label double")
    steps = fitted.groupBy("level").agg(F.sum("label").alias("good"), F.count("*").alias("n")).orderBy("level").toPandas()
    if len(steps):
        model.raw, model.chance = isotonic(steps["level"].to_numpy(), steps["good"].to_numpy(), steps["n"].to_numpy())
    return model


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score of every row of ``docs``: the chance that its text is good, from a fit on ``labels`` (doc_id, label).

    Only the text is used for a score; null texts count as empty. A doc_id labelled twice takes the mean label, null
    labels and ids are left out; repeated rows get equal scores. One read of the texts makes the statistics; what
    follows moves a few numbers per document. Extra columns are not used.
    """
    stats = materialise(docs.select("doc_id", text_statistics(text_or_empty()).alias("stats")))
    given = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("label").alias("label"))
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(stats.join(given, "doc_id")))

    @F.pandas_udf(DoubleType())
    def score(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in column:
            yield pd.Series(shared.value.score(_stack(batch)))

    return stats.select("doc_id", score("stats").alias("score"))
