"""Language identification by error-correcting output codes over binary n-gram classifiers."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.llm.common import text_or_empty

UNKNOWN = "und"
#: Hash buckets of n-grams, their lengths in bytes, and the bytes handled at once.
BUCKETS, GRAMS, BLOCK = 1 << 14, (2, 3, 4), 1 << 20
#: Weight of a classifier's mean log-odds in the decoding loss, and the least lead of the nearest codeword.
SHARPNESS, LEAD = 4.0, 0.05

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], dtype=np.uint64)


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed byte n-grams of the whole lower-cased text; all but letters count as spaces."""
    raw = np.frombuffer(text.lower().encode("utf-8"), dtype=np.uint8)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    longest = max(GRAMS)
    for at in range(0, len(raw), BLOCK):
        c = _FOLD[raw[max(0, at - longest + 1) : at + BLOCK]]
        skip = min(at, longest - 1)  # bytes seen before: only n-grams that end in this block are new
        key = c.copy()
        for n in range(2, longest + 1):
            if len(c) < n:
                break
            key = key[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
            if n in GRAMS:
                mixed = (key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(50)
                counts += np.bincount(mixed[max(0, skip - n + 1) :].astype(np.int64), minlength=BUCKETS)
    return counts


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1: every split of up to 6 languages, random splits beyond. Columns are never constant."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        bits = [[1] + [1 if (k >> i) & 1 else -1 for i in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(bits, dtype=float).T
    rng, columns = np.random.default_rng(seed), set()
    while len(columns) < int(np.ceil(10 * np.log2(n))):
        column = tuple(rng.permutation([1] * (n // 2) + [-1] * (n - n // 2)))
        if tuple(-x for x in column) not in columns:
            columns.add(column)
    return np.array(sorted(columns), dtype=float).T


class LanguageModel:
    """Binary naive Bayes classifiers, one for each bit of the codewords."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.languages, self.codes = languages, codebook(len(languages))
        share = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True) if len(languages) else counts
        self.weights = np.zeros((BUCKETS, self.codes.shape[1]), dtype=np.float32)
        for b, bit in enumerate(self.codes.T):
            if (bit > 0).any() and (bit < 0).any():
                self.weights[:, b] = np.log(share[bit > 0].mean(axis=0)) - np.log(share[bit < 0].mean(axis=0))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, whether another codeword is nearly as near). The score is the share of the nearest one."""
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        counts = gram_counts(text)
        used = np.flatnonzero(counts)
        if not len(used):
            return UNKNOWN, 0.0, True
        odds = counts[used] @ self.weights[used] / counts[used].sum()
        # each classifier's loss on each codeword's bit: confident bits weigh more
        loss = np.logaddexp(0, -SHARPNESS * self.codes * odds).sum(axis=1)
        near = np.exp(loss.min() - loss)
        share = np.sort(near / near.sum())
        lead = share[-1] - (share[-2] if len(share) > 1 else 0.0)
        return self.languages[int(loss.argmin())], float(share[-1]), bool(lead < LEAD)


def _count_by_language(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            sums[lang] = sums.get(lang, 0) + gram_counts(text)
    for lang, n in sums.items():
        used = np.flatnonzero(n)
        yield pd.DataFrame({"lang": lang, "bucket": used, "n": n[used]})


def fit_languages(labelled: DataFrame) -> LanguageModel:
    """Learns from all rows of ``labelled`` (text, lang) with a non-null lang; null texts count as empty.

    Each task sums n-gram counts by language; the driver gets one count for each language and bucket.
    """
    rows = labelled.where("lang IS NOT NULL").select("lang", text_or_empty().alias("text"))
    sums = (
        rows.mapInPandas(_count_by_language, "lang string, bucket long, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    languages = sorted(sums["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[[languages.index(x) for x in sums["lang"]], sums["bucket"].to_numpy(dtype=np.int64)] = sums["n"]
    return LanguageModel(languages, counts)


def predict_languages(docs: DataFrame, model: LanguageModel, name: str = "language") -> DataFrame:
    """``docs`` with a struct column ``name``: lang_pred, score (0 to 1), ambiguous.

    Reads the whole text and nothing else. Null texts and texts without letters, and all texts where nothing
    was learned, get ``und``, score 0, ambiguous. Equal texts get equal results. No row is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in texts:
            yield pd.DataFrame([own.predict(t) for t in batch], columns=["lang_pred", "score", "ambiguous"])

    return docs.withColumn(name, predicted("text"))


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language a model learned from their own lang column can tell.

    Rejected are texts that are null or have no letter, and those whose two nearest codewords tie within LEAD.
    """
    told = predict_languages(docs, fit_languages(docs.select("text", "lang")), "_llm_language")
    return told.where(f"_llm_language.lang_pred <> '{UNKNOWN}' AND NOT _llm_language.ambiguous").select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
