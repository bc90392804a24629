"""Language ID: a byte convolutional network over every fixed-length window of a text."""

from __future__ import annotations

import functools

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamspark.llm.cnn import ByteCNN
from loamspark.llm.common import bounded_sample, read, with_arrow_columns

WINDOW = 256
#: Bound of the labelled rows that the model is fitted on, windows taken from each, and gradient steps of so many windows.
SAMPLE_ROWS, SAMPLE_WINDOWS, STEPS, BATCH = 4000, 4, 900, 128
UNDETERMINED = "und"


def windows(text: bytes) -> np.ndarray:
    """The whole text in rows of WINDOW bytes, the last filled with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


class LanguageModel:
    def __init__(self, languages: list[str], network: ByteCNN | None):
        self.languages, self.network = languages, network

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], seed: int = 1) -> LanguageModel:
        """From (text, language); whole windows and short pieces both train it. Without rows it never decides."""
        languages = sorted({lang for _, lang in rows})
        if not languages:
            return cls([], None)
        rng, xs, ys = np.random.default_rng(seed), [], []
        for text, lang in rows:
            w = windows(text.encode("utf-8", "replace"))
            for row in w[rng.permutation(len(w))[:SAMPLE_WINDOWS]]:
                xs.append(row)
                ys.append(languages.index(lang))
                short = row.copy()
                short[int(rng.integers(16, WINDOW)) :] = 0
                xs.append(short)
                ys.append(languages.index(lang))
        epochs = -(-STEPS * BATCH // len(xs))
        return cls(languages, ByteCNN(len(languages), seed).fit(np.array(xs), np.array(ys), epochs, seed, BATCH))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score: the softmax of the mean log probabilities over a text's windows, weighted by their bytes."""
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if self.network is None:
            return names, scores
        letter = regex.compile(r"\p{L}").search
        pending: list[tuple[int, bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            if text and letter(text):
                pending.append((i, text.encode("utf-8", "replace")))
                size += len(pending[-1][1])
            if pending and (size > 1 << 21 or i == len(texts) - 1):
                self._decide(pending, names, scores)
                pending, size = [], 0
        return names, scores

    def _decide(self, pending: list[tuple[int, bytes]], names: list[str], scores: list[float]) -> None:
        blocks = [windows(b) for _, b in pending]
        starts = np.cumsum([0] + [len(b) for b in blocks])
        logs = self.network.log_probabilities(np.concatenate(blocks)).astype(np.float64)
        lengths = np.concatenate([np.minimum(WINDOW, len(b) - WINDOW * np.arange(len(w))) for (_, b), w in zip(pending, blocks, strict=True)])
        means = np.add.reduceat(logs * lengths[:, None], starts[:-1]) / np.add.reduceat(lengths, starts[:-1])[:, None]
        p = np.exp(means - means.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for (i, _), row in zip(pending, p, strict=True):
            k = int(row.argmax())
            names[i], scores[i] = self.languages[k], float(min(1.0, row[k]))


def held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fitted on at most about `rows` labelled documents (null or empty texts and null languages are left out) outside the held-out quarter.

    Repeated rows are sampled together; a table without usable rows gives a model that never decides.
    """
    usable = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    return LanguageModel.fit(sorted((r["text"], r["lang"]) for r in bounded_sample(usable.select("doc_id", "text", "lang"), rows, "text")))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred and score from text alone; und and 0 for a null text or one without a letter.

    Columns of these names are replaced; repeated rows stay; equal texts get equal values; an empty table stays empty.
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return with_arrow_columns(docs, text, fields, functools.partial(_predictor, model))


def _predictor(model: LanguageModel):
    return lambda texts: list(model.predict(texts))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
