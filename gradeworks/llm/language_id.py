"""Language ID by the nearest centroid of hashed TF-IDF n-gram vectors.

A text is lower-cased, everything that is no letter becomes one blank, and its 1- to 3-grams
of bytes are hashed to DIMENSIONS buckets, weighted by log(1 + count) times inverse document
frequency, and scaled to length one. Every language has several centroids, found by spherical
k-means. A text gets the language of the centroid of the largest cosine; that cosine is the
score. A text further from its centroid than anything of that language that was learned from,
by a margin, is rejected. Texts that are null or without a letter are ``und``, with score 0,
and rejected.

The classifier is fitted on at most SAMPLE_PER_LANGUAGE different labelled texts a language, drawn
by a hash of the text; prediction reads nothing but the text. Which texts are drawn depends on
neither order nor repeats, and of equally near centroids the first counts, so that every run gives
the same. Each row is predicted, repeated rows and those of a null id too; texts of any length are
taken whole. An empty table has no rows; without a text to learn from every row is ``und``. Columns
with other names are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeworks.llm.common import id_bucket, read_table

UNKNOWN = "und"
FOLDS = 5
DIMENSIONS = 4096
SAMPLE_PER_LANGUAGE = 400
CENTROIDS = 3
# A text is rejected below this share of the least cosine seen in the sample of its language.
MARGIN = 0.5
_ROUNDS = 12
_ROWS = 256

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
# One step of the text counts goes over about so many bytes.
_STEP = 1 << 20


def _plain(text: str) -> bytes:
    return (" " + _OTHER.sub(" ", text).strip().lower() + " ").encode("utf-8", "replace")


def _counts(text: str) -> np.ndarray:
    """Occurrences of each bucket's n-grams in the whole text, in steps of bounded memory."""
    letters = np.frombuffer(_plain(text), np.uint8)
    total = np.zeros(DIMENSIONS, np.int64)
    for start in range(0, len(letters), _STEP):
        part = letters[start : start + _STEP + 2].astype(np.uint32)
        gram = part
        for width in (1, 2, 3):
            if width > 1:
                gram = gram[:-1] * np.uint32(256) + part[width - 1 :]
            # Windows of the next step's first letters are counted there.
            own = gram[: min(_STEP, len(letters) - start - width + 1)]
            bucket = ((own * np.uint32(0x9E3779B1) + np.uint32(width * 0x1F3D5B79)) >> np.uint32(15)) % DIMENSIONS
            total += np.bincount(bucket, minlength=DIMENSIONS)
    return total


def _scaled(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1, length)


@dataclass(frozen=True)
class Classifier:
    """Languages, weights of the buckets, centroids with their language, least cosine by language."""

    languages: list[str]
    weights: np.ndarray
    centroids: np.ndarray
    owners: np.ndarray
    floors: np.ndarray

    def vectors(self, texts: list[str]) -> np.ndarray:
        counts = np.stack([_counts(text) for text in texts]).astype(np.float32)
        return _scaled(np.log1p(counts) * self.weights)

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """Language, score and rejection of each text."""
        readable = [i for i, text in enumerate(texts) if text and _LETTER.search(text)]
        found = pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "rejected": True}, index=range(len(texts)))
        for start in range(0, len(readable) if self.languages else 0, _ROWS):
            rows = readable[start : start + _ROWS]
            cosine = self.vectors([texts[i] for i in rows]) @ self.centroids.T
            best = cosine.argmax(axis=1)
            score = np.clip(cosine[np.arange(len(rows)), best], 0, 1).astype(float)
            owner = self.owners[best]
            found.loc[rows, "lang_pred"] = [self.languages[o] for o in owner]
            found.loc[rows, "score"] = score
            found.loc[rows, "rejected"] = score < self.floors[owner]
        return found


def _sample(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and n-gram counts of at most SAMPLE_PER_LANGUAGE different texts with letters a language.

    Texts are reduced to one of each before any is drawn, by a hash of the text, so that neither ids
    nor repeats nor empty rows have a say. Only the counts of the drawn texts leave the tasks.
    """
    labelled = docs.where((id_bucket(F.col("doc_id"), FOLDS) != 0) & F.col("lang").isNotNull())
    text = F.col("text").cast("string")
    draws = [F.xxhash64(F.lit(i), text).alias(f"draw{i}") for i in (0, 1)]
    keyed = labelled.where(text.rlike(r"\p{L}")).select("lang", text.alias("text"), *draws)
    keys = ["lang", "draw0", "draw1"]
    # Spark keeps no more than the bound of a language in each task before any row moves.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw0", "draw1"))
    drawn = keyed.select(*keys).distinct().withColumn("rank", rank).where(F.col("rank") <= SAMPLE_PER_LANGUAGE)
    texts = keyed.join(F.broadcast(drawn.select(*keys)), keys, "left_semi").dropDuplicates(keys)
    counted = texts.select(*keys, F.pandas_udf(_counted, "binary")("text").alias("counts")).collect()
    rows = sorted(counted, key=lambda r: (r.lang, r.draw0, r.draw1))
    counts = [np.frombuffer(r.counts, np.float32) for r in rows]
    return [r.lang for r in rows], np.stack(counts) if counts else np.zeros((0, DIMENSIONS), np.float32)


def _counted(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: _counts(text).astype(np.float32).tobytes())


def _clusters(rows: np.ndarray) -> np.ndarray:
    """Centroids of spherical k-means, started from rows far from each other."""
    chosen = [int((rows @ rows.mean(axis=0)).argmax())]
    while len(chosen) < min(CENTROIDS, len(rows)):
        chosen.append(int((rows @ rows[chosen].T).max(axis=1).argmin()))
    centres = rows[chosen]
    for _ in range(_ROUNDS):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = [rows[nearest == i].sum(axis=0) if (nearest == i).any() else centres[i] for i in range(len(centres))]
        centres = _scaled(np.stack(sums))
    return centres


def fit(docs: DataFrame) -> Classifier:
    """Learns from the labelled documents outside the held-out fold."""
    labels, counts = _sample(docs)
    languages = sorted(set(labels))
    if not languages:
        none = np.zeros((0, DIMENSIONS), np.float32)
        return Classifier([], np.ones(DIMENSIONS, np.float32), none, np.zeros(0, int), np.zeros(0))
    weights = (np.log((1 + len(labels)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    rows, own = _scaled(np.log1p(counts) * weights), np.array([languages.index(lang) for lang in labels])
    centres = [_clusters(rows[own == i]) for i in range(len(languages))]
    floors = [float((rows[own == i] @ c.T).max(axis=1).min()) * MARGIN for i, c in enumerate(centres)]
    owners = np.repeat(np.arange(len(languages)), [len(c) for c in centres])
    return Classifier(languages, weights, np.concatenate(centres).astype(np.float32), owners, np.array(floors))


def predictor(spark: SparkSession, classifier: Classifier):
    """Column function: text to a struct (lang_pred, score, rejected)."""
    # DIMENSIONS numbers for each centroid: its size does not depend on the documents.
    sent = spark.sparkContext.broadcast(classifier)

    def predict(texts: pd.Series) -> pd.DataFrame:
        return sent.value.predict(texts.tolist())

    return F.pandas_udf(predict, "lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """The rows of ``docs`` whose text the classifier does not reject, with all their columns."""
    predict = predictor(docs.sparkSession, classifier)
    return docs.where(~predict(F.col("text").cast("string"))["rejected"])


def identify(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of ``docs``."""
    predict = predictor(docs.sparkSession, classifier)
    found = docs.select("doc_id", predict(F.col("text").cast("string")).alias("found"))
    return found.select("doc_id", "found.*")


def held_out(doc_id: Column) -> Column:
    return id_bucket(doc_id, FOLDS) == 0


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
