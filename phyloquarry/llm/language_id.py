"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased letters are hashed into DIMS features; document frequencies are
counted over all training texts (a vector of fixed length for each task, summed by Spark). The weights are
fitted with follow-the-regularised-leader (FTRL-proximal, elastic net) on a bounded sample of labelled rows:
about PER_LANGUAGE texts a language, picked by a hash of the id, as packed sparse features. A fifth of the
sample is held back to calibrate one softmax temperature. Prediction is a scan with the model broadcast
(languages x DIMS floats); nothing is shuffled.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

DIMS = 1 << 14
#: Labelled texts of each language in the fitting sample, in expectation; never more than twice that in all.
PER_LANGUAGE = 400
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 1e-4, 1e-5
UNKNOWN = "und"


@lru_cache(1)
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(indices, counts) of the text's hashed n-grams; None if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letters = letter_table()[points]
    if not letters.any():
        return None
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    c = np.where(letters, points, 32)[keep].astype(np.uint32)
    c = np.concatenate(([np.uint32(32)], c))
    m = c * np.uint32(2654435761)
    two = (m[:-1] ^ (m[:-1] >> np.uint32(15))) * np.uint32(2246822519) + m[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(3266489917) + m[2:]
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    counts = np.bincount(np.concatenate([m >> shift, (two * np.uint32(668265263)) >> shift, (three * np.uint32(374761393)) >> shift]), minlength=DIMS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weighted(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF values of unit length, with a constant feature in place DIMS."""
    at, counts = found
    x = np.log1p(counts) * idf[at]
    x /= max(np.sqrt((x * x).sum()), 1e-12)
    return np.append(at, DIMS), np.append(x, 1.0)


def bucket(id_col: str, n: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Of each feature over all texts of ``docs``, and the number of texts with letters."""

    def task(batches):
        seen, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if found := grams(text.as_py()):
                    seen[found[0]] += 1
                    n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, DIMS), pa.int32()), pa.array(np.append(seen[at], n), pa.int64())], ["feature", "n"])

    sums = docs.where(F.col(text_col).isNotNull()).select(text_col).mapInArrow(task, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    out = np.zeros(DIMS + 1, np.int64)
    for r in sums.collect():  # DIMS + 1 rows at most
        out[r.feature] = r.n
    return out[:DIMS], int(out[DIMS])


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int) -> np.ndarray:
    """FTRL-proximal weights (k x DIMS+1) after EPOCHS passes in the given order."""
    z, n = np.zeros((k, DIMS + 1)), np.zeros((k, DIMS + 1))

    def weights(za: np.ndarray, na: np.ndarray) -> np.ndarray:
        return np.where(np.abs(za) <= L1, 0.0, -(za - np.sign(za) * L1) / ((BETA + np.sqrt(na)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, x, y in rows:
            za, na = z[:, at], n[:, at]
            w = weights(za, na)
            error = softmax(w @ x)
            error[y] -= 1
            g = np.outer(error, x)
            more = na + g * g
            z[:, at] = za + g - (np.sqrt(more) - np.sqrt(na)) / ALPHA * w
            n[:, at] = more
    return weights(z, n)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The softmax temperature with the least log loss, by golden-section search over its logarithm.

    Labels are smoothed by one part in n + 2, or a sample without errors would call for no doubt at all.
    """
    smooth = 1 / (len(y) + 2)
    target = np.full(scores.shape, smooth / scores.shape[1])
    target[np.arange(len(y)), y] += 1 - smooth

    def loss(t: float) -> float:
        return float(-(target * np.log(np.maximum(softmax(scores / np.exp(t)), 1e-300))).sum(1).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class Model:
    """Languages, weights, inverse document frequencies and temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray, idf: np.ndarray, heat: float) -> None:
        self.langs, self.weights, self.idf, self.heat = langs, weights, idf, heat

    def predict(self, text: str | None) -> tuple[str, float]:
        found = grams(text) if text else None
        if found is None or not self.langs:
            return UNKNOWN, 0.0
        at, x = weighted(found, self.idf)
        p = softmax(self.weights[:, at] @ x / self.heat)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """The model learned from ``docs``' text and non-null language; without such rows it answers ``und``."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    seen = {r[lang_col]: r["n"] for r in labelled.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).orderBy(lang_col).collect()}
    langs = list(seen)
    if not langs:
        return Model([], np.zeros((0, DIMS + 1)), np.zeros(DIMS), 1.0)
    df, n = document_frequencies(labelled, text_col)
    idf = np.log((1 + n) / (1 + df)) + 1
    share = F.coalesce(*[F.when(F.col(lang_col) == lang, F.lit(per_language / seen[lang])) for lang in langs])
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("language")), F.lit(1 << 40)) / float(1 << 40)
    sample = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw")).where(F.col("draw") < share)

    def features(batches):
        for batch in batches:
            out = []
            for lang, text, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if found := grams(text):
                    out.append((lang, at, found[0].astype("<i4").tobytes(), found[1].astype("<i4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["lang", "draw", "at", "counts"])

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["draw", "lang"], kind="stable")
        rows = [(*weighted((np.frombuffer(a, "<i4"), np.frombuffer(c, "<i4")), idf), langs.index(lang)) for lang, a, c in zip(frame["lang"], frame["at"], frame["counts"], strict=True)]
        order = np.random.default_rng(7).permutation(len(rows))
        held = [rows[i] for i in order[: len(rows) // 5]]
        weights = follow_leader([rows[i] for i in order[len(rows) // 5 :]], len(langs))
        heat = temperature(np.array([weights[:, at] @ x for at, x, _ in held]), np.array([y for *_, y in held])) if held else 1.0
        return pd.DataFrame({"lang": langs, "weights": [w.astype("<f8").tobytes() for w in weights], "heat": heat})

    packed = sample.mapInArrow(features, "lang string, draw double, at binary, counts binary").orderBy("draw").limit(2 * per_language * len(langs))
    fitted = {r.lang: r for r in written(packed).groupBy().applyInPandas(train, "lang string, weights binary, heat double").collect()}
    if not fitted:
        return Model([], np.zeros((0, DIMS + 1)), idf, 1.0)
    return Model(langs, np.array([np.frombuffer(fitted[x].weights, "<f8") for x in langs]), idf, fitted[langs[0]].heat)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced, all others are kept.

    A null text and one without letters get ``und`` and 0.0. Repeated rows stay rows, an empty table gives none.
    """
    rest = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = rest.columns.index(text_col)
    schema = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def task(batches):
        own = shared.value
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return rest.mapInArrow(task, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all ``documents``, learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(bucket("doc_id", 4) != 2))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": (op8_language_id, None)}
