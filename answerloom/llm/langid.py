"""Language identification by a string kernel, Nyström landmarks and one-versus-rest kernel ridge regression.

Two texts are compared by the blended-spectrum presence kernel: the number of hashed n-grams (1 to 3 code points)
that occur in both, over the root of the product of their numbers. A bounded sample of labelled rows is drawn by
hash; landmarks are part of it. Texts become kernel values against the landmarks, in the Nyström feature space one
ridge regression per language is solved, and whole batches are scored by two matrix products.

Defined cases: a text that is null or has no letter is `und` with score 0; rows without a lang, or with a null
doc_id, teach nothing but are predicted; if nothing can be learnt every text is `und`; repeated rows are predicted
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches

GRAMS = (1, 2, 3)
DIMS = 1 << 12  # buckets of hashed n-grams
SAMPLE_PER_LANG = 300  # labelled rows drawn per language, about
LANDMARKS_PER_LANG = 32
RIDGE = 1e-2
BATCH = 256


def presence(texts: list[str], dims: int = DIMS) -> np.ndarray:
    """A 0/1 row per text: which buckets its lower-cased n-grams hit."""
    out = np.zeros((len(texts), dims), np.float32)
    for row, text in zip(out, texts, strict=True):
        codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        gram = np.zeros(len(codes), np.uint32)
        for n in GRAMS:
            if len(codes) < n:
                break
            gram = (gram[: len(codes) - n + 1] * np.uint32(0x01000193)) ^ (codes[n - 1:] + np.uint32(n << 24))
            mixed = gram * np.uint32(0x9E3779B1)
            row[(mixed >> np.uint32(16)) & np.uint32(dims - 1)] = 1
    return out


def normed(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # normalised presence rows
    weights: np.ndarray  # landmarks x languages

    def scores(self, texts: list[str]) -> np.ndarray:
        kernel = normed(presence(texts, self.landmarks.shape[1])) @ self.landmarks.T
        return kernel @ self.weights


def fit(rows: list[tuple[str, np.ndarray]], per_lang: int = LANDMARKS_PER_LANG, ridge: float = RIDGE) -> Model:
    """rows: (lang, presence row), in a fixed order."""
    langs = sorted({lang for lang, _ in rows})
    x = normed(np.stack([r for _, r in rows]))
    seen: dict[str, int] = {}
    picked = []
    for i, (lang, _) in enumerate(rows):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= per_lang:
            picked.append(i)
    marks = x[picked]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # kernel values to Nyström features
    phi = (x @ marks.T) @ root
    y = np.array([[1.0 if lang == known else 0.0 for known in langs] for lang, _ in rows])
    share = y.sum(0)
    weigh = 1 / share[y.argmax(1)]  # languages count alike
    a = (phi * weigh[:, None]).T @ phi + ridge * np.eye(phi.shape[1]) * weigh.mean()
    return Model(langs, marks.astype(np.float32), (root @ np.linalg.solve(a, (phi * weigh[:, None]).T @ y)).astype(np.float32))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model | None:
    """Fit to about `per_lang` rows of each language among the rows that are not held out.

    Runs two jobs: label counts, and the drawn rows' presence bits (DIMS / 8 bytes each) for the driver.
    """
    small_batches(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / n))) for lang, n in sorted(counts.items())])
    chance = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 40)) / float(1 << 40)

    @F.pandas_udf("binary")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series([np.packbits(presence([t])[0].astype(bool)).tobytes() for t in texts])

    drawn = known.filter(chance < share).select("lang", chance.alias("at"), "doc_id", bits("text").alias("bits")).collect()
    drawn = sorted(drawn, key=lambda r: (r["at"], r["doc_id"], r["bits"]))
    return fit([(r["lang"], np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(np.float32)) for r in drawn]) if drawn else None


def _predictor(model: Model | None):
    """A column function: text to (lang, score)."""
    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
            known = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
            at = np.flatnonzero(known) if model else []
            for i in range(0, len(at), BATCH):
                some = at[i: i + BATCH]
                found = model.scores([texts.iloc[j] for j in some])
                langs[some] = np.array(model.langs, object)[found.argmax(1)]
                scores[some] = np.clip(found.max(1), 0, 1)
            yield pd.DataFrame({"lang": langs, "score": scores})

    return predict


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row. Only `text` is an input of the prediction."""
    small_batches(docs.sparkSession)
    found = docs.select("doc_id", _predictor(model)("text").alias("_found"))
    return found.select("doc_id", F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"))


def accepted(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows, with all their columns, whose language is found with a score of at least `least`."""
    small_batches(docs.sparkSession)
    name = fresh(docs, "language_found")
    found = docs.withColumn(name, _predictor(model)("text"))
    return found.filter((F.col(name)["lang"] != "und") & (F.col(name)["score"] >= least)).drop(name)
