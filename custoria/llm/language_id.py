"""Language identification by error-correcting output codes.

Each language has a codeword of bits. One logistic classifier per bit is trained on hashed byte n-grams of labelled texts;
a text's bit margins are compared with every codeword by a weighted logistic loss, a bit weighing as much as its
classifier is better than chance. The nearest codeword wins; a small gap to the second one is flagged as ambiguous.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custoria.llm.common import held_out, prepare, text_column
from custoria.llm.grams import gram_counts, letters

LENGTHS = (1, 2, 3)
CELLS = 4096
#: Labelled texts per language that the classifiers are fitted on.
TRAIN_PER_LANGUAGE = 800
#: Languages beyond this many get random codewords instead of all possible splits.
EXHAUSTIVE = 5
#: Share of the total bit weight by which the nearest codeword must beat the second.
AMBIGUOUS = 0.02

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def codewords(n: int, seed: int = 17) -> np.ndarray:
    """n codewords of -1 and 1: every split of the languages, or for many languages the best of some random codes."""
    if n < 2:
        return np.zeros((n, 0), "i1")
    if n <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1, -1).astype("i1")
    rng, best, width = np.random.default_rng(seed), None, 10 * int(np.ceil(np.log2(n)))
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], "i1"), (n, width))
        code[0, code.min(0) == code.max(0)] *= -1
        apart = width - (code.astype("i4") @ code.T.astype("i4") + width) // 2
        np.fill_diagonal(apart, width)
        if best is None or apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


def features(text: str) -> np.ndarray:
    """Square roots of the relative n-gram frequencies."""
    counts = gram_counts(letters(text), LENGTHS, CELLS)
    return np.sqrt(counts / max(1, counts.sum()), dtype="f4")


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300, decay: float = 1e-5) -> np.ndarray:
    """Weights (features + 1, targets) of logistic regressions on targets -1 and 1, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros((x.shape[1], y.shape[1]), x.dtype)
    ahead, share = w.copy(), (weight / weight.sum()).astype(x.dtype)[:, None]
    step = np.float32(4.0 / max(1e-9, float((share * x * x).sum())))
    for t in range(steps):
        margin = np.clip(y * (x @ ahead), -30, 30)
        slope = x.T @ (share * -y / (1 + np.exp(margin))) + decay * ahead
        new = ahead - step * slope
        ahead = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w


@dataclass
class Codes:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bit_weight: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[int, float, float]:
        """Nearest language, its share of the vote, and its lead over the second."""
        if len(self.languages) == 1:
            return 0, 1.0, 1.0
        margin = x @ self.weights[:-1] + self.weights[-1]
        loss = (np.logaddexp(0, -self.code * margin) * self.bit_weight).sum(1) / self.bit_weight.sum()
        order = np.argsort(loss, kind="stable")
        share = np.exp(-(loss - loss[order[0]]) * 4)
        return int(order[0]), float(1 / share.sum()), float(loss[order[1]] - loss[order[0]])


def fit_codes(texts: list[str], labels: list[str]) -> Codes:
    names = sorted(set(labels))
    code = codewords(len(names))
    if len(names) < 2:
        return Codes(names, code, np.zeros((CELLS + 1, 0), "f4"), np.zeros(0))
    x = np.stack([features(t) for t in texts])
    place = np.array([names.index(label) for label in labels])
    weight = 1.0 / np.bincount(place)[place]
    y = code[place].astype("f4")
    w = fit_logistic(x, y, weight)
    right = ((np.sign(x @ w[:-1] + w[-1]) == y) * weight[:, None]).sum(0) / weight.sum()
    return Codes(names, code, w, np.maximum(2 * right - 1, 1e-3))


def train(documents: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> Codes | None:
    """Codes learned from text and non-null lang of rows that are not held out; None without any such row.

    Of each language about `per_language` rows with a letter are taken, chosen by hash, so the sample is bounded.
    """
    rows = documents.select("doc_id", F.col("lang").cast("string").alias("lang"), text_column().alias("text"))
    labelled = rows.filter(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & ~held_out() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000
    sample = labelled.filter(draw).select("lang", "text").limit(2 * per_language * len(counts))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, labels = [], []
        for batch in batches:
            texts += batch["text"].tolist()
            labels += batch["lang"].tolist()
        if texts:
            yield pd.DataFrame({"model": [pickle.dumps(tuple(vars(fit_codes(texts, labels)).values()))]})

    found = sample.coalesce(1).mapInPandas(fit, "model binary").collect()
    return Codes(*pickle.loads(bytes(found[0].model))) if found else None


def predict(model: Codes | None, text: str) -> tuple[str, float, bool]:
    if model is None or not _LETTER.search(text):
        return UNKNOWN, 0.0, False
    best, score, lead = model.decode(features(text))
    return model.languages[best], score, lead < AMBIGUOUS


def _predictions(model: Codes | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(model, text) for text in batch.column(batch.num_columns - 1).to_pylist()]
            lang, score, ambiguous = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())],
                [*batch.schema.names[:-1], "lang_pred", "score", "ambiguous"],
            )

    return run


def identify(documents: DataFrame, model: Codes | None) -> DataFrame:
    """One row per row of `documents`: doc_id, held_out, lang_pred, score, ambiguous.

    A null text, and one without any letter, is `und` with score 0; so is every text when nothing was learned. Other texts
    get the nearest language, also short and mixed ones; those that two codewords fit about equally are ambiguous.
    """
    rows = documents.select("doc_id", held_out().alias("held_out"), text_column().alias("text"))
    schema = "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean"
    return rows.mapInArrow(_predictions(model), schema)


def with_language(documents: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """Train on `documents` and predict them all."""
    prepare(documents.sparkSession)
    return identify(documents, train(documents, per_language))


def drop_unidentified(documents: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """The rows of `documents` that have a language, with all their columns; `und` texts go."""
    prepare(documents.sparkSession)
    model = train(documents, per_language)
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [text is not None and predict(model, text)[0] != UNKNOWN for text in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
