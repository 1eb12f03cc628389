"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of about 512 bytes. Every passage is encoded (shares of character kinds, repetition, hashed
three-byte grams, then a learned layer); gated attention, learned from document labels alone, weighs the passages, and
the weighted sum is scored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custoria.llm.common import held_out, prepare, text_column

#: Labelled documents per class that are fitted on.
TRAIN_PER_CLASS = 1500
PASSAGE = 512
GRAMS = 64
HIDDEN, GATE = 24, 16
THRESHOLD = 0.3
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Kind of every byte: lower, upper, digit, blank, line end, beyond ASCII, other, then one kind per mark.
_KIND = np.full(256, 6, "u1")
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[32], _KIND[[10, 13]], _KIND[128:] = 0, 1, 2, 3, 4, 5
for _i, _mark in enumerate(_MARKS):
    _KIND[_mark] = 7 + _i
KINDS = 7 + len(_MARKS)
WIDTH = KINDS + 4 + GRAMS


def passages(raw: bytes) -> np.ndarray:
    """Features of each passage of a text (at least one row)."""
    n = max(1, round(len(raw) / PASSAGE))
    codes = np.frombuffer(raw, "u1")
    out = np.zeros((n, WIDTH), "f4")
    if not len(codes):
        return out
    place = np.minimum(np.arange(len(codes)) * n // len(codes), n - 1)
    size = np.bincount(place, minlength=n)[:, None].astype("f4")
    kinds = np.bincount(place * KINDS + _KIND[codes], minlength=n * KINDS).reshape(n, KINDS) / size
    out[:, :KINDS] = np.sqrt(kinds)
    wide = codes.astype("u4")
    if len(codes) >= 5:
        four = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]
        at = place[: len(four)]
        both = np.sort((at.astype("u8") << np.uint64(32)) | four)
        new = np.concatenate(([True], both[1:] != both[:-1]))
        fresh = np.bincount((both[new] >> np.uint64(32)).astype("i8"), minlength=n)
        out[:, KINDS] = fresh / np.maximum(1, np.bincount(at, minlength=n))
        out[:, KINDS + 1] = np.bincount(place[1:], weights=codes[1:] == codes[:-1], minlength=n) / size[:, 0]
        gram = ((four >> np.uint32(8)) * np.uint32(0x9E3779B1)) >> np.uint32(26)
        hashed = np.bincount(at * GRAMS + gram, minlength=n * GRAMS).reshape(n, GRAMS)
        out[:, KINDS + 4 :] = np.sqrt(hashed / np.maximum(1, hashed.sum(1, keepdims=True)))
    out[:, KINDS + 2] = np.log1p(size[:, 0]) / 8
    out[:, KINDS + 3] = np.log1p(n) / 8
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Attention:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Scores of bags; `x` holds the standardised passages of all, `starts` the first of each."""
        w, s = self.w, {"x": x}
        sizes = np.diff(np.append(starts, len(x)))
        s["bag"] = np.repeat(np.arange(len(starts)), sizes)
        s["h"] = np.tanh(x @ w["e"] + w["eb"])
        s["t"], s["g"] = np.tanh(s["h"] @ w["v"]), _sigmoid(s["h"] @ w["u"])
        energy = (s["t"] * s["g"]) @ w["a"]
        energy -= np.maximum.reduceat(energy, starts)[s["bag"]]
        raised = np.exp(energy)
        s["weight"] = raised / np.add.reduceat(raised, starts)[s["bag"]]
        s["z"] = np.add.reduceat(s["weight"][:, None] * s["h"], starts)
        s["p"] = _sigmoid(s["z"] @ w["c"] + w["cb"])
        return s

    def backward(self, s: dict[str, np.ndarray], starts: np.ndarray, slope: np.ndarray) -> dict[str, np.ndarray]:
        w, bag = self.w, s["bag"]
        d = {"c": s["z"].T @ slope, "cb": slope.sum(keepdims=True)}
        dz = (slope[:, None] * w["c"])[bag]
        along = (dz * s["h"]).sum(1)
        de = s["weight"] * (along - np.add.reduceat(s["weight"] * along, starts)[bag])
        d["a"] = (s["t"] * s["g"]).T @ de
        dt = de[:, None] * w["a"] * s["g"] * (1 - s["t"] ** 2)
        dg = de[:, None] * w["a"] * s["t"] * s["g"] * (1 - s["g"])
        d["v"], d["u"] = s["h"].T @ dt, s["h"].T @ dg
        dh = (dz * s["weight"][:, None] + dt @ w["v"].T + dg @ w["u"].T) * (1 - s["h"] ** 2)
        d["e"], d["eb"] = s["x"].T @ dh, dh.sum(0)
        return d

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        starts = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1]))
        return self.forward((np.concatenate(bags) - self.mean) * self.scale, starts)["p"]


def fit(texts: list[str], labels: np.ndarray, weight: np.ndarray, steps: int = 400, rate: float = 0.01) -> Attention:
    bags = [passages(t.encode()) for t in texts]
    x = np.concatenate(bags)
    starts = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1]))
    mean, spread = x.mean(0), x.std(0)
    rng = np.random.default_rng(5)
    shapes = {"e": (WIDTH, HIDDEN), "eb": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "cb": (1,)}
    w = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in ("eb", "cb") else np.zeros(s)).astype("f4") for k, s in shapes.items()}
    model = Attention(mean, (1 / np.maximum(spread, 0.02)).astype("f4"), w)
    x = (x - model.mean) * model.scale
    share = (weight / weight.sum()).astype("f4")
    one, two = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for t in range(1, steps + 1):
        s = model.forward(x, starts)
        for k, d in model.backward(s, starts, share * (s["p"] - labels)).items():
            d = d + 1e-4 * w[k]
            one[k] = 0.9 * one[k] + 0.1 * d
            two[k] = 0.999 * two[k] + 0.001 * d * d
            w[k] = (w[k] - rate * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.999**t)) + 1e-8)).astype("f4")
    return model


def train(documents: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Attention | float:
    """A model from labelled rows that are not held out; the label itself where there is only one, 0.5 where there is none.

    Per class about `per_class` rows are taken by hash, weighted back to how common the class is; the fit runs in one task.
    """
    marks = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    marks = marks.filter(~held_out())
    counts = {r.label: r.n for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    share = F.create_map(*[F.lit(v) for label, n in counts.items() for v in (label, min(1.0, per_class / n))])
    drawn = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col("label")) * 1_000_000)
    drawn = F.broadcast(drawn.limit(4 * per_class))  # bounded, so the texts stay where they are
    sample = documents.select("doc_id", text_column().alias("text")).join(drawn, "doc_id").select("doc_id", "label", "text").limit(4 * per_class)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if rows:
            rows = pd.concat(rows).sort_values(["doc_id", "text"])
            label = rows["label"].to_numpy("i8")
            weight = np.array([counts[c] / max(1, (label == c).sum()) for c in label.tolist()])
            model = fit(rows["text"].tolist(), label.astype("f4"), weight)
            yield pd.DataFrame({"model": [pickle.dumps((model.mean, model.scale, model.w))]})

    found = sample.coalesce(1).mapInPandas(run, "model binary").collect()
    return Attention(*pickle.loads(bytes(found[0].model))) if found else 0.5


def score_documents(documents: DataFrame, model: Attention | float) -> DataFrame:
    """One row per row of `documents`: doc_id, held_out, score, predicted. A null text is scored as the empty one."""
    rows = documents.select("doc_id", held_out().alias("held_out"), text_column().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            if isinstance(model, float):
                p = np.full(len(texts), model)
            else:
                p = np.concatenate([np.zeros(0), *(model.score([passages(t) for t in texts[i : i + 64]]) for i in range(0, len(texts), 64))])
            p = p.astype("f8")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype("i4"))], ["doc_id", "held_out", "score", "predicted"]
            )

    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def with_quality(documents: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    prepare(documents.sparkSession)
    return score_documents(documents, train(documents, labels, per_class))
