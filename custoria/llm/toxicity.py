"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, over block-max inverted indexes.

Terms are words and word beginnings. On a bounded sample of labelled texts the terms that tell the classes apart are chosen;
the sample's TF-IDF vectors over them form an inverted index whose postings are cut into blocks of examples, each with the
largest weight per term. For a query the block bounds say which blocks can hold one of the nearest examples; blocks are
scored from the best bound down, and the search ends when no bound beats the k-th cosine, so the neighbours are exact.
Their votes, weighted by similarity, go through a monotone calibration fitted with each example's own vote left out.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custoria.llm.common import held_out, prepare, text_column
from custoria.llm.grams import letters

#: Labelled examples per class that are indexed.
EXAMPLES_PER_CLASS = 2000
#: Word beginnings that are terms.
BEGINNINGS = (3, 4, 5, 6)
#: Terms kept, and the chi-square a term must reach.
MOST_TERMS, LEAST_CHI = 3000, 24.0
BLOCK = 64
NEIGHBOURS = 15
REMEMBERED_QUERIES = 50_000


def terms_of(text: str) -> Counter:
    """Counts of all terms: " word " for words, " begin" for beginnings of longer words."""
    counts: Counter = Counter()
    for word, n in Counter(letters(text).decode().split()).items():
        counts[f" {word} "] += n
        for size in BEGINNINGS:
            if len(word) > size:
                counts[f" {word[:size]}"] += n
    return counts


def choose_terms(sets: list[Counter], labels: np.ndarray, weight: np.ndarray) -> list[str]:
    """Terms by chi-square of occurrence against label, best first."""
    present: tuple[Counter, Counter] = (Counter(), Counter())
    for counts, label in zip(sets, labels):
        present[label].update(counts.keys())
    n = [int((labels == c).sum()) for c in (0, 1)]
    found = []
    for term in present[0].keys() | present[1].keys():
        a, b = present[1][term], present[0][term]
        if a + b < 4:
            continue
        c, d = n[1] - a, n[0] - b
        below = (a + b) * (c + d) * n[0] * n[1]
        chi = (a * d - b * c) ** 2 * (n[0] + n[1]) / below if below else 0.0
        if chi >= LEAST_CHI:
            found.append((-chi, term))
    return [term for _, term in sorted(found)[:MOST_TERMS]]


@dataclass
class Index:
    """Inverted index of the examples, blocks of `BLOCK` examples with the largest weight per term and block."""

    terms: list[str]
    idf: np.ndarray
    labels: np.ndarray
    weight: np.ndarray
    ids: np.ndarray
    weights: np.ndarray  # (terms, examples)
    bounds: np.ndarray  # (terms, blocks)
    knots: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))
    empty: float = 0.0
    known: dict = field(default_factory=dict)

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        place = np.array(sorted(counts), "i8")
        value = np.array([1 + math.log(counts[p]) for p in place.tolist()]) * self.idf[place]
        return place, value / np.linalg.norm(value)

    def nearest(self, place: np.ndarray, value: np.ndarray, leave: int = -1) -> list[tuple[float, int]]:
        """The `NEIGHBOURS` examples of largest positive cosine, ties to the lower example; `leave` is passed over."""
        bound = value @ self.bounds[place]
        best: list[tuple[float, int]] = []
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] <= 0 or len(best) == NEIGHBOURS and bound[block] < best[-1][0]:
                break
            start = block * BLOCK
            cosine = value @ self.weights[place, start : start + BLOCK]
            least = best[-1][0] if len(best) == NEIGHBOURS else 0.0
            for i in np.flatnonzero(cosine >= max(least, 1e-12)).tolist():
                if start + i != leave:
                    best.append((float(cosine[i]), start + i))
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:NEIGHBOURS]
        return best

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of the toxic among the neighbours; one at distance d counts 1 / (d + 0.05), and as its class is common."""
        strength = np.array([s for s, _ in near])
        at = np.array([i for _, i in near])
        mass = self.weight[at] / (1.05 - np.minimum(strength, 1.0))
        return float((mass * self.labels[at]).sum() / mass.sum())

    def score(self, counts: dict[int, int]) -> tuple[float, list[int], list[float]]:
        if not counts:
            return self.empty, [], []
        key = tuple(sorted(counts.items()))
        found = self.known.get(key)
        if found is None:
            near = self.nearest(*self.vector(counts))
            p = float(np.interp(self.vote(near), *self.knots)) if near and len(self.knots[0]) else self.empty
            found = (p, [int(self.ids[i]) for _, i in near], [s for s, _ in near])
            if len(self.known) >= REMEMBERED_QUERIES:
                self.known.clear()
            self.known[key] = found
        return found


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators; knots for linear interpolation."""
    pools: list[list[float]] = []
    for value, target, mass in sorted(zip(x.tolist(), y.tolist(), weight.tolist())):
        pools.append([value * mass, target * mass, mass])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(texts: list[str], labels: np.ndarray, weight: np.ndarray, ids: np.ndarray) -> Index:
    """Index and calibration; `weight` says how many labelled texts an example stands for."""
    sets = [terms_of(t) for t in texts]
    terms = choose_terms(sets, labels, weight) if len(set(labels.tolist())) == 2 else []
    place = {t: i for i, t in enumerate(terms)}
    counts = [{place[t]: n for t, n in s.items() if t in place} for s in sets]
    present = np.zeros(len(terms))
    for own in counts:
        present[list(own)] += 1
    idf = np.log((len(texts) + 1) / (present + 1)) + 1
    used = np.array([i for i, own in enumerate(counts) if own], "i8")
    width = -(-max(1, len(used)) // BLOCK) * BLOCK
    index = Index(terms, idf, labels[used], weight[used], ids[used], np.zeros((len(terms), width), "f4"), np.zeros((len(terms), width // BLOCK)))
    vectors = [index.vector(counts[i]) for i in used]
    for column, (at, value) in enumerate(vectors):
        index.weights[at, column] = value
    index.bounds = index.weights.reshape(len(terms), -1, BLOCK).max(2).astype("f8") * (1 + 1e-6)
    bare = np.array([not own for own in counts], bool)
    if bare.any():
        index.empty = float((labels[bare] * weight[bare]).sum() / weight[bare].sum())
    else:
        index.empty = float((labels * weight).sum() / weight.sum())
    votes = []
    for column, vector in enumerate(vectors):
        near = index.nearest(*vector, leave=column)
        if near:
            votes.append((index.vote(near), index.labels[column], index.weight[column]))
    if votes:
        index.knots = monotone(*(np.array(c, "f8") for c in zip(*votes)))
    return index


def train(documents: DataFrame, labels: DataFrame, per_class: int = EXAMPLES_PER_CLASS) -> bytes | None:
    """A pickled index from labelled rows that are not held out; None without any.

    Per class about `per_class` rows are taken by hash. The fit runs in one task on this bounded sample.
    """
    marks = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    marks = marks.filter(~held_out())
    counts = {r.label: r.n for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for label, n in counts.items() for v in (label, min(1.0, per_class / n))])
    drawn = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col("label")) * 1_000_000)
    drawn = F.broadcast(drawn.limit(4 * per_class))  # bounded, so the texts stay where they are
    sample = documents.select("doc_id", text_column().alias("text")).join(drawn, "doc_id").select("doc_id", "label", "text").limit(4 * per_class)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b for b in batches if len(b)] or [pd.DataFrame({"doc_id": [], "label": [], "text": []})])
        if len(rows):
            rows = rows.sort_values(["doc_id", "text"])
            label = rows["label"].to_numpy("i8")
            weight = np.array([counts[c] / max(1, (label == c).sum()) for c in label.tolist()])
            index = fit(rows["text"].tolist(), label, weight, rows["doc_id"].to_numpy("i8"))
            yield pd.DataFrame({"model": [pickle.dumps(tuple(vars(index).values()))]})

    found = sample.coalesce(1).mapInPandas(run, "model binary").collect()
    return bytes(found[0].model) if found else None


def _scorer(model):
    """Scores whole texts; the terms are found by one automaton over the text."""
    import ahocorasick

    index = Index(*pickle.loads(model))
    index.weights = index.weights.astype("f8")
    finder = ahocorasick.Automaton()
    for i, term in enumerate(index.terms):
        finder.add_word(term, i)
    if index.terms:
        finder.make_automaton()
    long = re.compile(r" \w")

    def score(text: str):
        counts: dict[int, int] = {}
        if index.terms:
            body = letters(text).decode()
            for end, i in finder.iter(body):
                # A beginning counts only before a longer word.
                if index.terms[i][-1] == " " or body[end + 1 : end + 2] != " ":
                    counts[i] = counts.get(i, 0) + 1
        return index.score(counts)

    return score


def score_documents(documents: DataFrame, model) -> DataFrame:
    """One row per row of `documents`: doc_id, held_out, score, predicted, neighbours, similarities.

    Null and empty texts, and those without any chosen term, get the rate of labelled texts without one. Without labelled
    rows every score is 0. neighbours are ids of labelled examples, nearest first.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", held_out().alias("held_out"), text_column().alias("text"))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(sent.value) if sent.value else lambda text: (0.0, [], [])
        for batch in batches:
            found = [score(t) for t in batch.column(2).to_pylist()]
            p = np.clip(np.array([f[0] for f in found], "f8"), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(p),
                    pa.array((p >= 0.5).astype("i4")),
                    pa.array([f[1] for f in found], pa.list_(pa.int64())),
                    pa.array([f[2] for f in found], pa.list_(pa.float64())),
                ],
                ["doc_id", "held_out", "score", "predicted", "neighbours", "similarities"],
            )

    schema = "doc_id bigint, held_out boolean, score double, predicted int, neighbours array<bigint>, similarities array<double>"
    return rows.mapInArrow(run, schema)


def with_toxicity(documents: DataFrame, labels: DataFrame, per_class: int = EXAMPLES_PER_CLASS) -> DataFrame:
    prepare(documents.sparkSession)
    return score_documents(documents, train(documents, labels, per_class))
