"""Benchmark items inside documents, by embedding edit distance into Hamming distance.

Texts are read as words (ASCII letters lower-cased, ASCII punctuation dropped). A document holds an item of n words if some
run of its words is within floor(n * (100 - percent) / 100) word edits of it.

1. Windows. An item cut into (edits + 1) pieces keeps one piece whole, so only item-sized windows that hold the first words
   of a piece at its place can match. All other windows are passed over without loss.
2. The CGK walk reads a window word by word; at each of n steps it notes the current word, and a shared random bit of
   (step, word) tells whether to go on to the next. Walks of texts within few edits mostly agree. As there are no more steps
   than words, no walk leaves its window. Every other repeat walks from the last word backwards, so that both ends of a
   window are read. Each repeat samples some steps of a walk of its own; a window is a candidate if all samples of one
   repeat agree with the item's. Per class of item lengths (powers of two) samples and repeats are fitted: repeats reach the
   target recall on copies with all edits allowed, samples are those that let the fewest unrelated windows pass. Where no
   choice reaches the recall, nothing is sampled and all windows of that class are verified.
3. Candidates are verified by the exact edit distance of the item to any run of words in the window and around it.

The benchmark's distinct texts travel to the tasks in slices bounded in number and bytes; a larger benchmark takes one pass
per slice, and the driver holds one slice at a time. Ids are joined to the found texts afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custoria.llm.common import prepare, settle, text_column
from custoria.llm.shingles import Shingler, mix

PERCENT = 80
RECALL = 0.995
#: Items that travel to the tasks at once, and bytes of their texts; only a single item may be larger.
SLICE_ITEMS, SLICE_BYTES = 20_000, 1 << 23
#: Words of a piece that must be found, at most.
SEED_WORDS = 4
#: Most steps sampled per repeat, most repeats, and the copies that a fit tries.
MOST_SAMPLES, MOST_REPEATS, TRIED = 5, 128, 400
#: Words of windows that are walked at once.
_CELLS = 1 << 15
_FILTER = 1 << 20
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_PLACE = mix(np.arange(1, SEED_WORDS + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SAMPLE = mix(np.arange(101, 101 + MOST_SAMPLES, dtype="u8")) | np.uint64(1)


def words_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Word hashes of each text."""
    shingler = Shingler(1)
    for chunk in shingler._chunks(texts):
        hashes, first = shingler.word_hashes([t.translate(_WORDS).lower() for t in chunk])
        for a, b in zip(first[:-1], first[1:]):
            yield hashes[a:b]


def seeds_at(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the `n` words from each place on."""
    with np.errstate(over="ignore"):
        joint = np.full(max(0, len(words) - n + 1), n, "u8")
        for i in range(n):
            joint += words[i : len(words) - n + 1 + i] * _PLACE[i]
    return mix(joint)


def edit_distance_inside(item: np.ndarray, words: np.ndarray) -> int:
    """Fewest word edits between `item` and any run of `words`."""
    row, step = np.zeros(len(words) + 1, "i8"), np.arange(len(words) + 1)
    for i, word in enumerate(item):
        new = row + 1
        new[0] = i + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (words != word))
        row = np.minimum.accumulate(new - step) + step
    return int(row.min())


def walks(texts: np.ndarray, steps: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """Words noted at the sampled `steps` (repeats, texts, samples) of a walk per lane over `texts` (texts, words)."""
    repeats, n, samples = steps.shape
    at = np.zeros((repeats, n), "i8")
    noted = np.zeros((repeats, n, samples), "u8")
    lane = mix(lanes.astype("u8") + np.uint64(12345))[:, None]
    rows, last = np.arange(n)[None, :], texts.shape[1] - 1
    for step in range(int(steps.max(initial=-1)) + 1):
        word = np.where(at <= last, texts[rows, np.minimum(at, last)], np.uint64(0))
        for s in range(samples):
            here = steps[:, :, s] == step
            noted[:, :, s][here] = word[here]
        with np.errstate(over="ignore"):
            at += (mix(word ^ (lane + np.uint64(step * 0x9E3779B97F4A7C15 & (2**64 - 1)))) >> np.uint64(63)).astype("i8")
    return noted


def _padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), "u8")
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def notes(texts: list[np.ndarray], length: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Words noted (repeats, texts, samples) in windows for items of `length` words; odd repeats walk backwards.

    `share` (repeats, samples) holds the places, in [0, 1), of the sampled steps.
    """
    out = np.zeros((len(share), len(texts), share.shape[1]), "u8")
    lanes = np.arange(len(share))
    at = 0
    while at < len(texts) and out.size:
        some = max(1, min(512, _CELLS // max(1, int(length[at : at + 512].max()))))
        part = texts[at : at + some]
        steps = (share[:, None, :] * length[None, at : at + some, None]).astype("i8")
        width = max(1, max(map(len, part)))
        out[0::2, at : at + some] = walks(_padded(part, width), steps[0::2], lanes[0::2])
        out[1::2, at : at + some] = walks(_padded([t[::-1] for t in part], width), steps[1::2], lanes[1::2])
        at += some
    return out


def _edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    out = words.tolist()
    for _ in range(edits):
        at = int(rng.integers(0, max(1, len(out))))
        kind = int(rng.integers(0, 3))
        new = int(rng.integers(1, 1 << 62))
        out[at : at + (kind != 0)] = [] if kind == 1 else [new]
    return np.array(out, "u8")


@dataclass
class Sampling:
    """Sampled places of the repeats, fitted to items of one class of lengths, and what the fit measured."""

    share: np.ndarray
    recall: float = 1.0
    unrelated: float = 1.0

    def marks(self, texts: list[np.ndarray], length: np.ndarray) -> np.ndarray:
        """One number per repeat and text that stands for all its samples."""
        with np.errstate(over="ignore"):
            return mix((notes(texts, length, self.share) * _SAMPLE[: self.share.shape[1]]).sum(2, dtype="u8"))


def fit_sampling(words: list[np.ndarray], edits: np.ndarray, pool: np.ndarray, recall: float) -> Sampling:
    """Samples and repeats for these items; unrelated windows are drawn from the words of `pool`."""
    rng = np.random.default_rng(99)
    share = rng.random((MOST_REPEATS, MOST_SAMPLES))
    tries = max(40, min(TRIED, (1 << 16) // max(map(len, words))))
    some = np.resize(rng.permutation(len(words)), tries)
    own = [words[i] for i in some]
    length = np.array([len(w) for w in own])
    copies = [_edited(words[i], int(edits[i]), rng)[: len(words[i])] for i in some]
    other = [pool[rng.integers(0, len(pool), len(w))] for w in own]
    base, near, far = (notes(t, length, share) for t in (own, copies, other))
    best = Sampling(share[:1, :0])
    for samples in range(1, MOST_SAMPLES + 1):
        hit, miss = (np.maximum.accumulate((x == base)[:, :, :samples].all(2), axis=0).mean(1) for x in (near, far))
        enough = np.flatnonzero(hit >= recall)
        # Half as many repeats again, as the copies tried are few.
        repeats = 3 * (int(enough[0]) + 1) // 2 + 1 if len(enough) else MOST_REPEATS + 1
        if repeats <= MOST_REPEATS and miss[repeats - 1] < best.unrelated:
            best = Sampling(share[:repeats, :samples], float(hit[repeats - 1]), float(miss[repeats - 1]))
    return best


@dataclass
class Items:
    """Items of one slice, ready for the tasks."""

    ids: list
    words: list[np.ndarray]
    edits: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # per seed length: filter, seed, item, place
    kind: np.ndarray  # class of lengths
    sampling: dict[int, Sampling]  # per class
    row: np.ndarray  # of an item among those of its class
    marks: dict[int, np.ndarray]  # per class, (repeats, items of the class)

    def passed(self, which: np.ndarray, windows: list[np.ndarray]) -> np.ndarray:
        """Whether the walks over each window agree with those of its item in all samples of a repeat."""
        out = np.zeros(len(which), bool)
        for kind in np.unique(self.kind[which]).tolist():
            at = np.flatnonzero(self.kind[which] == kind)
            own = which[at]
            length = np.array([len(self.words[i]) for i in own])
            seen = self.sampling[kind].marks([windows[i] for i in at], length)
            out[at] = (seen == self.marks[kind][:, self.row[own]]).any(0)
        return out


def build_items(rows: list[tuple], percent: int = PERCENT, recall: float = RECALL) -> Items:
    """Seeds and sampled walks of the items; items without words are left out."""
    ids, words = [], []
    for (item, _), own in zip(rows, words_of([t for _, t in rows])):
        if len(own):
            ids.append(item)
            words.append(own)
    edits = np.array([len(w) * (100 - percent) // 100 for w in words], "i8")
    found: dict[int, list[tuple[int, int, int]]] = {}
    for i, own in enumerate(words):
        pieces = int(edits[i]) + 1
        n = min(SEED_WORDS, len(own) // pieces)
        hashes = seeds_at(own, n)
        for piece in range(pieces):
            at = piece * len(own) // pieces
            found.setdefault(n, []).append((int(hashes[at]), i, at))
    seeds = {}
    for n, own in found.items():
        own.sort()
        code = np.array([s for s, _, _ in own], "u8")
        near = np.zeros(_FILTER, bool)
        near[code % np.uint64(_FILTER)] = True
        seeds[n] = (near, code, np.array([i for _, i, _ in own]), np.array([p for _, _, p in own]))

    kind = np.array([len(w).bit_length() for w in words], "i8")
    row, sampling, marks = np.zeros(len(words), "i8"), {}, {}
    pool = np.concatenate(words) if words else np.zeros(0, "u8")
    for k in np.unique(kind).tolist():
        own = np.flatnonzero(kind == k)
        row[own] = np.arange(len(own))
        texts = [words[i] for i in own]
        sampling[k] = fit_sampling(texts, edits[own], pool, recall)
        marks[k] = sampling[k].marks(texts, np.array([len(t) for t in texts]))
    return Items(ids, words, edits, seeds, kind, sampling, row, marks)


def matches(items: Items, documents: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """(document, item, distance, place) of every item found, at its best candidate window."""
    found: set[tuple[int, int, int]] = set()
    for n, (near, code, item, place) in items.seeds.items():
        for d, words in enumerate(documents):
            joint = seeds_at(words, n)
            for at in np.flatnonzero(near[joint % np.uint64(_FILTER)]).tolist():
                k = int(np.searchsorted(code, joint[at]))
                while k < len(code) and code[k] == joint[at]:
                    found.add((d, int(item[k]), at - int(place[k])))
                    k += 1
    if not found:
        return []
    best: dict[tuple[int, int], tuple[int, int]] = {}
    order = sorted(found)
    for at in range(0, len(order), 512):
        part = order[at : at + 512]
        which = np.array([i for _, i, _ in part])
        windows = [documents[d][max(0, start) : max(0, start + len(items.words[i]))] for d, i, start in part]
        for (d, i, start), ok in zip(part, items.passed(which, windows)):
            if ok:
                n, slack = len(items.words[i]), int(items.edits[i])
                distance = edit_distance_inside(items.words[i], documents[d][max(0, start - slack) : max(0, start + n + slack)])
                if distance <= slack:
                    best[d, i] = min(best.get((d, i), (distance, start)), (distance, start))
    return [(d, i, distance, max(0, start)) for (d, i), (distance, start) in best.items()]


def _key() -> Column:
    return F.sha2(text_column(), 256)


def _slices(benchmark: DataFrame, percent: int, slice_items: int, slice_bytes: int) -> Iterator[tuple[Items, bool]]:
    """Distinct texts by their keys, slice by slice, and whether it is the only slice."""
    texts = benchmark.groupBy(_key().alias("key")).agg(F.first(text_column()).alias("text"))
    slices = 1
    while True:
        part = F.pmod(F.xxhash64("key"), F.lit(slices)).alias("part")
        size = texts.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
        over = F.greatest(F.col("n") / slice_items, F.when(F.col("n") > 1, F.col("size") / slice_bytes).otherwise(0))
        most = size.agg(F.max(over)).first()[0] or 0
        if most <= 1:
            break
        slices *= max(2, math.ceil(most))
    for i in range(slices):
        rows = texts.filter(part == i).collect() if slices > 1 else texts.collect()
        yield build_items(sorted((r.key, r.text.encode()) for r in rows), percent), slices == 1


def find_items(
    documents: DataFrame, benchmark: DataFrame, percent: int = PERCENT, slice_items: int = SLICE_ITEMS, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """One row per row of `documents` and item found in it: doc_id, item_id, distance, n_words, place.

    distance is the fewest word edits found, n_words the item's length, place the word the window starts at (both from the
    candidate windows, best first). Null and empty texts, and items without words, match nothing; items of fewer than five
    words match without edits only. An item without id is reported as -1. Rows that repeat are reported as often; equal
    items each on their own. No items or no documents give no rows. Further columns of both tables are passed over.
    """
    prepare(documents.sparkSession)
    rows = documents.select("doc_id", text_column().alias("text"))

    def scan(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = matches(items, list(words_of(batch.column(1).cast(pa.binary()).to_pylist())))
                out = [(ids[d], items.ids[i], distance, len(items.words[i]), place) for d, i, distance, place in found]
                columns = list(zip(*out)) if out else [[]] * 5
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "key", "distance", "n_words", "place"])

        return run

    schema = "doc_id bigint, key string, distance bigint, n_words bigint, place bigint"
    parts = []
    for items, only in _slices(benchmark, percent, slice_items, slice_bytes):
        part = rows.mapInArrow(scan(items), schema)
        parts.append(part if only else settle(part, "found"))
    ids = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), _key().alias("key"))
    return reduce(DataFrame.unionByName, parts).join(ids, "key").select("doc_id", "item_id", "distance", "n_words", "place")


def drop_contaminated(
    documents: DataFrame, benchmark: DataFrame, percent: int = PERCENT, slice_items: int = SLICE_ITEMS, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """The rows of `documents` that hold no item, with all their columns."""
    prepare(documents.sparkSession)
    place = documents.columns.index("text")

    def keep(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or b"" for t in batch.column(place).cast(pa.binary()).to_pylist()]
                gone = {d for d, *_ in matches(items, list(words_of(texts)))}
                yield batch.filter(pa.array([d not in gone for d in range(batch.num_rows)], pa.bool_()))

        return run

    for items, only in _slices(benchmark, percent, slice_items, slice_bytes):
        documents = documents.mapInArrow(keep(items), documents.schema)
        documents = documents if only else settle(documents, "kept")
    return documents
