"""Removal of byte strings that occur more than once in the corpus.

A string of `length` bytes that starts at two places holds the same anchor at both: the 64-byte gram with the least hash
among all grams in it. So instead of all suffixes only those at anchors are sorted, about one in 170 bytes, and nothing is
lost.

1. One scan writes the anchors of each distinct text. Grams that occur at two places are shared.
2. Texts with shared anchors send, per anchor, the bytes that a window around it can cover. A group of equal anchors is
   sorted (see `suffixes`), which tells for every anchor which windows occur elsewhere. Groups beyond `hot_rows` are never
   gathered: each window whose anchor they are is hashed, and windows with equal hashes are counted as an aggregate.
3. Texts collect their covered ranges.

Texts that are equal as a whole are one text with a count: all their windows are repeated, and one copy per task stands for
them. In a periodic run the anchors repeat as well; the middle of a long run has no other windows than its ends, so its
anchors are left out and the run itself is marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custoria.llm.common import prepare, settle, with_text
from custoria.llm.shingles import _BYTE, Powers, mix
from custoria.llm.suffixes import common, shared_windows

LENGTH = 400
GRAM = 64
#: Anchors of one gram that a task gathers; beyond, windows are hashed and aggregated.
HOT_ROWS = 20_000
#: Rows of contexts worked on at once.
BLOCK_ROWS = 2048
_CHUNK = 1 << 22


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, from running minima of blocks to both sides."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo("u8").max, "u8")
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


class Anchors:
    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.powers = length, gram, Powers()

    def grams(self, codes: np.ndarray) -> np.ndarray:
        up, down = self.powers.upto(len(codes) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(codes) + 1, "u8")
            np.cumsum(_BYTE[codes] * up[:-1], out=total[1:])
            n = len(codes) - self.gram + 1
            return mix((total[self.gram :] - total[:n]) * down[:n])

    def find(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places and grams' hashes of the anchors: of every window the leftmost gram with the least hash."""
        codes = np.frombuffer(raw, "u1")
        width = self.length - self.gram + 1
        places, keys = [np.zeros(0, "i8")], [np.zeros(0, "u8")]
        for start in range(0, max(0, len(codes) - self.length + 1), _CHUNK):
            part = codes[start : start + _CHUNK + self.length - 1]
            hashes = self.grams(part)
            mask = np.uint64((1 << 24) - 1)
            least = window_minima((hashes & ~mask) | np.arange(len(hashes), dtype="u8"), width) & mask
            at = least[np.concatenate(([True], least[1:] != least[:-1]))].astype("i8")
            places.append(at + start)
            keys.append(hashes[at])
        place, key = np.concatenate(places), np.concatenate(keys)
        new = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, bool)
        return place[new], key[new]

    def thin(self, raw: bytes, place: np.ndarray, key: np.ndarray):
        """Leaves out the middle of long periodic runs; returns places, keys and the runs, which are repeated throughout."""
        runs = []
        if len(place) < 8:
            return place, key, runs
        keep = np.ones(len(place), bool)
        gap = np.diff(place)
        same = (key[1:] == key[:-1]) & np.concatenate(([True], gap[1:] == gap[:-1]))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype("i1")))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            while b > a and gap[a] != gap[b - 1]:
                a += 1
            start, stop, period = int(place[a]), int(place[b]) + self.gram, int(gap[a]) if b > a else 0
            if b - a < 4 or stop - start < 2 * (self.length + period) or raw[start + period : stop] != raw[start : stop - period]:
                continue
            runs.append((start, stop))
            keep[a : b + 1] &= (place[a : b + 1] < start + self.length + period) | (place[a : b + 1] > stop - self.length - period)
        return place[keep], key[keep], runs


_STAGED = "id binary, n_bytes bigint, place array<bigint>, key array<bigint>, start array<bigint>, stop array<bigint>"


def _scan(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, seen = Anchors(length, gram), set()
        lists = pa.list_(pa.int64())
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            sizes = []
            for own, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                sizes.append(len(raw))
                if own in seen or len(raw) < length:
                    values = (None, None, [], [])
                else:
                    if len(seen) > 1 << 20:
                        seen.clear()
                    seen.add(own)
                    place, key, runs = anchors.thin(raw, *anchors.find(raw))
                    values = (place, key.view("i8"), [r[0] for r in runs], [r[1] for r in runs])
                for column, value in zip(columns, values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(c, lists) for c in columns)],
                ["id", "n_bytes", "place", "key", "start", "stop"],
            )

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of every id in a task."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for own in batch.column(0).to_pylist():
            keep.append(own not in seen)
            if len(seen) > 1 << 20:
                seen.clear()
            seen.add(own)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _contexts(length: int, gram: int):
    """Bytes around each anchor, plus one, zero outside of the text: length - gram to the left, length to the right."""
    before = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, raw, spots in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                for at in range(0, len(spots), 512):
                    rows = []
                    for s in spots[at : at + 512]:
                        left = raw[max(0, s["place"] - before) : s["place"]].rjust(before, b"\xff")
                        rows.append((s["key"], own, s["place"], s["n"], (left + raw[s["place"] : s["place"] + length].ljust(length, b"\xff")).translate(_UP)))
                    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "id", "place", "n", "bytes"])

    return run


#: Bytes plus one; 255, which no UTF-8 text has, becomes 0.
_UP = bytes((c + 1) % 256 for c in range(256))
_RANGES = "id binary, start bigint, stop bigint"


def _ranges(rows: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64()))], ["id", "start", "stop"])


def _joined(rows: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges with those of the same row that overlap or touch made one."""
    order = np.lexsort((starts, rows))
    rows, starts, stops = rows[order], starts[order], stops[order]
    if not len(rows):
        return rows, starts, stops
    # Rows are moved apart, so that one running maximum serves them all.
    span = int(stops.max() - starts.min()) + 2
    reach = np.maximum.accumulate(stops - starts.min() + rows * span)
    fresh = np.flatnonzero(np.concatenate(([True], starts[1:] - starts.min() + rows[1:] * span > reach[:-1])))
    return rows[fresh], starts[fresh], np.maximum.reduceat(stops, fresh)


def _compare(length: int, gram: int):
    """Covered ranges from groups of equal keys; rows come sorted by key, id and place."""
    before, full = length - gram, 2 * length - gram

    def settle_rows(rows: list[tuple]) -> pa.RecordBatch:
        context = np.frombuffer(b"".join(r[3] for r in rows), "u1").reshape(len(rows), full)
        right, left = context[:, before:], context[:, before - 1 :: -1] if before else context[:, :0]
        key = np.array([r[0] for r in rows], "i8")
        cuts = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(rows))
        size = np.diff(cuts)
        place = np.array([r[2] for r in rows], "i8")
        out = [(np.zeros(0, "i8"),) * 3]
        pair = cuts[:-1][size == 2]
        if len(pair):
            to_right, to_left = common(right[pair], right[pair + 1]), common(left[pair], left[pair + 1])
            least = np.maximum(0, length - to_right)
            hit = np.flatnonzero(least <= to_left)
            for own in (pair[hit], pair[hit] + 1):
                out.append((own, place[own] - to_left[hit], place[own] - least[hit] + length))
        for a, n in zip(cuts[:-1][size > 2].tolist(), size[size > 2].tolist()):
            pad = -before % 8
            own_left = np.pad(left[a : a + n], ((0, 0), (0, pad)))
            own_right = np.pad(right[a : a + n], ((0, 0), (0, -length % 8)))
            own, least, most = shared_windows(own_right, own_left, length, gram // 8 * 8)
            own = own + a
            out.append((own, place[own] - most, place[own] - least + length))
        found, starts, stops = _joined(*(np.concatenate(c) for c in zip(*out)))
        return _ranges([(rows[i][1], start, stop) for i, start, stop in zip(found.tolist(), starts.tolist(), stops.tolist())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last = None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if last is not None and row[:3] == last[:3]:
                    continue  # the same place of a text that several tasks sent
                if len(rows) >= BLOCK_ROWS and row[0] != last[0]:
                    yield settle_rows(rows)
                    rows = []
                rows.append(row)
                last = row
        if rows:
            yield settle_rows(rows)

    return run


def _owned(bodies: list[bytes], anchors: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """First and last offset of the windows of each context whose anchor is the context's own, as `find` would choose it."""
    before, full = anchors.length - anchors.gram, 2 * anchors.length - anchors.gram
    codes = np.frombuffer(b"".join(bodies), "u1") - np.uint8(1)
    hashes = np.append(anchors.grams(codes), np.zeros(anchors.gram - 1, "u8")).reshape(len(bodies), full)
    hashes = hashes[:, : full - anchors.gram + 1] & ~np.uint64((1 << 24) - 1)
    own, ends = hashes[:, before : before + 1], np.ones((len(bodies), 1), bool)
    # Of equal grams the leftmost is the anchor. Grams that reach out of the text are in no window inside of it.
    first = before - np.hstack((ends, hashes[:, :before] <= own))[:, ::-1].argmax(1)
    return first, np.hstack((hashes[:, before + 1 :] < own, ends)).argmax(1)


def _windows(length: int, gram: int):
    """Hashes of all windows that have the anchor; one that holds several belongs to one of them, wherever it occurs."""
    before = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for batch in batches:
            out = []
            owns, places, bodies = (batch.column(i).to_pylist() for i in range(3))
            if bodies:
                for own, place, body, first, last in zip(owns, places, bodies, *(c.tolist() for c in _owned(bodies, anchors))):
                    for at in range(first, last + 1):
                        window = body[at : at + length]
                        if 0 not in window:
                            out.append((hashlib.blake2b(window, digest_size=16).digest(), own, place - before + at))
            columns = list(zip(*out)) if out else [[], [], []]
            kinds = (pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["window", "id", "start"])

    return run


def _merge(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(zip(starts, stops)):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        raws = batch.column(1).cast(pa.binary()).to_pylist()
        for doc, raw, whole, starts, stops in zip(batch.column(0).to_pylist(), raws, *(batch.column(i).to_pylist() for i in range(2, 5))):
            spans = [(0, len(raw))] if whole else _merge(starts or [], stops or [])
            kept, at = [], 0
            for start, stop in spans:
                kept.append(raw[at:start])
                at = stop
            kept.append(raw[at:])
            removed = sum(b - a for a, b in spans)
            rows.append((doc, len(raw), removed, len(spans), hashlib.sha256(b"".join(kept)).hexdigest(), [{"start": a, "stop": b} for a, b in spans]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
        columns = list(zip(*rows)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
        )


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of `documents`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (ranges of bytes).

    A text is its UTF-8 bytes, null the empty one. Every byte covered by a string of `length` bytes that also starts
    elsewhere is removed, in the same text or another row, overlapping or not; strings are judged on the input. Rows that
    repeat are elsewhere to each other. Shorter texts lose nothing. Matches never span two rows.
    """
    prepare(documents.sparkSession)
    digest = F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16)
    rows = with_text(documents).select("doc_id", digest.alias("id"), "text")
    long = rows.filter(F.octet_length("text") >= length)
    staged = settle(long.select("id", "text").mapInArrow(_scan(length, gram), _STAGED), "anchors")

    texts = staged.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    # Copies of a text have the same anchors; those that several tasks found are listed once.
    anchors = settle(
        staged.filter("place is not null").select("id", F.explode(F.arrays_zip("place", "key")).alias("a")).select("id", "a.place", "a.key"), "places"
    )
    tag = F.xxhash64("id", "place")
    # Saved, so that a join reads it by itself: Spark then broadcasts it where it is small, and else splits a frequent key.
    counted = anchors.groupBy("key").agg(F.min(tag).alias("low"), F.max(tag).alias("high"), F.count(F.lit(1)).alias("n"))
    shared = settle(counted.filter("low <> high").select("key", "n"), "shared")
    spots = anchors.join(shared, "key").groupBy("id").agg(F.collect_set(F.struct("place", "key", "n")).alias("spots"))
    sent = long.select("id", "text").mapInArrow(_once, "id binary, text string").join(spots, "id").select("id", "text", "spots")
    contexts = settle(sent.mapInArrow(_contexts(length, gram), "key bigint, id binary, place bigint, n bigint, bytes binary"), "contexts")

    few = contexts.filter(F.col("n") <= hot_rows).select("key", "id", "place", "bytes")
    found = few.repartition("key").sortWithinPartitions("key", "id", "place").mapInArrow(_compare(length, gram), _RANGES)
    many = contexts.filter(F.col("n") > hot_rows).select("id", "place", "bytes")
    windows = many.mapInArrow(_windows(length, gram), "window binary, id binary, start bigint")
    here = F.xxhash64("id", "start")
    twice = settle(windows.groupBy("window").agg(F.min(here).alias("low"), F.max(here).alias("high")).filter("low <> high").select("window"), "windows")
    covered = windows.join(twice, "window").select("id", "start", (F.col("start") + length).alias("stop")).distinct()
    periodic = staged.select("id", F.explode(F.arrays_zip("start", "stop")).alias("r")).select("id", "r.start", "r.stop")
    ranges = found.unionByName(covered).unionByName(periodic).groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))

    info = settle(
        texts.join(ranges, "id", "left")
        .select("id", (F.col("copies") > 1).alias("whole"), F.col("ranges.start").alias("start"), F.col("ranges.stop").alias("stop"))
        .filter("whole or start is not null"),
        "ranges",
    )
    return (
        rows.join(info, "id", "left")
        .select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "start", "stop")
        .mapInArrow(_cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<start:bigint,stop:bigint>>")
    )
