"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Pieces of equal length are interchangeable, so one exact best-fit-decreasing run over the counts per length (2048 at most)
plans the whole corpus. A segment tree over remaining capacities finds the tightest open bin in logarithmic time, and bins
of equal capacity are handled as one run. The plan is a bounded table of runs; tasks look their pieces up in it by
(length, rank), and the rank of a piece comes from counts per (length, hash slice), so no length meets in one task.
"""

from __future__ import annotations

import os
import re
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from custoria.llm.common import prepare, settle, with_text

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
#: Word encodings a worker remembers, about, and the longest word remembered.
REMEMBERED_WORDS, LONGEST_WORD = 600_000, 64
#: Pieces of one length that one task ranks.
SLICE_ROWS = 50_000

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class CapacityTree:
    """Segment tree over capacities 0..limit, with the number of open runs at each."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        node = capacity + self.size
        while node:
            self.open[node] += n
            node //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` that has an open run."""
        node = least + self.size
        if self.open[node]:
            return least
        while node > 1:
            if not node % 2 and self.open[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.size:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.size


@dataclass(frozen=True)
class Run:
    """Pieces `rank`.. of `length` fill bins `bin`.., `per_bin` each, from `offset` on."""

    length: int
    rank: int
    pieces: int
    bin: int
    per_bin: int
    offset: int


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing over `counts` pieces per length. The number of runs depends on `capacity` only."""
    tree = CapacityTree(capacity)
    free: dict[int, list[tuple[int, int]]] = {}
    plan: list[Run] = []
    opened = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            free.setdefault(room, []).append((first, n))
            tree.add(room, 1)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                first, n = opened, -(-left // (room // length))
                opened += n
            else:
                first, n = free[room].pop()
                tree.add(room, -1)
            per = room // length
            full = min(n, left // per)
            if full:
                plan.append(Run(length, rank, full * per, first, per, capacity - room))
                put(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n and left and left < per:
                plan.append(Run(length, rank, left, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(room, first + full, n - full)
    return plan


# The tokenizer cuts words into runs of letters, single digits and runs of other marks, and some contractions first.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|[!-/:-@\[-`{-~]+")
_CAPITAL = re.compile("[A-Z]")
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Pieces encoded in one call, and bytes of text whose new words are learned together.
_JOINED, _TEXT_BYTES = 256, 1 << 21


def _pieces(word: str) -> list[str] | None:
    """The pieces of a word that is not all letters, if they are certain: letters, ASCII digits and ASCII marks."""
    if not word.isascii():  # as the tokenizer does first: some letters become a letter and a mark
        word = unicodedata.normalize("NFC", word)
        if word != word.lower():
            word = "".join(map(str.lower, word))
    letters = word.rstrip(_MARKS)
    if letters.isalpha():
        return [p for p in (letters, word[len(letters) :]) if p]
    pieces = _PIECE.findall(word)
    # Capitals are left in texts that hold "<|" only; the tokenizer lowers them before it looks for contractions.
    if "<|" in word or _CAPITAL.search(word) or sum(map(len, pieces)) != len(word) or not all(p.isalpha() or p.isascii() for p in pieces):
        return None
    return pieces


class Tokens:
    """Encodes texts word by word: the tokenizer splits at white space anyway, so equal words have equal ids.

    New words are cut into pieces that the tokenizer never joins, and new pieces are encoded many at a time, with blanks
    between them; the ids that end a piece tell them apart. Each has one end at least, so as many ends as pieces are one
    each; where there are more, and for words whose pieces are not certain, every word is encoded by itself. A Python worker outlives its tasks, so the words
    it knows are kept in its process for the tasks to come.
    """

    def __init__(self, path: str | None, name: str = TOKENIZER):
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(name)
        kept = sys.modules.setdefault("_custoria_words", types.ModuleType("_custoria_words")).__dict__
        if path not in kept:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            model = Tokenizer.from_file(path)
            ends = np.zeros(max(model.get_vocab().values()) + 1, bool)
            suffix = getattr(model.model, "end_of_word_suffix", None)
            for token, at in model.get_vocab().items():
                ends[at] = bool(suffix) and token.endswith(suffix)
            kept[path] = (model, {}, {}, ends)
        self.model, self.known, self.older, self.ends = kept[path]

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(f.ids, "<u4").tobytes() for f in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        chunks = [pieces[at : at + _JOINED] for at in range(0, len(pieces), _JOINED)]
        out: list[bytes] = []
        for own, found in zip(chunks, self.model.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(own) or cuts[-1] != 4 * len(ids):
                out += self._alone(own)
                continue
            body = ids.tobytes()
            out += [body[i:j] for i, j in zip([0, *cuts], cuts)]
        return out

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        if not words:
            return {}
        names = b"\n".join(words).decode().split("\n")
        known = self.known
        have: dict[str, bytes] = {name: b"" for name in names if name.isalpha()}
        new, cut, alone = list(have), [], []
        for word, name in zip(words, names):
            if name in have and name.isalpha():
                continue
            pieces = _pieces(name)
            if pieces is None:
                alone.append((word, name))
                continue
            cut.append((word, pieces))
            for piece in pieces:
                if piece not in have:
                    ids = known.get(piece.encode())
                    have[piece] = ids or b""
                    if not ids:
                        new.append(piece)
        ids = self._joined(new)
        have.update(zip(new, ids))
        found = dict(zip("\n".join(new).encode().split(b"\n"), ids)) if new else {}
        take = have.__getitem__
        found.update((word, b"".join(map(take, pieces))) for word, pieces in cut)
        if alone:
            found.update(zip((word for word, _ in alone), self._alone([name for _, name in alone])))
        return found

    def encode_all(self, texts: pa.StringArray) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit numbers.

        Words are split and numbered by Arrow, so only distinct ones are looked up; their ids are gathered by number.
        """
        # The tokenizer lower-cases all but its special tokens, which start with "<|".
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        numbered = lists.flatten().dictionary_encode()
        distinct = numbered.dictionary.cast(pa.binary()).to_pylist()
        known, older = self.known, self.older
        ids = list(map(known.get, distinct))
        absent = [at for at, found in enumerate(ids) if found is None]
        for at in absent:
            ids[at] = older.get(distinct[at])
        new = self._learn([distinct[at] for at in absent if ids[at] is None])
        for at in absent:
            if ids[at] is None:
                ids[at] = new[distinct[at]]
            if len(distinct[at]) <= LONGEST_WORD:
                known[distinct[at]] = ids[at]
        if len(known) > REMEMBERED_WORDS // 2:  # words not seen since the last time are forgotten
            older.clear()
            older.update(known)
            known.clear()

        flat, sizes = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), "i8", len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        number = numbered.indices.to_numpy()
        n = sizes[number]
        ends = np.concatenate([[0], np.cumsum(n)])
        body = flat[np.repeat(starts[number] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]).tolist()
        return [body[i:j] for i, j in zip(cuts, cuts[1:])]


def _groups(texts: pa.StringArray) -> Iterator[pa.StringArray]:
    """Consecutive texts of a few megabytes together; a longer one is a group of its own."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for at, size in enumerate(sizes.tolist()):
        if at > first and held + size > _TEXT_BYTES:
            yield texts.slice(first, at - first)
            first, held = at, 0
        held += size
    if len(texts) > first:
        yield texts.slice(first)


def _cut(path: str | None, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path)
        width = 4 * capacity
        for batch in batches:
            ids, pieces, starts, lengths, crcs, bodies = [], [], [], [], [], []
            encoded = (body for group in _groups(batch.column(1)) for body in tokens.encode_all(group))
            for doc, body in zip(batch.column(0).to_pylist(), encoded):
                body += bytes(4)
                for piece, at in enumerate(range(0, len(body), width)):
                    part = body[at : at + width]
                    ids.append(doc)
                    pieces.append(piece)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                    if with_ids:
                        bodies.append(np.frombuffer(part, "<u4").astype("i4"))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip((ids, pieces, starts, lengths, crcs), kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(bodies, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def token_pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` tokens of every document, in `with_ids` with the ids themselves.

    A document's tokens are the ids of its text, then id 0; a null or empty text gives the single id 0.
    """
    prepare(documents.sparkSession)
    schema = _PIECES + (", ids array<int>" if with_ids else "")
    return with_text(documents).mapInArrow(_cut(path, capacity, with_ids), schema)


def _place(plan: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), "i8"), np.zeros(len(rank), "i8")
            for n in np.unique(length):
                here = np.flatnonzero(length == n)
                first, bins, per, start = plan[int(n)]
                run_at = np.searchsorted(first, rank[here], "right") - 1
                inside = rank[here] - first[run_at]
                sequence[here] = bins[run_at] + inside // per[run_at]
                offset[here] = start[run_at] + inside % per[run_at] * n
            keep = [i for i, name in enumerate(batch.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)],
                [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"],
            )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """`pieces` (any columns, with `doc_id`, `piece` and `length` of 1 to `capacity`) with sequence_id and offset.

    Sequences are gapless from offset 0. Their number is what best-fit decreasing over all pieces gives. Repeated
    documents are packed as often as they occur; no pieces give no rows.
    """
    spark = prepare(pieces.sparkSession)
    columns = pieces.columns
    # Where a row stands in the saved pieces spreads equal rows, of a document that repeats, over the slices.
    pieces = settle(pieces.withColumn("_place", F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table: dict[int, tuple[np.ndarray, ...]] = {}
    for length in counts:
        table[length] = ()
    runs: dict[int, list[Run]] = {length: [] for length in counts}
    for run in plan_bins(counts, capacity):
        runs[run.length].append(run)
    for length, own in runs.items():
        table[length] = tuple(np.array(c, "i8") for c in zip(*((r.rank, r.bin, r.per_bin, r.offset) for r in own)))

    slices = max(1, max(counts.values(), default=0) // slice_rows)
    order = ["doc_id", "piece", *(c for c in ("start", "ids_crc32") if c in pieces.columns)]
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64(*order, "_place"), F.lit(slices)))
    before = (
        sliced.groupBy("length", "slice")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n"))
        .drop("n")
    )
    within = Window.partitionBy("length", "slice").orderBy(*order, "_place")
    ranked = (
        sliced.join(before, ["length", "slice"])
        .withColumn("rank", F.col("before") + F.row_number().over(within) - 1)
        .select(*columns, F.col("rank").cast("bigint"))
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(_place(table), f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(token_pieces(documents, path, capacity), capacity)
