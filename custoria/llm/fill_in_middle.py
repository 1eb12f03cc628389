"""Fill-in-the-middle: every text is cut twice and its middle moved to the end.

A unit is a code point (or a line). Cuts are found for a whole Arrow batch at once, eight bytes at a time: the UTF-8 bytes
of all its texts are viewed as 64-bit words, arithmetic on whole words marks every byte that ends a unit, bits are counted
per word, the word that holds the unit sought is found by searching the running counts, and a multiplication resolves the
byte inside it. Texts never leave their partition: there is no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custoria.llm.common import prepare, with_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of a hundred texts, how many are transformed, and of a hundred transformed ones, how many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
CODE_POINT, LINE = "code point", "line"

_ONES, _HIGH, _LOW = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080), np.uint64(0x7F7F7F7F7F7F7F7F)
_NEWLINES = np.uint64(0x0A0A0A0A0A0A0A0A)
_SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class Units:
    """Select and rank over the unit-ending bytes of texts that lie back to back in `raw`, `ends` giving their ends."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray, unit: str = CODE_POINT):
        words = np.zeros(len(raw) // 8 + 2, "<u8")  # at least one byte of padding, which starts a unit
        words.view("u1")[: len(raw)] = raw
        if unit == CODE_POINT:
            follows = (words >> np.uint64(7)) & ~(words >> np.uint64(6)) & _ONES
            starts = ~follows & _ONES
            self.marks = starts >> np.uint64(8)
            self.marks[:-1] |= starts[1:] << np.uint64(56)
        elif unit == LINE:
            other = words ^ _NEWLINES
            self.marks = (~(((other & _LOW) + _LOW) | other | _LOW)) >> np.uint64(7)
            last = np.diff(ends, prepend=0) > 0
            at = ends[last] - 1
            np.bitwise_or.at(self.marks, at >> 3, np.uint64(1) << (8 * (at & 7)).astype("u8"))
        else:
            raise ValueError(f"no such unit: {unit}")
        self.counts = np.zeros(len(words) + 1, "i8")
        np.cumsum(np.bitwise_count(self.marks), out=self.counts[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Units that end before byte `at`."""
        word, bits = at >> 3, (8 * (at & 7)).astype("u8")
        return self.counts[word] + np.bitwise_count(self.marks[word] & ((np.uint64(1) << bits) - np.uint64(1)))

    def select(self, nth: np.ndarray) -> np.ndarray:
        """The byte that ends unit `nth`, counted from 1."""
        word = np.searchsorted(self.counts, nth, "left") - 1
        sought = (nth - self.counts[word]).astype("u8")
        upto = self.marks[word] * _ONES  # in byte j: marks in bytes 0 to j
        reached = ((upto | _HIGH) - sought * _ONES) & _HIGH
        return 8 * word + 8 - np.bitwise_count(reached)


def cuts(texts: pa.BinaryArray, first: np.ndarray, second: np.ndarray, unit: str = CODE_POINT):
    """(n, a, b, end of prefix, end of middle) of every text, ends in bytes from its start.

    n units a text; a and b are the smaller and the larger of first % (n + 1) and second % (n + 1).
    """
    wide = texts.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], "i8")[wide.offset : wide.offset + len(wide) + 1]
    body = wide.buffers()[2]
    raw = np.frombuffer(body, "u1")[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, "u1")
    offsets = offsets - offsets[0]
    units = Units(raw, offsets[1:], unit)
    before = units.rank(offsets)
    n = np.diff(before)
    x, y = (h.astype("i8") % (n + 1) for h in (first, second))
    a, b = np.minimum(x, y), np.maximum(x, y)
    start = offsets[:-1]

    def end(count: np.ndarray) -> np.ndarray:
        at = np.zeros(len(n), "i8")
        some = count > 0
        at[some] = units.select(before[:-1][some] + count[some]) + 1 - start[some]
        return at

    return n, a, b, end(a), end(b)


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that depend on the id and the seed only."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def _transform(seed: int, transformed: int, suffix_first: int, unit: str):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            h = np.array([draws(i, seed) for i in ids], "u8")
            n, a, b, left, right = cuts(texts, h[:, 0], h[:, 1], unit)
            forms, outputs = [], []
            for text, i, j, share, order in zip(texts, left, right, h[:, 2] % 100, h[:, 3] % 100):
                raw = text.as_py()
                if not raw or share >= transformed or any(m in raw for m in marks):
                    forms.append(PLAIN)
                    outputs.append(raw)
                    continue
                before, after = marks[0] + raw[:i], marks[1] + raw[j:]
                forms.append(SPM if order < suffix_first else PSM)
                both = after + before if order < suffix_first else before + after
                outputs.append(both + marks[2] + raw[i:j])
            plain = np.array([f == PLAIN for f in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(n),
                    pa.array(forms, pa.string()),
                    pa.array(a, mask=plain),
                    pa.array(b - a, mask=plain),
                    pa.array(outputs, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def fill_in_middle(
    documents: DataFrame, seed: int = 1, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, unit: str = CODE_POINT
) -> DataFrame:
    """One row per row of `documents`: doc_id, n, form, prefix_chars, middle_chars, output.

    n is the text's number of units. A text is left as it is (`plain`, with null lengths) if it is empty or null, holds one
    of the marks, or is not among the `transformed` of a hundred; else its output is prefix, suffix, middle (`psm`), or for
    `suffix_first` of a hundred suffix, prefix, middle (`spm`), each behind its mark. prefix_chars and middle_chars count
    units. Draws depend on doc_id and seed alone, so repeated rows are cut alike; a null doc_id draws like an empty one.
    No rows give no rows; other columns are left behind.
    """
    prepare(documents.sparkSession)
    rows = with_text(documents).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_transform(seed, transformed, suffix_first, unit), _SCHEMA)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from. No piece holds a mark and marks do not overlap themselves, so the first
    occurrence of a mark is where a piece ends."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    head = lambda mark: F.substring_index(body, mark, 1)
    tail = lambda mark: F.substr(body, F.char_length(head(mark)) + len(mark) + 1)
    second = lambda mark: F.substring_index(tail(mark), MIDDLE, 1)
    last = lambda mark: F.substr(tail(mark), F.char_length(second(mark)) + len(MIDDLE) + 1)
    return (
        F.when(F.col(form) == PLAIN, F.col(output))
        .when(F.col(form) == PSM, F.concat(head(SUFFIX), last(SUFFIX), second(SUFFIX)))
        .when(F.col(form) == SPM, F.concat(second(PREFIX), last(PREFIX), head(PREFIX)))
    )


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of the output and of the text rebuilt from it."""
    cut = fill_in_middle(documents)
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"),
    )
