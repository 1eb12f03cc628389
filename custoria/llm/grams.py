"""Hashed byte n-gram counts of texts."""

from __future__ import annotations

import numpy as np

#: Everything in ASCII that is no letter, and what it becomes.
LETTERS_ONLY = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def letters(text: str) -> bytes:
    """Lower-cased UTF-8 with one blank between words of letters and around them."""
    return b" " + b" ".join(text.lower().encode().translate(LETTERS_ONLY).split()) + b" "


def gram_counts(raw: bytes, lengths: tuple[int, ...], size: int) -> np.ndarray:
    """Counts of all n-grams of the given lengths, hashed to `size` (a power of two) cells."""
    codes = np.frombuffer(raw, "u1").astype("u4")
    total = np.zeros(size, "i8")
    with np.errstate(over="ignore"):
        joint = codes.copy()
        for n in range(1, max(lengths) + 1):
            if n > 1:
                if len(codes) < n:
                    break
                joint = joint[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :]
            if n in lengths:
                cell = ((joint * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(12)) & np.uint32(size - 1)
                total += np.bincount(cell, minlength=size)
    return total
