"""Brute-force versions of the operators, one text or pair at a time."""

from __future__ import annotations

import hashlib
import re

KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _digits(text):
    return [int(c) for c in text if c in "0123456789"]


def valid(kind, text):
    digits = _digits(text)
    if kind == "ip":
        return all(int(part) <= 255 for part in text.split("."))
    if kind == "card":
        doubled = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and doubled % 10 == 0
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def personal_data(text):
    """(counts by kind, the base spans as text)"""
    spans, counts = [], {}
    for place, (kind, pattern) in enumerate(KINDS.items()):
        own = [(m.start(), place, kind, m.end()) for m in pattern.finditer(text or "") if valid(kind, m[0])]
        counts[kind] = len(own)
        spans += own
    return counts, ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def repeats(texts, length):
    """(bytes, removed, spans, digest of the rest) per text: every byte under a string of `length` that starts twice."""
    from collections import Counter

    raws = [(t or "").encode() for t in texts]
    seen = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), spans, sha(kept)))
    return out
