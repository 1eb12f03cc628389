"""The corpus operators against brute force, on edge cases and on skewed groups."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from custoria.llm import decontamination, exact_dedup, language_id, licences, packing, personal_data, quality, repeats, toxicity
from custoria.llm.queries import QUERIES
from custoria.llm.shingle_join import bands_of, drop_near, part_keys, shingle_groups
from custoria.llm.shingles import Shingler, mix
from custoria.llm.signature_tree import join, linked
from custoria.llm.suffixes import deep_shallow
from tests.conftest import SMALL
from tests.llm import plain

EDGE = [(1, None), (2, ""), (3, " \n"), (None, "a b c"), (5, "a b c"), (5, "a b c"), (6, "x" * 30_000), (7, "é ß 😀 1")]
WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows_of(frame, *names):
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=lambda t: tuple((v is not None, str(v)) for v in t))


# ---- exact dedup ----------------------------------------------------------------------------


def exact_brute(rows):
    groups = {}
    for place, (doc, text) in enumerate(rows):
        body = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(body, []).append((-len(text or ""), doc is None, doc or 0, place))
    out = []
    for body, own in groups.items():
        best = min(own)
        keep = rows[best[3]][0]
        for *_, place in own:
            out.append((rows[place][0], keep, len(own), plain.sha(body)))
    return out


@pytest.mark.parametrize("key_bits", [64, 2])
def test_exact_groups(spark, documents, key_bits):
    """Also with keys of two bits, where every chain holds several texts."""
    rng = random.Random(3)
    texts = [prose(rng, 5) for _ in range(20)]
    rows = [*EDGE, *((100 + i, rng.choice(texts).replace(" ", rng.choice([" ", "  ", "\t"]))) for i in range(120))]
    rows += [(1000 + i, "the hot text") for i in range(90)]
    got = exact_dedup.exact_groups(documents(*rows), key_bits=key_bits)
    found = rows_of(got, "doc_id", "keep_id", "group_size", "text_sha256")
    assert found == sorted(exact_brute(rows), key=lambda t: tuple((v is not None, str(v)) for v in t))
    kept = got.filter("kept").groupBy("text_sha256").count().collect()
    assert {r["count"] for r in kept} == {1} and len(kept) == len({r[3] for r in found})


def test_chains_tell_texts_of_one_digest_apart():
    """Key and digest agree, bytes do not; a chain goes on over batches and ends with its key."""
    batch = lambda *rows: pa.RecordBatch.from_pylist([dict(zip(("bucket", "key", "first", "sha", "entry"), row)) for row in rows])
    out = exact_dedup._own(iter([batch((0, 5, 1, b"s", b"a"), (0, 5, 2, b"s", b"b")), batch((0, 5, 3, b"s", b"a"), (1, 6, 4, b"s", b"b"))]))
    assert [(r["bucket"], r["key"], r["link"], r["first"]) for b in out for r in b.to_pylist()] == [(0, 5, 0, 1), (0, 5, 1, 2), (0, 5, 0, 3), (1, 6, 0, 4)]


def test_drop_exact_keeps_one_row_and_all_columns(spark, documents):
    table = documents(*EDGE)
    kept = exact_dedup.drop_exact(table)
    assert kept.columns == table.columns
    assert rows_of(kept, "doc_id") == rows_of(exact_dedup.exact_groups(table).filter("kept"), "doc_id")
    assert exact_dedup.drop_exact(table.limit(0)).count() == 0


def test_the_directory_splits_only_overfull_buckets():
    plan = exact_dedup.bucket_plan({0: 100, 1: 100, 2: 1, 9: 5}, 4, 100)
    assert plan[0][0] != plan[1][0] and plan[0][1] == 4
    assert len({bucket for bucket, _ in plan[8:]}) == 1 and plan[8][1] == 1
    assert [b for b, _ in plan] == sorted(b for b, _ in plan)
    assert exact_dedup.bucket_plan({3: 1000}, 3, 10)[3][1] == 3


# ---- packing --------------------------------------------------------------------------------


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for capacity in (10, 64, 100):
        lengths = [rng.randint(1, capacity) for _ in range(300)]
        bins = []
        for n in sorted(lengths, reverse=True):
            fitting = [b for b in bins if b[0] >= n]
            if fitting:
                min(fitting)[0] -= n
            else:
                bins.append([capacity - n])
        counts = {n: lengths.count(n) for n in set(lengths)}
        runs = packing.plan_bins(counts, capacity)
        used, seen = {}, {n: [] for n in counts}
        for run in runs:
            for i in range(run.pieces):
                at = run.offset + i % run.per_bin * run.length
                used.setdefault(run.bin + i // run.per_bin, []).append((at, at + run.length))
                seen[run.length].append(run.rank + i)
        assert len(used) == len(bins)
        assert all(sorted(seen[n]) == list(range(counts[n])) for n in counts)
        for spans in used.values():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_packing_round_trip(spark, documents):
    rng = random.Random(8)
    rows = [*EDGE, *((50 + i, prose(rng, rng.randint(1, 900))) for i in range(60)), (900, prose(rng, 6000))]
    model = packing.Tokens(None).model
    pieces = packing.pack(packing.token_pieces(documents(*rows), with_ids=True), slice_rows=10).collect()
    by_doc = {}
    for r in pieces:
        assert r["length"] == len(r["ids"]) <= packing.CAPACITY and r["start"] == r["piece"] * packing.CAPACITY
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc, text in rows:
        if doc != 5:
            own = sorted(by_doc[doc], key=lambda r: r["piece"])
            assert sum((list(r["ids"]) for r in own), []) == model.encode(text or "", add_special_tokens=False).ids + [0]
    assert len(by_doc[5]) == 2
    spans = {}
    for r in pieces:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["offset"] + r["length"]))
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= packing.CAPACITY and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    assert packing.pack_documents(documents(*rows).limit(0)).count() == 0


# ---- n-gram Jaccard join --------------------------------------------------------------------


def groups_brute(rows, words, percent):
    sets = {}
    for doc, text in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets.setdefault(doc, []).append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    label = {d: d for d in sets if d is not None}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if label[a] != label[b] and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    out = []
    for doc, own in sets.items():
        out += [(doc, len(one), label.get(doc)) for one in own]
    return out


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


@pytest.mark.parametrize("words,percent,block", [(3, 90, 4 << 20), (5, 80, 4 << 20), (5, 80, 20_000)])
def test_shingle_groups(spark, documents, words, percent, block):
    """Near copies at every distance; small blocks deal one cluster to many tasks."""
    rng = random.Random(words * percent)
    rows = [r for r in EDGE if r[0] != 6]
    for g in range(8):
        base = prose(rng, rng.choice([4, 12, 40, 150, 400]))
        rows += [(100 * (g + 1) + i, edited(rng, base, rng.randint(0, 1 + len(base) // 300))) for i in range(9)]
    hot = prose(rng, 200)
    rows += [(5000 + i, edited(rng, hot, rng.randint(0, 3))) for i in range(40)]
    passage = prose(rng, 60)
    rows += [(7000 + i, f"{prose(rng, 40)} {passage}") for i in range(20)]
    got = shingle_groups(documents(*rows), words, percent, block)
    want = sorted(groups_brute(rows, words, percent), key=lambda t: tuple((v is not None, str(v)) for v in t))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == want


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(4)
    for percent in (80, 90):
        for size in (1, 2, 5, 9, 19, 20, 33, 70, 150, 400, 1200):
            for _ in range(8):
                a = np.unique(rng.integers(0, 1 << 63, size * 2, dtype="u8"))[:size]
                differ = (2 * size) * (100 - percent) // (100 + percent)
                gone, new = differ // 2, differ - differ // 2
                b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 1 << 63, new, dtype="u8"))))
                if linked(a, b, percent):
                    assert set(part_keys(a, percent).tolist()) & set(part_keys(b, percent).tolist()), (percent, size)
                assert bands_of(size, percent)


def test_tree_join_connects_what_is_linked():
    rng = np.random.default_rng(9)
    base = [np.unique(rng.integers(0, 5000, 120)).astype("u8") for _ in range(6)]
    sets = [np.unique(np.where(rng.random(len(b)) < 0.06, rng.integers(0, 5000, len(b)).astype("u8"), b)) for b in base for _ in range(12)]
    want = {(i, j) for i in range(len(sets)) for j in range(i) if linked(sets[i], sets[j], 80)}

    def closure(pairs):
        up = list(range(len(sets)))
        for _ in up:
            for i, j in pairs:
                up[i] = up[j] = min(up[i], up[j])
        return up

    found = join(sets, 80)
    assert closure(found) == closure(want) and all(linked(sets[i], sets[j], 80) for i, j in found)
    across = join(sets, 80, 30)
    assert all((i < 30) != (j < 30) for i, j in across)
    inside = [(i, j) for i, j in want if (i < 30) == (j < 30)]
    assert closure(across + inside) == closure(want)


def test_drop_near_keeps_the_smallest(spark, documents):
    table = documents((3, "a b c d e f g"), (2, "A b c d e f g"), (9, "q r s t u v"), (None, "a b c d e f g"), (4, None))
    assert rows_of(drop_near(table), "doc_id") == [(None,), (2,), (4,), (9,)]
    assert shingle_groups(table.limit(0)).count() == 0


def test_shingles_equal_plain_ones():
    texts = ["", " \t", "One", "one TWO", "a b c d", "a  b\x0bc\nd", "é É a b c"]
    sets = list(Shingler(3).sets([t.encode() for t in texts]))
    assert [len(s) for s in sets] == [0, 0, 1, 1, 2, 2, 3]
    assert (sets[4] == sets[5]).all() and all((np.diff(s.astype("f8")) > 0).all() for s in sets)


# ---- repeats --------------------------------------------------------------------------------


def test_deep_shallow_sorts():
    rng = np.random.default_rng(2)
    strings = rng.integers(0, 3, (300, 64)).astype("u1")
    strings[::3] = strings[0]
    strings[1::7, :60] = strings[1, :60]
    group = np.sort(rng.integers(0, 5, 300))
    order = deep_shallow(strings, group, shallow=1)
    assert sorted(order.tolist()) == list(range(300))
    keys = [(int(group[i]), strings[i].tobytes()) for i in order]
    assert keys == sorted(keys)


def test_ranges_of_a_text_leave_the_comparison_joined():
    rng = random.Random(5)
    word = lambda n: bytes(rng.randrange(1, 255) for _ in range(n))
    length, gram = 60, 16
    middle, rows = word(gram), []
    for i in range(12):  # texts that agree on ever more bytes before the anchor: a range for every depth
        rows.append((1, bytes([i]), 100, word(44 - 3 * i) + bytes(range(1, 1 + 3 * i))[::-1] + middle + b"x" * 44))
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64(), pa.binary()))], ["key", "id", "place", "bytes"])
    found = [tuple(r.values()) for b in repeats._compare(length, gram)(iter([batch])) for r in b.to_pylist()]
    # Row i shares with row i + 1, the last one with the one before.
    assert sorted(found) == [(bytes([i]), 100 - 3 * min(i, 10), 160) for i in range(12)]


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeats(spark, documents, hot):
    """Shared passages at all borders, periodic runs, copies; a low bound sends frequent anchors the aggregate way."""
    rng = random.Random(hot)
    passage = prose(rng, 30)
    rows = [r for r in EDGE if r[0] != 6]
    for i in range(30):
        a, b = sorted(rng.randrange(len(passage)) for _ in range(2))
        rows.append((100 + i, prose(rng, rng.randint(0, 20)) + passage[a:b] + prose(rng, rng.randint(0, 9))))
    rows += [(200 + i, passage) for i in range(4)]
    rows += [(300, "ab" * 700), (301, "x" + "ab" * 40), (302, "abc " * 30 + passage[:40] + "abc " * 300), (303, "z" * 61)]
    table = documents(*rows)
    got = repeats.remove_repeats(table, length=60, gram=16, hot_rows=hot)
    want = sorted((doc, *values) for (doc, _), values in zip(rows, plain.repeats([t for _, t in rows], 60)) if doc is not None)
    found = rows_of(got.filter("doc_id is not null"), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(found) == want
    assert repeats.remove_repeats(table.limit(0)).count() == 0


def test_a_window_of_frequent_grams_is_hashed_once():
    """A window that holds many anchors belongs to one of them; before, each of them hashed all windows around it."""
    length, gram = 60, 16
    raw = (prose(random.Random(7), 30) + " " + "abcdefghi" * 30 + " " + prose(random.Random(8), 30)).encode()
    places, _ = repeats.Anchors(length, gram).find(raw)
    padded = raw.rjust(len(raw) + length, b"\xff").ljust(len(raw) + 2 * length, b"\xff").translate(repeats._UP)
    bodies = [padded[p + gram : p + 2 * length] for p in places.tolist()]
    batch = pa.RecordBatch.from_arrays([pa.array([b"t"] * len(places)), pa.array(places), pa.array(bodies)], ["id", "place", "bytes"])
    starts = [s for b in repeats._windows(length, gram)(iter([batch, batch.slice(0, 0)])) for s in b.column(2).to_pylist()]
    assert sorted(starts) == list(range(len(raw) - length + 1))


def test_frequent_windows_are_joined_with_a_saved_table(documents, monkeypatch):
    """Next to an aggregate by window Spark can neither broadcast a join by window nor split it where one is frequent; so for grams."""
    rng, plans = random.Random(23), {}

    def settle(frame, label, save=repeats.settle):
        plans[label] = frame._jdf.queryExecution().executedPlan().toString()
        return save(frame, label)

    monkeypatch.setattr(repeats, "settle", settle)
    passage = prose(rng, 30)
    rows = [(i, prose(rng, 9) + passage + prose(rng, 9)) for i in range(30)]
    got = repeats.remove_repeats(documents(*rows), length=60, gram=16, hot_rows=3)
    assert "Join" in plans["ranges"] and not re.search(r"Aggregate\(keys=\[window", plans["ranges"])
    assert "Join" in plans["contexts"] and not re.search(r"Aggregate\(keys=\[key", plans["contexts"])
    want = [(doc, *values[:2]) for (doc, _), values in zip(rows, plain.repeats([t for _, t in rows], 60))]
    assert sorted(rows_of(got, "doc_id", "n_bytes", "n_removed")) == want and min(w[2] for w in want) >= len(passage)


# ---- personal data --------------------------------------------------------------------------


def test_long_runs_of_digits_take_linear_time(spark, documents):
    """A text of 100,000 digits, of digits and marks, and of short numbers: each would end after minutes if rescanned."""
    rng = random.Random(18)
    digits = "".join(rng.choice("0123456789") for _ in range(100_000))
    texts = [digits, "1." * 50_000, "1-" * 50_000, "+1 " * 30_000, "4111 1111 1111 1111 " * 5_000, "a1@" * 30_000]
    begin = time.perf_counter()
    rows = personal_data.base_spans(documents(*enumerate(texts), parts=6)).collect()
    assert time.perf_counter() - begin < 60
    for row in rows:
        wanted = plain.personal_data(texts[row["doc_id"]])[1] if row["doc_id"] != 1 else None
        if wanted is not None:
            assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in row["base"]) == wanted


def test_luhn_of_any_length(spark):
    rng = random.Random(19)
    numbers = ["", "0", "18", "79927398713", "4111 1111-1111 1111", *("".join(rng.choice("0123456789") for _ in range(rng.randrange(1, 40))) for _ in range(200))]
    frame = spark.createDataFrame([(n,) for n in numbers], "n string")
    for r in frame.select("n", personal_data.luhn(F.col("n")).alias("ok")).collect():
        digits = [int(c) for c in reversed(r["n"]) if c.isdigit()]
        assert r["ok"] == (sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0)


PII = [
    (10, "mail bob@x.org, a@b.c+d@e.ff and +1 (017) 555-7713."),
    (11, "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.255 4111 1111-1111 1111 4111111111111112"),
    (12, "é😀 x@y.z " + "9" * 5000 + " " + "a" * 5000 + "@ " + "a.b" * 3000),
    (13, "+12345678 +1 2 3 4 5 6 7 8 9 +(123)"),
]


def test_base_spans(spark, documents):
    rows = [*EDGE, *PII, (14, " ".join(f"u{i}@h{i}.org" for i in range(700)))]
    found = {r["doc_id"]: r for r in personal_data.find_personal_data(documents(*rows)).collect()}
    for doc, text in rows:
        counts, spans = plain.personal_data(text)
        assert found[doc]["base_sha256"] == plain.sha(spans), doc
        assert all(found[doc][f"n_{kind}"] == n for kind, n in counts.items())
        assert found[doc]["spans"] == spans
    assert personal_data.find_personal_data(documents(*rows).limit(0)).count() == 0


def test_contexts_reveal_unseen_identifiers(spark, documents):
    rng = random.Random(1)
    rows = [(i, f"{prose(rng, 6)} mailto: user{i}@host.org thanks {prose(rng, 4)}") for i in range(60)]
    rows += [(100 + i, f"{prose(rng, 6)} {rng.randint(10, 99)}kg {prose(rng, 4)}") for i in range(60)]
    rows.append((500, "see mailto: user77@intranet thanks"))
    table = personal_data.find_personal_data(documents(*rows))
    assert table.filter("n_found > 0").select("doc_id", "spans").collect() == [(500, "email:12:27")]
    nodes = table._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in nodes and "Arrow" not in nodes


def test_contexts_reveal_other_formats_and_further_hops(spark, documents):
    rng = random.Random(2)
    rows = [(1000 + i, f"{prose(rng, 6)} tel: +1 {rng.randint(200, 999)} 555-{rng.randint(1000, 9999)} {prose(rng, 4)}") for i in range(600)]
    cards = [f"4{rng.randint(0, 10**14 - 1):014d}" for _ in range(60)]
    for i, body in enumerate(cards):
        last = next(d for d in "0123456789" if plain.valid("card", body + d))
        rows.append((100 + i, f"{prose(rng, 6)} card: {body}{last} {prose(rng, 4)}"))
    rows += [(200 + i, f"{prose(rng, 6)} mailto: user{i}@host.org {prose(rng, 4)}") for i in range(60)]
    rows += [(300 + i, f"{prose(rng, 6)} about {rng.randint(1000000, 9999999)} {prose(rng, 4)} in {5 + i % 2} parts") for i in range(60)]
    first = {400 + i: f"tel: 030{i:02d}5551{i:02d}" for i in range(30)}
    second = {450 + i: f"ring 030{i:02d}5551{i:02d}" for i in range(30)}
    third = {490: "ring 0404444 maybe"}
    spaced = {491: "tel: 555 123 4567 now", 492: "card: 4111 1111 1111 1112 now", 493: "mailto: anna at host dot org now", 494: "tel: 5 now"}
    want = {491: "phone:5:17", 492: "card:6:25", 493: "email:8:28", 494: "phone:5:6", 490: "phone:5:12"}
    want |= {d: "phone:5:16" for d in (*first, *second)}
    rows += [*first.items(), *second.items(), *third.items(), *spaced.items()]
    found = personal_data.find_personal_data(documents(*rows)).filter("n_found > 0").collect()
    assert {r["doc_id"]: r["spans"] for r in found} == want


# ---- trained operators ----------------------------------------------------------------------


def graded(spark, documents):
    rng = random.Random(11)
    good = [(i, prose(rng, 80)) for i in range(150)]
    bad = [(200 + i, " ".join(f"{rng.choice(WORDS)}%%%" for _ in range(60)) if i % 2 else f"{rng.choice(WORDS)} " * 90) for i in range(60)]
    rude = [(400 + i, f"{prose(rng, 40)} nastyword {prose(rng, 40)} vileword") for i in range(60)]
    rows = good + bad + rude
    labels = spark.createDataFrame(
        [(d, 0 if 200 <= d < 400 else 1, int(d >= 400)) for d, _ in rows] + [(None, 1, 1), (1, None, None)],
        "doc_id bigint, quality int, toxic int",
    )
    return documents(*rows, *((d + 9000 if d is not None else None, t) for d, t in EDGE)), labels


def test_quality(spark, documents):
    table, labels = graded(spark, documents)
    found = quality.with_quality(table, labels).join(labels, "doc_id").filter("held_out and quality is not null").collect()
    assert found and all(r["predicted"] == r["quality"] for r in found)
    everything = quality.with_quality(table, labels)
    assert everything.count() == table.count() and everything.filter("score is null or score < 0 or score > 1").count() == 0
    assert {r["score"] for r in quality.with_quality(table, labels.limit(0)).collect()} == {0.5}
    assert quality.with_quality(table.limit(0), labels).count() == 0


def test_toxicity(spark, documents):
    table, labels = graded(spark, documents)
    found = toxicity.with_toxicity(table, labels).join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    assert found and all(r["predicted"] == r["toxic"] for r in found)
    everything = toxicity.with_toxicity(table, labels)
    assert everything.count() == table.count() and everything.filter("score is null or score < 0 or score > 1").count() == 0
    assert {r["score"] for r in toxicity.with_toxicity(table, labels.limit(0)).collect()} == {0.0}


def test_nearest_examples_are_exact():
    rng = random.Random(6)
    texts = [prose(rng, 30) + (" bad worse" if i % 3 == 0 else " fine") + f" x{i % 7}" for i in range(400)]
    label = np.array([int(i % 3 == 0) for i in range(400)])
    index = toxicity.fit(texts, label, np.ones(400), np.arange(400))
    place = {t: i for i, t in enumerate(index.terms)}
    for text in texts[:40] + ["bad fine worse", "fine"]:
        counts = {place[t]: n for t, n in toxicity.terms_of(text).items() if t in place}
        at, value = index.vector(counts)
        cosine = value @ index.weights[at]
        want = sorted(((-c, i) for i, c in enumerate(cosine.tolist()) if c > 0))[: toxicity.NEIGHBOURS]
        assert [i for _, i in index.nearest(at, value)] == [i for _, i in want]


def test_language(spark, documents):
    rng = random.Random(12)
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ei"], "cc": ["ñes", "que", "ció"]}
    rows = [(i, " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(40)), lang) for lang, s in sounds.items() for i in rng.sample(range(9000), 120)]
    rows += [(9500, None, "aa"), (9501, "12 34", "bb"), (9502, "", None), (None, "kalo milo kaka", None)]
    table = documents(*rows)
    found = language_id.with_language(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    judged = [r for r in found if r["held_out"] and r["doc_id"] < 9500]
    assert judged and np.mean([r["lang"] == r["lang_pred"] for r in judged]) > 0.95
    assert {r["lang_pred"] for r in found if r["doc_id"] >= 9500} == {"und"}
    kept = language_id.drop_unidentified(table)
    assert kept.columns == table.columns and kept.count() == len(rows) - 3
    assert {r["lang_pred"] for r in language_id.with_language(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.with_language(table.limit(0)).count() == 0


def test_codewords_differ():
    for n in (2, 3, 4, 9, 40):
        code = language_id.codewords(n).astype(int)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= 1 and (n < 4 or min(apart) >= 3)
    assert language_id.codewords(1).shape == (1, 0)


def test_licences(spark, documents):
    rng = random.Random(13)
    rows = [(i, "\n".join(prose(rng, 12) for _ in range(4))) for i in range(60)]
    rows += [
        (100, f"{prose(rng, 9)}\nReleased under the MIT License.\n{prose(rng, 9)}"),
        (101, "Licensed under the Apache License, Version 2.0."),
        (102, f"{prose(rng, 90)} This work is licensed under the GNU General Public License, version 3. {prose(rng, 90)}"),
        (103, "the licence of poets"),
        *((d if d is None else d + 200, t) for d, t in EDGE),
    ]
    found = rows_of(licences.find_licences(documents(*rows)), "doc_id", "paragraph", "family")
    assert sorted(found) == [(100, 1, "MIT"), (101, 0, "Apache-2.0"), (102, 0, "GPL-3.0")]


def test_wrapped_licences(spark, documents):
    rng = random.Random(15)
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files"
    gpl = "This work is licensed under the GNU General\n * Public License, version 3."
    rows = [(i, "\n".join(prose(rng, 12) for _ in range(4))) for i in range(60)]
    rows += [(100, f"{prose(rng, 9)}\n# {mit}\n{prose(rng, 9)}"), (101, f"{prose(rng, 9)}\n\n * {gpl}\n")]
    found = rows_of(licences.find_licences(documents(*rows)), "doc_id", "paragraph", "family")
    assert sorted(found) == [(100, 1, "MIT"), (101, 2, "GPL-3.0")]


def test_wrapped_licences_in_every_source_header(spark, documents):
    """Halves of wrapped notices are the rule in such a corpus, yet are no examples of the unknown class."""
    rng = random.Random(17)
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files"
    rows = [(i, f"# {mit}\n{prose(rng, 30)}") for i in range(60)] + [(100 + i, prose(rng, 60)) for i in range(30)] + [(100, None)]
    table = documents(*rows, rows[0])
    found = rows_of(licences.find_licences(table), "doc_id", "paragraph", "family")
    assert sorted(found) == sorted([(i, 0, "MIT") for i in range(60)] + [(0, 0, "MIT")])
    assert licences.find_licences(table.limit(0)).count() == 0


def test_several_licences_in_a_line(spark, documents):
    rng = random.Random(16)
    rows = [(i, "\n".join(prose(rng, 12) for _ in range(4))) for i in range(60)]
    rows += [
        (102, f"{prose(rng, 90)} Released under the MIT License. {prose(rng, 90)} Licensed under the Apache License, Version 2.0. {prose(rng, 9)}"),
        (103, "SPDX-License-Identifier: MIT OR Apache-2.0"),
    ]
    found = rows_of(licences.find_licences(documents(*rows)), "doc_id", "paragraph", "family")
    assert sorted(found) == [(102, 0, "Apache-2.0"), (102, 0, "MIT"), (103, 0, "Apache-2.0"), (103, 0, "MIT")]


def test_items_with_all_edits_allowed_are_found_as_by_brute_force():
    rng = np.random.default_rng(5)
    words = lambda n: rng.integers(0, 1500, n)
    texts = [" ".join(f"w{w}" for w in words(n)).encode() for n in (5, 10, 15, 20, 40, 80) for _ in range(20)]
    items = decontamination.build_items(list(enumerate(texts)))
    fresh = lambda n: rng.integers(1, 1 << 62, n).astype("u8")
    found_in = [np.concatenate([fresh(int(rng.integers(0, 30))), decontamination._edited(own, int(edits), rng), fresh(9)]) for own, edits in zip(items.words, items.edits)]
    beyond = [decontamination._edited(own, 3 * int(edits) + 3, rng) for own, edits in zip(items.words, items.edits)]
    bodies = [*found_in, *beyond, fresh(400), fresh(0)]
    near = {(d, i): decontamination.edit_distance_inside(own, body) for d, body in enumerate(bodies) for i, own in enumerate(items.words)}
    wanted = {pair: n for pair, n in near.items() if n <= items.edits[pair[1]]}
    found = {(d, i): n for d, i, n, _ in decontamination.matches(items, bodies)}
    assert set(found) <= set(wanted) and len(wanted) >= len(texts)
    assert len(found) >= decontamination.RECALL * len(wanted)


def test_sampling_selects():
    """Of windows unrelated to an item hardly any pass; copies with all edits do, and equal ones always."""
    rng = np.random.default_rng(8)
    common = 1 / np.arange(1, 4001)
    draw = lambda n: mix(rng.choice(4000, n, p=common / common.sum()).astype("u8") + np.uint64(1))
    texts = [" ".join(f"w{w}" for w in rng.choice(4000, n, p=common / common.sum())).encode() for n in (10, 20, 40, 80) for _ in range(100)]
    items = decontamination.build_items(list(enumerate(texts)))
    every = np.arange(len(texts))
    assert items.passed(every, items.words).all()
    copies = [decontamination._edited(w, int(e), rng)[: len(w)] for w, e in zip(items.words, items.edits)]
    assert items.passed(every, copies).mean() >= 0.98
    others = np.array([items.passed(every, [draw(len(w)) for w in items.words]) for _ in range(5)]).mean(0)
    assert all(others[np.array([len(w) == n for w in items.words])].mean() < 0.01 for n in (20, 40, 80))
    assert others.mean() < 0.02


def test_decontamination(spark, documents):
    rng = random.Random(14)
    items = [(i, prose(rng, rng.randint(12, 50))) for i in range(60)]
    benchmark = spark.createDataFrame([*items, (None, "just some words"), (99, None), (98, "")], "item_id bigint, text string")
    rows = [*EDGE, *((200 + i, prose(rng, 150)) for i in range(50))]
    planted = set()
    for i, text in items:
        words = text.split()
        for _ in range(len(words) // 10):
            words[rng.randrange(len(words))] = "zzz"
        if i % 2:
            rows.append((1000 + i, f"{prose(rng, 60)} {' '.join(words).upper()}! {prose(rng, 60)}"))
            planted.add((1000 + i, i))
    table = documents(*rows)
    for slice_items in (20_000, 7):
        found = {(r["doc_id"], r["item_id"]) for r in decontamination.find_items(table, benchmark, slice_items=slice_items).collect()}
        assert found == planted
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_items(table, benchmark, slice_bytes=4000).collect()} == planted
    # Repeated items, one of them most of the table, are each reported, and further columns do no harm.
    most = benchmark.unionByName(benchmark.filter("item_id = 1").withColumn("item_id", F.explode(F.sequence(F.lit(500), F.lit(600)).cast("array<bigint>"))))
    most = most.withColumn("doc_id", F.lit(7)).withColumn("key", F.lit("x")).withColumn("distance", F.lit("y"))
    found = [(r["doc_id"], r["item_id"]) for r in decontamination.find_items(table, most, slice_items=30).collect()]
    assert sorted(found) == sorted([*planted, *((1001, i) for i in range(500, 601))])
    assert decontamination.drop_contaminated(table, most, slice_items=40).count() == len(rows) - len(planted)
    kept = decontamination.drop_contaminated(table, benchmark)
    assert kept.columns == table.columns and kept.count() == len(rows) - len(planted)
    assert decontamination.find_items(table.limit(0), benchmark).count() == 0
    assert decontamination.find_items(table, benchmark.limit(0)).count() == 0


# ---- queries --------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op4_licences", "op7_decontamination", "op13_filter_audit"}))
def test_every_document_is_in_the_result(spark, name):
    ids = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").distinct().count()
    assert QUERIES[name](spark, SMALL).select("doc_id").distinct().count() == ids
