"""Fill-in-the-middle, sharding and the filter audit against brute force, on edge cases and on skewed groups."""

import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from custoria.llm import fill_in_middle as fim
from custoria.llm import filter_audit, packing, sharding

EDGE = [(1, None), (2, ""), (3, " \n"), (None, "a b c"), (5, "a b c"), (5, "a b c"), (6, "x" * 300_000), (7, "é ß 😀 1")]
ALPHABET = ["a", "é", "ß", "語", "😀", "\n", " ", "<", "P>", "́", "\x00"]


def noise(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def units_of(text, unit):
    if unit == fim.CODE_POINT:
        return list(text)
    lines = [line + "\n" for line in text.split("\n")]
    lines[-1] = lines[-1][:-1]
    return [line for line in lines if line]


# ---- fill in the middle -----------------------------------------------------------------------


@pytest.mark.parametrize("unit", [fim.CODE_POINT, fim.LINE])
def test_units_select_and_rank(unit):
    rng = random.Random(11)
    texts = [noise(rng, rng.choice([0, 0, 1, 2, 7, 8, 9, 40, 300])) for _ in range(200)]
    first = np.array([rng.getrandbits(32) for _ in texts], "u8")
    second = np.array([rng.getrandbits(32) for _ in texts], "u8")
    array = pa.array([t.encode() for t in [*texts, "tail"]], pa.binary()).slice(0, len(texts))
    n, a, b, left, right = fim.cuts(array, first, second, unit)
    for i, text in enumerate(texts):
        units = units_of(text, unit)
        x, y = sorted((int(first[i]) % (len(units) + 1), int(second[i]) % (len(units) + 1)))
        ends = [len("".join(units[:k]).encode()) for k in (x, y)]
        assert (n[i], a[i], b[i], left[i], right[i]) == (len(units), x, y, *ends)


def fim_plain(doc, text, unit):
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    text = text or ""
    units = units_of(text, unit)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return doc, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("unit", [fim.CODE_POINT, fim.LINE])
def test_fill_in_middle(spark, documents, unit):
    rng = random.Random(12)
    rows = [*EDGE, *((100 + i, noise(rng, rng.randrange(60))) for i in range(300)), (900, "a<P>b"), (901, "<S>"), (902, "<<M>>")]
    rows += [(2000, "the hot text " * 9)] * 100
    frame = fim.fill_in_middle(documents(*rows), unit=unit)
    found = frame.select("*", fim.restored().alias("back")).collect()
    key = lambda r: repr(r)
    assert sorted((tuple(r)[:-1] for r in found), key=key) == sorted((fim_plain(d, t, unit) for d, t in rows), key=key)
    forms = {r["form"] for r in found}
    assert forms == {"plain", "psm", "spm"}
    assert sorted(r["back"] for r in found) == sorted(t or "" for _, t in rows)
    assert fim.fill_in_middle(documents((1, "a")).limit(0)).count() == 0


def test_form_parameters(spark, documents):
    table = documents(*((i, f"text {i}") for i in range(200)))
    assert {r["form"] for r in fim.fill_in_middle(table, transformed=100, suffix_first=100).collect()} == {"spm"}
    assert {r["form"] for r in fim.fill_in_middle(table, transformed=0).collect()} == {"plain"}
    assert fim.fill_in_middle(table, seed=2).exceptAll(fim.fill_in_middle(table)).count() > 100


# ---- sharding ---------------------------------------------------------------------------------


def homes(frame, weights):
    return {r["doc_id"]: r["shard"] for r in sharding.assign(frame, weights).collect()}


def test_a_change_of_shards_moves_only_what_it_must(spark, documents):
    table = documents(*((i, f"t{i % 7}") for i in range(6000)))
    eight = sharding.even(8)
    before, grown = homes(table, eight), homes(table, sharding.even(9))
    moved = {d for d in before if before[d] != grown[d]}
    assert all(grown[d] == 8 for d in moved) and 0.08 < len(moved) / 6000 < 0.14
    lost = homes(table, {s: w for s, w in eight.items() if s != 3})
    assert all(before[d] == 3 for d in before if before[d] != lost[d]) and 3 not in lost.values()
    heavier = homes(table, {**eight, 5: 2.0})
    assert all(heavier[d] == 5 for d in before if before[d] != heavier[d])
    share = sum(s == 5 for s in heavier.values()) / 6000
    assert abs(share - 2 / 9) < 0.03
    counts = np.bincount(list(before.values()), minlength=8)
    assert counts.min() > 650 and counts.max() < 850
    table_of = {(r["source"], r["target"]): r["n"] for r in sharding.moves(table, eight, sharding.even(9)).collect()}
    assert sum(table_of.values()) == len(moved) and {t for _, t in table_of} == {8}
    assert 2 not in homes(table, {**eight, 2: 0.0}).values()
    for wrong in ({0: -1.0, 1: 1.0}, {0: 0.0}, {}):
        with pytest.raises(ValueError):
            sharding.assign(table, wrong)


@pytest.mark.parametrize("range_rows", [2, sharding.RANGE_ROWS])
def test_slots_are_gapless_with_a_hot_key(spark, documents, range_rows):
    rows = [*EDGE, *((100 + i, f"t{i % 5}") for i in range(400)), *[(77, "hot")] * 300, *[(77, "hotter")] * 100]
    frame = documents(*rows, parts=5)
    key = sharding.key_text("doc_id")
    home, place = sharding.shard_of(key, sharding.even(4)), sharding.hash_number(key)
    sized = frame.select("doc_id", F.length("text").alias("size"), home.alias("shard"), place.alias("place"))
    out = sharding.slots(sized, "place", ["doc_id", "size"], range_rows=range_rows).collect()
    assert len(out) == len(rows)
    for shard in range(4):
        own = sorted((r["slot"], r["place"]) for r in out if r["shard"] == shard)
        assert [s for s, _ in own] == list(range(len(own))) and [p for _, p in own] == sorted(p for _, p in own)
    placed = sharding.placed(frame).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in placed) == sorted(
        (str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows
    )
    assert all(r["grown_shard"] in (r["shard"], 40) and r["law"] == "key" for r in placed)
    for shard in {r["shard"] for r in placed}:
        assert sorted(r["slot"] for r in placed if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in placed)))
    assert sharding.placed(frame.limit(0)).count() == 0


def test_written_shards_hold_every_row_once(spark, documents, tmp_path):
    frame = documents(*EDGE, *((100 + i, f"t{i}") for i in range(100)))
    sharding.write_shards(frame, str(tmp_path / "shards"), sharding.even(3))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.drop("shard").exceptAll(frame).count() == 0 and back.count() == len(EDGE) + 100
    assert back.exceptAll(sharding.assign(frame, sharding.even(3)).select(*back.columns)).count() == 0


# ---- filter audit -----------------------------------------------------------------------------


def audit_plain(rows, labels):
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    docs = []
    for d, t, lang in rows:
        t = t or ""
        w = t.encode().split()
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)}
        fails |= {"D": any(c in "#$%&*|" for c in t), "E": d is not None and first[t] < d}
        own = [(q, x) for i, q, x in labels if i == d and d is not None]
        docs.append((lang or "", {f for f, bad in fails.items() if bad}, any(q == 1 for q, _ in own), any(x == 1 for _, x in own)))
    out = {}
    for part in {p for p, *_ in docs}:
        own = [x for x in docs if x[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                earlier = set(order[: step - 1])
                here = [x for x in own if f in x[1] and not x[1] & earlier]
                total[f] += len(here)
                out[part, order, step] = [
                    sum(not x[1] & (earlier | {f}) for x in own), len(here), sum(f in x[1] and bool(x[1] & earlier) for x in own),
                    sum(x[1] == {f} for x in own), sum(x[2] for x in here), sum(x[3] for x in here), f,
                ]
        for key, values in out.items():
            if key[0] == part:
                values[-1] = total[values[-1]]
    return out


def test_filter_audit(spark, documents):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(300)]
    rows = [(*r, None) for r in EDGE]
    for i in range(200):
        n = rng.choice([0, 50, 99, 100, 150])
        pool = words[: rng.choice([20, 300])]
        text = " ".join(rng.choice(pool) for _ in range(n)) + rng.choice(["", " #", " " + "ABC" * rng.choice([1, 60])])
        rows.append((rng.randrange(150), text, rng.choice(["en", "de", None, ""])))
    rows += [(1000 + i, " ".join(words[:120]), "en") for i in range(150)]
    labels = [(rng.choice([None, *range(160), 1003]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(200)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).withColumn("part", F.lit(1))
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    found = filter_audit.audit(documents(*rows), table).collect()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == limit
    assert {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in found} == audit_plain(rows, labels)
    assert filter_audit.audit(documents(*rows).limit(0), table).count() == 0
    unlabelled = filter_audit.audit(documents(*rows), table.limit(0))
    assert unlabelled.filter("good_lost + toxic_lost > 0").count() == 0 and unlabelled.count() == len(found)


def test_the_recursion_has_a_row_per_part_and_prefix(spark, documents):
    rows = [(i, f"text {i}", f"l{i % 40}") for i in range(80)]
    masks = filter_audit.failures(documents(*rows))
    walk = filter_audit.prefix_metrics(filter_audit.cells(masks, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert walk.count() == 40 * 325 and walk.select("part", "prefix").distinct().count() == 40 * 325


# ---- words of the packing tokenizer -------------------------------------------------------------

ODD = [
    "don't 'sabc I'll it's ÉCOLE ÑAÑO naïve² x_y_z 12ab3.4 “quoted” İstanbul K'M K áb 가 가 😀😀a ß ﬁ Ⅷ ①",
    "<|startoftext|> <|EndOfText|>x K'M 'RE <| ' '' 's's '''re", "a\x1cb a b \u0085 word x", "\x00 \x7f a\x01b", "ſ ẞ Ω Å",
    "क्षि ไทย 中文字 العربية", "", " \n", "a" * 5000 + " " + "é" * 100 + "!?" * 50,
]


def test_words_are_encoded_as_whole_texts_are(monkeypatch):
    """Also when what is remembered is dropped in between, and with words whose pieces are not certain."""
    rng = random.Random(21)
    alphabet = ["a", "b", "é", "ß", "İ", "'", "s", "t", "1", "²", ".", "-", "_", "語", "😀", "́", " ", " ", "\n", "B"]
    texts = [*ODD, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(3000))]
    tokens = packing.Tokens(None)
    tokens.known.clear()
    tokens.older.clear()
    wanted = [np.array(e.ids, "<u4").tobytes() for e in tokens.model.encode_batch(texts, add_special_tokens=False)]
    raws = pa.array(texts)
    assert tokens.encode_all(raws) == wanted and tokens.encode_all(raws) == wanted
    assert max(map(len, tokens.known)) <= packing.LONGEST_WORD
    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 200)
    assert [tokens.encode_all(raws.slice(i, 1))[0] for i in range(len(raws))] == wanted
    assert [len(g) for g in packing._groups(pa.array(["x" * 10, "y" * packing._TEXT_BYTES, "z", ""]))] == [1, 1, 2]
