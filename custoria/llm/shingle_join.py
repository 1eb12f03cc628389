"""Self-join of documents on the Jaccard similarity of their word shingles, by signature trees.

1. Candidates. The hash space of shingles is cut into as many parts as two linked sets can differ in, plus one and some
   spare, so two linked sets agree in at least one part that is not nearly empty (pigeonhole; see `Band`). A document sends
   one 64-bit key per part. Parts of nothing but hot shingles, those of passages that many documents share, count as nearly
   empty (see `hot_shingles`; any set of shingles may be called hot without losing a link). A task keeps one row per key and ties its other documents to that one, so a hot key costs a row per task.
   Documents tied by keys form clusters; a link never leaves a cluster.
2. Verification. Only documents in clusters send their sets, equal sets once per task. A cluster that fits a block is
   joined by one dual traversal of its signature tree. A larger one is dealt to blocks by hash: blocks are joined inside;
   one document of each connected piece goes on to join blocks with each other in the same way; documents still outside
   the largest piece meet every block. No pair of documents is ever listed before the trees have pruned it.
3. Components of the links found are the components of all links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custoria.llm.common import prepare, settle, with_text
from custoria.llm.graph import components
from custoria.llm.runs import runs
from custoria.llm.shingles import Shingler, mix
from custoria.llm.signature_tree import join

#: Bytes of sets in one block of a large cluster.
BLOCK_BYTES = 4 << 20
#: Keys a task holds before it sends them on.
HELD_KEYS = 1 << 20
#: A shingle is hot if at least so many of a few thousand documents in a task share it; at most so many are hot.
HOT_SHARE, MOST_HOT = 3, 500_000
#: Tokens a task counts together, in search of hot ones.
COUNTED = 1 << 21
#: Share of the parts that may hold hot shingles only before a set is weak.
HOT_SPARE = 0.05
#: Growth of the largest set size from one band to the next.
GROWTH = 1.3


class Band(NamedTuple):
    """Sizes of the smaller set of a pair, and how sets in the band are cut.

    Sets a <= b with 100 |a & b| >= percent |a | b| differ in at most (a + b)(100 - percent)/(100 + percent) shingles, so
    of `parts` parts at least parts - differ agree. A part with fewer than `light` shingles is light. At most `spare` parts
    of most sets are light, or hot throughout; then one of the agreeing parts is not. A set with more light parts is weak: it also sends the
    keys of its light parts, and one key for its empty parts if those alone exceed `spare`, so two weak sets meet as well.
    """

    number: int
    least: int
    most: int
    parts: int
    light: int
    spare: int


def _cut(least: int, differ: int) -> tuple[int, int, int]:
    for light in (4, 3, 2, 1):
        for parts in range(differ + 1, 3 * differ + 8):
            mean, spare = least / parts, parts - differ - 1
            rare = parts * sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(light))
            if (parts == 1 and least >= light) or spare >= rare + 3 * math.sqrt(rare) + HOT_SPARE * parts:
                return parts, light, spare
    return differ + 1, 1, 0


@lru_cache(maxsize=None)
def band(number: int, percent: int) -> Band:
    least = 1 if not number else band(number - 1, percent).most + 1
    most = max(least, int(least * GROWTH))
    differ = (most + most * 100 // percent) * (100 - percent) // (100 + percent)
    return Band(number, least, most, *_cut(least, differ))


def bands_of(size: int, percent: int) -> list[Band]:
    """Bands in which a set of this size can meet a partner, itself included."""
    lowest, found, number = -(-size * percent // 100), [], 0
    while (one := band(number, percent)).least <= size:
        if one.most >= lowest:
            found.append(one)
        number += 1
    return found


class Hot:
    """Membership in a sorted array of hot shingles."""

    def __init__(self, hot: np.ndarray):
        self.hot, self.near = hot, np.zeros(1 << 22, bool)
        self.near[hot % np.uint64(1 << 22)] = True

    def cold(self, tokens: np.ndarray) -> np.ndarray:
        maybe = self.near[tokens % np.uint64(1 << 22)]
        if maybe.any():
            at = np.flatnonzero(maybe)
            place = np.minimum(np.searchsorted(self.hot, tokens[at]), len(self.hot) - 1)
            maybe[at] = self.hot[place] == tokens[at]
        return ~maybe


def part_keys(tokens: np.ndarray, percent: int, hot: Hot | None = None) -> np.ndarray:
    """Keys of a sorted set of shingle hashes."""
    keys = []
    cold = hot.cold(tokens) if hot else np.ones(len(tokens), bool)
    with np.errstate(over="ignore"):
        for one in bands_of(len(tokens), percent):
            part = ((tokens >> np.uint64(32)) * np.uint64(one.parts)) >> np.uint64(32)
            at = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
            count = np.diff(np.append(at, len(tokens)))
            sums = np.add.reduceat(mix(tokens ^ np.uint64(0x9E3779B97F4A7C15)), at)
            tag = np.uint64((one.number + 1) * 0xD1342543DE82EF95 & (2**64 - 1))
            key = mix(mix(sums + part[at] * np.uint64(0xDA942042E4DD58B5) + count.astype("u8")) ^ tag)
            heavy = (count >= one.light) & np.logical_or.reduceat(cold, at)
            if one.parts - int(heavy.sum()) <= one.spare:
                keys.append(key[heavy])
            else:
                keys.append(np.where(heavy, key, mix(key + np.uint64(1))))
                if one.parts - len(at) > one.spare:
                    keys.append(mix(np.array([tag], "u8") + np.uint64(2)))
    return np.concatenate(keys) if keys else np.zeros(0, "u8")


def _ties(keys: np.ndarray, nodes: np.ndarray):
    """One row per distinct key, and ties (first node, other node) of equal keys."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    lead = nodes[np.flatnonzero(first)][np.cumsum(first) - 1]
    tied = ~first & (lead != nodes)
    pairs = np.unique(np.stack((lead[tied], nodes[tied])), axis=1) if tied.any() else np.zeros((2, 0), "i8")
    return keys[first], nodes[first], pairs


_KEYS = "key bigint, node bigint"


def _counted(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sets, held = Shingler(words), [], 0

        def flush():
            token, n = np.unique(np.concatenate(sets), return_counts=True)
            token, n = token[n >= HOT_SHARE], n[n >= HOT_SHARE]
            return pa.RecordBatch.from_arrays([pa.array(token.view("i8")), pa.array(n)], ["token", "n"])

        for batch in batches:
            for tokens in shingler.sets(batch.column(0).cast(pa.binary()).to_pylist()):
                sets.append(tokens)
                held += len(tokens)
                if held > COUNTED:
                    yield flush()
                    sets, held = [], 0
        if sets:
            yield flush()

    return run


def hot_shingles(rows: DataFrame, words: int) -> np.ndarray:
    """Sorted shingles that many documents share: counted in every task over all documents, summed, the most frequent kept.

    The result is bounded by MOST_HOT. It steers which keys are sent, never which links are found.
    """
    local = rows.select("text").mapInArrow(_counted(words), "token bigint, n bigint")
    total = local.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(MOST_HOT)
    return np.sort(total.select("token").toPandas()["token"].to_numpy("i8").view("u8"))


def _send(words: int, percent: int, sent_hot):
    def flush(keys, nodes):
        key, node, pairs = _ties(np.concatenate(keys), np.concatenate(nodes))
        with np.errstate(over="ignore"):  # a tie travels as two rows under a key of its own
            own = mix(mix(pairs[0].view("u8")) + mix(pairs[1].view("u8") ^ np.uint64(0x632BE59BD9B4E019)))
        key = np.concatenate((key, own, own)).view("i8")
        node = np.concatenate((node, pairs[0], pairs[1]))
        for at in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(key[at : at + (1 << 16)]), pa.array(node[at : at + (1 << 16)])], ["key", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, keys, nodes, held = Shingler(words), [], [], 0
        hot = Hot(sent_hot.value) if len(sent_hot.value) else None
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for doc, tokens in zip(ids, shingler.sets(batch.column(1).cast(pa.binary()).to_pylist())):
                if len(tokens):
                    own = part_keys(tokens, percent, hot)
                    keys.append(own)
                    nodes.append(np.full(len(own), doc, "i8"))
                    held += len(own)
                if held > HELD_KEYS:
                    yield from flush(keys, nodes)
                    keys, nodes, held = [], [], 0
        if keys:
            yield from flush(keys, nodes)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties of rows with equal keys; rows come sorted by key and node."""
    last_key, last_node = None, None
    for batch in batches:
        key, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not len(key):
            continue
        first = np.concatenate(([key[0] != last_key], key[1:] != key[:-1]))
        places = np.flatnonzero(first)
        lead = np.concatenate(([last_node if last_node is not None else 0], node[places]))[np.cumsum(first)]
        tied = ~first & (lead != node)
        last_key, last_node = key[-1], lead[-1]
        pairs = np.unique(np.stack((lead[tied], node[tied])), axis=1) if tied.any() else np.zeros((2, 0), "i8")
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        shingler, sent = Shingler(words), set()
        for batch in batches:
            digests, bodies, sizes = [], [], []
            for tokens in shingler.sets(batch.column(2).cast(pa.binary()).to_pylist()):
                body = tokens.tobytes()
                digest = hashlib.blake2b(body, digest_size=16).digest()
                digests.append(digest)
                sizes.append(len(body))
                bodies.append(None if digest in sent else body)
                if len(sent) > 1 << 20:
                    sent.clear()
                sent.add(digest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary())],
                ["cluster", "node", "digest", "bytes", "body"],
            )

    return run


def _join_runs(percent: int, keys: int):
    """Links inside each group of rows (keys..., node, side, label, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, keys):
            side = group.column("side").to_numpy()
            order = np.argsort(side, kind="stable")
            nodes, label = group.column("node").to_numpy()[order], group.column("label").to_numpy()[order]
            bodies = group.column("body").combine_chunks().to_pylist()
            sets = [np.frombuffer(bodies[i], "u8") for i in order]
            split = int((side == 0).sum()) if side.any() else None
            if split == 0:
                continue
            _, known = np.unique(label, return_inverse=True)
            known = np.where(label < 0, -1, known) if (label >= 0).any() else None
            found = join(sets, percent, split, known)
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[list(a)]), pa.array(nodes[list(b)])], ["u", "v"])

    return run


_LINKS = "u bigint, v bigint"


def _cross(percent: int, frame: DataFrame, keys: list[str]) -> DataFrame:
    spread = frame.select(*keys, "node", "side", "label", "body").repartition(*keys).sortWithinPartitions(*keys)
    return spread.mapInArrow(_join_runs(percent, len(keys)), _LINKS)


def _cluster_links(members: DataFrame, bodies: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """Connecting links inside every cluster of `members` (cluster, node, carrier, bytes); nodes are distinct.

    The sets come from `bodies` (carrier, body) when the members have been dealt to blocks.
    """
    totals = members.groupBy("cluster").agg(F.sum("bytes").alias("total"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = totals.select("cluster", F.ceil(F.col("total") / F.lit(block_bytes)).cast("int").alias("blocks"))
    dealt = settle(
        members.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "dealt"
    ).withColumns({"side": F.lit(0), "label": F.lit(-1).cast("bigint")})
    links = settle(_cross(percent, dealt.join(bodies, "carrier"), ["cluster", "block"]), "links")
    large = dealt.filter("blocks > 1")
    if not large.limit(1).count():
        return links

    def pieces(found: DataFrame) -> DataFrame:
        own = found.unionByName(large.select(F.col("node").alias("u"), F.col("node").alias("v")))
        return large.drop("label").join(components(own), "node")

    inside = pieces(links.join(large.select(F.col("node").alias("u")), "u", "left_semi"))
    lead = inside.groupBy("cluster", "label").agg(F.min("node").alias("node"))
    leaders = settle(large.join(lead.select("node"), "node", "left_semi").select("cluster", "node", "carrier", "bytes"), "leaders")
    if 2 * leaders.count() <= large.count():
        links = links.unionByName(_cluster_links(leaders, bodies, percent, block_bytes))
    merged = settle(pieces(links.join(large.select(F.col("node").alias("u")), "u", "left_semi")), "merged")

    # Documents outside the largest piece of their cluster meet every block.
    counts = merged.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    core = counts.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("core"))
    strays = merged.join(core, "cluster").filter("label <> core").drop("core")
    shares = strays.groupBy("cluster").agg(F.ceil(F.sum("bytes") / F.lit(block_bytes)).cast("int").alias("groups"))
    left = (
        strays.join(shares, "cluster")
        .withColumn("group", F.pmod(F.xxhash64("node", F.lit(7)), F.col("groups")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    right = (
        merged.join(shares, "cluster")
        .withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        .withColumn("side", F.lit(1))
    )
    columns = ["cluster", "group", "block", "node", "side", "label", "carrier"]
    across = left.select(columns).unionByName(right.select(columns)).join(bodies, "carrier")
    return links.unionByName(settle(_cross(percent, across, ["cluster", "group", "block"]), "links"))


def shingle_groups(documents: DataFrame, words: int = 5, percent: int = 80, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `documents`: doc_id, n_shingles, component_id.

    A document's set are its distinct shingles of `words` words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased); with fewer words
    the whole sequence is the one shingle; a text without words, or null, has no shingle and is linked with nothing. Two
    documents link when 100 * intersection >= percent * union. component_id is the smallest doc_id a document reaches by
    links, itself included. Rows that repeat a doc_id are one document for linking: what one of them reaches, all reach. A
    row without doc_id takes no part and has no component. An empty table gives an empty result.
    """
    prepare(documents.sparkSession)
    rows = with_text(documents)
    named = rows.filter("doc_id is not null")
    hot = named.sparkSession.sparkContext.broadcast(hot_shingles(named, words))
    sent = named.mapInArrow(_send(words, percent, hot), _KEYS)
    ties = sent.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_meet, _LINKS).distinct()
    clusters = settle(components(ties).select(F.col("node").alias("doc_id"), F.col("label").alias("cluster")), "clusters")
    sets = settle(  # the clusters grow with the corpus, so they are never broadcast
        named.join(clusters.hint("merge"), "doc_id").select("cluster", "doc_id", "text").mapInArrow(
            _sets(words), "cluster bigint, node bigint, digest binary, bytes bigint, body binary"
        ),
        "sets",
    )
    # Equal sets: the smallest document stands for all, and a row that carries the set brings it along.
    brought = F.when(F.col("body").isNotNull(), F.col("node"))
    alike = settle(
        sets.groupBy("cluster", "digest").agg(F.min("node").alias("least"), F.min(brought).alias("carrier"), F.max("bytes").alias("bytes")),
        "alike",
    )
    copies = sets.join(alike, ["cluster", "digest"]).select(F.col("least").alias("u"), F.col("node").alias("v"))
    members = alike.select("cluster", F.col("least").alias("node"), F.struct("carrier", "digest").alias("carrier"), "bytes")
    bodies = sets.filter("body is not null").select(F.struct(F.col("node").alias("carrier"), "digest").alias("carrier"), "body")
    links = _cluster_links(members, bodies, percent, block_bytes)
    found = settle(components(copies.unionByName(links)), "components")

    sized = rows.mapInArrow(_sizes(words), "doc_id bigint, n_shingles bigint")
    return sized.join(found, sized["doc_id"] == found["node"], "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id")
    )


def _sizes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sizes = [len(s) for s in shingler.sets(batch.column(1).cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_shingles"])

    return run


def drop_near(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `documents` that stay, with all their columns: of every component the document with the smallest id.

    Rows without doc_id stay. Rows that repeat the id that stays: any one of them stays.
    """
    groups = shingle_groups(documents, words, percent).filter("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return documents.join(groups, documents["doc_id"] == groups["_gone"], "left_anti")
