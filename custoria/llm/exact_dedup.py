"""Exact duplicates through an extendible-hash index on shared files.

One scan normalises every text (white space of ASCII removed), hashes it and writes a staged Parquet table below the
shared folder: a small record per row that names the first row of its task with the same text, and the normalised bytes
with that first row only: an entry. The byte counts per hash prefix build the directory: it doubles until no bucket is over
its capacity, splitting only overfull buckets. The directory is saved next to the staged table. Owner tasks each take a
range of buckets, sorted by key; entries with the same 64-bit key form a chain, and an entry joins a link of the chain only
if all bytes are equal. Every owner writes its buckets, in order, as one file of the index: (bucket, key, link, first).
A class of equal texts is a link of a chain, so groups come from compared bytes and from no digest.

Copies within a task send their bytes once, so a text that a third of all rows share costs one entry per task. The owner
keeps the chain of one key at a time, so its memory is the distinct texts of one key. Rows find their class through the
first row of their task, so no value of the join has more rows than a scan task, however often a text occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from custoria.llm.common import prepare, scratch_path, settle, with_text

WHITE = b" \t\n\x0b\x0c\r"
#: Texts a scan task remembers before it forgets them all and starts again.
REMEMBERED_BYTES = 32 << 20
#: Bytes of entries per bucket of the index.
BUCKET_BYTES = 64 << 20
#: The directory has at most 2**MAX_BITS cells, so it stays within a few megabytes at any size of corpus.
MAX_BITS = 20

_STAGED = "doc_id bigint, row bigint, n_points bigint, first bigint, key bigint, sha binary, entry binary, n_bytes bigint"
_INDEX = "bucket int, key bigint, link int, first bigint, sha binary"


def bucket_plan(cell_bytes: dict[int, int], bits: int, capacity: int) -> list[tuple[int, int]]:
    """Bucket and local depth of every cell of a directory with 2**bits cells.

    The directory starts with one bucket. An overfull bucket splits at its next bit; if that bit is not in the directory
    yet, the directory doubles. Buckets that a single cell overfills stay whole.
    """
    sums = [0]
    for cell in range(1 << bits):
        sums.append(sums[-1] + cell_bytes.get(cell, 0))

    def weight(prefix: int, depth: int) -> int:
        width = bits - depth
        return sums[(prefix + 1) << width] - sums[prefix << width]

    depth, slots = 0, [0]
    buckets = [(0, 0)]  # prefix, local depth
    overfull = [0] if weight(0, 0) > capacity and bits else []
    while overfull:
        bucket = overfull.pop()
        prefix, local = buckets[bucket]
        if local == depth:
            slots = [b for b in slots for _ in range(2)]
            depth += 1
        buckets[bucket] = (prefix * 2, local + 1)
        buckets.append((prefix * 2 + 1, local + 1))
        width = depth - local - 1
        for slot in range((prefix * 2 + 1) << width, (prefix * 2 + 2) << width):
            slots[slot] = len(buckets) - 1
        for half in (bucket, len(buckets) - 1):
            if weight(*buckets[half]) > capacity and buckets[half][1] < bits:
                overfull.append(half)
    order = {b: i for i, b in enumerate(dict.fromkeys(slots))}  # numbered along the keys
    return [(order[b], buckets[b][1]) for b in (slots[cell >> (bits - depth)] for cell in range(1 << bits))]


def _scan(key_bits: int):
    mask = (1 << key_bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[bytes, int]] = {}
        held = 0
        for batch in batches:
            firsts, keys, shas, entries, sizes = [], [], [], [], []
            for row, raw in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                body = raw.translate(None, WHITE)
                sha = hashlib.sha256(body).digest()
                known = seen.get(sha)
                if known and known[0] == body:
                    firsts.append(known[1])
                    for column in (keys, shas, entries, sizes):
                        column.append(None)
                    continue
                if held > REMEMBERED_BYTES:
                    seen, held = {}, 0
                seen[sha] = (body, row)
                held += len(body)
                key = int.from_bytes(sha[:8], "big")
                firsts.append(row)
                keys.append(key - (1 << 63) if key_bits == 64 else key & mask)
                shas.append(sha)
                entries.append(body)
                sizes.append(len(body) + 64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pc.utf8_length(batch.column(2)).cast(pa.int64()),
                    pa.array(firsts, pa.int64()),
                    pa.array(keys, pa.int64()),
                    pa.array(shas, pa.binary()),
                    pa.array(entries, pa.binary()),
                    pa.array(sizes, pa.int64()),
                ],
                ["doc_id", "row", "n_points", "first", "key", "sha", "entry", "n_bytes"],
            )

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of an owner, which come sorted by key, with the link of its key's chain that holds the same bytes."""
    current, chain = None, []
    for batch in batches:
        links = []
        for key, entry in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist()):
            if key != current:
                current, chain = key, []
            try:
                links.append(chain.index(entry))
            except ValueError:
                links.append(len(chain))
                chain.append(entry)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(links, pa.int32()), batch.column(2), batch.column(3)],
            ["bucket", "key", "link", "first", "sha"],
        )


def exact_groups(documents: DataFrame, bucket_bytes: int = BUCKET_BYTES, key_bits: int = 64) -> DataFrame:
    """One row per row of `documents`: doc_id, keep_id, group_size, kept, text_sha256, n_points, link.

    Texts are equal when identical after removal of the characters of `[\\x20\\x09-\\x0D]`; a null text is the empty one,
    and empty texts equal each other. Of each group one row stays: most code points in the original text, then the
    smallest doc_id (a null id comes last), then any one of the rows that are the same in both. `kept` is true for
    exactly one row of a group, also where ids repeat. An empty table gives an empty result. `key_bits` below 64
    shortens the keys, to try out chains.
    """
    spark = prepare(documents.sparkSession)
    rows = with_text(documents).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    staged = settle(rows.mapInArrow(_scan(key_bits), _STAGED), "index-staged")

    entries = staged.filter("entry is not null")
    total = entries.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    owners = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    capacity = max(64 << 10, min(bucket_bytes, total // (4 * owners)), total >> (MAX_BITS - 2))
    bits = min(MAX_BITS, key_bits, max(1, (total // capacity).bit_length() + 3))
    if key_bits == 64:  # the signed key has its first bit flipped
        cell = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits)
    else:
        cell = F.shiftright("key", key_bits - bits)
    cell_bytes = {r.cell: r.n for r in entries.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("n")).collect()}
    plan = bucket_plan(cell_bytes, bits, capacity)

    filled, owner_rows, before = max(1, total), [], 0
    first = {}
    for c, (bucket, depth) in enumerate(plan):
        first.setdefault(bucket, min(owners - 1, before * owners // filled))
        owner_rows.append((c, bucket, depth, first[bucket]))
        before += cell_bytes.get(c, 0)
    path = scratch_path(spark, "index-directory")
    spark.createDataFrame(owner_rows, "cell bigint, bucket int, depth int, owner int").coalesce(1).write.parquet(path)
    directory = spark.read.parquet(path)  # at most 2**MAX_BITS rows

    owned = (
        entries.select("key", "first", "sha", "entry", cell.alias("cell"))
        .join(F.broadcast(directory), "cell")
        .repartitionById(owners, F.col("owner"))
        .sortWithinPartitions("bucket", "key")
        .select("bucket", "key", "first", "sha", "entry")
    )
    index = settle(owned.mapInArrow(_own, _INDEX), "index-buckets")

    # not(x) = -x - 1 turns the order around without overflow; null ids come last.
    order = F.struct("n_points", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row"))
    copies = staged.groupBy("first").agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("best"))
    classes = copies.join(index, "first").groupBy("key", "link").agg(
        F.sum("n").alias("group_size"), F.max(F.struct("best", "sha")).alias("top")
    )
    found = settle(index.select("key", "link", "first").join(classes, ["key", "link"]), "index-classes")
    return (
        staged.select("doc_id", "row", "n_points", "first")
        .join(found, "first")
        .select(
            "doc_id",
            F.bitwise_not("top.best.id").alias("keep_id"),
            "group_size",
            (F.col("row") == F.bitwise_not("top.best.row")).alias("kept"),
            F.lower(F.hex("top.sha")).alias("text_sha256"),
            "n_points",
            "link",
        )
    )


def without_white(text):
    """The same normalisation as a column expression."""
    for char in WHITE:
        text = F.replace(text, F.lit(chr(char)), F.lit(""))
    return text


def drop_exact(documents: DataFrame) -> DataFrame:
    """The rows of `documents` that stay, with all their columns."""
    kept = exact_groups(documents).filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("n_points").alias("_points")
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = documents.withColumns({"_sha": F.sha2(without_white(text).cast("binary"), 256), "_points": F.char_length(text).cast("bigint")})
    same = marked["doc_id"].eqNullSafe(kept["_id"]) & (marked["_sha"] == kept["_sha"]) & (marked["_points"] == kept["_points"])
    rows = Window.partitionBy("doc_id", "_sha", "_points").orderBy("_points")
    return (
        marked.join(kept, same, "left_semi")
        .withColumn("_n", F.row_number().over(rows))
        .filter("_n = 1")
        .select(*documents.columns)
    )
