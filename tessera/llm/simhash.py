"""SimHash near-duplicates through pivot distance tables.

Fingerprints are made in the task that reads the documents and equal ones
become one row (with partial aggregation, so groups of copies shrink before the
shuffle).  Two fingerprints that differ in at most 4 of 64 bits agree in one of
five bands, so each fingerprint enters five buckets.  A bucket over
BUCKET_ROWS is split the same way by five bands of the bits that vary inside it,
and so on: each step fixes some of them, more than 4096 fingerprints vary in 13
bits at least, so it ends; no bucket is dropped, and one bucket's rows reach one
task in bounded number.  Inside the buckets a table holds each
fingerprint's Hamming distances to the pivots: rows are sorted by the first
distance and only rows whose first distances differ by at most 4 meet; a pair
is discarded when any other coordinate differs by more, and survivors are
verified.  Only links that join two parts of a bucket are emitted (a spanning
forest), never all pairs.  Components follow from alternating large-star and
small-star rounds, each written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.checkpoint import drop
from tessera.llm.common import blocks, map_arrow, read, text_bytes, text_column, written

SEED = 42
SHINGLE = 4
DISTANCE = 4
PIVOTS = 16
#: Rows of the largest bucket that one task compares.
BUCKET_ROWS = 4096
#: Rows that go, of two longs each, up to which without_duplicates() broadcasts them.
BROADCAST_ROWS = 200_000
_CHUNK_ROWS = 1 << 17


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of a text, repeats included; a short text is one shingle."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z alone are lower-cased, and only the six ASCII spaces split
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxh64_intdigest(joined, SEED)] if words else []
    past = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], past[:-size])).tolist()
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (past[size - 1 :] - 1).tolist(), strict=True)]


def block_fingerprints(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Fingerprints of a block of texts: bits set in over half of the hashes; no words: zero."""
    hashes = [shingle_hashes(t, size) for t in texts]
    counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    starts = np.concatenate(([0], np.cumsum(counts[some])[:-1]))
    flat = np.fromiter((h for hs in hashes for h in hs), np.uint64, int(counts.sum()))
    for a in range(0, len(some), 256):  # bounds the unpacked bits
        part = some[a : a + 256]
        low, high = starts[a], starts[a + 256] if a + 256 < len(some) else len(flat)
        bits = np.unpackbits(flat[low:high].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, starts[a : a + 256] - low, axis=0, dtype=np.int32)
        out[part] = np.packbits(2 * sums > counts[part][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """(key, same, fp) of each row, all longs but the key; null texts as empty ones; made in the reading task.

    `same` is a hash of the text: rows of one key with other texts are told apart by it.
    """
    spark = docs.sparkSession

    def run(batches):
        for batch in batches:
            prints = [block_fingerprints(block, size) for block in blocks(batch.to_pylist(), len)]
            yield pa.array((np.concatenate(prints) if prints else np.zeros(0, np.uint64)).view(np.int64))

    raw = text_bytes(text)
    return docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(raw).alias("same"), text_column(spark, run, "long")(raw).alias("fp"))


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints by rule (a Weyl sequence, mixed), the same everywhere."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bands(mask: int, n: int) -> list[int]:
    """The bits of a mask in n bands of about the same size."""
    bits = [b for b in range(64) if mask >> b & 1]
    cuts = [len(bits) * k // n for k in range(n + 1)]
    return [sum(1 << b for b in bits[cuts[k] : cuts[k + 1]]) for k in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_links(group: np.ndarray, fp: np.ndarray, distance: int = DISTANCE, count: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each bucket's rows within the distance: a spanning forest, as row numbers."""
    table = np.bitwise_count(fp[:, None] ^ pivots(count)[None, :]).astype(np.int16)
    order = np.lexsort((table[:, 0], group))
    group, fp, table = group[order], fp[order], table[order]
    label = np.arange(len(fp))
    active, step, left, right = label[:-1], 1, [], []
    while len(active):
        active = active[active + step < len(fp)]
        other = active + step
        near = (group[active] == group[other]) & (table[other, 0] - table[active, 0] <= distance)
        active = active[near]  # sorted: who is too far now stays too far
        a, b = active, active + step
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        for k in range(1, count):
            if not len(a):
                break
            close = np.abs(table[a, k] - table[b, k]) <= distance
            a, b = a[close], b[close]
        same = np.bitwise_count(fp[a] ^ fp[b]) <= distance
        a, b = a[same], b[same]
        if len(a):
            joined = {}

            def root(x, joined=joined):
                while x in joined:
                    x = joined[x]
                return x

            for i, j, x, y in zip(a.tolist(), b.tolist(), label[a].tolist(), label[b].tolist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    joined[max(x, y)] = min(x, y)
                    left.append(i)
                    right.append(j)
            moved = np.arange(len(fp))
            for x in sorted(joined):
                moved[x] = moved[joined[x]]
            label = moved[label]
        step += 1
    return order[np.array(left, np.int64)], order[np.array(right, np.int64)]


def _bucketed_links(rows: DataFrame, distance: int) -> DataFrame:
    """(a, b) links inside the buckets of (bucket, fp) rows."""

    def run(batches):
        held: list = []
        size = 0

        def flush(bucket, fp):
            group = np.concatenate(([0], np.cumsum(bucket[1:] != bucket[:-1])))
            left, right = bucket_links(group, fp.view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(fp[left]), pa.array(fp[right])], names=["a", "b"])

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size < _CHUNK_ROWS:
                continue
            bucket, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            whole = np.flatnonzero(bucket != bucket[-1])
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut:
                yield flush(bucket[:cut], fp[:cut])
            held, size = [[bucket[cut:], fp[cut:]]], len(fp) - cut
        if size:
            yield flush(*(np.concatenate(c) for c in zip(*held, strict=True)))

    dealt = rows.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket")
    return map_arrow(dealt, run, "a long, b long")


def _band_masks(big: DataFrame, n: int) -> DataFrame:
    """(bucket, masks): the bits that vary inside each bucket, in n bands."""

    def run(batches):
        for batch in batches:
            masks = [[_signed(m) for m in _bands(v & (1 << 64) - 1, n)] for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(masks, pa.list_(pa.int64()))], names=["bucket", "masks"])

    return map_arrow(big, run, "bucket long, masks array<long>")


def links(spark: SparkSession, distinct: DataFrame, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS, n_rows: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` whose components are those of all links.

    A bucket's name is a hash of the bucket it came from, the band and the
    band's bits; two buckets of one name are compared as one, which costs time
    but no link.
    """
    n = distance + 1
    every = F.array(*[F.lit(_signed(m)) for m in _bands((1 << 64) - 1, n)])
    rows = distinct.select(F.lit(0).cast("long").alias("bucket"), "fp", every.alias("masks"))
    ready = []
    while True:
        rows = rows.select("bucket", "fp", F.posexplode("masks").alias("band", "mask")).select(F.xxhash64("bucket", "band", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), "fp")
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_or("fp").alias("some"), F.bit_and("fp").alias("all"))
        big = sizes.where(F.col("n") > bucket_rows).select("bucket", F.col("some").bitwiseXOR(F.col("all")).alias("varying"))
        big = written(spark, _band_masks(big, n), "buckets", None if n_rows is None else n_rows // bucket_rows)
        if big.isEmpty():
            ready.append(rows)
            return _bucketed_links(reduce(DataFrame.unionByName, ready), distance)
        ready.append(rows.join(big.select("bucket"), "bucket", "left_anti"))
        rows = written(spark, rows.join(big, "bucket"), "split")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of edges (a, b) of longs that is not itself that node.

    Large-star and small-star rounds; each round's edges are written, so
    neither lineage nor any one group grows, and so are the least neighbours,
    so the join with them may split a hot node.
    """
    found = written(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    n = found.count()
    edges = written(spark, found.distinct(), "edges", n)
    drop(found)
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(spark, both.groupBy("a").agg(F.min("b").alias("m")), "least", n)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = written(spark, large.distinct(), "large", n)
        drop(edges, least)
        least = written(spark, large.groupBy("a").agg(F.min("b").alias("m")), "least", n)
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = written(spark, small.distinct(), "small", n)
        drop(large, least)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, n = now, now[0]


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(key, same, fp, component_id) of each row; `same` tells texts of one key apart."""
    spark = docs.sparkSession
    found = written(spark, fingerprints(docs, text, key, size), "fingerprints")
    distinct = written(spark, found.groupBy("fp").agg(F.min("key").alias("least")), "distinct", found.count())
    n = distinct.count()
    roots = components(spark, links(spark, distinct.select("fp"), distance, bucket_rows, n))
    rooted = written(spark, distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted", n)
    least = written(spark, rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least", n)  # a shuffle of its own, so a large component can be split
    named = written(spark, rooted.join(least, "root").select("fp", "component_id"), "named", n)
    drop(distinct, rooted, least)
    return found.join(named, "fp")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(key, fp, component_id) of each row: its fingerprint and the smallest key linked to it.

    Null texts count as empty; texts without words share fingerprint zero.
    Rows that repeat keep their rows and share a component; rows of one key
    with other texts are judged each by its own.  A null key takes part in
    links but is never a component's id unless all its keys are null.  Columns
    of other names, also of those given here, take no part.
    """
    return classes(docs, text, key, size, distance, bucket_rows).select(F.col("key").alias(key), "fp", "component_id")


def without_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows, all columns, that stay: those with a component's smallest key, and all with a null key.

    Each row is judged by its own text, so a text stays in some row of its
    component even if its other rows have keys that repeat.  What goes is
    broadcast if its counted rows allow, else joined by shuffle.
    """
    spark = docs.sparkSession
    found = classes(docs, text, key)
    gone = written(spark, found.where(F.col("key") != F.col("component_id")).select("key", "same").distinct(), "gone", found.count())
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    columns = [F.col("_row")[c].alias(c) for c in docs.columns]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{key}`").alias("key"), F.xxhash64(text_bytes(text)).alias("same"))
    return packed.join(gone, ["key", "same"], "left_anti").select(*columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
