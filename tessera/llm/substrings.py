"""Removal of repeated passages through prefix-partitioned suffix trees.

Suffixes start at every word; a passage of `window` words that repeats is a
node of depth `window` or more in the suffix tree of all documents.  The tree
is never built whole:

1. Documents are dealt once, by their places, into shares of about SHARE bytes
   and kept as a table bucketed by share, so later passes need no shuffle of
   texts.  A share is worked on BLOCK bytes at a time.
2. A suffix belongs to the group named by its first `window` words, more exactly
   by the least hash of the word grams in them: neighbouring suffixes mostly
   have that gram in common, so a stretch of them is sent once with its words.
   Shares first send the group names alone (sorted and packed); a group that has
   one stretch in the whole corpus holds no repeat and is dropped.
3. Shares send the stretches of the other groups, equal ones once with the
   smallest key, so no group gets a stretch more than once a share.  A group
   with over HOT stretches is spread by the whole window.
4. Each part of the groups splits its suffixes by prefixes of variable length: a
   prefix is made longer, word by word, until its suffixes fit GROUP; prefixes
   with few suffixes go together.  The subtree of such a group has its suffixes,
   sorted word by word, as leaves; neighbours that agree in `window` words lie
   under one deep internal node, whose smallest key decides.  What goes back to
   a share are its windows under nodes with a smaller key, and that key.
5. Each share marks those windows and cuts the words they cover.

There are as many parts as shares, some 900 thousand group names each.  Between
shares and parts goes a row a pair of them at most, and never more rows than
stretches: 1,300 rows for 0.85 GB of text, 450 million for 0.5 TB, of 40 names.

Windows are compared by 48-bit hashes of each of their words (624 bits for 13);
only the way back uses one 64-bit hash of the window.
"""

from __future__ import annotations

import uuid
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import blocks, give_back, placed, read, small_batches, text_bytes

WINDOW = 13
GRAM = 6
#: Bytes of text in one share, and of it that are worked on at a time.
SHARE, BLOCK = 24 << 20, 3 << 20
#: Stretches of a group that one part may get.
HOT = 20_000
#: Suffixes of the largest subtree that is built at a time.
GROUP = 200_000
MAX_BUCKETS = 100_000

_WORD_MASK = (1 << 48) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


#: Odd and without a common factor or step: sums over other orders of the same words differ.
_COEFFICIENTS = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def pack(values: np.ndarray) -> bytes:
    """An array's bytes, plane by plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpack(data: bytes, n: int, kind) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(data, n, np.uint64), dtype=np.uint64)


class Block:
    """The words of a block's documents and the windows that start at them."""

    def __init__(self, keys: list, texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> None:
        from xxhash import xxh64_intdigest

        gram = min(gram, window)
        self.window = window
        self.words = [t.split() for t in texts]
        self.counts = np.fromiter(map(len, self.words), np.int64, len(texts))
        size = int(self.counts.sum())
        # hashing every word costs less than looking words up
        self.hash = np.fromiter(map(xxh64_intdigest, chain.from_iterable(self.words)), np.uint64, size) & np.uint64(_WORD_MASK)
        doc = np.repeat(np.arange(len(texts)), self.counts)
        n = max(0, size - window + 1)
        known = np.array([k is not None for k in keys], bool)
        self.start = np.flatnonzero((doc[:n] == doc[window - 1 :]) & known[doc[:n]]) if n else np.zeros(0, np.int64)
        self.key = np.array([0 if k is None else k for k in keys], np.int64)[doc[self.start]]
        self.gram, self.doc = gram, doc

    @cached_property
    def whole(self) -> np.ndarray:
        """The hash of each window."""
        return self._grams(self.window)[self.start]

    @cached_property
    def group(self) -> np.ndarray:
        """The group of each window: the least hash of its grams."""
        least = self._grams(self.gram)
        width, step = self.window - self.gram + 1, 1
        while step < width:  # sliding minimum over `width` grams by doubling
            jump = min(step, width - step)
            least = np.minimum(least[:-jump], least[jump:])
            step += jump
        return least[self.start]

    @cached_property
    def stretch(self) -> np.ndarray:
        """The first windows of the stretches: windows next to each other in one document with one group."""
        if not len(self.start):
            return np.zeros(0, np.int64)
        doc = self.doc[self.start]
        same = (np.diff(self.start) == 1) & (self.group[1:] == self.group[:-1]) & (doc[1:] == doc[:-1])
        return np.flatnonzero(np.concatenate(([True], ~same)))

    def _grams(self, size: int) -> np.ndarray:
        n = max(0, len(self.hash) - size + 1)
        total = np.zeros(n, np.uint64)
        for j in range(size):
            total += self.hash[j : j + n] * _COEFFICIENTS[j]
        return _mix(total)

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """The groups of the stretches, as 48-bit names in order, and how many stretches each has."""
        return np.unique(name(self.group[self.stretch]), return_counts=True)

    def sent(self, repeated: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
        """(group, length in words, key, first window, sum of windows, words) of the stretches of the repeated groups; words in 48 bits, one stretch after the other."""
        names = name(self.group)
        ends = np.append(self.stretch[1:], len(self.start))
        wanted = _in(names[self.stretch], repeated)
        first, past = self.stretch[wanted], ends[wanted]
        split = _in(names[first], hot)
        single = _ranges(first[split], past[split])
        by = np.concatenate([names[first[~split]], name(self.whole[single])])
        first, past = np.concatenate([first[~split], single]), np.concatenate([past[~split], single + 1])
        length = past - first + self.window - 1
        sums = np.concatenate(([np.uint64(0)], np.cumsum(self.whole, dtype=np.uint64)))
        at = _ranges(self.start[first], self.start[first] + length)
        words = self.hash.view(np.uint8).reshape(-1, 8)[at, :6]
        return by, length, self.key[first], self.whole[first], sums[past] - sums[first], words

    def removed(self, hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """For each word: a window that covers it is among the hashes and starts in a document with a larger key."""
        if not len(hashes) or not len(self.start):
            return np.zeros(len(self.hash), bool)
        at = np.minimum(np.searchsorted(hashes, self.whole), len(hashes) - 1)
        start = self.start[(hashes[at] == self.whole) & (self.key > keys[at])]
        change = np.zeros(len(self.hash) + 1, np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, start + self.window, -1)
        return np.cumsum(change)[:-1] > 0


def once_each(by, length, key, whole, about, words):
    """Equal stretches once: (group, length, smallest key, whether there are larger keys, words), in the groups' order.

    Equal stretches have group, length, first window and sum of windows in common.
    """
    order = np.lexsort((key, about, whole, length, by))
    by_, length_, whole_, about_, key_ = by[order], length[order], whole[order], about[order], key[order]
    if not len(order):
        return by, length, key, np.zeros(0, bool), words
    new = np.flatnonzero(np.concatenate(([True], (by_[1:] != by_[:-1]) | (length_[1:] != length_[:-1]) | (about_[1:] != about_[:-1]) | (whole_[1:] != whole_[:-1]))))
    last = np.append(new[1:], len(order)) - 1
    offset = np.cumsum(length) - length
    first = order[new]
    return by_[new], length_[new], key_[new], key_[last] > key_[new], words[_ranges(offset[first], offset[first] + length[first])]


def _ranges(first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    size = past - first
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def name(group: np.ndarray) -> np.ndarray:
    return _mix(group) >> np.uint64(16)


def _in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def prefix_groups(start: np.ndarray, words: np.ndarray, window: int, limit: int = GROUP):
    """The suffixes that start there in groups of about `limit`, by prefixes that are as long as that takes.

    A prefix with more suffixes is made longer by a word, up to the window, and
    those with fewer go together.
    """
    stack = [(np.arange(len(start)), 0)]
    while stack:
        held, depth = stack.pop()
        if len(held) <= limit or depth == window:
            yield held
            continue
        word = words[start[held] + depth]
        order = np.argsort(word, kind="stable")
        held, word = held[order], word[order]
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        size = np.diff(np.append(first, len(held)))
        large = size > limit
        stack += [(held[a : a + n], depth + 1) for a, n in zip(first[large].tolist(), size[large].tolist(), strict=True)]
        few = held[np.repeat(~large, size)]
        bins = (np.cumsum(size[~large]) - size[~large]) // limit  # whole prefixes, in turn
        yield from np.split(few, np.flatnonzero(np.diff(np.repeat(bins, size[~large]))) + 1) if len(few) else ()


def deep_nodes(start: np.ndarray, row: np.ndarray, words: np.ndarray, key: np.ndarray, more: np.ndarray, share: np.ndarray, window: int):
    """(share, window hash, smallest key) of the nodes of depth `window` in the subtree of suffixes, for each share that has larger keys.

    A suffix starts at a word of a row; a row has its smallest key, whether equal
    stretches have larger ones (`more`), and its share.
    """
    leaves = [words[start + j] for j in range(window)]
    order = np.lexsort(leaves[::-1])  # word by word, the first word first
    deep = np.ones(max(0, len(order) - 1), bool)  # neighbours that have `window` words in common
    for column in leaves:
        column = column[order]
        deep &= column[1:] == column[:-1]
    node = np.concatenate(([0], np.cumsum(~deep))) if len(order) else np.zeros(0, np.int64)
    row = row[order]
    heads = np.flatnonzero(np.concatenate(([True], ~deep))) if len(order) else np.zeros(0, np.int64)
    smallest = np.minimum.reduceat(key[row], heads)[node] if len(order) else np.zeros(0, np.int64)
    told = np.flatnonzero((key[row] > smallest) | more[row])
    told = told[np.lexsort((share[row[told]], node[told]))]
    if len(told):  # once a share
        told = told[np.concatenate(([True], (node[told][1:] != node[told][:-1]) | (share[row[told]][1:] != share[row[told]][:-1])))]
    total = np.zeros(len(told), np.uint64)
    for j, column in enumerate(leaves):
        total += column[order[told]] * _COEFFICIENTS[j]
    return share[row[told]], _mix(total), smallest[told]


def in_shares(docs: DataFrame, key: str, text: str, share_bytes: int = SHARE) -> tuple[DataFrame, str, int]:
    """The documents as a table bucketed by share, its name, and the number of shares.

    Columns share, key, raw, no_text, row (all columns but the text).  Rows are
    dealt by their places, so neither null nor repeated keys meet in one share.
    """
    spark = docs.sparkSession
    docs = placed(docs)
    raw = text_bytes(text)
    total = docs.agg(F.sum(F.length(raw) + 64)).first()[0] or 0
    n = int(total // share_bytes) + 1
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    dealt = docs.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int").alias("share"), F.col(f"`{key}`").cast("long").alias("key"), raw.alias("raw"), F.col(f"`{text}`").isNull().alias("no_text"), F.struct(*rest).alias("row"))
    buckets = min(n, MAX_BUCKETS)
    table = f"tessera_shares_{uuid.uuid4().hex}"
    dealt.repartition(buckets, "share").write.option("compression", "zstd").bucketBy(buckets, "share").format("parquet").saveAsTable(table)
    location = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first()["data_type"]
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.table(table), table, n


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, share_bytes: int = SHARE, block_bytes: int = BLOCK, hot: int = HOT, group: int = GROUP, with_text: bool = False) -> DataFrame:
    """struct `row` (all other columns), n_words, n_removed, spans of removed words, and kept text as bytes.

    The key must be an integer column.  A word goes when a window of `window`
    words that covers it has its word sequence also at a start in a document
    with a smaller key; windows are judged on the input.  Null texts have no
    words.  Documents with a null key lose nothing and take nothing.  Rows with
    the same key are one document and take nothing from each other; repeated
    rows each keep their row.  Kept words are joined by one space.  Columns of
    any names pass in `row`.

    `with_text` gives `text` instead of `kept`: the kept words where some were
    removed, else the text as it was, null for null.
    """
    small_batches(docs.sparkSession)
    shared, _, n = in_shares(docs, key, text, share_bytes)
    rows = shared.select("share", "key", "raw")
    packed = pa.schema([("part", pa.int32()), ("share", pa.int32()), ("n", pa.int32()), ("names", pa.binary()), ("counts", pa.binary())])
    listed = pa.schema([("share", pa.int32()), ("n", pa.int32()), ("names", pa.binary()), ("n_hot", pa.int32()), ("hot", pa.binary())])
    stretches = pa.schema([("part", pa.int32()), ("share", pa.int32()), ("n", pa.int32()), ("n_words", pa.int32()), ("lengths", pa.binary()), ("keys", pa.binary()), ("more", pa.binary()), ("words", pa.binary())])
    nodes = pa.schema([("share", pa.int32()), ("n", pa.int32()), ("found", pa.binary()), ("keys", pa.binary())])

    def opened(table: pa.Table):
        """The share's blocks, each with its first row."""
        sizes = pc.binary_length(table["raw"]).to_pylist()
        at = 0
        for part in blocks(sizes, lambda size: size, block_bytes):
            piece = table.slice(at, len(part))
            yield at, Block(piece["key"].to_pylist(), piece["raw"].to_pylist(), window)
            at += len(part)

    def lists_of(table: pa.Table, values: str, sizes: str) -> np.ndarray:
        found = [unpack_sorted(d, k) for d, k in zip(table[values].to_pylist(), table[sizes].to_pylist(), strict=True)]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)

    def by_part(part: np.ndarray):
        """(part, its places in order) of parts."""
        order = np.argsort(part, kind="stable")
        for held in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if len(held):
                yield int(part[held[0]]), held

    def table_of(out: list[tuple], schema: pa.Schema) -> pa.Table:
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else schema.empty_table()

    def tell(table: pa.Table) -> pa.Table:
        share = table["share"][0].as_py()
        names, counts = zip(*[block.names() for _, block in opened(table)], strict=True)
        names, at = np.unique(np.concatenate(names), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate(counts), minlength=len(names)).astype(np.uint32)
        out = [(part, share, len(g), pack_sorted(names[g]), pack(counts[g])) for part, g in by_part((names % np.uint64(n)).astype(np.int64))]
        give_back()
        return table_of(out, packed)

    def repeated(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        each = [unpack_sorted(d, k) for d, k in zip(table["names"].to_pylist(), sizes, strict=True)]
        counts = [unpack(d, k, np.uint32) for d, k in zip(table["counts"].to_pylist(), sizes, strict=True)]
        names, at = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts), minlength=len(names))
        again, many = names[total >= 2], names[total > hot]
        out = []
        for share, own in zip(table["share"].to_pylist(), each, strict=True):
            mine, hottest = own[_in(own, again)], own[_in(own, many)]
            if len(mine):
                out.append((share, len(mine), pack_sorted(mine), len(hottest), pack_sorted(hottest)))
        return table_of(out, listed)

    def send(table: pa.Table, lists: pa.Table) -> pa.Table:
        if not table.num_rows or not lists.num_rows:
            return stretches.empty_table()
        again, hottest = lists_of(lists, "names", "n"), lists_of(lists, "hot", "n_hot")
        found = [np.concatenate(c) for c in zip(*[block.sent(again, hottest) for _, block in opened(table)], strict=True)]
        by, length, keys, more, words = once_each(*found)
        del found
        offset, share, out = np.cumsum(length) - length, table["share"][0].as_py(), []
        for part, g in by_part((by % np.uint64(n)).astype(np.int64)):
            at = _ranges(offset[g], offset[g] + length[g])
            out.append((part, share, len(g), len(at), pack(length[g].astype(np.uint32)), pack(keys[g]), pack(more[g].astype(np.uint8)), words[at].tobytes()))
        give_back()
        return table_of(out, stretches)

    def resolve(table: pa.Table) -> pa.Table:
        lengths, keys, mores, shares, words = [], [], [], [], []
        for b, k, m, ls, ks, fs, ws in zip(*[table[c].to_pylist() for c in ("share", "n", "n_words", "lengths", "keys", "more", "words")], strict=True):
            lengths.append(unpack(ls, k, np.uint32).astype(np.int64))
            keys.append(unpack(ks, k, np.int64))
            mores.append(unpack(fs, k, np.uint8).astype(bool))
            shares.append(np.full(k, b, np.int32))
            wide = np.zeros((m, 8), np.uint8)
            wide[:, :6] = np.frombuffer(ws, np.uint8).reshape(m, 6)
            words.append(wide.view(np.uint64).ravel())
        length, key, more, share, word = (np.concatenate(c) for c in (lengths, keys, mores, shares, words))
        each = length - window + 1
        row = np.repeat(np.arange(len(length), dtype=np.int32), each)
        offset = np.cumsum(length) - length
        start = _ranges(offset, offset + each)
        found = [deep_nodes(start[held], row[held], word, key, more, share, window) for held in prefix_groups(start, word, window, group)]
        share, found, key = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((found, share))
        share, found, key = share[order], found[order], key[order]
        out = [(part, len(g), pack_sorted(found[g]), pack(key[g])) for part, g in by_part(share.astype(np.int64))]
        give_back()
        return table_of(out, nodes)

    span = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))

    def cut(table: pa.Table, lists: pa.Table) -> pa.Table:
        hashes = [unpack_sorted(d, k) for d, k in zip(lists["found"].to_pylist(), lists["n"].to_pylist(), strict=True)]
        keys = [unpack(d, k, np.int64) for d, k in zip(lists["keys"].to_pylist(), lists["n"].to_pylist(), strict=True)]
        hashes, keys = (np.concatenate(c) if c else np.zeros(0, kind) for c, kind in ((hashes, np.uint64), (keys, np.int64)))
        order = np.lexsort((keys, hashes))
        hashes, keys = hashes[order], keys[order]
        first = np.concatenate(([True], hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, bool)  # of one hash the smallest key
        hashes, keys = hashes[first], keys[first]
        out = []
        for row, block in opened(table):
            gone = block.removed(hashes, keys)
            spans, kept, past, n_removed = [], [], 0, []
            whole = table["no_text"].slice(row, len(block.words)).to_pylist() if with_text else None
            raws = table["raw"].slice(row, len(block.words)).to_pylist() if with_text else None
            for i, words in enumerate(block.words):
                mine = gone[past : past + len(words)]
                past += len(words)
                n_removed.append(int(mine.sum()))
                if not n_removed[-1]:
                    spans.append([])
                    kept.append((None if whole[i] else raws[i]) if with_text else b" ".join(words))
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
                spans.append([{"first": a, "past": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                kept.append(b" ".join([w for w, g in zip(words, mine.tolist(), strict=True) if not g]))
            last = pa.array(kept, pa.binary()).cast(pa.string()) if with_text else pa.array(kept, pa.binary())
            arrays = [table["row"].slice(row, len(block.words)).combine_chunks(), pa.array(block.counts), pa.array(n_removed, pa.int64()), pa.array(spans, span), last]
            out.append(pa.Table.from_arrays(arrays, names=["row", "n_words", "n_removed", "spans", "text" if with_text else "kept"]))
        give_back()
        return pa.concat_tables(out)

    told = rows.groupBy("share").applyInArrow(tell, "part int, share int, n int, names binary, counts binary")
    lists = told.repartition(n, "part").groupBy("part").applyInArrow(repeated, "share int, n int, names binary, n_hot int, hot binary")
    sent = rows.groupBy("share").cogroup(lists.groupBy("share")).applyInArrow(send, "part int, share int, n int, n_words int, lengths binary, keys binary, more binary, words binary")
    found = sent.repartition(n, "part").groupBy("part").applyInArrow(resolve, "share int, n int, found binary, keys binary")
    kind = shared.schema["row"].dataType.simpleString()
    last = "text string" if with_text else "kept binary"
    return shared.groupBy("share").cogroup(found.groupBy("share")).applyInArrow(cut, f"row {kind}, n_words long, n_removed long, spans array<struct<first:int,past:int>>, {last}")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, with removed words cut from the text.

    A text that loses words is its kept words joined by one space and n_chars,
    where there is one, its length; other texts stay byte for byte.
    """
    out = remove_repeats(docs, window=window, with_text=True)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append("text")
        elif c == "n_chars":
            columns.append(F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row")[c]).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("row")[c].alias(c))
    return out.select(*columns)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of passages that a smaller doc_id has."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select(F.col("row")["doc_id"].alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), least AS (SELECT g, min(doc_id) AS m FROM starts GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM (SELECT s.doc_id, s.i FROM starts s JOIN least l ON s.g = l.g WHERE s.doc_id > l.m)
), flat AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words
), kept AS (
  SELECT f.doc_id, string_agg(f.x, ' ' ORDER BY f.p) AS t, count(*) AS n FROM flat f ANTI JOIN gone g ON f.doc_id = g.doc_id AND f.p = g.p GROUP BY f.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
