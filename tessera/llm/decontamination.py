"""Benchmark decontamination with a generalised suffix automaton over words.

The test items' words build one automaton.  Each document streams through it
and the longest match that ends at each word is tracked: where it reaches the
window's length (or is a whole item of fewer words), the matched words are hit
and the items of the automaton's state are recorded.  Only stretches of words
whose neighbours all follow each other in some item are streamed; in all other
places the longest match is shorter than two words.

The automaton holds at most MAX_WORDS words, so its broadcast is bounded; a
larger item set is cut into shards that are matched one after the other and
merged for the documents they hit.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.llm.common import only, read, text_bytes, text_column, worker_table, written

WINDOW = 13
#: Words of one shard's automaton, some 300 bytes each.
MAX_WORDS = 200_000
#: A document is contaminated where at least one word in COVERAGE is hit.
COVERAGE = 20

#: Separators become spaces and A-Z lower case; bytes of other characters stay.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z lower-cased."""
    return text.translate(_NORMAL).split()


class Automaton:
    """Generalised suffix automaton of the items' words, with the items of every state."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        sequences = [(key, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for key, words in items if words]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        # of each state: the suffix state that stands for its last `window` words, and the nearest suffix that is a whole shorter item
        self.whole, self.short = [0] * len(self.next), [0] * len(self.next)
        for s in order:
            if self.length[s] >= window:
                self.whole[s] = s if self.length[self.link[s]] < window else self.whole[self.link[s]]
        self.items: dict[int, set] = {}  # of those states
        ends: dict[int, dict[int, set]] = {}  # items of fewer words than a window that are a suffix here
        for key, sequence in sequences:
            state = 0
            for word in sequence:
                state = self.next[state][word]
                if self.whole[state]:
                    self.items.setdefault(self.whole[state], set()).add(key)
            if len(sequence) < window:
                while self.length[self.link[state]] >= len(sequence):
                    state = self.link[state]
                ends.setdefault(state, {}).setdefault(len(sequence), set()).add(key)
        self.ends = ends
        for s in order:
            self.short[s] = s if s in ends else self.short[max(self.link[s], 0)]
        self.least = min((min(len(s), window) for _, s in sequences), default=0)
        n = len(self.vocabulary)
        follow = {a * n + b for _, s in sequences for a, b in zip(s, s[1:])}
        self.follow = np.array(sorted(follow), dtype=np.int64)

    def _extend(self, last: int, word: int) -> int:
        step, link, length = self.next, self.link, self.length
        known = step[last].get(word)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is None:
            new = self._state({}, 0, length[last] + 1)
        at = last
        while known is None and at >= 0 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if known is None and at < 0:
            return new
        target = step[at][word]
        if length[target] == length[at] + 1:
            link[new] = target
            return new
        copy = self._state(dict(step[target]), link[target], length[at] + 1)
        while at >= 0 and step[at].get(word) == target:
            step[at][word] = copy
            at = link[at]
        link[target] = copy
        if known is not None:
            return copy
        link[new] = copy
        return new

    def _state(self, step: dict, link: int, length: int) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def stretches(self, words: list[bytes]):
        """(start, word numbers) of the stretches that may hold a window."""
        if not self.least or len(words) < self.least:
            return
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        pair = np.zeros(len(ids) + 1, bool)  # pair[i]: words i-1 and i follow each other in an item
        both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        if len(both) and len(self.follow):
            codes = ids[both] * len(self.vocabulary) + ids[both + 1]
            place = np.minimum(np.searchsorted(self.follow, codes), len(self.follow) - 1)
            pair[both[self.follow[place] == codes] + 1] = True
        starts = np.flatnonzero((ids >= 0) & ~pair[:-1])
        ends = np.flatnonzero((ids >= 0) & ~pair[1:]) + 1
        for k in np.flatnonzero(ends - starts >= self.least):
            yield int(starts[k]), ids[starts[k] : ends[k]].tolist()

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans (first word, one past the last; apart and in order) and the items that hit."""
        step, link, length, window = self.next, self.link, self.length, self.window
        spans: list[tuple[int, int]] = []
        found: set = set()
        for start, ids in self.stretches(words):
            state = matched = 0
            for i, word in enumerate(ids, start + 1):
                while state and word not in step[state]:
                    state = link[state]
                    matched = length[state]
                state = step[state].get(word, 0)
                matched = matched + 1 if state else 0
                if matched < self.least:
                    continue
                hit, at = 0, self.short[state]
                if matched >= window:
                    found |= self.items[self.whole[state]]
                    hit = window
                while at:  # at most one length a step, each below a window
                    for n, keys in self.ends[at].items():
                        if n <= matched:
                            found |= keys
                            hit = max(hit, n)
                    at = self.short[link[at]] if link[at] > 0 else 0
                if hit:
                    first = i - hit
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, i))
        return spans, found


def shards(items: DataFrame, key: str, text: str, limit: int, window: int = WINDOW):
    """The items, a bounded number of words at a time; null keys are no items.

    An item of more words comes in parts that overlap by all but one word of a
    window, so each of its windows is whole in one part.
    """
    rows = only(items.where(F.col(f"`{key}`").isNotNull()), key, text).select(F.col(f"`{key}`").cast("string"), text_bytes(text))
    limit = max(limit, window)
    shard, held = [], 0
    for item, raw in rows.toLocalIterator():
        words = words_of(bytes(raw))
        for at in range(0, max(1, len(words) - window + 1), limit - window + 1):
            part = words[at : at + limit]
            if held and held + len(part) > limit:
                yield shard
                shard, held = [], 0
            shard.append((item, part))
            held += len(part)
    yield shard


_FOUND = "n_words long, spans array<struct<first:int,past:int>>, items array<string>"


def matched(spark: SparkSession, items: list, window: int):
    """A Column function of a text column: struct(n_words, spans, items) against a shard of items."""
    shipped = spark.sparkContext.broadcast((items, window))  # at most MAX_WORDS words
    name = hashlib.sha256(repr((window, items)).encode()).hexdigest()
    kinds = [pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())])), pa.list_(pa.string())]

    def run(batches):
        automaton = worker_table(name, lambda: Automaton(*shipped.value))
        for batch in batches:
            counts, spans, found = [], [], []
            for said in batch.to_pylist():
                words = words_of((said or "").encode())
                hit, keys = automaton.match(words)
                counts.append(len(words))
                spans.append([{"first": a, "past": b} for a, b in hit])
                found.append(sorted(keys))
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip((counts, spans, found), kinds, strict=True)], names=["n_words", "spans", "items"])

    return text_column(spark, run, _FOUND)


def overlapping(docs: DataFrame, parts, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(row, found): each row of docs as a struct and its struct(n_words, spans, items) against all shards of items.

    One shard is matched in the pass that reads the documents.  With more, the
    rows are written once with their places, each shard's pass keeps only
    places and spans of what it hits, and these are merged and joined back.
    """
    spark = docs.sparkSession
    parts = iter(parts)
    first, second = next(parts), next(parts, None)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if second is None:
        return rows.select("row", matched(spark, first, window)(F.col("row")[text]).alias("found"))
    placed = written(spark, rows.withColumn("place", F.monotonically_increasing_id()), "placed")
    hits = None
    for shard in itertools.chain([first, second], parts):
        found = placed.select("place", matched(spark, shard, window)(F.col("row")[text]).alias("found"))
        hit = written(spark, found.where(F.size("found.items") > 0).select("place", "found.spans", "found.items"), "hits")
        hits = hit if hits is None else hits.unionByName(hit)
    one = hits.groupBy("place").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    one = one.select("place", merged(F.col("spans")).alias("spans"), "items")
    counted = placed.select("row", "place", matched(spark, [], window)(F.col("row")[text])["n_words"].alias("n_words"))
    joined = counted.join(one, "place", "left")
    none = F.array().cast("array<struct<first:int,past:int>>"), F.array().cast("array<string>")
    return joined.select("row", F.struct("n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items")).alias("found"))


def find_overlaps(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """(key, n_words, spans, items) of each document against all items.

    Spans are word positions (first, one past the last), apart and in order;
    items are the distinct keys, as sorted strings, of items with a window that
    occurs.  Null texts have no words; items without words or key never occur;
    without items no document is hit.  One output row per input row, repeated
    rows and null keys included; columns of other names take no part.
    """
    found = overlapping(only(docs, key, text), shards(items, item_key, item_text, max_words, window), text, window)
    return found.select(F.col("row")[key].alias(key), "found.n_words", "found.spans", "found.items")


def merged(spans):
    """A list of spans in any order as spans that are apart and in order."""
    kind = "array<struct<first:int,past:int>>"

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.array(F.struct(last["first"].alias("first"), F.greatest(last["past"], x["past"]).alias("past"))).cast(kind)
        return F.when((F.size(acc) > 0) & (last["past"] >= x["first"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), joined)).otherwise(F.concat(acc, F.array(x))).cast(kind)

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def hit_words(spans):
    """How many words the spans cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["past"] - s["first"])


def contaminated(n_words, spans, coverage: int = COVERAGE):
    """The verdict: hit at all, and at least one word in `coverage` hit."""
    return (hit_words(spans) > 0) & (coverage * hit_words(spans) >= n_words)


def judged(overlaps: DataFrame, coverage: int = COVERAGE) -> DataFrame:
    """find_overlaps() with n_hit and the verdict."""
    return overlaps.withColumn("n_hit", hit_words(F.col("spans"))).withColumn("contaminated", contaminated(F.col("n_words"), F.col("spans"), coverage))


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, coverage: int = COVERAGE, long_span: int | None = None, max_words: int = MAX_WORDS) -> DataFrame:
    """The documents, all columns, without contaminated ones.

    `long_span`: in documents that stay, spans of at least that many words are
    cut out of the text (None: texts stay as they are).  A null text is clean
    and stays null; rows that repeat stay or go together; columns of other
    names, also of those that find_overlaps() gives, take no part.
    """
    spark, parts = docs.sparkSession, shards(items, "item_id", "text", max_words, window)
    first, second = next(parts), next(parts, None)
    if second is None and long_span is None:  # the rows stay in the JVM, only texts leave it
        mine = matched(spark, first, window)(F.col(f"`{text}`"))
        return docs.where(~contaminated(mine["n_words"], mine["spans"], coverage))
    found = overlapping(docs, itertools.chain([first], [] if second is None else [second], parts), text, window)
    kept = found.where(~contaminated(F.col("found.n_words"), F.col("found.spans"), coverage))
    columns = [F.col("row")[c].alias(c) for c in docs.columns]
    if long_span is None:
        return kept.select(*columns)
    cut = F.pandas_udf(lambda texts, spans: texts.combine(spans, cut_spans), StringType())
    shorter = cut(F.col("row")[text], F.filter("found.spans", lambda s: s["past"] - s["first"] >= long_span))
    return kept.select(*[shorter.alias(c) if c == text else held for c, held in zip(docs.columns, columns, strict=True)])


def cut_spans(text: str | None, spans) -> str | None:
    """A text without the words of the spans and what separates them."""
    if text is None or not len(spans):
        return text
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    out, past = [], 0
    for s in spans:
        out.append(raw[past : at[s["first"]][0]])
        past = at[s["past"] - 1][1]
    return b"".join([*out, raw[past:]]).decode()


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that lie in a window of some benchmark item."""
    found = judged(find_overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), "contaminated")


OP9_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, w, least(len(w), 13) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
    WHERE item_id IS NOT NULL) WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)
), sizes AS (SELECT DISTINCT n FROM windows),
starts AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n
), hits AS (
  SELECT s.doc_id, s.i, s.n, v.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM starts) s JOIN windows v ON v.n = s.n AND v.g = s.g
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(l.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l.ks, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM words d LEFT JOIN covered c USING (doc_id) LEFT JOIN listed l USING (doc_id)
"""
