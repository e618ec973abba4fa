"""Token counts without token ids.

Pieces of a pre-token depend on that pre-token alone, so a document's token
count is the sum over its distinct pre-tokens of frequency times piece count.
Documents are counted a block at a time inside the task that reads them: the
block's distinct pre-tokens form a table whose piece counts are computed once,
each document's frequency table is joined to it, and the products are summed.
No id is ever made and nothing is shuffled: a corpus-wide pre-token table would
need all (document, pre-token) pairs, more bytes than the corpus itself, on
disk.  Tables already computed are kept across blocks up to a fixed number of
entries of bounded length, so memory does not grow with the input.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import KEY_CHARS, Kept, blocks, map_arrow, only, read, worker_table

#: Entries of the kept tables; beyond it only the newest block's entries stay.
TABLE_ENTRIES = 400_000

#: Python's str.split() also splits at these four, which Unicode's White_Space lacks.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class PieceCounter:
    """Counts the tokens that a `tokenizers` specification gives a text.

    The specification's pre-tokenizer must drop white space and never join
    text across it (`splits_at_space`); other specifications are pre-tokenized
    over the whole text, which is slower and gives the same counts.
    """

    def __init__(self, specification: str, entries: int = TABLE_ENTRIES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(specification)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        described = json.loads(specification)
        added = [t["content"] for t in described.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.splits_at_space = splits_at_space(described)
        self.entries = entries
        self.pieces: dict[str, int] = {}  # by pre-token
        self.chunks = Kept(lambda c: self._count(c) if c else 0, entries)  # by white-space-free chunk of pre-tokens

    def _pre_tokens(self, text: str) -> list[str]:
        normalizer, splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        normal = normalizer.normalize_str(text) if normalizer else text
        return [t for t, _ in splitter.pre_tokenize_str(normal)] if splitter else [normal]

    def _count(self, text: str) -> int:
        """Tokens of a text: added tokens count one, pre-tokens their pieces."""
        total, parts = 0, [text]
        if self.added and (found := self.added.findall(text)):
            total, parts = len(found), self.added.split(text)
        pieces, tokenize = self.pieces, self.tokenizer.model.tokenize
        for part in parts:
            if part:
                for token in self._pre_tokens(part):
                    n = pieces.get(token)
                    if n is None:
                        n = len(tokenize(token))
                        if len(token) <= KEY_CHARS:
                            if len(pieces) >= self.entries:
                                pieces.clear()
                            pieces[token] = n
                    total += n
        return total

    def count_block(self, texts: list[str]) -> list[int]:
        """Token counts of a block of texts."""
        if not self.splits_at_space:
            return [self._count(t) if t else 0 for t in texts]
        frequencies = [Counter(_SPACES.split(t) if _NOT_SPACE.search(t) else t.split()) for t in texts]
        of = self.chunks.of(set().union(*frequencies)).__getitem__
        return [sum(map(mul, f.values(), map(of, f))) for f in frequencies]


def splits_at_space(described: dict) -> bool:
    """Whether text on the two sides of white space is tokenized independently.

    True for a first pre-tokenizing step that keeps only what its pattern
    matches where the pattern excludes white space, with normalizers that work
    character by character and added tokens without white space or stripping.
    """
    steps = described.get("pre_tokenizer") or {}
    first = (steps.get("pretokenizers") or [steps])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    excluding = "[^\\s" in pattern and " " not in pattern and "\\s" not in pattern.replace("[^\\s", "")
    normalizer = described.get("normalizer") or {}
    kinds = {n.get("type") for n in normalizer.get("normalizers") or ([normalizer] if normalizer else [])}
    added = described.get("added_tokens") or []
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not _SPACES.search(t["content"]) for t in added)
    dropped = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    return bool(dropped and excluding and kinds <= {"NFC", "Replace", "Lowercase"} and plain)


def count_tokens(docs: DataFrame, specification: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens) of each row; one output row per input row.

    A null text counts as empty: no bytes, no tokens.  Rows that repeat and
    null keys pass through; other columns take no part.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(specification)  # a vocabulary file: a few MB whatever the corpus
    name = hashlib.sha256(specification.encode()).hexdigest()

    def run(batches):
        counter = worker_table(name, lambda: PieceCounter(shipped.value))
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for block in blocks(rows, lambda r: len(r[1] or "")):
                texts = [t or "" for _, t in block]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _ in block], type=batch.schema.field(0).type),
                        pa.array([len(t.encode()) for t in texts], type=pa.int64()),
                        pa.array(counter.count_block(texts), type=pa.int64()),
                    ],
                    names=[key, "n_bytes", "n_tokens"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(only(docs, key, text), run, f"`{key}` {kind}, n_bytes long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    """Tokens of every document under word_bpe_49k.json."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        counted = count_tokens(read(spark, sf_dir, "documents"), file.read())
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
