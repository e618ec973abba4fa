"""Odd documents and plain versions of the operators."""

from __future__ import annotations

import hashlib
import re

ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it all at once today.", "en", "a", 3),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it all at once today.", "en", "a", 3),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it all at once today.", "en", "a", 3),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \t\n  ", "en", "b", 3),
    (None, "a row without an id, yet with words of its own that nobody else has in this table", "en", "b", 3),
    (6, "123 456 !!! ###", "en", "b", 3),
    (7, "ÄÖÜ straße naïve café \u2581x \u65e5\u672c\u8a9e \U0001f600 e\u0301 A\u030a \x1c \x85 \xa0 <|endoftext|> don't", "de", "c", 3),
    (8, "word " * 4000, "en", "c", 3),
    (9, "Start of its own. " + "the lazy dog and runs away from it all at once today. and then other words", "en", "c", 3),
    (-4, "fox jumps over the lazy dog and runs away from it all at once today. minus four", "en", "c", 3),
    (10, "one", "en", "c", 3),
    (11, "a b c d", "fr", "c", 3),
    (12, "\n".join(["Released under the MIT License.", "Nothing here.", "Licensed under CC BY-NC 4.0.", "the license of the mit was said to be under the tree"]), "en", "c", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark, clash: bool = False):
    frame = spark.createDataFrame(ODD, SCHEMA)
    if clash:
        for name in ("row", "spans", "items", "n_words", "raw", "key", "block", "fp", "component_id", "score", "lang_pred", "media", "digest", "kept"):
            frame = frame.withColumn(name, frame.doc_id)
    return frame


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(rows, window=13):
    """(doc_id, n_words, n_removed, kept text) by comparing all windows; rows are (doc_id, text)."""
    least: dict[tuple, int] = {}
    for k, text in rows:
        ws = words(text)
        for i in range(len(ws) - window + 1):
            if k is not None:
                g = tuple(ws[i : i + window])
                least[g] = min(least.get(g, k), k)
    out = []
    for k, text in rows:
        ws = words(text)
        gone = set()
        for i in range(len(ws) - window + 1):
            if k is not None and least[tuple(ws[i : i + window])] < k:
                gone |= set(range(i, i + window))
        out.append((k, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def near(rows, distance=4):
    """(doc_id, fingerprint, component) by comparing all pairs; rows are (doc_id, text)."""
    import xxhash

    prints = []
    for _, text in rows:
        ws = [w.encode() for w in words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        shingles = [b" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] or ([b" ".join(ws)] if ws else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    of = list(range(len(rows)))

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                of[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return [(k, prints[i], least.get(root(i))) for i, (k, _) in enumerate(rows)]


def contaminated(text, items, window=13):
    """(n_words, n_hit, keys) by comparing all windows; items are (key, text)."""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    ws, hit, keys = split(text), set(), set()
    for key, said in items:
        iw = split(said)
        n = min(len(iw), window)
        if not n:
            continue
        grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
        for i in range(len(ws) - n + 1):
            if tuple(ws[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                keys.add(str(key))
    return len(ws), len(hit), sorted(keys)
