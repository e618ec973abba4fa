"""Language identification with a linear-chain conditional random field over words.

Every word has features: itself if it is in the lexicon of the training sample,
its beginnings and ends of up to three and four characters and its character
trigrams.  Feature weights and label transitions are learned together by
gradient steps on the exact likelihood; forward-backward then gives each word a
distribution over languages, so words of another language inside a text are
told apart, and a document gets the language with the largest mean posterior.

Training uses at most SAMPLE documents a language, up to SAMPLE_CHARS
characters of each (chosen by hash over all labelled rows): bounded, whatever
the corpus.  Its stretches are strung together in changing languages, so the
transitions see switches.  Prediction reads whole texts in the task that holds
them; emissions are computed once for each distinct word of a block.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import BLOCK_BYTES, blocks, only, read, text_column

SAMPLE = 300
SAMPLE_CHARS = 2500
UNKNOWN = "und"
#: reject_unknown() asks for this share of what lies between a chance guess and certainty (0.3 with four languages).
MARGIN = 1 / 15
#: Words of one segment of a sequence in forward-backward; the results do not depend on it.
SEGMENT = 256
#: Words whose emissions a worker keeps.
TABLE_ENTRIES = 150_000
_LETTERS = re.compile(r"[^\W\d_]+")
_LENGTH, _BATCH, _EPOCHS, _RATE, _DECAY = 48, 512, 4, 0.5, 1e-4


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _LETTERS.findall(text.lower())


def features(word: str) -> list[str]:
    """Names of a word's features."""
    n = len(word)
    out = ["=" + word]
    out += ["^" + word[:k] for k in range(1, min(3, n) + 1)]
    out += ["$" + word[-k:] for k in range(1, min(4, n) + 1)]
    out += [word[i : i + 3] for i in range(n - 2)]
    return out


class Model:
    """Feature weights and transitions; grows no further once trained."""

    def __init__(self, labels: list[str], index: dict[str, int], weights: np.ndarray, transitions: np.ndarray) -> None:
        self.labels, self.index, self.weights, self.transitions = labels, index, weights, transitions

    def emissions(self, words: list[str]) -> np.ndarray:
        """(words, labels): the summed weights of each word's features."""
        get = self.index.get
        found = [[i for i in map(get, features(w)) if i is not None] for w in words]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for f in found for i in f), np.int64, int(counts.sum()))
        sums = np.concatenate((np.zeros((1, len(self.labels))), np.cumsum(self.weights[flat], axis=0, dtype=np.float64)))
        past = np.cumsum(counts)
        return sums[past] - sums[past - counts]


def posteriors(emissions: np.ndarray, transitions: np.ndarray, lengths: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Posterior label sums of each sequence; emissions of all sequences one after the other.

    Sequences are cut into segments of at most so many words, and all segments
    run side by side, longest first, so a step costs one small matrix product
    whatever their number, and a long sequence takes no more steps than others.
    Products of a segment's transfer matrices give what goes in at its ends, so
    nothing is lost by the cuts.
    """
    n_labels = emissions.shape[1]
    total = np.zeros((len(lengths), n_labels))
    if not len(emissions):
        return total
    weight = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    step = np.exp(transitions - transitions.max())
    count = -(-lengths // segment)
    sequence = np.repeat(np.arange(len(lengths)), count)
    place = np.arange(len(sequence)) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(lengths) - lengths)[sequence] + place * segment
    size = np.minimum(segment, lengths[sequence] - place * segment)
    head, tail = _ends(weight, step, count, place, start, size) if (count > 1).any() else (np.full((len(size), n_labels), 1 / n_labels), np.ones((len(size), n_labels)))
    order = np.argsort(-size, kind="stable")
    size, start, begins, head, tail = size[order], start[order], (place == 0)[order], head[order], tail[order]
    active = np.searchsorted(-size, -np.arange(size[0]), side="left").tolist()  # segments longer than t
    forward = np.empty_like(weight)
    now = np.where(begins[:, None], head, head @ step)
    for t, k in enumerate(active):
        at = start[:k] + t
        now = (now[:k] @ step if t else now) * weight[at]
        now /= now.sum(axis=1, keepdims=True)
        forward[at] = now
    back, sums = tail, np.zeros((len(size), n_labels))
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        both = forward[at] * back[:k]
        sums[:k] += both / both.sum(axis=1, keepdims=True)
        if t:
            after = (weight[at] * back[:k]) @ step.T
            back[:k] = after / after.sum(axis=1, keepdims=True)
    np.add.at(total, sequence[order], sums)
    return total


def _ends(weight: np.ndarray, step: np.ndarray, count: np.ndarray, place: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward values before each segment's first word and backward values after its last, up to a factor."""
    n_labels = len(step)
    head, tail = np.full((len(size), n_labels), 1 / n_labels), np.ones((len(size), n_labels))
    held = np.flatnonzero(np.repeat(count, count) > 1)
    held = held[np.argsort(-size[held], kind="stable")]
    active = np.searchsorted(-size[held], -np.arange(size[held[0]]), side="left").tolist()
    product = np.repeat(np.eye(n_labels)[None], len(size), axis=0)
    now = product[held]
    for t, k in enumerate(active):
        moved = now[:k] @ step
        if not t:
            moved = np.where((place[held] == 0)[:, None, None], now, moved)  # no transition leads to a sequence's first word
        moved *= weight[start[held[:k]] + t][:, None]
        now[:k] = moved / moved.sum(axis=(1, 2), keepdims=True)
    product[held] = now
    first = np.cumsum(count) - count
    for j in range(1, int(count.max())):
        at = first[count > j] + j
        went = (head[at - 1][:, None] @ product[at - 1])[:, 0]
        head[at] = went / went.sum(axis=1, keepdims=True)
    for j in range(int(count.max()) - 2, -1, -1):
        at = first[count > j + 1] + j
        came = (product[at + 1] @ tail[at + 1][:, :, None])[:, :, 0]
        tail[at] = came / came.sum(axis=1, keepdims=True)
    return head, tail


def _marginals(emissions: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(batch, time, labels) label posteriors and the expected transitions."""
    batch, length, n = emissions.shape
    weight = np.exp(emissions - emissions.max(axis=2, keepdims=True))
    step = np.exp(transitions - transitions.max())
    forward, back = np.empty_like(weight), np.ones_like(weight)
    for t in range(length):
        forward[:, t] = ((forward[:, t - 1] @ step) if t else 1 / n) * weight[:, t]
        forward[:, t] /= forward[:, t].sum(axis=1, keepdims=True)
    for t in range(length - 1, 0, -1):
        back[:, t - 1] = (weight[:, t] * back[:, t]) @ step.T
        back[:, t - 1] /= back[:, t - 1].sum(axis=1, keepdims=True)
    single = forward * back
    single /= single.sum(axis=2, keepdims=True)
    before, after = forward[:, :-1], weight[:, 1:] * back[:, 1:]
    before = before / ((before @ step) * after).sum(axis=2, keepdims=True)
    return single, step * np.tensordot(before, after, axes=([0, 1], [0, 1]))  # no array of labels x labels a word


def train(samples: list[tuple[str, str]], seed: int = 5) -> Model | None:
    """A model of (text, language) samples; None without any word."""
    labels = sorted({lang for _, lang in samples})
    rng = np.random.default_rng(seed)
    pieces: list[tuple[int, list[str]]] = []
    for text, lang in samples:
        words = words_of(text)
        at = 0
        while at < len(words):  # stretches of one language
            size = int(rng.integers(8, 2 * _LENGTH))
            pieces.append((labels.index(lang), words[at : at + size]))
            at += size
    if not pieces:
        return None
    order = rng.permutation(len(pieces))
    flat = [w for k in order for w in pieces[k][1]]
    gold = np.concatenate([np.full(len(pieces[k][1]), pieces[k][0]) for k in order])
    n = max(1, len(flat) // _LENGTH)
    flat, gold = (flat + flat)[: n * _LENGTH] if len(flat) < _LENGTH else flat[: n * _LENGTH], np.resize(gold, n * _LENGTH)
    vocabulary: dict[str, int] = {}
    ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in flat]).reshape(n, _LENGTH)
    gold = gold.reshape(n, _LENGTH)
    often = Counter(f for w in flat for f in features(w))
    index = {f: i for i, f in enumerate(sorted(f for f, c in often.items() if c > 2))}
    model = Model(labels, index, np.zeros((len(index), len(labels))), np.zeros((len(labels), len(labels))))
    known = [[i for i in map(index.get, features(w)) if i is not None] for w in vocabulary]
    width = np.fromiter(map(len, known), np.int64, len(known))
    column = np.fromiter((i for f in known for i in f), np.int64, int(width.sum()))
    past = np.cumsum(width)
    squared, squared_t = np.full_like(model.weights, 1e-6), np.full_like(model.transitions, 1e-6)
    for _ in range(_EPOCHS):
        for part in np.array_split(rng.permutation(n), max(1, n // _BATCH)):
            word, truth = ids[part], gold[part]
            sums = np.concatenate((np.zeros((1, len(labels))), np.cumsum(model.weights[column], axis=0)))
            emission = (sums[past] - sums[past - width])[word]
            single, pair = _marginals(emission, model.transitions)
            single[np.arange(len(part))[:, None], np.arange(_LENGTH)[None, :], truth] -= 1
            slope = np.stack([np.bincount(word.ravel(), single[:, :, k].ravel(), len(vocabulary)) for k in range(len(labels))], axis=1)
            spread = np.repeat(slope, width, axis=0)
            grad = np.stack([np.bincount(column, spread[:, k], len(index)) for k in range(len(labels))], axis=1) / len(part) + _DECAY * model.weights
            seen = np.zeros_like(pair)
            np.add.at(seen, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
            grad_t = (pair - seen) / len(part) + _DECAY * model.transitions
            squared += grad**2
            squared_t += grad_t**2
            model.weights -= _RATE * grad / np.sqrt(squared)
            model.transitions -= _RATE * grad_t / np.sqrt(squared_t)
    model.weights = model.weights.astype(np.float32)
    return model


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 1 modulo 3; a null key does not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """Up to `sample` labelled rows a language that are not held out, those with the smallest hashes of key and text.

    Rows that repeat key and text count once, so neither a repeated key nor
    copies make the list longer than `sample` a language.
    """
    rows = only(docs, key, text, lang).toDF("key", "text", "lang")
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("key").isNotNull() & ~held_out(F.col("key")))
    place = F.pmod(F.xxhash64("key", "text", F.lit(17)), F.lit(1 << 40))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(place, 0.05).alias("n"))  # one row a language
    length = F.length("text")
    first = F.floor(F.when(length > chars, length - chars).otherwise(0) * (F.pmod(F.xxhash64("key", F.lit(19)), F.lit(1000)) / 1000.0)).cast("int") + 1
    near = rows.join(F.broadcast(counts), "lang").where(place / float(1 << 40) < 1.5 * sample / F.col("n"))
    near = near.groupBy("lang", place.alias("place")).agg(F.min(F.col("text").substr(first, F.lit(chars))).alias("text"))
    found = near.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).where(F.col("_r") <= sample).collect()
    return [(r["text"], r["lang"]) for r in sorted(found, key=lambda r: (r["place"], r["lang"], r["text"]))]


def judge(model: Model | None, texts: list[str | None], of: dict[str, int], table: np.ndarray) -> tuple[list[str], list[float], np.ndarray]:
    """Languages and scores of texts; `of` and `table` hold the emissions of words met before."""
    langs, scores = [], []
    for block in blocks(texts, lambda t: len(t or ""), BLOCK_BYTES // 4):
        found = [words_of(t) if t else [] for t in block]
        found = [[w for w in ws if any(map(str.isalpha, w))] if any(map(str.isnumeric, "".join(ws))) else ws for ws in found]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        if model is None or not lengths.sum():
            langs += [UNKNOWN] * len(block)
            scores += [0.0] * len(block)
            continue
        if len(of) > TABLE_ENTRIES:
            of.clear()
        new = list(set().union(*found) - of.keys())
        made = model.emissions(new)
        table = np.concatenate((table, made)) if of else made
        of.update(zip(new, range(len(of), len(of) + len(new)), strict=True))
        flat = np.fromiter(map(of.__getitem__, (w for ws in found for w in ws)), np.int64, int(lengths.sum()))
        mean = posteriors(table[flat], model.transitions, lengths) / np.maximum(lengths, 1)[:, None]
        best = mean.argmax(axis=1)  # of equal ones the first label
        for n, k, row in zip(lengths.tolist(), best.tolist(), mean, strict=True):
            langs.append(model.labels[k] if n else UNKNOWN)
            scores.append(min(1.0, round(float(row[k]), 6)) if n else 0.0)
    return langs, scores, table


def predicted(spark: SparkSession, model: Model | None):
    """A Column function: struct(lang_pred, score) of a text column."""
    shipped = spark.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches):
        of: dict[str, int] = {}
        table = np.zeros((0, 1))
        for batch in batches:
            langs, scores, table = judge(shipped.value, batch.to_pylist(), of, table)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return text_column(spark, run, "lang_pred string, score double")


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of docs with lang_pred and score (0 to 1), in one narrow pass; columns of those names are replaced.

    A null text, and one without a letter, is `und` with score 0; so is every
    text without a model.  Of languages with equal posteriors the first in
    order is taken.  Rows that repeat get equal values.
    """
    found = docs.withColumn("_found", predicted(docs.sparkSession, model)(F.col(f"`{text}`")))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    return found.select(*kept, F.col("_found.lang_pred").alias("lang_pred"), F.col("_found.score").alias("score"))


def learn(docs: DataFrame) -> Model | None:
    """A model of the documents' labelled rows."""
    return train(training_sample(docs))


def least_score(model: Model | None, margin: float = MARGIN) -> float:
    """The score a text of a known language has at least: a chance guess, 1 / languages, plus a share of the rest."""
    chance = 1 / len(model.labels) if model else 1.0
    return chance + margin * (1 - chance)


def reject_unknown(docs: DataFrame, model: Model | None, min_score: float | None = None, text: str = "text") -> DataFrame:
    """The documents, all columns, whose language is known with at least `min_score` (least_score(), if None).

    Null texts and texts without a letter go.  Rows that repeat stay or go
    together; columns of any other names take no part.
    """
    spark, least = docs.sparkSession, least_score(model) if min_score is None else min_score
    shipped = spark.sparkContext.broadcast(model)

    def run(batches):
        of: dict[str, int] = {}
        table = np.zeros((0, 1))
        for batch in batches:
            langs, scores, table = judge(shipped.value, batch.to_pylist(), of, table)
            yield pa.array([lang != UNKNOWN and s >= least for lang, s in zip(langs, scores, strict=True)], pa.bool_())

    return docs.where(text_column(spark, run, "boolean")(F.col(f"`{text}`")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = read(spark, sf_dir, "documents")
    found = predict(only(docs, "doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
