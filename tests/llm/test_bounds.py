"""Bounds that hold whatever the keys are, exact forward-backward, long texts, and whole windows of long items."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tessera.llm import common, decontamination, language_id, licences, media, sentencepiece_bpe, simhash, substrings, token_counts, url_filter
from tests.llm import helpers as H

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text_of(seed: int, n: int = 60) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_no_text_is_lost_by_repeated_ids(spark, sf):
    a, b = text_of(1), text_of(2)
    rows = [(1, a), (5, a), (5, b), (9, b), (9, b), (None, a), (5, b)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], SCHEMA)
    kept = sorted(((r.doc_id, r.text) for r in pipeline.one_of_each(spark, docs, sf).collect()), key=repr)
    assert kept == sorted([(1, a), (5, b), (5, b), (None, a)], key=repr)


def test_what_goes_is_joined_by_shuffle_past_the_bound(spark):
    docs = spark.createDataFrame([(k, text_of(k % 3)) for k in range(12)], "doc_id long, text string")
    found = [sorted(r.doc_id for r in simhash.without_duplicates(docs, broadcast_rows=n).collect()) for n in (0, 1000)]
    assert found == [[0, 1, 2]] * 2


@pytest.mark.parametrize("key", ["cast(null as long)", "cast(7 as long)"])
def test_samples_are_bounded_whatever_the_keys(spark, key):
    docs = spark.range(20_000).select(F.expr(key).alias("doc_id"), F.concat(F.lit("some words of number "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    assert 0 < licences.sample_of(docs, "text", "doc_id").count() <= licences.SAMPLE
    chosen = language_id.training_sample(docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(0))))
    held = docs.where(language_id.held_out(F.coalesce("doc_id", F.lit(0)))).count()
    assert len(chosen) <= language_id.SAMPLE and (held or len(chosen) > 0.8 * language_id.SAMPLE)


def test_samples_come_from_whole_texts(spark):
    end = "the last paragraph stands behind many others"
    long = "\n".join(f"paragraph number {k} of a long text" for k in range(2000))
    docs = spark.createDataFrame([(k, long + f"\n{end} {k}") for k in range(20)], "doc_id long, text string")
    places = [int(p.split()[2]) for r in licences.sample_of(docs, "text", "doc_id").collect() for p in r.t.split("\n") if p.startswith("paragraph")]
    assert max(places) > 1000


@pytest.mark.parametrize("key", ["cast(null as long)", "cast(7 as long)"])
def test_rows_of_one_key_are_dealt_over_all_shares(spark, key):
    docs = spark.range(4000).select(F.expr(key).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    shared, _, n = substrings.in_shares(docs, "doc_id", "text", share_bytes=4000)
    sizes = [r["count"] for r in shared.groupBy("share").count().collect()]
    assert n > 50 and max(sizes) < 3 * 4000 / n and sum(sizes) == 4000


@pytest.mark.parametrize("shares", [100, 400])
def test_a_passage_in_every_share(spark, shares):
    """The suffixes of a passage that all documents have come once a share, and only the first document keeps it."""
    passage = text_of(5, 40)
    rows = [(k, text_of(100 + k, 12) + " " + passage) for k in range(shares)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = substrings.remove_repeats(docs, share_bytes=450, block_bytes=200, hot=20, group=16)
    found = sorted((r.row.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in out.collect())
    assert found == sorted(H.repeats(rows))


def test_prefixes_grow_until_groups_fit():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 3, 3000).astype(np.uint64)
    start = np.arange(len(words) - 5)
    groups = list(substrings.prefix_groups(start, words, 5, 40))
    assert sorted(np.concatenate(groups).tolist()) == start.tolist()
    heads = [{tuple(words[i : i + 5].tolist()) for i in start[g]} for g in groups]
    assert all(a.isdisjoint(b) for a, b in itertools.combinations(heads, 2))  # a window is whole in one group
    assert all(len(g) <= 80 or len(h) == 1 for g, h in zip(groups, heads, strict=True))


def _model():
    import public_tokenizers

    return sentencepiece_bpe.load_model(public_tokenizers.path("piece_bpe_32k.model"))


def test_decoding_reads_the_ids():
    encoder = sentencepiece_bpe.Encoder(_model())
    flat, counts = encoder.encode_ids(["a text of several words", "another \U0001f600 text"])
    right = encoder.decode_ids(flat, counts).to_pylist()
    assert right == ["a text of several words", "another \U0001f600 text"]
    for at in range(len(flat)):
        if flat[at] != encoder.end_id:
            wrong = flat.copy()
            wrong[at] = encoder.ids["▁other"]
            assert encoder.decode_ids(wrong, counts).to_pylist() != right


@pytest.mark.parametrize("slots", [3, 20])
def test_encoding_with_small_tables(slots):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    encoder = sentencepiece_bpe.Encoder(_model(), entries=20, kept_bytes=2000, slots=slots)
    rng = random.Random(8)
    texts = ["".join(rng.choice("aeinorst thlymg\né中\x00") for _ in range(rng.randint(0, 200))) for _ in range(400)]
    for text, (ids, n, decoded) in zip(texts, encoder.encode_block(texts), strict=True):
        wanted = library.encode(text, add_eos=True)
        assert (ids, n, decoded) == (" ".join(map(str, wanted)), len(wanted), library.decode(wanted))


def test_a_model_with_other_characters_is_refused():
    model = _model() | {}
    model["pieces"] = [*model["pieces"], "\ue000\ue001"]
    model["scores"], model["kinds"] = [*model["scores"], -1.0], [*model["kinds"], 1]
    with pytest.raises(ValueError):
        sentencepiece_bpe.Encoder(model)


def test_long_keys_are_not_kept():
    kept = common.Kept(len, 10)
    assert kept.of({"a", "b" * 1000}) == {"a": 1, "b" * 1000: 1000} and set(kept.once) == {"a"}
    assert kept.of({"a", "b" * 1000}) == {"a": 1, "b" * 1000: 1000} and set(kept.often) == {"a"}


def test_one_table_a_worker():
    made = []
    for name in ("x", "x", "y", "x"):
        common.worker_table(name, lambda name=name: made.append(name) or name)
    assert made == ["x", "y", "x"]


@pytest.mark.parametrize("segment", [256, 1, 2, 3])
def test_posteriors_equal_enumeration(segment):
    rng = np.random.default_rng(4)
    lengths = np.array([4, 1, 0, 5, 6])
    emissions, transitions = rng.normal(size=(16, 3)), rng.normal(size=(3, 3))
    found = language_id.posteriors(emissions, transitions, lengths, segment)
    at = 0
    for n, got in zip(lengths.tolist(), found, strict=True):
        total, sums = 0.0, np.zeros(3)
        for path in itertools.product(range(3), repeat=n):
            p = np.exp(sum(emissions[at + i, y] for i, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
            total += p
            for y in path:
                sums[y] += p
        assert got == pytest.approx(sums / total if n else np.zeros(3))
        at += n


def test_equal_posteriors_give_the_first_language(spark):
    model = language_id.Model(["aa", "bb"], {}, np.zeros((0, 2)), np.zeros((2, 2)))
    assert [r.lang_pred for r in language_id.predict(spark.createDataFrame([("some words",)], "text string"), model).collect()] == ["aa"]
    assert language_id.least_score(model) == pytest.approx(0.5 + 0.5 / 15) and language_id.least_score(None) == 1.0


def test_rules_of_equal_length(spark):
    rules = [("a.com", "/", "allow"), ("com", "/xy/", "block"), ("a.com", "/x", "block")]
    rows = spark.createDataFrame([(1, "http://a.com/xy/"), (2, "http://b.com/xy/")], "page_id long, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(rows, [*rules, ("b.com", "/x", "allow")]).collect()}
    assert found == {1: ("com/xy/", "block"), 2: ("com/xy/", "block")}


ITEMS = [(1, " ".join(["a"] * 60)), (2, "a b " * 30), (3, "a b c"), (4, "b"), (5, text_of(9, 100))]


def test_items_longer_than_a_shard(spark):
    docs = [(1, "x " + "a " * 30 + "y a b c"), (2, text_of(9, 100)), (3, "a b " * 9 + "q"), (4, None), (5, text_of(9, 100)[30:400])]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for limit in (1, 20, 200_000):
        found = decontamination.judged(decontamination.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), items, max_words=limit)).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found) == sorted((k, *H.contaminated(t, ITEMS)) for k, t in docs)
        clean = decontamination.remove_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items, max_words=limit)
        assert [r.doc_id for r in clean.collect()] == [4]


def test_repetitive_items_take_linear_time():
    automaton = decontamination.Automaton([(1, [b"a"] * 20_000)])
    spans, found = automaton.match([b"a"] * 20_000)
    assert spans == [(0, 20_000)] and found == {1}


def test_long_texts(spark):
    """One text of some MB passes every operator that reads texts whole."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    long = text_of(11, 150_000) + "\n" + "x" * 200_000 + "\n" + text_of(11, 150_000)
    rows = [(1, long), (2, "short"), (3, long)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], SCHEMA)
    prints = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert prints[1] == prints[3] and prints[3][1] == 1
    removed = {r.row.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(docs).collect()}
    assert removed == {1: (300_001, 0), 2: (1, 0), 3: (300_001, 300_001)}  # one document takes nothing from itself
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        specification = file.read()
    library = Tokenizer.from_str(specification)
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, specification).collect()}
    assert counts == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in rows}
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    encoded = {r.doc_id: (r.n_tokens, r.decoded) for r in sentencepiece_bpe.encode_texts(docs, _model()).collect()}
    assert encoded == {k: (len(pieces.encode(t, add_eos=True)), t) for k, t in rows}
    items = spark.createDataFrame([(1, " ".join(long.split()[-20:]))], "item_id long, text string")
    assert {r.doc_id: r["items"] for r in decontamination.find_overlaps(docs, items).collect()} == {1: ["1"], 2: [], 3: ["1"]}
    assert {r.doc_id for r in language_id.predict(docs, None).collect()} == {1, 2, 3}
    stored = media.store_media(spark, docs)
    assert {r.n_bytes for r in media.media_features(stored).collect()} == {len(long), 5}
    notice = long + "\nReleased under the MIT License.\n" + long
    found = licences.scan(spark.createDataFrame([(1, notice)], "doc_id long, text string"), licences.train(docs)).first().notices
    assert [n.family for n in found] == ["mit"]


def test_unclosed_silent_elements():
    def texts(html):
        return [p["text"] for p in media.parse_html(html) if p["kind"] == "text"]

    assert texts("<p>a<template><b>hidden</p><p>c</p>") == ["a", "c"]
    assert texts("<div><noscript>no script</div><p>d</p>") == ["d"]
    assert texts("<template><noscript>x</template>y") == ["y"]
    assert texts("<p>a<script>if (a < b) {'</p>'}</script>b</p>") == ["ab"]
