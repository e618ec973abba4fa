"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, decontamination, language_id, licences, media, sentencepiece_bpe, simhash, substrings, token_counts, url_filter
from tests.llm import helpers as H

KEYS = sorted([k for k, *_ in H.ODD], key=repr)


def keys(frame):
    return sorted([r.doc_id for r in frame.select("doc_id").collect()], key=repr)


def specification():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def model():
    import public_tokenizers

    return sentencepiece_bpe.load_model(public_tokenizers.path("piece_bpe_32k.model"))


BENCHMARK = [(1, "quick brown fox jumps over the lazy dog and runs away from it all at once"), (2, "one"), (3, None), (None, "a b c d"), (4, "!!"), (1, "quick brown fox")]


@pytest.mark.parametrize("clash", [False, True])
def test_token_counts(spark, clash):
    from tokenizers import Tokenizer

    found = token_counts.count_tokens(H.odd(spark, clash), specification()).collect()
    library = Tokenizer.from_str(specification())
    wanted = [(k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t, *_ in H.ODD]
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)


def test_token_counts_of_other_specifications():
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        text = file.read()
    counter, library = token_counts.PieceCounter(text, entries=50), Tokenizer.from_str(text)
    texts = [t or "" for _, t, *_ in H.ODD]
    assert not counter.splits_at_space
    assert counter.count_block(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("clash", [False, True])
def test_sentencepiece(spark, clash):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = sentencepiece_bpe.encode_texts(H.odd(spark, clash), model()).collect()
    wanted = []
    for k, t, *_ in H.ODD:
        ids = library.encode(t or "", add_eos=True)
        wanted.append((k, len(ids), " ".join(map(str, ids)), library.decode(ids)))
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)


def test_sentencepiece_random_texts():
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    encoder = sentencepiece_bpe.Encoder(model(), entries=100)
    rng = random.Random(4)
    texts = ["".join(rng.choice("aabcdeehilnorst  tthe.,\n\t%é\u65e5\u2581\U0001f600\x00") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for text, (ids, n, decoded) in zip(texts, encoder.encode_block(texts), strict=True):
        wanted = library.encode(text, add_eos=True)
        assert (ids, n, decoded) == (" ".join(map(str, wanted)), len(wanted), library.decode(wanted))
        assert encoder.encode(text) == wanted and encoder.decode(wanted) == decoded


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("block_bytes, hot", [(1 << 20, 20_000), (300, 1), (60, 20_000)])
def test_repeats(spark, clash, block_bytes, hot):
    out = substrings.remove_repeats(H.odd(spark, clash), share_bytes=3 * block_bytes, block_bytes=block_bytes, hot=hot, group=hot)
    found = [(r.row.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in out.collect()]
    assert sorted(found, key=repr) == sorted(H.repeats([(k, t) for k, t, *_ in H.ODD]), key=repr)


@pytest.mark.parametrize("window, hot", [(3, 20_000), (3, 2), (5, 20_000)])
def test_repeats_random(spark, window, hot):
    rng = random.Random(window)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))) for k in range(60)]
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window, share_bytes=400, block_bytes=150, hot=hot, group=3 * hot)
    found = [(r.row.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in out.collect()]
    assert sorted(found) == sorted(H.repeats(rows, window))


def test_texts_that_lose_nothing_stay(spark):
    docs = H.odd(spark, clash=True)
    found = {r.doc_id: r for r in substrings.without_repeats(docs).collect()}
    assert found[3].text is None and found[5].text == " \t\n  " and found[1].text != H.ODD[0][1] and found[1].n_chars == len(found[1].text) and found[-4].text == H.ODD[11][1]
    assert substrings.without_repeats(docs).columns == docs.columns


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("bucket_rows", [4096, 2])
def test_near_duplicates(spark, clash, bucket_rows):
    found = simhash.near_duplicates(H.odd(spark, clash), bucket_rows=bucket_rows).collect()
    wanted = H.near([(k, t) for k, t, *_ in H.ODD])
    assert sorted([(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in found], key=repr) == sorted(wanted, key=repr)


def test_links_of_close_fingerprints(spark):
    rng = random.Random(6)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(40)})
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    found = simhash.components(spark, simhash.links(spark, frame, bucket_rows=8)).collect()
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    root = signed | {r.node & (2**64 - 1): r.root for r in found}
    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 4:
                assert root[a] == root[b]


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("max_words", [200_000, 5])
def test_overlaps(spark, clash, max_words):
    items = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    found = decontamination.judged(decontamination.find_overlaps(H.odd(spark, clash), items, max_words=max_words)).collect()
    got = sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found], key=repr)
    known = [(k, t) for k, t in BENCHMARK if k is not None]
    assert got == sorted([(k, *H.contaminated(t, known)) for k, t, *_ in H.ODD], key=repr)


def test_contaminated_documents_go_and_spans_are_cut(spark):
    items = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    clean = " ".join(f"x{k}" for k in range(100))
    docs = spark.createDataFrame([(1, "w1 w2 w3 alone", 5), (2, clean + " w1, w2 w3!", 5), (3, clean, 5), (4, None, 5)], "doc_id long, text string, spans long")
    assert keys(decontamination.remove_contaminated(docs, items)) == [2, 3, 4]
    kept = {r.doc_id: r.text for r in decontamination.remove_contaminated(docs, items, long_span=3).collect()}
    assert kept == {2: clean + " !", 3: clean, 4: None}


@pytest.mark.parametrize("clash", [False, True])
def test_language(spark, clash):
    docs = H.odd(spark, clash)
    found = language_id.predict(docs.select("doc_id", "text"), language_id.learn(docs)).collect()
    unknown = {r.doc_id for r in found if r.lang_pred == "und"}
    assert len(found) == len(H.ODD) and unknown == {3, 4, 5, 6} and all(r.score == 0 for r in found if r.lang_pred == "und")
    kept = language_id.reject_unknown(docs, language_id.learn(docs))
    assert kept.columns == docs.columns and not {3, 4, 5, 6} & set(keys(kept))
    assert {r.lang_pred for r in language_id.predict(docs.select("doc_id", "text"), None).collect()} == {"und"}


def test_language_of_switched_text():
    samples = [("the and of to in that is was for it with as", "en"), ("der die und das von mit den ist im für auf ein", "de")] * 20
    trained = language_id.train(samples)
    words = language_id.words_of("the and of to in der die und das von")
    import numpy as np

    sums = language_id.posteriors(trained.emissions(words), trained.transitions, np.array([10]))
    assert sums.sum() == pytest.approx(10) and trained.labels == ["de", "en"] and abs(sums[0, 0] - 5) < 0.5


@pytest.mark.parametrize("clash", [False, True])
def test_licences(spark, clash):
    docs = H.odd(spark, clash)
    found = {r.doc_id: sorted(n.family for n in r.notices) for r in licences.scan(docs, licences.train(docs)).collect()}
    assert found.pop(12) == ["cc-by-nc", "mit"] and not any(found.values())


@pytest.mark.parametrize("clash", [False, True])
def test_media(spark, clash):
    stored = media.store_media(spark, H.odd(spark, clash))
    features = {r.digest: r for r in media.media_features(stored).collect()}
    texts = {}
    for r in stored.collect():
        samples, length = media.decode_image(bytes(r.media))
        texts.setdefault(r.doc_id, set()).add(samples[:length].decode())
        assert features[r.digest].n_bytes == length and len(samples) % 192 == 0 and samples
    assert texts == {k: {t or "" for j, t, *_ in H.ODD if j == k} for k in {k for k, *_ in H.ODD}}


def test_damaged_media_is_told():
    image = bytearray(media.encode_image(b"text"))
    image[40] ^= 1
    with pytest.raises(ValueError):
        media.decode_image(bytes(image))


def test_interleaved_pages(spark):
    html = '<h1>Title</h1><p>One <b>two</b> &amp; three<script>var x = "</p>";</script></p><figure><img src="a.png" alt="old"><img src="b.png"><figcaption>Both <i>of them</i></figcaption></figure><p>After<img src="c.png" alt="c">end'
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p>broken <img> <p")], "page_id long, html string")
    found = {r.page_id: [(p.kind, p.text or p.ref, p.caption) for p in r.parts] for r in media.interleaved(pages).collect()}
    assert found[1] == [("text", "Title", None), ("text", "One two & three", None), ("media", "a.png", "Both of them"), ("media", "b.png", "Both of them"), ("text", "After", None), ("media", "c.png", "c"), ("text", "end", None)]
    assert found[2] == found[3] == [] and found[4][0][1].startswith("broken")
    features = spark.createDataFrame([("a.png", 1)], "digest string, n long")
    resolved = media.resolve(media.interleaved(pages), features, "page_id").orderBy("position").collect()
    assert [(r.digest, r.n, r.caption) for r in resolved] == [("a.png", 1, "Both of them"), ("b.png", None, "Both of them"), ("c.png", None, "c")]


CONVERSATIONS = [
    (1, 0, "user", "a <|im_end|> <\\|x|> <|"),
    (1, 1, "assistant", "b<\\\\|im_start|>\n"),
    (1, 1, "assistant", "b<\\\\|im_start|>\n"),
    (2, 5, "assistant", None),
    (2, None, None, "no role"),
    (3, 0, "odd\\n\nrole <|im_start|>", "x"),
    (None, 0, "user", "no id"),
    (4, 0, "assistant", "long " * 50_000),
]


@pytest.mark.parametrize("part_chars", [1 << 20, 1])
def test_chat(spark, part_chars):
    rows = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1)).withColumn("part", F.lit(1))
    formatted = chat.format_chat(rows, part_chars=part_chars)
    found = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    order = sorted(CONVERSATIONS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    assert set(found) == {1, 2, 3, 4, None}
    for key, r in found.items():
        mine = [((c[2] or ""), (c[3] or "")) for c in order if c[0] == key]
        loss = "".join(t for role, t in mine if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(mine), H.sha("".join(f"{a}\n{b}\n" for a, b in mine)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), H.sha(loss))


def test_templates():
    source = "{% set sep = ' ' + '-' %}{% for m in messages %}{% if loop.first %}<{% elif m.role == 'x' and not loop.last %}x{% else %}{{ m.text | upper }}{% endif %}{{ sep }}{% endfor %}{% if 1 == 2 %}never{% else %}{{ 'e' + 'nd' }}{% endif %}"
    messages = [{"role": "a", "text": "p"}, {"role": "x", "text": "q"}, {"role": "x", "text": "r"}]
    assert "".join(p[0] for p in chat.compile_template(source)(messages) if p) == "< -x -R -end"
    assert chat.fold_body(chat.parse("a{{ 'b' + 'c' | upper }}{% if true %}d{% endif %}")) == [("const", "abCd")]
    assert list(chat.compile_template("")([])) == []
    for wrong in ("{% for m in messages %}", "{{ m.__class__ }}", "{{ f() }}", "{% else %}", "{{ x | eval }}", "{% import os %}", "{{ 'open }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(wrong)


def test_escapes_are_reversible():
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice("<|\\n\nia") for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unline(chat.line(text)) == text and "\n" not in chat.line(text)


URLS = [
    (1, None),
    (2, ""),
    (3, "no scheme.com/en/"),
    (4, "http://EXAMPLE.com/en/x?y#z"),
    (5, "http://www.example.com/en/"),
    (6, "http://a.b.example.com/en"),
    (7, "https://x.net/es/1"),
    (8, "ftp://org.net?a=/es/"),
    (9, "http://notexample.com#/en/"),
    (None, "http://x.org/\u00e9"),
    (10, "http://x.org/" + "a" * 3000),
    (10, "http://x.org/" + "a" * 3000),
    (11, "a://b.com/://c.net/es/"),
]


def test_urls(spark):
    rows = spark.createDataFrame(URLS, "page_id long, url string").withColumn("score", F.lit(1)).withColumn("key", F.lit(1)).withColumn("host", F.lit(1))
    found = url_filter.filter_urls(rows).collect()
    by = {r.page_id: (r.host, r.path, r.rule) for r in found}
    assert len(found) == len(URLS)
    assert by[1] == by[2] == by[3] == ("", "", None)
    assert by[4] == ("example.com", "/en/x", "example.com/en/") and by[5][2] == "www.example.com/en/" and by[6] == ("a.b.example.com", "/en", "com/")
    assert by[7][2] == "net/es/" and by[8] == ("org.net", "", None) and by[9] == ("notexample.com", "", None) and by[11] == ("b.com", "/://c.net/es/", "com/")
    assert all(r.verdict in ("allow", "block") for r in found)


def test_url_likelihoods(spark):
    from collections import Counter
    from math import log

    fit = [("http://a.com/en/1", 1), ("http://b.com/fr/22", 1), ("https://c.net/es/3", -1), ("http://d.net/fr/", -1)]
    order = 3

    def likelihood(texts, url):
        seen, total, kinds = Counter(), Counter(), Counter()
        for t in texts:
            t = "\x02" * order + t + "\x03"
            seen.update(t[i - k : i + 1] for i in range(order, len(t)) for k in range(order + 1))
        for g, n in seen.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1

        def p(h, c):
            if h is None:
                return 1 / 256
            lower = p(h[1:] if h else None, c)
            return (seen[h + c] + kinds[h] * lower) / (total[h] + kinds[h]) if total[h] else lower

        t = "\x02" * order + url + "\x03"
        return sum(log(p(t[i - order : i], t[i])) for i in range(order, len(t))) / (len(t) - order)

    weights = url_filter.fit(spark.createDataFrame(fit, "url string, sign int"), order)
    urls = ["http://x.org/de/1", "", "http://a.com/\u00e9", "http://b.com/" + "fr/\U0001f600" * 1500]
    for limit in (10**6, 0):
        got = {r.url: r.score for r in url_filter.score(spark.createDataFrame([(u,) for u in urls], "url string"), weights, ["url"], order, broadcast_rows=limit).collect()}
        for u in urls:
            assert got[u] == pytest.approx(likelihood([t for t, s in fit if s == 1], u) - likelihood([t for t, s in fit if s == -1], u))


def test_empty_tables(spark):
    docs = H.empty(spark)
    assert token_counts.count_tokens(docs, specification()).count() == 0
    assert sentencepiece_bpe.encode_texts(docs, model()).count() == 0
    assert substrings.remove_repeats(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_overlaps(docs, items).count() == 0
    assert decontamination.judged(decontamination.find_overlaps(H.odd(spark), items)).where("contaminated or n_hit > 0").count() == 0
    assert language_id.predict(docs.select("doc_id", "text"), language_id.learn(docs)).count() == 0
    assert licences.scan(docs, licences.train(docs)).count() == 0
    assert media.media_features(media.store_media(spark, docs)).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert chat.read_back(chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
