"""The registered queries against SQL, the libraries, or plain versions over the whole tables."""

import hashlib
import zlib

import pytest

from tessera.llm import queries
from tests.helpers import same
from tests.llm import helpers as H


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf, name):
    same(spark, sf, queries.QUERIES[name], queries.ORACLES[name])


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]


def test_media(spark, sf):
    found = {r.doc_id: r for r in queries.QUERIES["op1_media"](spark, sf).collect()}
    texts = documents(spark, sf)
    assert len(found) == len(texts)
    by_text = {}
    for k, text in texts:
        raw, r = (text or "").encode(), found[k]
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert by_text.setdefault(text, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_near_duplicates(spark, sf):
    found = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.QUERIES["op3_simhash"](spark, sf).collect()}
    assert found == {k: (f, c) for k, f, c in H.near(documents(spark, sf))}


def test_token_counts(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {r.doc_id: r.n_tokens for r in queries.QUERIES["op7_token_counts"](spark, sf).collect()}
    assert found == {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in documents(spark, sf)}


def test_sentencepiece(spark, sf):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op10_sentencepiece"](spark, sf).collect()}
    for k, text in documents(spark, sf):
        ids = library.encode(text or "", add_eos=True)
        assert found[k] == (len(ids), H.sha(" ".join(map(str, ids))), H.sha(library.decode(ids)))


def test_language(spark, sf):
    found = queries.QUERIES["op6_language_id"](spark, sf).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_urls(spark, sf):
    found = {r.page_id: r for r in queries.QUERIES["op5_url_filter"](spark, sf).collect()}
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(found) == len(pages)
    for p in pages:
        rest = p.url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fitting = [(len(h + q), h + q, v) for h, q, v in rules if (host == h or host.endswith("." + h)) and path.startswith(q)]
        r = found[p.page_id]
        assert (r.host, r.path) == (host, path) and r.verdict in ("allow", "block")
        assert (r.rule, r.verdict) == max(fitting)[1:] if fitting else r.rule is None


def test_licences(spark, sf):
    lines = {
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "Released under the MIT License.": "mit",
        "All rights reserved.": "proprietary",
    }
    found = {r.doc_id: r.licences for r in queries.QUERIES["op2_licences"](spark, sf).collect()}
    assert found == {k: ",".join(sorted({f for line, f in lines.items() if line in (t or "").split("\n")})) for k, t in documents(spark, sf)}
