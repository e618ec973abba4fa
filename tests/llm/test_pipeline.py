"""The pipeline against brute force, stage by stage on each stage's own input, and on odd rows."""

import corpus_pipeline as pipeline
from tessera.llm import decontamination
from tests.llm import helpers as H

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def held(frame):
    rows = [tuple(r) for r in frame.collect()]
    return rows, frame.sparkSession.createDataFrame(rows, frame.schema)


def test_stages(spark, sf):
    assert [n for n, _ in pipeline.STAGES] == ["language id", "near duplicates", "repeated passages", "decontamination", "encoding"]
    stages = dict(pipeline.STAGES)
    first, docs = held(spark.read.parquet(f"{sf}/documents.parquet"))
    known, docs = held(stages["language id"](spark, docs, sf))
    assert set(known) <= set(first) and len(known) >= 0.98 * len(first)
    one, docs = held(stages["near duplicates"](spark, docs, sf))
    keep = {k for k, _, c in H.near([r[:2] for r in known]) if k == c}
    assert sorted(one) == sorted(r for r in known if r[0] in keep)
    cut, docs = held(stages["repeated passages"](spark, docs, sf))
    wanted = {k: (t if not n else kept) for (k, _, n, kept), (_, t, *_) in zip(H.repeats([r[:2] for r in one]), one, strict=True)}
    assert {r[0]: r[1] for r in cut} == {k: t for k, t in wanted.items() if t.strip()}
    clean, docs = held(stages["decontamination"](spark, docs, sf))
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    judged = {r[0]: H.contaminated(r[1], items) for r in cut}
    assert sorted(clean) == sorted(r for r in cut if not (judged[r[0]][1] and decontamination.COVERAGE * judged[r[0]][1] >= judged[r[0]][0]))
    assert docs.columns == COLUMNS
    last = stages["encoding"](spark, docs, sf).collect()
    whole = pipeline.run(spark, sf).collect()
    assert sorted(map(tuple, last)) == sorted(map(tuple, whole))
    library = _library()
    texts = {r[0]: r[1] for r in clean}
    for r in last:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), H.sha(" ".join(map(str, ids))), H.sha(library.decode(ids)))


def _library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_odd_rows(spark, sf):
    for docs in (H.odd(spark), H.odd(spark, clash=True), H.empty(spark)):
        columns = docs.columns
        for name, stage in pipeline.STAGES:
            rows, _ = held(stage(spark, docs, sf))
            if name != "encoding":
                docs = spark.createDataFrame(rows, docs.schema)
                assert stage(spark, docs, sf).columns == columns
        assert len({r[0] for r in rows}) >= (3 if docs.count() else 0)
