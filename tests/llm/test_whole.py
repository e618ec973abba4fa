"""The operators work on all of their input, also past the sizes of the test tables."""

from pyspark.sql import functions as F

from tessera.llm import language_id, licences, media, url_filter


def test_url_models_count_every_labelled_url(spark, monkeypatch):
    allowed, blocked = [f"http://a{k}.com/x" for k in range(2600)], [f"http://b{k}.net/fr/" for k in range(2600)]
    rows = [*enumerate([*allowed, *blocked, "http://c.com/" + "y" * 1500, "http://d.org/"])]
    seen = []
    fit, score = url_filter.fit, url_filter.score
    monkeypatch.setattr(url_filter, "fit", lambda urls, order: seen.append({r.url for r in urls.collect()}) or fit(urls, order))
    monkeypatch.setattr(url_filter, "score", lambda urls, *a: seen.append({r.url for r in urls.collect()}) or score(urls, *a))
    url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"))
    fitted, held, judged = seen
    assert not fitted & held and fitted | held == {u for _, u in rows[:-1]} and judged == {"http://d.org/"}
    assert 0.15 < len(held) / len(rows) < 0.25


def test_every_language_is_learned(spark):
    rows = [(10 * k + j, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{w}" for w in ("ba", "do", "ki", "mu") * 3), f"l{k:02}") for k in range(70) for j in range(9)]
    sample = language_id.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    langs = sorted({r[2] for r in rows})
    assert sorted({lang for _, lang in sample}) == langs and language_id.train(sample).labels == langs


def test_word_pairs_of_a_long_line(spark):
    line = "word " * ((1 << 20) + 10) + "under the MIT License"
    found = spark.createDataFrame([(line,)], "p string").select(licences.grams(F.col("p")).alias("g")).first().g
    assert set(found) == {"word", "under", "the", "mit", "license", "word word", "word under", "under the", "the mit", "mit license"}


def test_captions_are_kept():
    def parts(html):
        return [(p["kind"], p["text"] or p["ref"], p["caption"]) for p in media.parse_html(html)]

    assert parts("<figure><figcaption>Cap</figcaption><img src=a><img src=b></figure>") == [("media", "a", "Cap"), ("media", "b", "Cap")]
    assert parts("<p>x</p><figcaption>alone</figcaption><p>y</p>") == [("text", "x", None), ("text", "alone", None), ("text", "y", None)]
    assert parts("<figure><img src=a><figcaption>Cap</figure><p>after</p>") == [("media", "a", "Cap"), ("text", "after", None)]
    assert parts("<figure><figcaption>Cap</figcaption><p>in</p></figure>z") == [("text", "Cap", None), ("text", "in", None), ("text", "z", None)]
    assert parts("<figure><img src=a><figcaption>to the end") == [("media", "a", "to the end")]
    assert [p["position"] for p in media.parse_html("<figure><figcaption>Cap</figcaption><p>in</p></figure>z")] == [0, 1, 2]


def test_usual_notices_are_found(spark):
    texts = {
        "mit": "x\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software",
        "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:",
        "gpl": "it under the terms of the GNU General Public License as published by",
        "apache-2.0": "Licensed under the Apache License,\nVersion 2.0",
        "lgpl": "it under the terms of the GNU Lesser General Public License as published by",
        "apache-2.0,mit": "Licensed under the MIT License. Licensed under the Apache License, Version 2.0.",
        "cc-by-nc": "Licensed under CC BY-NC 4.0.\nand more of it",
        "": "the license of the mit was said\nto be under the tree",
    }
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    found = {r.doc_id: ",".join(sorted(n.family for n in r.notices)) for r in licences.scan(docs, licences.train(docs)).collect()}
    assert [found[k] for k in range(len(texts))] == list(texts)
