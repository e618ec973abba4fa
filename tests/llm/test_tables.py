"""Whole tables against plain versions: media order and captions, the URL models' verdicts."""

import hashlib
import html
import re
from collections import Counter
from math import log
from statistics import mean, pstdev

import pytest
from tessera.llm import media, queries, url_filter


def test_media_positions_and_captions(spark, sf):
    """Each document's image stands behind as many paragraphs as its digest says, with its own caption."""
    for r in queries.QUERIES["op1_media"](spark, sf).collect():
        assert (r.position, r.caption) == (int(r.media_sha256[0], 16), f"Payload {r.media_sha256[:8]}")


def plain_parts(page):
    """(text with its captions, references) of a page by cutting its tags out."""
    bare = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style|template|noscript)\b.*?</\1\s*>", "", page or "")
    refs = [html.unescape(r) for r in re.findall(r"""(?is)<(?:img|audio|video|source|embed)\b[^>]*?\bsrc=["']?([^"'\s>]+)""", bare)]
    return "".join(html.unescape(re.sub(r"(?s)<[^>]*>", " ", bare)).split()), refs


def test_pages_keep_order_and_captions(spark, sf):
    """Every page: its text in order, its references in order, nothing else."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = {r.page_id: r.parts for r in media.interleaved(pages).collect()}
    assert len(found) == pages.count() and any(found.values())
    for p in pages.collect():
        parts = found[p.page_id]
        text, refs = plain_parts(p.html)
        assert [x.position for x in parts] == list(range(len(parts)))
        assert "".join("".join(x.text.split()) for x in parts if x.kind == "text") == text
        assert [x.ref for x in parts if x.kind == "media"] == refs


def test_pages_with_figures(spark, sf):
    """Every page with a figure put in: its place and caption, whatever stands around it."""
    figure = '<figure><img src="sha256:ab"><figcaption>The caption</figcaption></figure>'
    end = re.compile('</p>(?!")')  # scripts hold one between quotes
    pages = [(r.page_id, end.sub(f"</p>{figure}", r.html, count=1)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect() if end.search(r.html or "")]
    assert len(pages) > 20
    found = {r.page_id: r.parts for r in media.interleaved(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    for k, page in pages:
        parts = found[k]
        at = [x.position for x in parts if x.ref == "sha256:ab"]
        before, _ = plain_parts(page[: page.index(figure)])
        assert len(at) == 1 and parts[at[0]].caption == "The caption"
        assert "".join("".join(x.text.split()) for x in parts[: at[0]] if x.kind == "text") == before
        assert not any("The caption" in (x.text or "") for x in parts)


def test_url_verdicts(spark):
    """Every verdict of the models against plain Witten-Bell models of the same URLs."""
    sf, order = "/root/testdata/sf0.01", url_filter.ORDER
    found = {r.page_id: r for r in queries.QUERIES["op5_url_filter"](spark, sf).collect()}
    pages = {r.page_id: (r.url, int(hashlib.md5((r.url or "").encode()).hexdigest()[:8], 16) % 5 == 0) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    sides = {s: {pages[k] for k, r in found.items() if r.rule and (r.verdict == "allow") == (s == 1)} for s in (1, -1)}

    def model(urls):
        seen, total, kinds = Counter(), Counter(), Counter()
        for t in urls:
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

        return p

    models = {s: model([u for u, held in urls if not held]) for s, urls in sides.items()}

    def score(url):
        t = "\x02" * order + url + "\x03"
        return sum(log(models[1](t[i - order : i], t[i])) - log(models[-1](t[i - order : i], t[i])) for i in range(order, len(t))) / (len(t) - order)

    held = {s: [score(u) for u, h in urls if h] for s, urls in sides.items()}
    (m1, d1), (m2, d2) = ((mean(held[s]), pstdev(held[s]) + 1e-9) for s in (1, -1))
    threshold = (m1 * d2 + m2 * d1) / (d1 + d2)
    judged = [k for k, r in found.items() if r.rule is None]
    assert judged
    for k in judged:
        mine = score(pages[k][0] or "")
        assert found[k].score == pytest.approx(mine, abs=1e-6) and (abs(mine - threshold) < 1e-9 or (found[k].verdict == "allow") == (mine > threshold))
