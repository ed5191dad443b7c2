"""Quality, language ID, SimHash, top-k, URLs, WARC: held-out accuracy and brute force."""

import zlib

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from farandole.llm import langid, quality, simhash, topk, urls, warc
from farandole.llm.components import components

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    told = {r.doc_id: r.quality for r in labels.collect()}
    held = [(out[i].predicted, q) for i, q in told.items() if out[i].held_out]
    assert len(out) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    assert np.mean([p == q for p, q in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())


def test_quality_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 1, 0), (None, 1, 0), (6, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(odd_docs, labels).count() == 10
    assert {r.score for r in quality.quality_scores(odd_docs, labels.where("false")).collect()} == {0.5}
    assert quality.quality_scores(no_docs, labels).count() == 0
    assert quality.accepted(odd_docs, labels.where("false")).columns == odd_docs.columns


def test_flattened_trees_follow_the_grown_ones():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = quality.grow(x, y)

    def walk(t, row):
        at = 0
        while trees.child[t, at]:
            at = trees.child[t, at] + (row[trees.feature[t, at]] > trees.threshold[t, at])
        return trees.value[t, at]

    slow = [trees.base + sum(walk(t, r) for t in range(len(trees.feature))) for r in x[:50]]
    assert np.allclose(trees.raw(x[:50]), slow)
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.97


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = langid.languages(docs).collect()
    assert len(out) == len(told) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.lang_pred == told[r.doc_id] for r in out if r.held_out]) > 0.97


def test_language_edges(odd_docs, no_docs):
    out = langid.languages(odd_docs).collect()
    assert len(out) == 10 and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (2, 3, 4)} == {"und"}
    assert {r.lang_pred for r in langid.languages(odd_docs.where("lang is null")).collect()} == {"und"}
    assert langid.languages(no_docs).count() == 0
    assert langid.identified(odd_docs, 0).columns == odd_docs.columns


def fingerprint_by_hand(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def groups_by_hand(fps, radius=3):
    above = {f: f for f in fps}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    u = np.array(sorted(above), np.uint64)
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= radius) + i + 1:
            a, b = top(int(u[i])), top(int(u[j]))
            above[max(a, b)] = min(a, b)
    return {f: top(f) for f in fps}


def test_simhash_documents(odd_docs, no_docs):
    rows = [(r.doc_id, fingerprint_by_hand(r.text)) for r in odd_docs.collect()]
    of = groups_by_hand([f for _, f in rows])
    first = {}
    for i, f in rows:
        if i is not None:
            first[of[f]] = min(first.get(of[f], i), i)
    want = sorted((i or 0, f"{f:016x}", first.get(of[f], -1)) for i, f in rows)
    got = sorted((r.doc_id or 0, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in simhash.near_duplicate_ids(odd_docs).collect())
    assert got == want and simhash.near_duplicate_ids(no_docs).count() == 0


def family(rng, centre, n, most):
    out = {centre}
    while len(out) < n:
        x = centre
        for k in rng.choice(64, rng.integers(1, most + 1), replace=False):
            x ^= 1 << int(k)
        out.add(x)
    return out


@pytest.mark.parametrize("most", [2, 5, 64])
def test_simhash_groups(spark, most):
    """Random fingerprints with planted links and dense families, some of which take the exact way."""
    rng = np.random.default_rng(most)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 300)}
    for x in list(fps)[:100]:
        y = x
        for k in rng.choice(64, rng.integers(1, 6), replace=False):
            y ^= 1 << int(k)
        fps.add(y)
    fps |= family(rng, 0, 150, 3) | family(rng, (1 << 64) - 1, 80, 6) | family(rng, 0x0123456789ABCDEF, 90, 2)
    rows = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(sorted(fps))], "doc_id long, fp long").repartition(3)
    want, first = groups_by_hand(fps), {}
    for k, f in enumerate(sorted(fps)):
        first.setdefault(want[f], k)
    got = {r.of_fp % (1 << 64): r.component_id for r in simhash.near_duplicates(rows, most=most).collect()}
    assert got == {f: first[want[f]] for f in fps}


def test_one_of_each_group(spark, odd_docs, no_docs):
    kept = simhash.without_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and simhash.without_near_duplicates(no_docs).count() == 0
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 7, 8]


def test_components(spark):
    chain = [(k, k + 1) for k in range(100, 140)] + [(5, k) for k in range(6, 60)] + [(7, 7), (300, 200), (200, 300), (None, 1), (400, 401), (401, 402), (402, 400)]
    got = {(r.node, r.component) for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {(k, 100) for k in range(100, 141)} | {(k, 5) for k in range(5, 60)} | {(200, 200), (300, 200), (400, 400), (401, 400), (402, 400)}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 50)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    monkeypatch.setattr(topk, "CHUNK_BYTES", 300)
    monkeypatch.setattr(topk, "STEP", 3)
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=8) * rng.choice([0.1, 1, 5])]) for k in range(300)]
    rows += [(k, [0.25] * 8) for k in range(300, 400)] + [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8), (405, [1.0, 2.0]), (420, [1.0, -2.0]), (440, []), (460, [1e30] * 8)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int").repartition(3)
    fine = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in fine:
        if q % 20 == 0:
            scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in fine if i != q and len(w) == len(v))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:20])]
    got = [tuple(r) for r in topk.top_k(table.where("vec_id % 20 = 0"), table).collect()]
    assert sorted(got) == sorted(want)
    none = table.where("false")
    assert topk.top_k(none, none).count() == 0 and topk.top_k(table.where("vec_id = 20"), none).count() == 0


def test_url_rules_and_aliases(spark):
    link = lambda u: f'<html><LINK href="{u}" rel=canonical><link rel="icon" href="/i">'
    rows = [
        (1, "HTTP://A.Example.COM/en/1?x#y", None), (2, "https://example.com/en/77", ""), (3, "x://net/de/", "<p>"), (4, "http://example.net/de/80", None), (5, "http://notexample.com/en/7", None),
        (6, None, link("http://a.com/en/")), (7, "no url", None), (8, "http://alias.io/p", link("http://z.com/en/a?b=1&amp;c=2")), (9, "http://other.io", '<meta http-equiv="Refresh" content="0; URL=http://alias.io/p#frag">'),
        (10, "http://third.io/d/e", link("../f")), (11, "http://third.io/d/g", link("e")), (11, "http://third.io/d/g", link("e")), (12, "http://ok.io/q", link("//both.io/k")), (13, "http://both.io/k", link("https://example.com/en/7")), (14, "http://bad.org/es/1", link("http://both.io/k")),
        (15, "http://w.io/?a", link("mailto:x@y")),
    ]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, host string, rule string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judged(pages, urls.rule_table(spark)).collect())
    assert got == sorted([
        (1, "a.example.com", "/en/1", "com/en/", "block"), (2, "example.com", "/en/77", "example.com/en/7", "allow"), (3, "net", "/de/", "net/de/", "allow"), (4, "example.net", "/de/80", "example.net/de/8", "block"), (5, "notexample.com", "/en/7", "com/en/", "block"),
        (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "alias.io", "/p", None, "block"), (9, "other.io", "", None, "block"),
        (10, "third.io", "/d/e", None, "allow"), (11, "third.io", "/d/g", None, "allow"), (11, "third.io", "/d/g", None, "allow"), (12, "ok.io", "/q", None, "allow"), (13, "both.io", "/k", None, "allow"), (14, "bad.org", "/es/1", "org/es/", "block"),
        (15, "w.io", "/", None, "allow"),
    ])
    assert urls.judged(pages.where("false"), urls.rule_table(spark)).count() == 0
    assert {r.verdict for r in urls.judged(pages, urls.rule_table(spark, ())).collect()} == {"allow"}


def test_merkle_audit(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 1000)
    monkeypatch.setattr(warc, "FANOUT", 3)
    rows = [(k, f"http://h/{k}", f"<p>{'x' * (k % 97)}{k}</p>") for k in range(1000)] + [(3, "http://h/3", "<p>xxx3</p>"), (None, None, None), (1001, "u", ""), (1002, "v", "y" * 5000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    held = warc.replicas(pages)
    assert held.count() == len(rows) - 1
    want = {(r.page_id, r.digest, r.copy_digest) for r in held.collect() if r.digest != r.copy_digest}
    got = warc.damage(pages).collect()
    assert len(got) == len(want) > 5 and {(r.page_id, r.digest, r.replica_digest) for r in got} == want
    assert {r.status for r in got} == {"missing", "corrupt"}
    same = held.select("archive", "offset", "length", "digest")
    assert warc.audit(same, same).count() == 0 and warc.damage(pages.where("false")).count() == 0
