"""The pipeline on a small corpus, each stage against brute force."""

from collections import Counter
from itertools import combinations

import corpus_pipeline
from farandole.llm import langid, mixing, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "language", "near_duplicates", "mixing", "packing"]
    columns = docs.columns

    kept = steps["quality"](spark, docs, SF).cache()
    good = {r.doc_id for r in quality.quality_scores(docs, labels).collect() if r.predicted}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == good

    known = steps["language"](spark, kept, SF).cache()
    assert known.columns == columns
    assert {r.doc_id for r in known.collect()} == {r.doc_id for r in langid.languages(kept).collect() if r.lang_pred != "und" and r.score >= 0.5}

    single = steps["near_duplicates"](spark, known, SF).cache()
    texts = {r.doc_id: (r.text or "").encode() for r in known.collect()}
    words = {i: t.lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in words.items()}
    of = {i: i for i in texts}
    for i, j in combinations(sorted(texts), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            low, high = sorted((of[i], of[j]))
            of = {k: low if v == high else v for k, v in of.items()}
    first = set(of.values())
    assert len(first) < len(texts)
    assert single.columns == columns and {r.doc_id for r in single.collect()} == first

    mixed = steps["mixing"](spark, single, SF).cache()
    want = Counter()
    for r in mixing.mix(single).collect():
        want[r.doc_id] += r.size > 0 and 2 * r.words >= r.size
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == +want

    pieces = steps["packing"](spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == +want
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in pieces}
