"""Parts of the trained models against plain Python: n-grams, weights, training steps, statistics, splits."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from farandole.llm import langid, quality

TEXTS = ["Hello, world!", "a", "Été été  42 x", "中文 \U0001f600 ab", "  lead and trail 7 ", "aaa aaa"]


def hashed(points):
    """The column of an n-gram of code points, in numbers of unlimited size cut to 32 bits."""
    cut = lambda x: x & 0xFFFFFFFF
    if len(points) == 1:
        h = cut(points[0] * 0x9E3779B1)
    else:
        pair = cut(points[0] * 0x9E3779B1) ^ cut(cut(points[1] * 0x85EBCA6B) + 0x27D4EB2F)
        h = pair if len(points) == 2 else cut(pair * 0x165667B1) ^ cut(points[2] * 0xC2B2AE35)
        h = cut(h * 0x9E3779B1)
    return h >> 32 - langid.BITS


@pytest.mark.parametrize("text", TEXTS)
def test_gram_counts(text):
    plain = "".join(c if c.isalpha() else " " for c in text.lower())
    # A blank stands before the first word, after each run of letters, and one more at the end.
    words = plain.split()
    line = " " + " ".join(words) + (" " if plain.rstrip() != plain else "") + " "
    points = [ord(c) for c in line]
    want = Counter(hashed([p]) for p in points[1:-1])
    for n in (2, 3):
        want.update(hashed(points[k : k + n]) for k in range(len(points) - n + 1))
    got = langid.gram_counts(text.encode())
    assert {i: int(n) for i, n in enumerate(got) if n} == dict(want)


def test_no_letters():
    assert all(langid.gram_counts(t) is None for t in (b"", b"12 34", b"\xf0\x9f\x98\x80"))


def test_document_frequencies(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*TEXTS, None, "", "9"])], "doc_id long, text string").repartition(3)
    n, df = langid.document_frequencies(docs)
    want = Counter(i for t in TEXTS for i in np.flatnonzero(langid.gram_counts(t.encode())).tolist())
    assert n == len(TEXTS) and {i: int(x) for i, x in enumerate(df) if x} == dict(want)


def test_training_steps():
    """Follow the regularised leader, coordinate by coordinate, in plain floats."""
    rng = random.Random(4)
    langs, rows = ["a", "b", "c"], []
    for _ in range(40):
        at = np.array(sorted(rng.sample(range(30), 6)))
        rows.append((at, np.array([rng.randrange(1, 5) for _ in at])))
    target = np.array([rng.randrange(3) for _ in rows])
    idf = np.ones(langid.BINS) * 1.5
    model = langid.train(langs, rows, target, idf)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, c):
        if abs(z[i, c]) <= langid.L1:
            return 0.0
        return -math.copysign(abs(z[i, c]) - langid.L1, z[i, c]) / ((langid.BETA + math.sqrt(n[i, c])) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(7)
    train = np.array([i for i in range(len(rows)) if i % langid.CALIBRATION != langid.CALIBRATION - 1])
    for _ in range(langid.ROUNDS):
        for r in order.permutation(train):
            at, counts = rows[r]
            raw = [(1 + math.log(k)) * 1.5 for k in counts]
            norm = math.sqrt(sum(v * v for v in raw))
            x = {int(i): v / norm for i, v in zip(at, raw)} | {langid.BINS: 1.0}
            score = [sum(v * weight(i, c) for i, v in x.items()) for c in range(3)]
            top = max(score)
            e = [math.exp(s - top) for s in score]
            gradients = {(i, c): v * (e[c] / sum(e) - (target[r] == c)) for i, v in x.items() for c in range(3)}
            old = {key: weight(*key) for key in gradients}
            for key, g in gradients.items():
                z[key] += g - (math.sqrt(n[key] + g * g) - math.sqrt(n[key])) / langid.ALPHA * old[key]
                n[key] += g * g
    for c in range(3):
        assert model.bias[c] == pytest.approx(weight(langid.BINS, c), abs=1e-9)
        assert [model.weights[i, c] for i in range(30)] == pytest.approx([weight(i, c) for i in range(30)], abs=1e-9)
    text = "some words".encode()
    counts = langid.gram_counts(text)
    at = np.flatnonzero(counts)
    v = (1 + np.log(counts[at])) * 1.5
    raw = (v / np.sqrt((v * v).sum())) @ model.weights[at] + model.bias
    p = np.exp(raw / model.temperature) / np.exp(raw / model.temperature).sum()
    assert model.predict(text) == (langs[int(p.argmax())], pytest.approx(p.max()))


def test_hot_language_sample(spark):
    """A language with most of the rows is learned from at most per_lang of them, the others from all."""
    rows = [(k, f"w{k} text", "hot") for k in range(3000)] + [(5000 + k, f"v{k} autre", "rare") for k in range(9)] + [(9000, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(docs, per_lang=50).langs == ["hot", "rare"]
    assert langid.fit(docs, per_lang=50, most_langs=1).langs == ["hot"]
    assert langid.fit(docs.where("false")).langs == []


def test_statistics():
    text = b"One two, two!\nOne two, two!\nXXXXX | 1234 longestwordofthemall"
    got = dict(zip(quality.STATISTICS, quality.statistics(text), strict=True))
    words = text.split()
    p = [c / len(text) for c in Counter(text).values()]
    want = {
        "log_bytes": math.log1p(len(text)), "log_words": math.log1p(len(words)), "word_length": sum(map(len, words)) / len(words), "long_words": 1 / len(words),
        "digits": 4 / len(text), "blanks": (len(words) - 1) / len(text), "high_bytes": 0, "distinct_lines": 2 / 3, "distinct_words": len(set(words)) / len(words), "top_word": 2 / len(words),
        "repeated_neighbours": 0, "distinct_pairs": len(set(zip(words, words[1:]))) / len(words), "sentence_ends": 2 / len(words), "bars": 1 / len(words), "entropy": -sum(x * math.log2(x) for x in p),
        "title_words": 2 / len(words), "longest_run": math.log1p(5), "line_length": math.log1p(len(text) / 3), "upper": 7 / len(text),
    }
    assert {k: got[k] for k in want} == pytest.approx(want)
    assert quality.statistics(b"")[1:] == [0.0] * (len(quality.STATISTICS) - 1)


def test_first_split_is_the_best():
    """The root of the first tree against all splits of all columns."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = (x[:, 2] + 0.3 * rng.normal(size=400) > 0.4).astype(float)
    trees = quality.grow(x, y)
    share = (y.sum() + 1) / (len(y) + 2)
    g, h = share - y, np.full(len(y), share * (1 - share))
    best = None
    for j in range(5):
        for cut in np.unique(np.quantile(x[:, j], np.arange(1, quality.BINS) / quality.BINS)):
            left = x[:, j] <= cut
            if min(h[left].sum(), h[~left].sum()) >= quality.LEAST_HESSIAN:
                gain = g[left].sum() ** 2 / (h[left].sum() + quality.L2) + g[~left].sum() ** 2 / (h[~left].sum() + quality.L2)
                best = max(best or (gain, j, cut), (gain, j, cut))
    assert (trees.feature[0, 0], trees.threshold[0, 0]) == (best[1], pytest.approx(best[2]))
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.9


def test_pipeline_of_odd_documents(spark, odd_docs, no_docs, tmp_path):
    """Every stage takes odd documents and none, and the last gives each kept one whole."""
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 9)], "doc_id long, quality long, toxic long")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd_docs, no_docs):
        docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        now = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns
        ids = {r.doc_id for r in now.collect()}
        pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert {r.doc_id for r in pieces} == ids
        by_doc = defaultdict(int)
        for r in pieces:
            by_doc[r.doc_id] += r.length
        assert all(by_doc[r.doc_id] % r.doc_tokens == 0 for r in pieces)
