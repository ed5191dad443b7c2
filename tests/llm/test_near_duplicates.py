"""The pipeline's near-duplicate stage against brute force by similarity alone."""

import random
from itertools import combinations

from farandole.llm import simhash


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute(texts):
    """First doc_id of each group; the sets are of the words themselves, not of hashes."""
    words = {i: t.lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in words.items()}
    of, pairs = {i: i for i in texts}, []
    for i, j in combinations(sorted(texts), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            pairs.append((i, j))
            low, high = sorted((of[i], of[j]))
            of = {k: low if v == high else v for k, v in of.items()}
    return set(of.values()), pairs, sets


def kept(spark, texts):
    return {r.doc_id for r in simhash.without_near_duplicates(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(3)).collect()}


def mutated(rng, words, changes):
    words = list(words)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{rng.randrange(10**9)}"
    return words


def test_every_pair_of_the_rule(spark):
    """Copies near the bound, some of which fingerprints of 3 bits miss."""
    rng, texts = random.Random(5), {}
    for n in range(120):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((12, 30, 50, 60, 120, 300)))]
        for k in range(2):
            texts[2 * n + k] = " ".join(mutated(rng, words, k * max(1, len(words) // 55)))
    want, pairs, _ = brute(texts)
    fps = {i: simhash._set_fingerprint(simhash.shingle_sets([t.encode()], 5)[0]) % (1 << 64) for i, t in texts.items()}
    assert {(fps[i] ^ fps[j]).bit_count() <= 3 for i, j in pairs} == {True, False}
    assert kept(spark, texts) == want


def test_members_pass_where_hubs_fail(spark):
    """Texts of 54 shingles: groups B differ among each other by one word at an end, and from every
    representative that comes first by far more; groups of equal word sets are among them."""
    rng, texts = random.Random(6), {}
    base = [f"b{k}" for k in range(58)]
    for n in range(25):  # hubs: they share most words, but are below 0.8 to all others
        texts[n] = " ".join(mutated(rng, base, 6))
    for n in range(25, 33):
        other = mutated(rng, base, 4)
        for k in range(3):
            texts[3 * n + k] = " ".join([*other[:-1], f"end{n}-{k}"] if k else other)
    # Equal word sets in another order: one fingerprint, but no common shingles with the head.
    shuffled = rng.sample(base, len(base))
    texts |= {200: " ".join(base), 201: " ".join(shuffled), 202: " ".join([*shuffled, shuffled[0]])}
    want, pairs, sets = brute(texts)
    assert (201, 202) in pairs and all(jaccard(sets[0], sets[i]) < 0.8 for i in texts if i > 0)
    assert kept(spark, texts) == want


def test_whole_table(spark):
    """All pairs of a whole table: recall and precision are 1."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text or "" for r in rows}
    assert kept(spark, texts) == brute(texts)[0]


def test_dense_meetings(spark, monkeypatch):
    """Families larger than a round's representatives and a ranked bucket."""
    monkeypatch.setattr(simhash, "HUBS", 3)
    monkeypatch.setattr(simhash, "RANKED", 8)
    rng = random.Random(8)
    base = [f"b{k}" for k in range(90)]
    texts = {n: " ".join(mutated(rng, base, rng.choice((1, 2, 3, 5)))) for n in range(70)}
    assert kept(spark, texts) == brute(texts)[0]


def test_shingle_sets():
    rng = random.Random(9)
    alphabet = ["a", "B", "\u00e9", " ", "\n", "\x0b", "\x00", "\u4e2d", "\x85"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))).encode() for _ in range(500)] + [b"", b" ", b"x" * 5000 + b" y", b"x" * 4999 + b"z y", b"w " * 40]
    for words in (1, 3, 5):
        got = simhash.shingle_sets(texts, words)
        of, back = {}, {}
        for t, own in zip(texts, got, strict=True):
            w = t.lower().split()
            want = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or {tuple(w)}
            assert len(own) == len(want) and (own[1:] > own[:-1]).all()
            if len(want) == 1:
                one = next(iter(want))
                assert of.setdefault(one, int(own[0])) == int(own[0]) and back.setdefault(int(own[0]), one) == one
        alone = [simhash.shingle_sets([t], words)[0].tolist() for t in texts]
        assert alone == [g.tolist() for g in got]
    for x, y in zip(got, got[1:]):
        bits = sum(((int(p) ^ int(q)) % (1 << 64)).bit_count() for p, q in zip(simhash._bitmap(x), simhash._bitmap(y), strict=True))
        assert bits <= len(set(x.tolist()) ^ set(y.tolist()))


def test_odd_rows(spark, odd_docs, no_docs):
    out = simhash.without_near_duplicates(odd_docs)
    assert out.columns == odd_docs.columns
    # 1 stands for its repeat and for 6, the empty text 2 for 3 and 4: none of them has a word.
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted((r.doc_id or 0, r.text) for r in odd_docs.dropDuplicates(["doc_id"]).collect() if r.doc_id not in (3, 4, 6))
    assert simhash.without_near_duplicates(no_docs).count() == 0
