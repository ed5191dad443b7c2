"""Media, mixing, tokens, packing: round trips and brute force."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from farandole.llm import media, mixing, packing, tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def png():
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"


def test_sniff_finds_and_rejects():
    import gzip

    p, z = png(), gzip.compress(b"payload" * 50)
    assert media.sniff(p) == [("image/png", 0, len(p))]
    assert media.sniff(b"xx" + GIF + b"yy" + z + p[:20]) == [("image/gif", 2, len(GIF)), ("application/gzip", 4 + len(GIF), len(z))]
    assert media.sniff(p[:-1] + b"\0") == []  # a wrong checksum
    assert media.sniff(b"BM and RIFF and PK\x03\x04 %PDF-1.") == []
    assert media.sniff(b"") == []


def test_carved_media(spark):
    p = png()
    rows = spark.createDataFrame([(1, bytearray(b"head" + p + GIF), "image/jpeg"), (2, None, None), (3, bytearray(p), "image/png")], "id long, media binary, declared string")
    found = media.sniffed(rows, ["id"])
    assert {(r.id, r.type, r.corrected) for r in found.collect()} == {(1, media.UNKNOWN, True), (2, media.UNKNOWN, True), (3, "image/png", False)}
    got = {(r.id, r.type, bytes(r.bytes)) for r in media.carved(found, ["id"]).collect()}
    assert got == {(1, "image/png", p), (1, "image/gif", GIF), (3, "image/png", p)}


def test_media_round_trip(odd_docs, no_docs):
    out = media.features(media.sniffed(media.text_media(odd_docs), ["doc_id", "n_bytes"])).collect()
    want = sorted([(r.doc_id or 0, (r.text or "").encode()) for r in odd_docs.collect()])
    got = sorted([(r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out])
    full = [(i, b, b + b"\0" * (-len(b) % 64 if b else 64)) for i, b in want]
    assert got == sorted((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for i, b, p in full)
    assert all(r.feature.startswith("audio/wav;payload=text/plain;corrected=0;wrong_file=0;embedded=0;held=;") for r in out)
    assert media.features(media.sniffed(media.text_media(no_docs), ["doc_id", "n_bytes"])).count() == 0


def mix_by_hand(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += size(t)
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [s for s in total if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), sum(total.values())
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * total[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3 * total[s]
            rest -= 3 * total[s]
        open_ -= full
    return total, target


def test_mix_meets_targets(spark, odd_docs, no_docs):
    for docs in (odd_docs, spark.createDataFrame([(k, "w " * (k % 37 + 1), "big" if k % 3 else f"s{k % 5}") for k in range(3000)], "doc_id long, text string, source string")):
        rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        total, target = mix_by_hand(rows)
        out = mixing.mix(docs).collect()
        taken = defaultdict(int)
        for r in out:
            assert 0 <= r.words <= r.size and r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
            taken[r.source] += r.words
        assert len(out) == 3 * len(rows)
        for s, t in target.items():
            assert abs(taken[s] - t) <= len(target)
    assert mixing.mix(no_docs).count() == 0 and mixing.taken(no_docs).count() == 0


def cut_by_hand(docs, quanta):
    """Words that each document takes, with one list of all quanta and one running total."""
    rows = [(r.doc_id, len((r.text or "").split()), r.source) for r in docs.collect()]
    total, target = mix_by_hand([(i, "w " * n, s) for i, n, s in rows])
    budget = sum(total.values())
    q, line = max(1, -(-budget // quanta)), []
    for nth, s in enumerate(sorted(total)):
        at = 0
        queue = sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16), i, n) for i, n, x in rows if x == s)
        for _ in range(3):
            for _, i, n in queue:
                for k in range(0, n, q):
                    if at + k < target[s]:
                        w = min(q, n - k)
                        line.append(((at + k + w) / target[s], nth, w, i))
                at += n
    got, spent = defaultdict(int), 0
    for _, _, w, i in sorted(line):
        got[i] += max(0, min(w, budget - spent))
        spent += w
    return got


def test_mix_is_cut_in_global_order(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "w " * (k * 37 % 90 + 1), "big" if k % 3 else f"s{k % 5}") for k in range(800)], "doc_id long, text string, source string")
    for quanta in (50, 4000):
        want = cut_by_hand(docs, quanta)
        got = defaultdict(int)
        for r in mixing.mix(docs, quanta=quanta, bucket_rows=64).collect():
            got[r.doc_id] += r.words
        assert {i: n for i, n in got.items() if n} == {i: n for i, n in want.items() if n}
    # Another order gives another mix.
    order = mixing.in_order
    monkeypatch.setattr(mixing, "in_order", lambda *a: order(*a).withColumn("spent", mixing.F.sum("words").over(mixing.Window.orderBy(mixing.F.desc("nth"), "finish"))))
    assert {r.doc_id: r.words for r in mixing.mix(docs, quanta=50).where("copy = 0").collect()} != {i: want[i] for i in range(800)}


def test_mix_in_small_buckets_is_the_same(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 11), "hot" if k % 2 else f"s{k % 7}") for k in range(500)], "doc_id long, text string, source string")
    one, many = ({(r.doc_id, r.end) for r in mixing.queued(docs, bucket_rows=n).collect()} for n in (10_000, 7))
    assert one == many


def test_mixed_documents(odd_docs, no_docs):
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns and mixing.mixed_documents(no_docs).columns == odd_docs.columns
    seen = defaultdict(int)
    for r in out.collect():
        seen[r.doc_id] += 1
    assert set(seen) <= {1, 5, 6, 7, 8, None} and seen[1] <= 6 and all(n <= 3 for k, n in seen.items() if k != 1)


def test_token_counts(odd_docs, no_docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(odd_docs, PIECES).collect())
    want = [(r.doc_id or 0, len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in odd_docs.collect()]
    assert got == sorted((i, b, n, n > 4096) for i, b, n in want)
    assert tokens.token_counts(no_docs, PIECES).count() == 0


def test_counts_of_any_text():
    sp, mine, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), tokens.PieceCounter(PIECES), np.random.default_rng(1)
    letters = list("ab \u2581\n\t\r.<s>\u00e9\u4e2d\U0001f600\u00a0\u3000\u0301  12\u0000")
    for _ in range(3000):
        text = "".join(rng.choice(letters, rng.integers(0, 30)))
        assert mine.count(text.encode()) == len(sp.encode(text)), repr(text)


def check_packing(docs):
    tok = Tokenizer.from_file(WORDS)
    pieces = packing.pack(docs, WORDS).collect()
    want = sorted(tuple(tok.encode(r.text or "", add_special_tokens=False).ids) + (2,) for r in docs.collect())
    line = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    at, got, now = 0, [], []
    for r in line:
        assert (r.sequence_id, r.offset) == (at // 4096, at % 4096) and r.length > 0 and r.offset + r.length <= 4096
        assert r.start == len(now)
        now += np.frombuffer(bytes(r.ids), "<u4").tolist()
        at += r.length
        if len(now) == r.doc_tokens:
            got.append(tuple(now))
            now = []
    assert sorted(got) == want and not now


def test_packing(spark, odd_docs, no_docs):
    check_packing(odd_docs)
    check_packing(odd_docs.repartition(5))
    assert packing.pack(no_docs, WORDS).count() == 0
    crcs = packing.with_crc(packing.pack(odd_docs, WORDS)).columns
    assert crcs == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def each(w, texts):
    ids, counts = w.ids(pa.array([t.encode() for t in texts], pa.binary()))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_ids_of_any_text():
    w, rng = packing.WordTokenizer(WORDS), np.random.default_rng(2)
    assert w.by_word
    letters = [chr(k) for k in range(256)] + list("'s 't're \u0301\u4e2d\u03a3\u0130abcdefg.,") * 4
    latin = [chr(k) for k in range(2, 28)] + [chr(k) for k in range(32, 256)] + list("'s 't're abcdefg.,  ") * 12
    for some in (letters, latin):
        texts = ["".join(rng.choice(some, rng.integers(0, 25))) for _ in range(3000)] + ["y" * 3000 + " x", "", " "]
        for text, ids in zip(texts, each(w, texts), strict=True):
            assert ids == w.library.encode(text, add_special_tokens=False).ids, repr(text)
    assert each(w, []) == [[]]
    ids, _ = w.ids(pa.array([b"a\xff\xc3 b"], pa.binary()))
    assert ids.tolist() == w.library.encode("a\ufffd\ufffd b", add_special_tokens=False).ids


def test_other_files_go_whole(monkeypatch):
    monkeypatch.setattr(packing, "PATTERN", "[a-z]+")
    w = packing.WordTokenizer(WORDS)
    assert not w.by_word
    assert each(w, ["Some words, here", "", "x"]) == [w.library.encode(t, add_special_tokens=False).ids for t in ("Some words, here", "", "x")]


def test_bounded_caches():
    w = packing.WordTokenizer(WORDS, most=50)
    texts = [f"word{k} and, {k} the{k % 7}" for k in range(200)] + ["z" * 100]
    for t in texts:
        assert each(w, [t]) == [w.library.encode(t, add_special_tokens=False).ids]
        assert len(w.words) <= 50 and len(w.words) == len(w.used) == len(w.ends) - 1 and w.ends[-1] == len(w.flat)
    assert "and," in w.words.to_pylist() and "z" * 100 not in w.words.to_pylist()


def test_ids_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_packing(docs)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted((r.doc_id, r.n_tokens) for r in tokens.token_counts(docs, PIECES).collect())
    assert got == sorted((r.doc_id, len(sp.encode(r.text or ""))) for r in docs.collect())
