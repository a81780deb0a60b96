import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from orthoframe.llm import packing, wavelet
from orthoframe.llm.bpe import CachedEncoder

from .conftest import rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)  # untouched, as the contract calls it
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_cached_encoder_equals_the_library(plain):
    small = CachedEncoder(PATH, pieces=30)
    usual = CachedEncoder(PATH)
    texts = [r[1] for r in rows()] + ["  a b", " x", "a ", "don't  stop\n\n now's it's", "€.x a", "a\tb c\x0cd\x1ce f\x85g h", "½½a. b²٣ ¨´x, x.\n.y", "a b c d", "\n", "a\nb\nc", "x . y ,, z%%%\nThe", "a.\n\nB c d", "a. \nB c", "a <|endoftext|> b", "<|endoftext|>"]
    dice = random.Random(6)
    letters = [*"ab .,'sL1²٣\n\t\x85 \u200b é!中🙂", "  ", "<|endoftext|>", "'s", "\n\n", " ", " "]
    texts += ["".join(dice.choice(letters) for _ in range(dice.randrange(1, 25))) for _ in range(3000)]
    batch = pa.array(texts, pa.string())
    want = [plain(t) for t in texts]
    for e in (small, usual):
        for chunk in (300, 1 << 20):
            assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_batch(batch, chunk)] == want
    assert np.frombuffer(usual.encode("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]
    as_text = np.frombuffer(CachedEncoder(PATH, special_as_text=True).encode("a <|endoftext|> b"), "<u4").tolist()
    assert 50256 not in as_text and as_text != plain("a <|endoftext|> b")
    assert list(usual.encode_batch(pa.array([], pa.string()))) == [] and usual.encode(None) == b""


def test_pieces_hold_each_id_once(docs, no_docs, plain):
    got = packing.pack(docs, PATH, window=64).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    want = Counter(r[0] for r in rows())
    ids = {r[0]: [*plain(r[1]), 1] for r in rows()}
    assert set(by_doc) == set(want)
    for doc, pieces in by_doc.items():
        assert all(p["doc_tokens"] == len(ids[doc]) for p in pieces)
        at = Counter()
        for p in pieces:
            own = np.frombuffer(p["ids"], "<u4").tolist()
            assert own == ids[doc][p["start"] : p["start"] + len(own)]
            at.update(range(p["start"], p["start"] + len(own)))
        assert at == Counter({i: want[doc] for i in range(len(ids[doc]))})
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for p in pieces:
            assert p["offset"] == at
            at += len(p["ids"]) // 4
        assert at == pieces[0]["padded_to"] <= 64 and at & (at - 1) == 0  # no padding at all
    assert packing.pack(no_docs, PATH).count() == 0


def test_best_level_is_the_best_of_all():
    dice = random.Random(2)
    p = packing.Packer(32)
    for k in range(400):
        size = dice.randrange(1, 32)

        def cost(level, size=size):
            n = p.levels.copy()
            if level:
                n[level] -= 1
            if level + size < 32:
                n[level + size] += 1
            return int((n[:32] ** 2).sum())

        open_ = [0, *[h for h in range(1, 33 - size) if h < 32 and p.levels[h]]]
        assert cost(p.best_level(size)) == min(map(cost, open_))
        p.add(k, bytes(4 * size))
    p.finish()
    sizes = [sum(len(x[2]) // 4 for x in s) for s in p.done]
    assert all(x & (x - 1) == 0 for x in sizes)


def test_open_windows_are_bounded():
    """Rests of more than half a window fill no other's window; none of these stays open for long."""
    p = packing.Packer(64, most_open=20)
    for k in range(500):
        p.add(k, bytes(4 * 47))
        assert p.n_open == int(p.levels.sum()) <= 20
    assert len(p.done) > 300
    p.finish()
    sizes = [sum(len(x[2]) // 4 for x in s) for s in p.done]
    assert sum(sizes) == 500 * 47 and all(x == 64 for x in sizes[:-5])
    at = defaultdict(list)
    for doc, start, ids, n in (x for s in p.done for x in s):
        assert n == 47
        at[doc].append((start, start + len(ids) // 4))
    for parts in at.values():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == 47 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))


def test_wavelet_matrix():
    dice = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 1), (511, 3), (513, 70000), (5000, 300)):
        ids = dice.integers(0, top, n).astype(np.uint32)
        w = wavelet.WaveletMatrix.from_columns(*wavelet.WaveletMatrix.build(ids).to_columns())
        assert (w.tokens() == ids).all()
        if n:
            at = dice.integers(0, n, 50)
            assert (w.access(at) == ids[at]).all()
        for token in {*ids[:3].tolist(), 0, 2, 10**6}:
            i, j = sorted(dice.integers(0, n + 1, 2).tolist())
            assert w.count(token, i, j) == (ids[i:j] == token).sum()
            assert w.occurrences(token).tolist() == np.flatnonzero(ids == token).tolist()
        for level in range(len(w.planes)):
            bits = np.unpackbits(w.planes[level], bitorder="little", count=n)
            for bit in (0, 1):
                where = np.flatnonzero(bits == bit)
                assert w.select(level, bit, np.arange(len(where))).tolist() == where.tolist()


def test_shards_round_trip(spark, docs, no_docs, plain, tmp_path):
    wavelet.write_shards(docs, f"{tmp_path}/w", PATH, shard=500)
    shards = spark.read.parquet(f"{tmp_path}/w")
    starts = {(r["part"], r["number"]): r["before"] for r in wavelet.shard_starts(shards).collect()}
    got = [(r["id"], starts[r["part"], r["number"]] + r["inside"], np.frombuffer(r["ids"], "<u4").tolist()) for r in wavelet.read_documents(shards).collect()]
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows()), key=lambda x: (x is not None, x))
    ids = {r[0]: [*plain(r[1]), 0] for r in rows()}
    at = 0
    for doc, start, own in got:
        assert (start, own) == (at, ids[doc])
        at += len(own)
    token = ids[0][0]
    assert sum(r["n_found"] for r in wavelet.count_token(shards, token).collect()) == sum(own.count(token) for _, _, own in got)
    assert wavelet.find_token(shards, token).count() == sum(own.count(token) for _, _, own in got)
    wavelet.write_shards(no_docs, f"{tmp_path}/e", PATH)
    assert wavelet.read_documents(spark.read.parquet(f"{tmp_path}/e")).count() == 0
