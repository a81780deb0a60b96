import random

import pytest
import xxhash

from orthoframe.llm import simhash as sh
from orthoframe.llm.components import components

from .conftest import rows


def plain(text, width=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_random_graphs(spark):
    dice = random.Random(1)
    for n, m in ((30, 20), (200, 150), (60, 0), (80, 79)):
        links = [(dice.randrange(n), dice.randrange(n)) for _ in range(m)]
        if m == 79:
            links = [(i, i + 1) for i in range(79)]  # a path
        got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
        want = {k: v for k, v in union(range(n), links).items() if k != v}
        assert got == want


def test_fingerprints(monkeypatch):
    for r in rows():
        assert sh.fingerprint(r[1]) == plain(r[1])
    long = rows()[75][1]
    monkeypatch.setattr(sh, "CHUNK", 100)
    assert sh.fingerprint(long) == plain(long)


def test_all_links_within_two_bits(spark):
    dice = random.Random(3)
    prints = {dice.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for _ in range(dice.randrange(6)):
            q = p
            for _ in range(dice.randrange(4)):
                q ^= 1 << dice.randrange(64)
            prints.add(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p, p) for p in signed], "node long, print long")
    for distance in (0, 2, 4):
        found = union(signed, [tuple(r) for r in sh.links(frame, distance).collect()])
        near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance]
        want = union(signed, near)
        assert found == want
    with pytest.raises(ValueError, match="0, 2 or 4"):
        sh.links(frame, 3)


def test_near_duplicates_match_brute_force(docs):
    got = sorted(((r["id"] is None, r["id"] or 0, r["print"] & (2**64 - 1), r["component"]) for r in sh.near_duplicates(docs).collect()), key=str)
    data = [(r[0], plain(r[1])) for r in rows()]
    near = [(i, j) for i, a in enumerate(data) for j, b in enumerate(data) if i < j and (a[1] ^ b[1]).bit_count() <= 2]
    root = union(range(len(data)), near)
    least = {}
    for i, (doc, _) in enumerate(data):
        if doc is not None:
            least[root[i]] = min(doc, least.get(root[i], doc))
    assert got == sorted(((d is None, d or 0, p, least.get(root[i])) for i, (d, p) in enumerate(data)), key=str)


def test_one_row_of_each_component_stays(docs, no_docs):
    out = sh.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    found = {r["id"] for r in sh.near_duplicates(docs).collect() if r["id"] is not None and r["id"] == r["component"]}
    got = [r["doc_id"] for r in out.collect()]
    assert sorted(x for x in got if x is not None) == sorted(found)
    assert got.count(None) == 1
    assert sh.drop_near_duplicates(no_docs).count() == 0
    assert sh.near_duplicates(no_docs).count() == 0
