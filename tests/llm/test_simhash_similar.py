import random

from orthoframe.llm import simhash_similar as ss

from .conftest import rows
from .test_simhash import union

SF = "/root/testdata/sf0.01"


def shingles(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else {()}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def plain(data):
    """Components of (id, text) by all pairs."""
    sets = [(i, shingles(t)) for i, t in data]
    near = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and jaccard(a, b) >= 0.8]
    return union({i for i, _ in data}, near)


def test_odd_rows(docs, no_docs):
    data = [(r[0], r[1]) for r in rows() if r[0] is not None]
    want = plain(data)
    got = ss.similar_documents(docs).collect()
    assert len(got) == len(data) and {r["id"]: r["component"] for r in got} == want
    assert ss.similar_documents(no_docs).count() == 0 and ss.drop_similar(no_docs).count() == 0
    out = ss.drop_similar(docs)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(want.values())) and kept.count(None) == 1


def test_edits_are_found_and_clean_documents_left(spark):
    dice = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    data = []
    for group in range(60):
        base = [dice.choice(words) for _ in range(dice.randint(150, 500))]
        data.append((10 * group, " ".join(base)))
        for k in range(1, 4):
            other = list(base)
            for _ in range(max(1, int(0.006 * k * len(base)))):
                other[dice.randrange(len(base))] = dice.choice(words)
            data.append((10 * group + k, " ".join(other)))
    data += [(10_000 + i, " ".join(dice.choice(words) for _ in range(200))) for i in range(200)]
    want = plain(data)
    got = {r["id"]: r["component"] for r in ss.similar_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == want and len({want[i] for i, _ in data if i < 600}) < 80


def test_corpus(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain([(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()])
    got = {r["id"]: r["component"] for r in ss.similar_documents(frame).collect()}
    assert got == want


def test_large_family_of_chained_copies(spark):
    """390 copies of one text in chains of three; links join neither id-neighbours nor a hub."""
    dice = random.Random(23)
    words = [f"w{i}" for i in range(5000)]
    base = [dice.choice(words) for _ in range(300)]

    def edited(text, n):
        other = list(text)
        for at in dice.sample(range(len(other)), n):
            other[at] = dice.choice(words)
        return other

    texts = []
    for _ in range(130):
        texts.append(edited(base, 4))
        texts += [edited(texts[-1], 1)]
        texts += [edited(texts[-1], 1)]
    ids = dice.sample(range(10_000), len(texts))
    data = [(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)]
    want = plain(data)
    got = {r["id"]: r["component"] for r in ss.similar_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) < 10


def test_extended_and_cut_copies_near_the_threshold(spark):
    dice = random.Random(29)
    words = [f"w{i}" for i in range(20_000)]
    data = []
    for pair in range(150):
        base = [dice.choice(words) for _ in range(500)]
        extra = [dice.choice(words) for _ in range(dice.randint(85, 122))]
        at = dice.choice((0, 250, 500))
        longer = base[:at] + extra + base[at:]
        data += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join(longer))] if pair % 2 else [(2 * pair, " ".join(longer)), (2 * pair + 1, " ".join(base))]
    want = plain(data)
    got = {r["id"]: r["component"] for r in ss.similar_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) < 170
