import hashlib
import re

from pyspark.sql import functions as F

from orthoframe.llm import pii

from .conftest import rows

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

TEXTS = [
    "mail a.b@c.d.e_f@g.hh x@y @z.com a@b a@b.c.d@e.f +1 (017) 555-7713 tel +49 30 1234567.",
    "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 or 001.02.3.255 1.2.3 999.1.1.1.1",
    "card 4111 1111 1111 1111, 4111111111111112 5500-0000-0000-0004 12 3-4 4111  1111 1111 1111 49927398716 0000000000000",
    "\U0001f600é +1 2 +123456789 +12345678901234567 + 1 ++1 (2) 3456789-0 (030) 123-4567 1-800-555-1234",
    'token = "3df5a35c7b8d733c0b5c7d364eda8ac88d929d1f" key sk-abcdef0123456789abcdef',
    "9" * 30000,
    "a" * 30000 + "@b.cc",
    "1 " * 5000,
    "1.2.3.4 " * 300,
    "1.2.3.4 4111 1111 1111 1111, a@b.cc " * 700,
    "",
]


def luhn(d):
    return sum((x if i % 2 == 0 else x * 2 - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans(spark, tmp_path):
    data = [(i, t) for i, t in enumerate(TEXTS + [None] + [r[1] for r in rows()])]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.op4_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(data)
    for i, text in data:
        want = plain(text)
        r = got[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(x.startswith(k) for x in want) for k in PATTERNS], (i, want, r)
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, want, r["spans"])
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(want) <= set(spans) and r["has_pii"] == bool(spans)
        keys = [(pii.KINDS.index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in spans)]
        assert keys == sorted(keys)


def test_corpus_spans_equal_the_plain_detector(spark):
    sf = "/root/testdata/sf0.01"
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.op4_pii(spark, sf).collect():
        assert r["base_sha256"] == hashlib.sha256(",".join(plain(text[r["doc_id"]])).encode()).hexdigest()


def test_estimation_ranks_labelers(spark):
    """Votes drawn from known reliabilities: the fit finds which labelers can be trusted."""
    import random

    dice = random.Random(3)
    right = [0.95, 0.9, 0.8, 0.9, 0.55]
    counts = {}
    for _ in range(6000):
        y = 1 if dice.random() < 0.6 else -1
        v = tuple(y if dice.random() < p else -y for p in right)
        counts[v] = counts.get(v, 0) + 1
    frame = spark.createDataFrame([("email", list(v), n) for v, n in counts.items()], "kind string, votes array<int>, n long")
    model = pii.reliabilities(frame).first()["model"]
    found = [(model["yes"][3 * i + 2] + model["no"][3 * i]) / 2 for i in range(5)]
    assert all(abs(a - b) < 0.04 for a, b in zip(found, right, strict=True))
    assert abs(model["share"][0] - 0.6) < 0.04


def test_secrets_and_national_numbers_are_added(spark):
    """Fifty keys after their words; long plain words and version numbers are left alone."""
    import hashlib as h

    data = [(i, f'the token = "{h.sha1(str(i).encode()).hexdigest()}" and call me on (030) 555-{1000 + i} now') for i in range(50)]
    data += [(100 + i, f"mail me at user{i}@host{i}.example.com or card 4111 1111 1111 1111 here") for i in range(50)]
    data += [(200 + i, "internationalization-and-localization version 1.2.3 page 10 20 30") for i in range(50)]
    got = pii.find_spans(spark.createDataFrame(data, "doc_id long, text string")).collect()
    by = {r["doc_id"]: [x["kind"] for x in r["spans"]] for r in got}
    assert all("secret" in by[i] and "phone" in by[i] for i in range(50))
    assert all(not by[200 + i] for i in range(50))


def test_mask_and_empty(spark, no_docs):
    data = [(1, "write to a@b.com or 1.2.3.4!"), (2, "nothing"), (3, None)]
    found = pii.find_spans(spark.createDataFrame(data, "doc_id long, text string"), keep=("doc_id", "text"))
    got = {r["doc_id"]: r["m"] for r in found.select("doc_id", pii.mask(F.col("text"), F.col("spans")).alias("m")).collect()}
    assert got == {1: "write to [email] or [ip]!", 2: "nothing", 3: None}
    assert pii.find_spans(no_docs).count() == 0


def test_many_matches_take_time_in_proportion(spark):
    import time

    def seconds(n):
        frame = spark.createDataFrame([("4111111111111111, 1.2.3.4 and " * n,)], "text string")
        start = time.perf_counter()
        assert frame.select(F.size(pii.candidates(F.col("text"))).alias("n")).first()["n"] == 2 * n
        return time.perf_counter() - start

    seconds(1000)
    few = seconds(4000)
    assert seconds(16000) < 10 * few + 1


def test_kept_columns_may_be_called_spans(spark):
    frame = spark.createDataFrame([(1, "a@b.com", "mine")], "doc_id long, text string, spans string")
    got = pii.find_spans(frame, keep=("doc_id", "spans")).first()
    assert got["spans"] == "mine" and [x["kind"] for x in got["spans_"]] == ["email"]
