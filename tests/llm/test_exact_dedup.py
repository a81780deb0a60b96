import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from orthoframe.llm import exact_dedup as ed

from .conftest import rows


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_groups_match_brute_force(docs):
    groups = defaultdict(list)
    for r in rows():
        groups[norm(r[1])].append(r[0])
    found = ed.find_copies(docs).collect()
    ids = Counter((r["id"], r["keep_id"], r["group_size"]) for r in found)
    want = Counter((i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g)
    assert ids == want


def test_drop_copies_keeps_one_row_of_each_text(docs):
    out = ed.drop_copies(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter(norm(r["text"]) for r in got) == Counter({norm(r[1]): 1 for r in rows()})
    least = {}
    for r in rows():
        if r[0] is not None:
            least[norm(r[1])] = min(least.get(norm(r[1]), r[0]), r[0])
    assert all(r["doc_id"] == least.get(norm(r["text"])) for r in got)


def test_colliding_digests_are_told_apart(docs, monkeypatch):
    monkeypatch.setattr(ed, "digest", lambda text: F.unhex(F.substring(F.sha2(ed.normalised(text).cast("binary"), 256), 1, 2)))
    groups = defaultdict(list)
    for r in rows():
        groups[norm(r[1])].append(r[0])
    found = ed.find_copies(docs).collect()
    want = Counter((i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g)
    assert Counter((r["id"], r["keep_id"], r["group_size"]) for r in found) == want


def test_runs_merge_into_the_level(spark, docs):
    index = ed.DigestIndex(spark)
    half = docs.filter("doc_id % 2 = 0")
    index.flush(half, "doc_id", "text")
    index.compact()
    index.flush(docs.filter("doc_id % 2 <> 0 or doc_id is null"), "doc_id", "text")
    level = {bytes(r["digest"]): (r["keep_id"], r["n_keep"], r["group_size"]) for r in index.compact().collect()}
    whole = ed.DigestIndex(spark)
    whole.flush(docs, "doc_id", "text")
    assert level == {bytes(r["digest"]): (r["keep_id"], r["n_keep"], r["group_size"]) for r in whole.compact().collect()}


def test_empty_table(no_docs):
    assert ed.find_copies(no_docs).count() == 0
    assert ed.drop_copies(no_docs).count() == 0


def test_lookup_in_several_runs_and_the_level(spark, docs):
    index = ed.DigestIndex(spark)
    for k in range(2):
        index.flush(docs.filter(F.pmod("doc_id", F.lit(4)) == k), "doc_id", "text")
    index.compact()
    for k in range(2, 4):
        index.flush(docs.filter((F.pmod("doc_id", F.lit(4)) == k) if k == 2 else (F.pmod("doc_id", F.lit(4)) == k) | F.col("doc_id").isNull()), "doc_id", "text")
    assert len(index.runs) == 2
    probe = docs.select(ed.digest(F.col("text")).alias("digest")).unionByName(spark.createDataFrame([(bytes(32),)], "digest binary"))
    got = {(bytes(r["digest"]), r["keep_id"], r["group_size"]) for r in index.lookup(probe).collect()}
    whole = ed.DigestIndex(spark)
    whole.flush(docs, "doc_id", "text")
    assert got == {(bytes(r["digest"]), r["keep_id"], r["group_size"]) for r in whole.compact().collect()}
    assert ed.DigestIndex(spark).lookup(probe.select("digest", F.lit(1).alias("id"))).count() == 0


def test_filter_rules_out_what_it_does_not_hold(spark):
    held = spark.range(0, 3000).select(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"))
    others = spark.range(3000, 13000).select(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"))
    table = ed.bloom(held)
    assert ed.with_chance(held, "digest", table, "maybe").filter("maybe").count() == 3000
    assert ed.with_chance(others, "digest", table, "maybe").filter("maybe").count() < 50
    plan = ed.with_chance(others, "digest", table, "maybe")._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan


def test_full_filter_only_lets_more_through(docs, monkeypatch):
    monkeypatch.setattr(ed, "WORDS", 1)
    groups = {norm(r[1]) for r in rows()}
    assert Counter(norm(r["text"]) for r in ed.drop_copies(docs).collect()) == Counter(dict.fromkeys(groups, 1))
