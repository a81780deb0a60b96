import re
from collections import Counter, defaultdict

import corpus_pipeline
import __spark_entry__ as entry

from orthoframe.llm.common import SPACE

from .test_mixing import plain_targets
from .test_quality import plain_counts
from .test_simhash_similar import plain

SF = "/root/testdata/sf0.001"


def test_stages_match_plain_versions(spark, tmp_path):
    """Every stage on its own input, against plain Python. (No cutoff is certified at this size.)"""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs, outputs = docs.columns, [], []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs.collect())
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        outputs.append(docs.collect())
        assert k == 4 or docs.columns == columns, name
    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    assert ids(outputs[0]) == sorted(r["doc_id"] for r in inputs[0] if (c := plain_counts(r["text"]))[0] >= 50 and 100 * c[4] <= 50 * c[0])
    first = {}
    for r in inputs[1]:
        key = re.sub(f"{SPACE}+", " ", r["text"] or "")
        first[key] = min(r["doc_id"], first.get(key, r["doc_id"]))
    assert ids(outputs[1]) == sorted(first.values())
    assert ids(outputs[2]) == sorted(set(plain([(r["doc_id"], r["text"]) for r in inputs[2]]).values()))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in inputs[3]:
        sizes[r["source"]] += plain_counts(r["text"])[0]
    for r in outputs[3]:
        taken[r["source"]] += plain_counts(r["text"])[0]
    assert all(abs(taken[s] - t) <= 0.1 * t + 30 for s, t in plain_targets(sizes).items())
    assert max(Counter(ids(outputs[3])).values()) <= 3
    held = Counter()
    for r in outputs[4]:
        held[r["doc_id"]] += r["length"]
    want = Counter()
    length = {r["doc_id"]: r["doc_tokens"] for r in outputs[4]}
    for r in inputs[4]:
        want[r["doc_id"]] += length[r["doc_id"]]
    assert held == want


def test_empty_and_odd_tables(spark, docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, no_docs, str(tmp_path)).count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        assert out.count() > 0 and (k == 4 or out.columns == docs.columns), name


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11))
