import random
import re
from collections import defaultdict

import numpy as np

from orthoframe.llm import mixing

from .conftest import rows


def plain_targets(sizes, weights=(1, 2, 3), cap=3.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(target[s] for s in full)
        free = sum(w[s] for s in order if s not in full)
        for s in order:
            if s not in full:
                target[s] = left * w[s] / free
        above = {s for s in order if s not in full and target[s] > cap * sizes[s]}
        if not above:
            return target
        for s in above:
            target[s] = cap * sizes[s]
        full |= above


def sizes_of(data):
    out = defaultdict(int)
    for r in data:
        out[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    return out


def test_targets_and_copies(docs, no_docs):
    want = plain_targets(sizes_of(rows()))
    got = mixing.take(docs, block=16).collect()
    assert len(got) == len(rows())
    taken = defaultdict(int)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    for s, t in want.items():
        longest = max(r["size"] for r in got if r["source"] == s)
        assert abs(taken[s] - t) <= max(3, longest)
    again = mixing.take(docs.repartition(5), block=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.take(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0


def test_mixed_rows(docs):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    taken = defaultdict(int)
    for r in mixing.take(docs).collect():
        taken[r["id"], r["size"]] += r["copies"]
    count = defaultdict(int)
    for r in out.collect():
        count[r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))] += 1
    assert {k: v for k, v in taken.items() if v} == count


def test_repeated_rows_are_one_item(spark):
    """A third of all rows are alike in id and size; blocks stay small, and copies go round evenly."""
    dice = random.Random(8)
    data = [(7, 50, "a", f"x{i}") for i in range(3000)] + [(None, 20, "b", "y")] * 500 + [(100 + i, dice.randint(1, 90), dice.choice("ab"), "z") for i in range(5000)]
    frame = spark.createDataFrame(data, "doc_id long, size long, source string, mix_id string").repartition(5)
    got = mixing.take(frame, size=frame["size"], block=200).collect()
    assert len(got) == len(data)
    for s in "ab":
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= 50
    for i in (7, None):
        copies = [r["copies"] for r in got if r["id"] == i]
        assert max(copies) - min(copies) <= 1
    out = mixing.mix(frame, size=frame["size"], block=200)
    assert out.columns == frame.columns
    want, have = defaultdict(int), defaultdict(int)
    for r in got:
        want[r["id"], r["size"]] += r["copies"]
    rows_ = out.collect()
    for r in rows_:
        have[r["doc_id"], r["size"]] += 1
    assert {k: v for k, v in want.items() if v} == have
    each = defaultdict(int)
    for r in rows_:
        if r["doc_id"] == 7:
            each[r["mix_id"]] += 1
    least = want[7, 50] // 3000
    assert set(each.values()) <= {least, least + 1} - {0}


def test_flight_keeps_both_totals():
    dice = np.random.default_rng(4)
    size = np.sort(dice.integers(0, 1000, 500))[::-1].astype(float)
    prob = np.full(500, 0.37)
    out = mixing.flight(prob, size)
    undecided = (out > 1e-9) & (out < 1 - 1e-9)
    assert undecided.sum() <= 2
    assert abs(out.sum() - prob.sum()) < 1e-6 and abs(out @ size - prob @ size) < 1e-3
    landed = mixing.landing(out, size)
    assert set(landed) <= {0.0, 1.0} and abs(landed @ size - prob @ size) <= 500
    landed = mixing.flight_and_landing(prob, size)
    assert set(landed) <= {0.0, 1.0} and abs(landed @ size - prob @ size) <= 2


def test_levels_reach_the_target(spark):
    dice = random.Random(9)
    data = [(i, " ".join("w" * dice.randint(1, 60)), "hot" if i % 3 else "cold", 0) for i in range(3000)]
    frame = spark.createDataFrame([(r[0], r[1], r[2]) for r in data], "doc_id long, text string, source string")
    want = plain_targets(sizes_of([(r[0], r[1], None, r[2]) for r in data]))
    taken = defaultdict(int)
    for r in mixing.take(frame, block=40).collect():
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - t) <= 60 for s, t in want.items())


def test_small_source_lands_beside_a_hot_one(spark):
    dice = random.Random(3)
    data = [(i, dice.randint(200, 900), "cold" if i < 30 else "hot") for i in range(430)]
    frame = spark.createDataFrame(data, "doc_id long, size long, source string")
    got = mixing.take(frame, size=frame["size"], weights=(1, 9), block=40).collect()
    taken = {s: sum(r["copies"] * r["size"] for r in got if r["source"] == s) for s in ("cold", "hot")}
    assert len(got) == 430 and all(abs(taken[r["source"]] - r["target"]) <= 5 for r in got)
