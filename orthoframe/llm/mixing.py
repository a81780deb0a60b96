"""Mixing sources to target weights by the cube method (Deville and Tillé, 2004).

Every source has a target; target over size gives the rate at which its documents are taken.
The whole part of a rate is taken surely; its fraction is the inclusion probability of one more
copy. The cube method turns these probabilities into 0 or 1 so that, at each step, the expected
number of documents and the expected number of words of the source stay exactly as they are:
three undecided documents move along the null space of the two constraints (1, 1, 1) and
(their sizes) until one of them is decided (the *flight*, in the fast form of Chauvet and
Tillé, 2006). What the constraints leave undecided, two documents, is *landed* together with ten
that the last flight spares, on the one of all choices whose words come nearest.

Scale: a source is dealt into blocks of bounded expected size, each block flies alone and hands
its last undecided documents to the next level, which has fewer blocks by a factor of about
``block / 2``; a source lands at the first level where it is one block. Blocks go through their
documents from long to short, so what remains are short ones. A hot source is many blocks, and no
step gathers a source.

Rows alike in id, size and source are interchangeable. They are one item with a number of rows: its
whole copies are spread evenly over them, and only the one fractional copy that is left flies.

Results depend on ids, sizes and sources alone (pseudo-random order by hash), so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, drop_table, fresh, materialize, read

#: Expected number of documents of a block.
BLOCK = 4096
#: Documents of a source that the last flight spares for the landing.
LANDING = 10
EPS = 1e-9
#: Numbers that one array holds where a repeated row is spread out.
RUN = 1 << 16


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, n) -> the same with rank, weight and target, one row a source.

    Sources in order of code points (null last) take the weights in turn and share the sum of
    all sizes by them. A target stops at ``cap`` times its source's size; what exceeds it is
    shared again by weight until none is above. With all sizes zero, all targets are zero.

    The table has a row for each source, so one sort of it is small beside any pass over
    documents. The final share per weight is the one at which the sources with the smallest
    ``cap * size / weight`` are full and the others are not.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.get(turn, F.pmod(F.col("rank"), F.lit(len(weights))))
    )
    ranked = ranked.withColumn("full", cap * F.col("source_size")).withColumn("limit", F.col("full") / F.col("weight"))
    everything = Window.orderBy("limit", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("limit", "rank").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("double")
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), zero)
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)
    # the share per weight if all sources before this one are full; the first that holds, holds for all after
    shared = ranked.withColumn("share", left / weight_left)
    held = F.when(F.col("share") <= F.col("limit"), F.col("share"))
    shared = shared.withColumn("share", F.min(F.struct(held.isNull().alias("no"), F.col("limit"), F.col("rank"), held.alias("share"))).over(everything)["share"])
    target = F.when(F.col("limit") <= F.col("share"), F.col("full")).otherwise(F.col("weight") * F.col("share"))
    return shared.select("source", "source_size", "n", "rank", "weight", F.coalesce(target, zero).alias("target"))


def flight(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Moves probabilities to 0 or 1 in the given order, but for at most two.

    Keeps the sum of probabilities and the sum of probability times size (to rounding).
    """
    prob = prob.astype(float).tolist()
    size = size.astype(float).tolist()
    open_: list[int] = []
    for k in range(len(prob)):
        if prob[k] <= EPS or prob[k] >= 1 - EPS:
            prob[k] = float(round(prob[k]))
            continue
        open_.append(k)
        while len(open_) >= 3:
            a, b, c = open_
            move = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            if move == (0.0, 0.0, 0.0):
                move = (1.0, -1.0, 0.0)
            step = min(((1 - prob[i]) / m if m > 0 else prob[i] / -m) for i, m in zip(open_, move, strict=True) if m)
            for i, m in zip((a, b, c), move, strict=True):
                prob[i] += step * m
                if prob[i] <= EPS or prob[i] >= 1 - EPS:
                    prob[i] = float(round(prob[i]))
                    open_.remove(i)
    return np.array(prob)


def landing(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decides the undecided (``LANDING + 2`` at most): of all choices, that whose words come
    nearest to the expected, then that whose number of documents does."""
    prob = prob.copy()
    last = np.flatnonzero((prob > EPS) & (prob < 1 - EPS))
    choices = (np.arange(1 << len(last))[:, None] >> np.arange(len(last))) & 1
    off_size = np.abs(choices @ size[last] - prob[last] @ size[last])
    off_n = np.abs(choices.sum(axis=1) - prob[last].sum())
    prob[last] = choices[np.lexsort((off_n, off_size.round(6)))[0]]
    return prob


def flight_and_landing(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decides all: a flight over all but ``LANDING`` documents spread over the sizes, then a
    landing of these and what the flight left, which together come close to any number of words."""
    order = np.flatnonzero((prob > EPS) & (prob < 1 - EPS))
    spared = order[np.unique(np.linspace(0, len(order) - 1, min(LANDING, len(order))).round().astype(int))]
    flying = np.setdiff1d(np.arange(len(prob)), spared)
    out = prob.copy()
    out[flying] = flight(prob[flying], size[flying])
    return landing(out, size)


def _fly(most: int):
    """Moves a block; one that is all of its source (``most`` documents at most) lands."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((block["dice"], -block["size"]))
        block = block.iloc[order]
        move = flight_and_landing if block["in_source"].iloc[0] <= most else flight
        return block.assign(prob=move(block["prob"].to_numpy(float), block["size"].to_numpy(float)))

    return run


def _decided(
    docs: DataFrame, id_column: str, source_column: str, size: Column | None, weights: Sequence[float], cap: float, block: int
) -> DataFrame:
    """(id, source, size, source_size, target, n, total): rows alike, and how often the mix takes all of them."""
    size = n_words(F.col("text")) if size is None else size
    rows = docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    rows = materialize(rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("items"))
    sums = materialize(sums, "mix-sources")
    goals = targets(sums.drop("items"), weights, cap).join(sums.select(F.col("source").alias("again"), "items"), F.col("source").eqNullSafe(F.col("again"))).drop("again")
    goals = materialize(goals, "mix-targets")
    drop_table(sums)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goals.select(F.col("source").alias("s"), "rank", "items", F.least(rate, F.lit(float(cap))).alias("rate"))
    joined = rows.join(goal, F.col("source").eqNullSafe(F.col("s")))
    wanted = F.col("rate") * F.col("n")
    whole = F.floor(wanted + EPS)
    start = joined.select("id", "rank", "size", "n", whole.cast("long").alias("whole"), F.greatest(wanted - whole, F.lit(0.0)).alias("prob"), F.col("items").alias("in_source"))
    decided: list[DataFrame] = []
    level, most = 0, goals.agg(F.max("items")).first()[0]
    while True:
        # items are dealt by id and size, so that runs agree
        dealt = start.withColumn("dice", F.xxhash64("id", "size", F.lit(level)))
        n_blocks = F.ceil(F.col("in_source") / block)
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("dice"), n_blocks))
        last = not most or most <= block
        dealt = dealt.select("id", "rank", "size", "n", "whole", "prob", "in_source", "dice", "block")
        flown = dealt.groupBy("rank", "block").applyInPandas(_fly(block), dealt.schema)
        flown = materialize(flown, f"mix-level-{level}")
        done = (F.col("prob") == 0) | (F.col("prob") == 1)
        decided.append(flown.filter(done).select("id", "rank", "size", "n", (F.col("whole") + F.col("prob").cast("long")).alias("total")))
        if last:
            break
        level += 1
        rest = flown.filter(~done)
        left = materialize(rest.groupBy("rank").agg(F.count(F.lit(1)).alias("in_source")), "mix-left")
        most = left.agg(F.max("in_source")).first()[0]
        if not most:
            break
        start = rest.drop("in_source", "dice", "block").join(left, "rank")
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.join(goals.drop("n", "items"), "rank").select("id", "source", "size", "source_size", "target", "n", "total")


def _numbers(n: Column) -> Column:
    """0 to n - 1 as arrays of bounded length, to be exploded twice."""
    firsts = F.sequence(F.lit(0).cast("long"), n - 1, F.lit(RUN).cast("long"))
    return F.transform(firsts, lambda a: F.sequence(a, F.least(a + (RUN - 1), n - 1)))


def take(
    docs: DataFrame,
    id_column: str = "doc_id",
    source_column: str = "source",
    size: Column | None = None,
    weights: Sequence[float] = (1, 2, 3),
    cap: float = 3.0,
    block: int = BLOCK,
) -> DataFrame:
    """(id, source, size, source_size, target, copies): how often the mix takes each row.

    ``size`` is an expression over ``docs`` (words of ``text`` by default); null sizes count 0.
    A source without any words takes none of its documents. Null ids are an id, null sources a source.
    Of rows alike in id, source and size some may have one copy more than others. A very long text is
    one large size. Other columns are not read. An empty table gives no rows.
    """
    found = _decided(docs, id_column, source_column, size, weights, cap, block)
    each = found.withColumn("some", F.explode(_numbers(F.col("n")))).withColumn("k", F.explode("some"))
    copies = F.floor(F.col("total") / F.col("n")) + F.when(F.col("k") < F.pmod("total", F.col("n")), 1).otherwise(0)
    return each.select("id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    source_column: str = "source",
    size: Column | None = None,
    weights: Sequence[float] = (1, 2, 3),
    cap: float = 3.0,
    block: int = BLOCK,
) -> DataFrame:
    """``docs`` as the mix has them: each row as often as :func:`take` says, other columns untouched.

    Rows alike in id, source and size are numbered (in the order in which they were written to a table
    of their own), and the first ones have the copies that do not go round. Nulls, empty tables and very
    long texts as for :func:`take`; other columns may have any names.
    """
    names = docs.columns
    found = _decided(docs, id_column, source_column, size, weights, cap, block)
    key, src, own, n, total, copies = fresh(names, "mix_id", "mix_source", "mix_size", "mix_n", "mix_total", "mix_copies")
    found = found.select(*[F.col(c).alias(a) for c, a in (("id", key), ("source", src), ("size", own), ("n", n), ("total", total))])
    found = materialize(found, "mix-decided")

    def times(rows: DataFrame) -> DataFrame:
        return rows.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(names)

    same = F.col(id_column).eqNullSafe(F.col(key)) & F.col(source_column).eqNullSafe(F.col(src))
    # (id, source) of several rows; these need their size and a number to be told apart
    groups = found.groupBy(key, src).agg(F.sum(n).alias("rows")).filter("rows > 1").select(F.col(key).alias("k"), F.col(src).alias("s"))
    groups = materialize(groups, "mix-repeated")
    if groups.isEmpty():
        return times(docs.join(found.withColumn(copies, F.col(total)).filter(F.col(copies) > 0).hint("merge"), same))  # grows with the documents
    repeated = F.col(key).eqNullSafe(F.col("k")) & F.col(src).eqNullSafe(F.col("s"))
    alone = found.join(groups, repeated, "left_anti").withColumn(copies, F.col(total)).filter(F.col(copies) > 0)
    once = times(docs.join(alone.hint("merge"), same))
    measure = F.coalesce(n_words(F.col("text")) if size is None else size, F.lit(0)).cast("long")
    wide = F.struct(*[F.col(c) for c in names]).alias("row")
    of = docs.select(wide, F.col(id_column).alias("id"), F.col(source_column).alias("source"), measure.alias("size"))
    of = of.join(groups, F.col("id").eqNullSafe(F.col("k")) & F.col("source").eqNullSafe(F.col("s")), "left_semi")
    # numbers stay as they are once they were written; the high bits are the part's
    of = materialize(of.withColumn("number", F.monotonically_increasing_id()), "mix-repeats").withColumn("part", F.shiftrightunsigned("number", 33))
    group = ["id", "source", "size"]
    held = of.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("held"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(*[F.col(c).alias(f"h_{c}") for c in (*group, "part")], F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    of = of.withColumn("inside", F.row_number().over(Window.partitionBy(*group, "part").orderBy("number")) - 1)
    met = [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in (*group, "part")]
    of = of.join(held, met[0] & met[1] & met[2] & met[3]).withColumn("place", F.col("before") + F.col("inside"))
    of = of.select("row", "place", *group).join(found, F.col("id").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(src)) & (F.col("size") == F.col(own)))
    each = F.floor(F.col(total) / F.col(n)) + F.when(F.col("place") < F.pmod(total, F.col(n)), 1).otherwise(0)
    return once.unionByName(times(of.select("row.*", each.alias(copies)).filter(F.col(copies) > 0)))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: what the mix of all documents takes of each; repeated rows are returned each."""
    found = take(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies")
