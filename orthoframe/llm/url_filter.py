"""URL filter: listed rules first, gradient-boosted trees on lexical features for the rest.

* **Rules** name a host and a path; one fits its host and all subdomains where the path starts
  with the rule's; the longest that fits decides.
* **Suffix statistics** are counted over all labelled URLs: for the host's last label, and for it
  with the path's first segment, how many URLs and how many of them blocked. They are counted in two
  folds (by a hash of the URL): a URL that the trees are fitted on has the rates of the other fold, so
  its own label is not among its features.
* **Trees** are fitted on a bounded sample of distinct labelled URLs (about ``SAMPLE`` at most, those
  whose hash lies below a threshold, weighted by their number) and judge the URLs that no rule fits. Features: length, depth,
  digit ratio, entropy, parameter count, labels and hyphens of the host, suffix statistics.

Labels are given, or else come from the rules themselves: URLs that a rule decides are the
labelled ones. In that case the trees carry the rules' judgement on to URLs like those that rules decide.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read

#: Distinct labelled URLs that the trees are fitted on, at most.
SAMPLE = 20_000
#: Labelled URLs that a suffix needs to outweigh the overall rate of blocked ones.
PRIOR = 20.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed by the query's contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://`` up to ``/ ? #``, in lower case, and the path after it."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The text of the longest rule that fits, or null. Rules are a list of the caller's, not data."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(r.text)).otherwise(found)
    return found


def verdict_of(rule: Column, rules: Sequence[Rule]) -> Column:
    out = F.lit(None).cast("string")
    for r in rules:
        out = F.when(rule == r.text, F.lit(r.verdict)).otherwise(out)
    return out


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def section(host: Column, path: Column) -> Column:
    return F.concat(suffix(host), F.lit("/"), F.coalesce(F.get(F.split(path, "/"), F.lit(1)), F.lit("")))


def lexical(url: str | None) -> tuple[float, ...]:
    """Features of the URL's letters alone."""
    url = url or ""
    rest = url.partition("://")[2]
    host = rest
    for mark in "/?#":
        host = host.partition(mark)[0]
    path = rest[len(host) :]
    query = path.partition("?")[2].partition("#")[0]
    path = path.partition("?")[0].partition("#")[0]
    n = max(1, len(url))
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(url).values())
    return (
        float(len(url)),
        float(path.count("/")),
        sum(c.isdigit() for c in url) / n,
        entropy,
        float(query.count("&") + 1 if query else 0),
        float(host.count(".") + 1 if host else 0),
        float(host.count("-")),
        float(len(host)),
        float("#" in rest),
    )


@dataclass
class BoostedTrees:
    """Trees of one depth, fitted to the logistic loss on features cut into bins by quantiles."""

    n_trees: int = 40
    depth: int = 4
    rate: float = 0.3
    bins: int = 32
    ridge: float = 1.0
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        rate = float(np.clip((y * weight).sum() / weight.sum(), 1e-6, 1 - 1e-6))
        self.base = math.log(rate / (1 - rate))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        score = np.full(len(x), self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, edges, weight * (y - p), weight * p * (1 - p))
            self.trees.append(tree)
            score += self._leaves(tree, x)
        return self

    def _grow(self, binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = (1 << self.depth) - 1
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(binned), np.int64)
        for level in range(self.depth):
            first = (1 << level) - 1
            width = 1 << level
            best = np.full(width, 1e-9)
            local = node - first
            for f, cut in enumerate(edges):
                if not len(cut):
                    continue
                k = len(cut) + 1
                at = local * k + binned[:, f]
                g = np.bincount(at, grad, width * k).reshape(width, k).cumsum(axis=1)
                h = np.bincount(at, hess, width * k).reshape(width, k).cumsum(axis=1)
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                pick = gain.argmax(axis=1)
                own = gain[np.arange(width), pick]
                better = own > best
                best[better] = own[better]
                feature[first : first + width][better] = f
                threshold[first : first + width][better] = cut[pick[better]]
            cut_bin = np.array([np.searchsorted(edges[f], t, side="left") if np.isfinite(t) else np.iinfo(np.int64).max for f, t in zip(feature, threshold, strict=True)])
            node = 2 * node + 1 + (binned[np.arange(len(binned)), feature[node]] > cut_bin[node])
        leaf = node - inner
        n = 1 << self.depth
        value = self.rate * np.bincount(leaf, grad, n) / (np.bincount(leaf, hess, n) + self.ridge)
        return feature, threshold, value

    def _leaves(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, threshold, value = tree
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        return value[node - len(feature)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self._leaves(tree, x)
        return 1 / (1 + np.exp(-score))


def fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(7)), F.lit(2))


def statistics(labelled: DataFrame, key: Column, name: str) -> DataFrame:
    """(key, rate, rate_0, rate_1): share of blocked URLs of each key, shrunk towards the overall share, in
    all labelled URLs and without those of fold 0 or 1."""
    parts = [("", F.lit(True)), ("_0", F.col("fold") != 0), ("_1", F.col("fold") != 1)]
    counts = [c for s, kept in parts for c in (F.count_if(kept).alias(f"n{s}"), F.count_if(kept & F.col("blocked")).alias(f"b{s}"))]
    sums = materialize(labelled.withColumn("fold", fold(F.col("url"))).groupBy(key.alias(name)).agg(*counts), f"url-{name}")
    total = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums.columns[1:]]).first()
    rates = []
    for s, _ in parts:
        overall = total[f"b{s}"] / (total[f"n{s}"] or 1)
        rates.append(((F.col(f"b{s}") + PRIOR * overall) / (F.col(f"n{s}") + PRIOR)).alias(f"{name}_rate{s}"))
    return sums.select(name, *rates)


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, labels: DataFrame | None = None, id_column: str = "page_id", url_column: str = "url", sample: int = SAMPLE) -> DataFrame:
    """(id, host, path, rule, verdict, chance): a row for each page; chance is the trees' (null by rule).

    ``labels`` has (url, blocked). Null URLs and those without ``://`` have empty host and path,
    which no rule fits. Without labelled URLs the trees allow all. An empty table gives no rows; repeated
    rows are judged alike, and each counts as a labelled URL; of rules of equal length that fit, the last
    by code points decides; a chance of one half blocks. Very long URLs are read whole. Columns other
    than id and URL are not read, so their names may be any.
    """
    host, path = host_and_path(F.col("url"))

    def parsed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("host", host).withColumn("path", path).withColumn("suffix", suffix(F.col("host"))).withColumn("section", section(F.col("host"), F.col("path")))

    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"))
    rows = parsed(rows).withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    rows = materialize(rows.withColumn("verdict", verdict_of(F.col("rule"), rules)), "url-rows")
    if labels is None:
        known = rows.filter("rule is not null").withColumn("blocked", F.col("verdict") == "block")
    else:
        known = parsed(labels.select("url", "blocked").filter("blocked is not null"))
    by_suffix = statistics(known, F.col("suffix"), "suffix")
    by_section = statistics(known, F.col("section"), "section")

    def rated(frame: DataFrame) -> DataFrame:
        return frame.join(by_suffix, "suffix", "left").join(by_section, "section", "left")

    chosen = materialize(known.groupBy("url", "suffix", "section", "blocked").agg(F.count(F.lit(1)).alias("n")), "url-known")
    n_known = chosen.count()
    if n_known > sample:  # a little less, as the share of hashes below the threshold varies
        chosen = chosen.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 32)) < F.lit(int(0.98 * sample / n_known * (1 << 32)))).limit(sample)
    other = [F.when(fold(F.col("url")) == 0, F.col(f"{n}_rate_0")).otherwise(F.col(f"{n}_rate_1")).alias(n) for n in ("suffix", "section")]
    data = rated(chosen).select("url", "blocked", "n", *other).toPandas().sort_values(["url", "blocked"])
    model = None
    if len(data):
        x = np.column_stack([np.array([lexical(u) for u in data["url"]]), data["suffix"].to_numpy(float), data["section"].to_numpy(float)])
        model = BoostedTrees().fit(x, data["blocked"].to_numpy(float), data["n"].to_numpy(float))

    kind = rows.schema["id"].dataType.simpleString()
    rest = rated(rows.filter("rule is null")).select("id", "host", "path", "url", "suffix_rate", "section_rate")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column("url").to_pylist()
            if model is None or not urls:
                chance = np.zeros(len(urls))
            else:
                rates = np.stack([np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False).astype(float), nan=model_rate) for c in ("suffix_rate", "section_rate")], axis=1)
                chance = model.probability(np.concatenate([np.array([lexical(u) for u in urls]), rates], axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), batch.column("path"), pa.array(chance)], ["id", "host", "path", "chance"])

    model_rate = 1 / (1 + math.exp(-model.base)) if model else 0.0
    judged = rest.mapInArrow(run, f"id {kind}, host string, path string, chance double")
    by_model = judged.select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("chance") >= 0.5, "block").otherwise("allow").alias("verdict"), "chance")
    by_rule = rows.filter("rule is not null").select("id", "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("chance"))
    return by_rule.unionByName(by_model)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: host, path, rule and verdict of all pages."""
    return judge(read(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
