"""Quality classifier with hierarchical empirical Bayes over sites.

* A **document classifier** (logistic regression on counts of the text) is fitted on a bounded
  sample of labelled documents and gives each document log-odds of being good.
* **Sites**: documents belong to a host and a path under it (here source, and language within
  it). Labels add up by path, paths to hosts, hosts to the whole. Sites count labels only, not what the
  classifier thinks, so that no evidence counts twice; for the same reason a labelled document's own
  label is left out of its site's sums when that document is judged.
* **Shrinkage**: a host's mean is drawn to the global mean, a path's mean to its host's, as Beta
  posteriors whose prior strengths come from the spread of the means (method of moments). Sparse
  sites stay near their parent.
* The **posterior** of a document adds what its path's log-odds exceed the global ones by to its
  own log-odds.

Site sums are grouped with partial sums before the shuffle; only the sums of hosts' spread reach
the driver. The sample for the fit holds about ``SAMPLE`` documents at most: those whose hash of the
id lies below a threshold that follows from the number of labels, so no task sorts or gathers others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialize, read
from .quality_rules import _features as text_features

#: Labelled documents that the document classifier is fitted on, at most.
SAMPLE = 50_000
STRENGTH = (1.0, 10_000.0)

INPUTS = ("log_words", "mean_length", "symbol_ratio", "capital_ratio", "bang_ratio", "dup_line_ratio", "repeat_ratio")


def inputs(f: Column) -> list[Column]:
    mean = F.when(f["n_words"] > 0, f["word_chars"].cast("double") / f["n_words"]).otherwise(F.lit(0.0))
    return [F.log1p(f["n_words"].cast("double")), F.log1p(mean), *[F.sqrt(f[c]) for c in INPUTS[2:]]]


@dataclass(frozen=True)
class Logistic:
    intercept: float
    weights: tuple[float, ...]

    def log_odds(self, columns: list[Column]) -> Column:
        out = F.lit(self.intercept)
        for w, c in zip(self.weights, columns, strict=True):
            out = out + F.lit(w) * c
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> Logistic:
    """Newton steps for the penalised likelihood; without rows, even odds."""
    if not len(y):
        return Logistic(0.0, (0.0,) * len(INPUTS))
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - centre) / spread])
    penalty = np.diag([1e-3, *[ridge] * x.shape[1]])
    beta = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        move = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ beta)
        beta += move
        if np.abs(move).max() < 1e-9:
            break
    weights = beta[1:] / spread
    return Logistic(float(beta[0] - weights @ centre), tuple(map(float, weights)))


def _labels(labels: DataFrame) -> DataFrame:
    """One row for each labelled id; conflicting labels count as good."""
    known = labels.filter("doc_id is not null and quality is not null")
    return known.groupBy(F.col("doc_id").alias("label_id")).agg((F.max("quality") > 0).cast("double").alias("y"))


def below(key: Column, share: float) -> Column:
    """Whether a hash of the key lies in the first ``share`` of all hashes."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 32)) < F.lit(int(share * (1 << 32)))


def fit(scored: DataFrame, sample: int = SAMPLE) -> Logistic:
    known = scored.filter("y is not null")
    n = known.count()
    if n > sample:  # a little less, as the share of hashes below the threshold varies
        known = known.filter(below(F.col("id"), 0.98 * sample / n)).limit(sample)
    data = known.select("y", *[c.alias(n_) for c, n_ in zip(inputs(F.col("f")), INPUTS, strict=True)]).toPandas()
    return fit_logistic(data[list(INPUTS)].to_numpy(float).reshape(-1, len(INPUTS)), data["y"].to_numpy(float))


def _strength(table: DataFrame, mean: Column, parent: Column) -> float:
    """Prior strength from the spread of a level's means around their parents' (weighted moments)."""
    own = F.when(F.col("n") > 0, F.col("s") / F.col("n"))
    row = table.select("n", parent.alias("m"), ((own - parent) ** 2).alias("d")).agg(
        F.sum(F.col("n") * F.col("d")).alias("spread"), F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("single"), F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 0, F.col("m") * (1 - F.col("m")))).alias("noise")
    ).first()
    if not row["n"]:
        return STRENGTH[1]
    # the spread of means holds the single documents' noise, m (1 - m) / n each
    between = max((row["spread"] - row["noise"]) / row["n"], 1e-12)
    return float(np.clip((row["single"] / row["n"]) / between - 1, *STRENGTH))


def classify(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", host: str = "source", path: str = "lang", sample: int = SAMPLE, threshold: float = 0.5
) -> DataFrame:
    """(id, classifier, host_mean, path_mean, posterior, kept) for each row.

    Null hosts and paths are sites of their own; null texts count as empty; very long texts are counted
    whole. Without labels the classifier and all means are one half, and all documents are kept.
    Repeated rows are judged alike, and their label counts for each; a document at the threshold is
    kept; an empty table gives no rows. Other columns are not read, so their names may be any.
    """
    marks = _labels(labels)
    rows = docs.select(F.col(id_column).alias("id"), F.col(host).alias("host"), F.col(path).alias("path"), text_features(F.col(text_column)).alias("f"))
    rows = materialize(rows.join(marks, F.col("id") == F.col("label_id"), "left").drop("label_id"), "quality-features")
    model = fit(rows, sample)
    odds = model.log_odds(inputs(F.col("f")))
    chance = 1 / (1 + F.exp(-odds))
    paths = materialize(rows.groupBy("host", "path").agg(F.count("y").cast("double").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("s")), "quality-paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "quality-hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = float(np.clip(total["s"] / total["n"], 1e-6, 1 - 1e-6)) if total["n"] else 0.5
    k_host = _strength(hosts, F.col("s"), F.lit(mean))

    def shrunk(s: Column, n: Column, k: float, parent: Column) -> Column:
        return (s + k * parent) / (n + k)

    named = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    joined = paths.join(named, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    sites = materialize(joined.withColumn("host_mean", shrunk(F.col("host_s"), F.col("host_n"), k_host, F.lit(mean))), "quality-sites")
    k_path = _strength(sites, F.col("s"), F.col("host_mean"))
    for t in (paths, hosts):
        drop_table(t)
    # a row's own label is taken out of the sums of its sites
    own_n, own_s = F.when(F.col("y").isNotNull(), 1.0).otherwise(0.0), F.coalesce("y", F.lit(0.0))
    host_mean = shrunk(F.col("host_s") - own_s, F.col("host_n") - own_n, k_host, F.lit(mean))
    path_mean = shrunk(F.col("s") - own_s, F.col("n") - own_n, k_path, host_mean)
    site = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))
    out = rows.join(sites.withColumnsRenamed({"host": "h", "path": "p"}).drop("host_mean"), site)
    out = out.select("id", chance.alias("classifier"), odds.alias("odds"), host_mean.alias("host_mean"), path_mean.alias("path_mean"))
    shift = F.log(F.col("path_mean") / (1 - F.col("path_mean"))) - float(np.log(mean / (1 - mean)))
    posterior = 1 / (1 + F.exp(-(F.col("odds") + shift)))
    return out.select("id", "classifier", "host_mean", "path_mean", posterior.alias("posterior")).withColumn("kept", F.col("posterior") >= threshold)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: posterior quality of all documents; host is the source, path the language in it."""
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
