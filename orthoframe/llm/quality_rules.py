"""Quality rules with risk-controlled thresholds, in DataFrame operations.

Each rule rejects a document when a ratio lies above a cutoff. Cutoffs come from labelled
documents (the holdout: quality 1 is good), for each stratum (language) apart:

* Candidate cutoffs are a fixed grid, set before any data are seen. The holdout is dealt by a hash of
  the id into two halves.
* **Choice**, on the first half: a rule takes the candidate with the largest gain (bad documents it
  rejects minus ``cost`` for each good one; the highest such cutoff on ties), or none without gain.
* **Certificate**, on the second half, for all rules of a stratum together: the good documents that
  *any* rule rejects are counted, with the chosen cutoffs, with each raised by one step of the grid, by
  two steps, and so on (a rule raised beyond the grid is out). ``k`` of ``n`` rejected certify a
  false-rejection rate of at most ``alpha`` when the exact binomial probability of at most ``k`` of
  ``n`` at rate ``alpha`` is at most ``delta`` over the number of strata (Bonferroni). This is the
  Clopper-Pearson upper bound at that level compared with ``alpha``. The steps' rejections are nested,
  so testing them from the highest cutoffs down to the first failure (a fixed sequence, which
  needs no further correction) ends at the lowest step that passes; that one is used.
* So with probability ``1 - delta`` there is no stratum in which all rules together reject more than
  ``alpha`` of good documents. A stratum without enough labels certifies nothing, and its documents pass.

Only counts by stratum, rule and step leave the pass over documents.
"""

from __future__ import annotations

from collections.abc import Sequence
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, let, materialize, read
from .textstats import base_counts, count_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Fixed candidate cutoffs of every ratio.
GRID = (0.0, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5, 0.7)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("symbol_ratio", "capital_ratio", "bang_ratio", "dup_line_ratio", "repeat_ratio")


@dataclass(frozen=True)
class Risk:
    """Largest certified false-rejection rate of a stratum, the chance that any stratum fails to keep
    it, and how many rejected bad documents outweigh a rejected good one."""

    alpha: float = 0.01
    delta: float = 0.05
    cost: float = 10.0
    grid: Sequence[float] = field(default=GRID)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def _features(text: Column) -> Column:
    """Struct of base counts and of the rules' ratios, with each count computed once."""
    counts = let(base_counts(text, "A-Z!"), lambda c: F.struct(c.alias("counted"), count_of(c["marks"], "A-Z").alias("capitals"), count_of(c["marks"], "!").alias("bangs")))

    return let(
        counts,
        lambda c: F.struct(
            *[c["counted"][n].alias(n) for n in BASE],
            _ratio(c["counted"]["n_symbols"], c["counted"]["word_chars"]).alias("symbol_ratio"),
            _ratio(c["capitals"], c["counted"]["word_chars"]).alias("capital_ratio"),
            _ratio(c["bangs"], c["counted"]["word_chars"]).alias("bang_ratio"),
            _ratio(c["counted"]["n_dup_lines"], c["counted"]["lines"]).alias("dup_line_ratio"),
            _ratio(c["counted"]["n_repeat_words"], c["counted"]["n_words"]).alias("repeat_ratio"),
        ),
    )


def base_failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1, by Stirling's series at x + 8."""
    y = x + 8.0
    product = F.lit(1.0)
    for i in range(8):
        product = product * (x + float(i))
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def at_most(k: Column, n: Column, rate: float) -> Column:
    """Exact binomial probability of at most ``k`` of ``n`` at ``rate``, for k <= rate * n.

    Terms are added from ``k`` downwards as multiples of the last one. They fall ever faster, and 40
    standard deviations further none changes the sum, so there are at most so many.
    """
    k_, n_ = k.cast("double"), n.cast("double")
    last = log_gamma(n_ + 1) - log_gamma(k_ + 1) - log_gamma(n_ - k_ + 1) + k_ * math.log(rate) + (n_ - k_) * math.log1p(-rate)
    terms = F.least(k_, 50 + F.ceil(40 * F.sqrt(n_ * rate))).cast("long")

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * (k - i + 1).cast("double") * (1 - rate) / ((n - k + i).cast("double") * rate)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    steps = F.when(terms > 0, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<long>"))
    return F.exp(last) * F.aggregate(steps, start, step, lambda s: s["total"])


def _level(ratio: Column, grid: Sequence[float]) -> Column:
    """How many of the grid's cutoffs a ratio lies above."""
    return sum((F.when(ratio > float(c), 1).otherwise(0) for c in grid), F.lit(0))


def cutoffs(holdout: DataFrame, risk: Risk = Risk(), rules: Sequence[str] = RULES) -> DataFrame:
    """(stratum, good boolean, half boolean, ratios...) -> (stratum, rule, cutoff, raised, n_good, good_out).

    A row for each rule that is in use in a stratum; ``raised`` is the step of the certificate, which
    has ``n_good`` good documents of which all rules together reject ``good_out``. ``half`` is true
    for documents of the certificate. Null strata are one stratum; rows whose ``good`` is null are
    ignored; no rows give no cutoffs.
    """
    grid = sorted(float(c) for c in risk.grid)
    known = holdout.filter("good is not null").select("stratum", "good", "half", *[_level(F.col(r), grid).alias(r) for r in rules])
    counts = known.filter("not half").groupBy("stratum").agg(
        *[F.count_if(F.col("good") & (F.col(r) > i)).alias(f"g_{r}_{i}") for r in rules for i in range(len(grid))],
        *[F.count_if(~F.col("good") & (F.col(r) > i)).alias(f"b_{r}_{i}") for r in rules for i in range(len(grid))],
    )
    chosen = []
    for r in rules:
        options = F.array(*[F.struct((F.col(f"b_{r}_{i}") - risk.cost * F.col(f"g_{r}_{i}")).alias("gain"), F.lit(i).alias("at")) for i in range(len(grid))])
        best = F.array_max(options)
        chosen.append(F.when(best["gain"] > 0, best["at"]).alias(f"at_{r}"))
    chosen = materialize(counts.select(F.col("stratum").alias("s"), *chosen), "rule-choices")  # one row a stratum
    strata = known.groupBy("stratum").agg(F.count_if(F.col("good") & F.col("half")).alias("n_good")).withColumnRenamed("stratum", "t")
    strata = materialize(strata, "rule-strata")
    sure = known.filter("half and good").join(chosen, F.col("stratum").eqNullSafe(F.col("s")))
    # a document is rejected at all steps up to this one
    above = F.greatest(F.lit(-1), *[F.coalesce(F.col(r) - 1 - F.col(f"at_{r}"), F.lit(-1)) for r in rules])
    out = materialize(sure.groupBy(F.col("stratum").alias("u"), above.alias("up_to")).agg(F.count(F.lit(1)).alias("n")), "rule-rejected")
    steps = chosen.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("raised"))
    found = steps.join(strata, F.col("s").eqNullSafe(F.col("t"))).join(out, F.col("s").eqNullSafe(F.col("u")), "left")
    names = ["s", "raised", "n_good", *[f"at_{r}" for r in rules]]
    found = found.groupBy(*names).agg(F.coalesce(F.sum(F.when(F.col("up_to") >= F.col("raised"), F.col("n"))), F.lit(0)).alias("good_out"))
    n_strata = strata.agg(F.count(F.lit(1)).alias("n_strata"))
    hopeless = F.col("good_out") > F.lit(risk.alpha) * F.col("n_good")
    chance = F.when(hopeless, F.lit(1.0)).otherwise(at_most(F.col("good_out"), F.col("n_good"), risk.alpha))
    passed = found.join(F.broadcast(n_strata)).filter(chance <= risk.delta / F.col("n_strata"))  # one row
    least = passed.groupBy("s").agg(F.min(F.struct("raised", "n_good", "good_out", *[f"at_{r}" for r in rules])).alias("x")).select("s", "x.*")
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.get(F.array(*map(F.lit, grid)), F.col(f"at_{r}") + F.col("raised")).alias("cutoff")) for r in rules]))
    out_rows = least.select(F.col("s").alias("stratum"), each.alias("e"), "raised", "n_good", "good_out")
    return out_rows.select("stratum", "e.rule", "e.cutoff", "raised", "n_good", "good_out").filter("cutoff is not null")


def _wide(found: DataFrame, rules: Sequence[str]) -> DataFrame:
    """A row for each stratum, with the cutoff of each rule or null."""
    return found.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in rules])


def holdout_of(scored: DataFrame, id_column: str, stratum: str, features: str, labels: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Labelled documents (each label once: conflicting labels of an id count as good) with ``half``."""
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    marks = marks.withColumnRenamed("doc_id", "label_id")
    own = scored.select(F.col(id_column).alias("own_id"), F.col(stratum).alias("stratum"), F.col(features).alias("f"))
    own = own.filter(~base_failed(F.col("f")))  # base rules have had their say on the others
    return own.join(marks, F.col("own_id") == F.col("label_id")).select("stratum", "good", certifies(F.col("own_id")).alias("half"), *[F.col("f")[r].alias(r) for r in rules])


def certifies(key: Column) -> Column:
    """Whether a labelled document belongs to the certificate's half of the holdout."""
    return F.substring(F.md5(key.cast("string").cast("binary")), 1, 1) >= "8"


def judge(scored: DataFrame, found: DataFrame, stratum: str, features: str, rejected: str, rules: Sequence[str] = RULES) -> DataFrame:
    """``scored`` with a boolean column ``rejected``: a ratio lies above its stratum's cutoff."""
    names = scored.columns
    s, *cuts = fresh(names, "cut_stratum", *[f"cut_{r}" for r in rules])
    table = _wide(found, rules).toDF(s, *cuts)
    above = [F.coalesce(F.col(features)[r] > F.col(c), F.lit(False)) for r, c in zip(rules, cuts, strict=True)]
    verdict = above[0]
    for x in above[1:]:
        verdict = verdict | x
    joined = scored.join(table, F.col(stratum).eqNullSafe(F.col(s)), "left")
    return joined.select(*names, verdict.alias(rejected))


def filter_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", stratum_column: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """``docs`` that pass the base rules and their stratum's cutoffs; other columns untouched.

    Null and empty texts fail the base rules. Repeated rows are judged alike (and a label counts for
    each); without labels only the base rules act; an empty table gives no rows. A ratio equal to a
    cutoff passes. Very long texts are counted whole, in one task's memory. Other columns may have any
    names, those used inside included. Documents go with their counts to the shared folder, so that
    texts are counted once and not shuffled.
    """
    names = docs.columns
    f, out = fresh(names, "rule_features", "rule_rejected")
    scored = materialize(docs.withColumn(f, _features(F.col(text_column))), "rule-scored")
    found = materialize(cutoffs(holdout_of(scored, id_column, stratum_column, f, labels, RULES), risk), "rule-cutoffs")
    return judge(scored, found, stratum_column, f, out).filter(~base_failed(F.col(f)) & ~F.col(out)).select(names)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: base counts and verdicts of all documents."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = materialize(docs.select("doc_id", "lang", _features(F.col("text")).alias("f")), "rule-features")
    found = materialize(cutoffs(holdout_of(scored, "doc_id", "lang", "f", labels, RULES)), "rule-cutoffs")
    out = judge(scored, found, "lang", "f", "rejected")
    failed = base_failed(F.col("f"))
    return out.select("doc_id", *[F.col("f")[c].alias(c) for c in BASE], failed.alias("base_failed"), (~failed & ~F.col("rejected")).alias("kept"))


def _op3_sql(risk: Risk = Risk()) -> str:
    ratio = {"symbol_ratio": ("n_symbols", "word_chars"), "capital_ratio": ("capitals", "word_chars"), "bang_ratio": ("bangs", "word_chars"), "dup_line_ratio": ("n_dup_lines", "lines"), "repeat_ratio": ("n_repeat_words", "n_words")}
    ratios = ", ".join(f"CASE WHEN {w} > 0 THEN {p}::DOUBLE / {w} ELSE 0.0 END AS {r}" for r, (p, w) in ratio.items())
    grid = ", ".join(f"({c}::DOUBLE)" for c in risk.grid)
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
windows AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (
  SELECT w.doc_id, lang, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
    coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS capitals,
    length(regexp_replace(t, '[^!]+', '', 'g')) AS bangs, len(string_split(t, chr(10))) AS lines
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {ratios} FROM c),
labelled AS (SELECT f.*, good, md5(doc_id::VARCHAR)[1:1] >= '8' AS half FROM f JOIN (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed),
grid AS (SELECT cutoff, row_number() OVER (ORDER BY cutoff) - 1 AS step FROM (VALUES {grid}) v(cutoff)),
long AS (UNPIVOT (SELECT doc_id, lang, good, half, {", ".join(ratio)} FROM labelled) ON {", ".join(ratio)} INTO NAME rule VALUE ratio),
gains AS (
  SELECT lang, rule, step, count(*) FILTER (NOT good AND ratio > cutoff) - {risk.cost} * count(*) FILTER (good AND ratio > cutoff) AS gain
  FROM long, grid WHERE NOT half GROUP BY lang, rule, step),
chosen AS (SELECT lang, rule, arg_max(step, struct_pack(gain := gain, step := step)) AS step FROM gains WHERE gain > 0 GROUP BY lang, rule),
strata AS (SELECT lang, count(*) FILTER (good AND half) AS n FROM labelled GROUP BY lang),
halves AS (SELECT DISTINCT lang FROM labelled WHERE NOT half),
steps AS (SELECT strata.lang, n, step AS raised FROM strata, grid WHERE EXISTS (SELECT 1 FROM halves WHERE halves.lang IS NOT DISTINCT FROM strata.lang)),
raised AS (
  SELECT s.lang, s.raised, c.rule, g.cutoff FROM steps s JOIN chosen c ON c.lang IS NOT DISTINCT FROM s.lang JOIN grid g ON g.step = c.step + s.raised),
hits AS (
  SELECT r.lang, r.raised, count(DISTINCT l.doc_id) AS k FROM raised r JOIN long l ON l.lang IS NOT DISTINCT FROM r.lang AND l.rule = r.rule
  WHERE l.good AND l.half AND l.ratio > r.cutoff GROUP BY r.lang, r.raised),
chances AS (
  SELECT s.lang, s.raised, coalesce(k, 0) AS g, n, (SELECT count(*) FROM strata) AS n_strata
  FROM steps s LEFT JOIN hits h ON h.lang IS NOT DISTINCT FROM s.lang AND h.raised = s.raised),
passed AS (
  SELECT lang, min(raised) AS raised FROM chances
  WHERE CASE WHEN g > {risk.alpha} * n THEN 1.0 ELSE list_sum(list_transform(range(0, g + 1), lambda i: exp(
      lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({risk.alpha}::DOUBLE) + (n - i) * ln(1 - {risk.alpha}::DOUBLE)))) END <= {risk.delta} / n_strata
  GROUP BY lang),
best AS (SELECT r.lang, r.rule, r.cutoff FROM raised r JOIN passed p ON p.lang IS NOT DISTINCT FROM r.lang AND p.raised = r.raised),
rejected AS (
  SELECT DISTINCT doc_id FROM (UNPIVOT (SELECT doc_id, lang, {", ".join(ratio)} FROM f) ON {", ".join(ratio)} INTO NAME rule VALUE ratio) x
  JOIN best ON best.rule = x.rule AND best.lang IS NOT DISTINCT FROM x.lang WHERE ratio > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM f
"""


OP3_SQL = _op3_sql()
