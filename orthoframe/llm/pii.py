r"""Personal data by weak supervision, in DataFrame operations.

* **Candidates** are matches of fixed patterns: per kind those of the base detector, its near
  misses, national phone numbers, and long mixed tokens (kind ``secret``).
* **Labelers** vote on each candidate, 1 (personal), -1 (not) or 0 (abstains): a checker of the
  pattern's rules (Luhn, octets, digits), gazetteers (domain endings, reserved networks, card
  prefixes, calling codes, key prefixes), words of the context before it, its borders, and the
  variety of its characters.
* **Expectation-maximisation** (Dawid and Skene, 1979) estimates each labeler's reliability and
  each kind's share from the counts of vote patterns, of which there are at most
  ``kinds * 3 ** labelers``, whatever the corpus. It runs as one fold inside one row.
* A **span classifier** (logistic regression) is trained on the estimated probabilities, with
  the span's length and share of digits beside its kind and votes, and decides on candidates.

Base spans stay whatever the classifier says. Candidates stay arrays of their document's row: no
join, and no shuffle but that of the pattern counts. Positions are code points, end exclusive.

Patterns equal those of the contract in what passes their checks (a run of fewer than 13 digits is no
card, so it is not matched at all); guards like ``(?<![0-9])`` with ``\G``
and possessive quantifiers keep them linear on very long runs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, fresh, let, materialize, read

#: In the order of output.
KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = ("rules", "gazetteer", "context", "borders", "variety")
EM_STEPS = 30
CONTEXT = 32
#: Elements of a block of running sums.
RUN = 256

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NATIONAL = r"(?<![0-9+])\(?[0-9]{3}\)?[\x20-][0-9]{3}-[0-9]{4}(?![0-9])"
SECRET = r"(?:(?<![A-Za-z0-9_-])|\G)[A-Za-z0-9_-]{20,}+"

#: Words before a span that speak for, or against, personal data of a kind.
FOR = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|client|address",
    "card": "card|visa|master|amex|credit|account|payment",
    "phone": "phone|tel|call|mobile|fax|contact",
    "secret": "token|key|secret|passw|auth|bearer|credential",
}
AGAINST = "version|license|licence|isbn|issn|doi|page|section|figure|chapter|http|sha|commit|uuid"
#: Common endings of domains; card issuers' first digits; calling codes; prefixes of keys.
ENDINGS = "com|org|net|edu|gov|io|co|info|biz|de|fr|es|it|uk|eu|us|ca|nl|ch|at|be|pl|ru|jp|cn|in|br|au"
ISSUERS = r"\A(?:3[0-9]|4|5[0-9]|6[0-9]|2[2-7])"
CALLING = r"\A\+(?:1|7|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-9]|8[0-9]|9[0-9])"
KEY_PREFIXES = r"\A(?:sk|pk|rk|ghp|gho|github|glpat|xox[abp]|AKIA|ASIA|AIza|eyJ)"
RESERVED = r"\A0*(?:0|127|255|22[4-9]|23[0-9])\."

_MATCHES = "array<struct<s:int,e:int,t:string,before:string,after:string>>"
_NONE = "array<struct<kind:string,s:int,e:int,base:boolean,votes:array<int>,size:int,digits:int>>"


def _running(sizes: Column) -> Column:
    """Sums of an array up to each element, by blocks of ``RUN``, so that no long array is copied for each."""
    zero = F.lit(0)

    def sums(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda out, x: F.concat(out, F.array(F.element_at(out, -1) + x)), lambda out: F.slice(out, 2, RUN))

    def fold(n: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(n), F.lit(RUN))

        def blocks(first: Column) -> Column:
            totals = F.transform(first, lambda at: F.aggregate(F.slice(n, at, F.lit(RUN)), zero, lambda a, x: a + x))
            before = F.aggregate(totals, F.array(zero), lambda out, x: F.concat(out, F.array(F.element_at(out, -1) + x)))
            return let(before, lambda b: F.flatten(F.transform(first, lambda at, k: sums(F.slice(n, at, F.lit(RUN)), F.get(b, k)))))

        return let(firsts, blocks)

    return let(sizes, fold)


def matches(text: Column, pattern: str, needs: Column) -> Column:
    """All leftmost non-overlapping matches in order, with places and what stands around.

    Texts between matches and the matches themselves alternate, so places are running sums of
    their lengths.
    """
    none = F.array().cast(_MATCHES)

    def fold(hits: Column) -> Column:
        def place(gaps: Column) -> Column:
            ends = _running(F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h)))

            def rows(end: Column) -> Column:
                def one(h: Column, i: Column) -> Column:
                    e = F.get(end, i)
                    return F.struct((e - F.length(h)).alias("s"), e.alias("e"), h.alias("t"), F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"))

                return F.transform(hits, one)

            return let(ends, rows)

        return F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), place)).otherwise(none)

    return F.when(needs, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), fold)).otherwise(none)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    def check(d: Column) -> Column:
        def step(total: Column, i: Column) -> Column:
            x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
            twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
            return total + F.when(i % 2 == 1, twice).otherwise(x)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), step) % 10 == 0

    return let(digits, check)


def valid(kind: str, t: Column) -> Column:
    """What a match must fulfil beyond its pattern."""
    if kind == "ip":
        def octet(x: Column) -> Column:
            return F.regexp_replace(x, r"\A0+(?=.)", "").rlike(r"\A(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])\z")

        return F.forall(F.split(t, r"\."), octet)
    if kind == "card":
        return let(_digits(t), lambda d: F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(t)).between(9, 15)
    if kind == "secret":
        return (F.length(t) <= 256) & t.rlike("[0-9]") & t.rlike("[A-Za-z]") & (F.length(F.regexp_replace(t, "[0-9]+", "")) * 10 >= F.length(t))
    return F.lit(True)


def _vote(good: Column, bad: Column | None = None) -> Column:
    """1 where ``good`` holds, else -1 where ``bad`` does (by default everywhere), else 0."""
    if bad is None:
        return F.when(good, 1).otherwise(-1)
    return F.when(good, 1).when(bad, -1).otherwise(0)


def gazetteer(kind: str, t: Column) -> Column:
    if kind == "email":
        return _vote(F.lower(t).rlike(rf"\.(?:{ENDINGS})\z"), t.rlike(r"[0-9-]\z"))
    if kind == "ip":
        return _vote(F.lit(False), t.rlike(RESERVED))
    if kind == "card":
        return _vote(_digits(t).rlike(ISSUERS))
    if kind == "phone":
        return _vote(t.rlike(CALLING), t.rlike(r"\A\+0"))
    return _vote(t.rlike(KEY_PREFIXES), F.lit(False))


def votes(kind: str, x: Column, fulfils: Column) -> Column:
    t, before = x["t"], F.lower(x["before"])
    unlike = F.size(F.array_distinct(F.split(F.lower(F.left(t, F.lit(256))), "")))
    clean = ~before.rlike(r"[\p{L}\p{N}]\z") & ~x["after"].rlike(r"\A[\p{L}\p{N}]")
    return F.array(
        _vote(fulfils),
        gazetteer(kind, t),
        _vote(before.rlike(rf"(?:{FOR[kind]})[^\n]{{0,12}}\z"), before.rlike(rf"(?:{AGAINST})[^\n]{{0,12}}\z")),
        _vote(clean),
        _vote(unlike >= 7, unlike <= 4),
    )


def _candidates(kind: str, found: Column, has_base: bool) -> Column:
    def one(x: Column) -> Column:
        t = x["t"]
        fulfils = valid(kind, t)
        share = F.floor(4.0 * F.length(_digits(t)) / F.length(t)).cast("int")

        def row(ok: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), (ok if has_base else F.lit(False)).alias("base"), votes(kind, x, ok).alias("votes"), F.least(F.lit(6), F.floor(F.log2(F.length(t))).cast("int")).alias("size"), share.alias("digits"))

        return let(fulfils, row)

    return F.transform(found, one)


def candidates(text: Column) -> Column:
    """All candidates of a text, with ``base`` for those that the base detector keeps."""
    text = F.coalesce(text, F.lit(""))
    digit = text.rlike("[0-9]")
    phones = _candidates("phone", matches(text, PHONE, text.contains("+")), True)
    national = _candidates("phone", matches(text, NATIONAL, digit & text.contains("-")), False)
    found = [
        _candidates("email", matches(text, EMAIL, text.contains("@")), True),
        _candidates("ip", matches(text, IP, digit & text.contains(".")), True),
        _candidates("card", matches(text, CARD, digit), True),
        # national numbers beside the international ones, not inside them
        let(phones, lambda p: F.concat(p, F.filter(national, lambda x: ~F.exists(p, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))))),
        _candidates("secret", matches(text, SECRET, digit), False),
    ]
    return F.concat(*found).cast(_NONE)


def reliabilities(patterns: DataFrame, steps: int = EM_STEPS) -> DataFrame:
    """One row with ``patterns`` and fitted ``model``: share by kind, and for each labeler and vote
    its probability given personal data (``yes``) or none (``no``), flat by labeler.

    ``patterns`` has (kind, votes, n), a row for each; there are at most ``5 * 3 ** 5``.
    """
    k, cells = len(KINDS), 3 * len(LABELERS)
    index = F.create_map(*[F.lit(x) for i, kind in enumerate(KINDS) for x in (kind, i)])
    row = patterns.agg(F.collect_list(F.struct(F.element_at(index, F.col("kind")).alias("k"), "kind", "votes", F.col("n").cast("double").alias("n"))).alias("patterns"))
    row = materialize(row, "pii-patterns-row")
    yes, no = [0.15, 0.25, 0.6] * len(LABELERS), [0.6, 0.25, 0.15] * len(LABELERS)
    first = F.struct(F.array(*[F.lit(0.5)] * k).alias("share"), F.array(*map(F.lit, yes)).alias("yes"), F.array(*map(F.lit, no)).alias("no"))

    def step(model: Column, _: Column) -> Column:
        weighted = F.transform("patterns", lambda p: F.struct(p["k"].alias("k"), p["votes"].alias("votes"), p["n"].alias("n"), (p["n"] * posterior(model, p["k"], p["votes"])).alias("r")))

        def total(rows: Column, of: Callable[[Column], Column]) -> Column:
            return F.aggregate(rows, F.lit(0.0), lambda a, p: a + of(p))

        def fit(w: Column) -> Column:
            def cell(j: Column, of: Callable[[Column], Column]) -> Column:
                here = total(w, lambda p: F.when(F.get(p["votes"], F.floor(j / 3).cast("int")) + 1 == j % 3, of(p)).otherwise(0.0))
                return (here + 1.0) / (total(w, of) + 3.0)

            def share(i: Column) -> Column:
                mine = F.filter(w, lambda p: p["k"] == i)
                return (total(mine, lambda p: p["r"]) + 1.0) / (total(mine, lambda p: p["n"]) + 2.0)

            return F.struct(
                F.transform(F.sequence(F.lit(0), F.lit(k - 1)), share).alias("share"),
                F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda j: cell(j, lambda p: p["r"])).alias("yes"),
                F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda j: cell(j, lambda p: p["n"] - p["r"])).alias("no"),
            )

        return let(weighted, fit)

    model = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step)
    return row.select("patterns", model.alias("model"))


def posterior(model: Column, k: Column, votes_: Column) -> Column:
    """Probability of personal data given the votes."""
    share = F.get(model["share"], k)
    logit = F.log(share / (1 - share))
    for i in range(len(LABELERS)):
        at = F.get(votes_, F.lit(i)) + (3 * i + 1)
        logit = logit + F.log(F.get(model["yes"], at) / F.get(model["no"], at))
    return 1 / (1 + F.exp(-logit))


def _inputs(kind: Column, votes_: Column, size: Column, digits: Column) -> list[Column]:
    flags = [kind == k for k in KINDS[1:]]
    for i in range(len(LABELERS)):
        flags += [F.get(votes_, F.lit(i)) == v for v in (-1, 1)]
    flags += [size >= s for s in (4, 5, 6)] + [digits >= d for d in (1, 2, 3, 4)]
    return [f.cast("double") for f in flags]


def train(scored: DataFrame, spans: str, steps: int = EM_STEPS) -> list[float] | None:
    """Intercept and weights of the span classifier; None without candidates."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    each = scored.select(F.explode(spans).alias("x")).select("x.kind", "x.votes", "x.size", "x.digits")
    table = materialize(each.groupBy("kind", "votes", "size", "digits").agg(F.count(F.lit(1)).alias("n")), "pii-patterns")
    if table.isEmpty():
        return None
    fitted = materialize(reliabilities(table.groupBy("kind", "votes").agg(F.sum("n").alias("n")), steps), "pii-reliabilities")
    chances = fitted.select("model", F.explode("patterns").alias("p")).select("p.kind", "p.votes", posterior(F.col("model"), F.col("p.k"), F.col("p.votes")).alias("chance"))
    rows = table.join(chances, ["kind", "votes"])
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("chance")).alias("weight")), F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("chance"))).alias("weight"))))
    inputs = _inputs(F.col("kind"), F.col("votes"), F.col("size"), F.col("digits"))
    names = [f"f{i}" for i in range(len(inputs))]
    rows = rows.select(*[c.alias(n) for c, n in zip(inputs, names, strict=True)], sides.alias("y")).select(*names, "y.label", F.col("y.weight").alias("weight")).filter("weight > 0")
    rows = materialize(VectorAssembler(inputCols=names, outputCol="features").transform(rows.coalesce(1)).select("features", "label", "weight"), "pii-training")
    fit = LogisticRegression(weightCol="weight", maxIter=40, regParam=1e-3, standardization=False).fit(rows)
    for t in (table, fitted, rows):
        drop_table(t)
    return [float(fit.intercept), *map(float, fit.coefficients)]


def chance(weights: Sequence[float], x: Column) -> Column:
    inputs = _inputs(x["kind"], x["votes"], x["size"], x["digits"])
    score = reduce(lambda a, b: a + b, [F.lit(w) * f for w, f in zip(weights[1:], inputs, strict=True)], F.lit(weights[0]))
    return 1 / (1 + F.exp(-score))


def find_spans(docs: DataFrame, text_column: str = "text", spans: str = "spans", keep: Sequence[str] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """``keep`` columns and ``spans``: base candidates and those that the classifier accepts, each
    with kind, s, e, base, votes, size and digits, by kind and place.

    Null texts count as empty and have no spans; repeated rows are judged alike; an empty table
    gives no rows. Very long texts are searched whole. Where a kept column is called like ``spans``, the
    spans' column gets underscores at its end.
    """
    (spans,) = fresh(keep, spans)
    scored = materialize(docs.select(*keep, candidates(F.col(text_column)).alias(spans)), "pii-candidates")
    weights = train(scored, spans)
    if weights is None:
        return scored
    accepted = F.filter(spans, lambda x: x["base"] | (chance(weights, x) >= threshold))
    order = F.create_map(*[F.lit(x) for i, kind in enumerate(KINDS) for x in (kind, i)])
    by_place = F.array_sort(F.transform(accepted, lambda x: F.struct(F.element_at(order, x["kind"]).alias("k"), x["s"].alias("s"), x.alias("x"))))
    return scored.withColumn(spans, F.transform(by_place, lambda y: y["x"]))


def mask(text: Column, spans: Column) -> Column:
    """The text with each span (overlaps joined from the left) replaced by its kind in brackets."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, x: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(x["s"] - state["at"], F.lit(0)))
        fresh_ = F.struct(F.greatest(x["e"], state["at"]).alias("at"), F.concat(state["out"], gap, F.lit("["), x["kind"], F.lit("]")).alias("out"))
        return F.when(x["s"] < state["at"], F.struct(F.greatest(x["e"], state["at"]).alias("at"), state["out"].alias("out"))).otherwise(fresh_)

    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    whole = F.aggregate(by_start, zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: counts and places of personal data in all documents."""
    found = find_spans(read(spark, sf_dir, "documents"))

    def joined(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = joined(F.filter("spans", lambda x: x["base"]))
    return found.select("doc_id", *[number(k) for k in KINDS[:4]], F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") > 0).alias("has_pii"))
