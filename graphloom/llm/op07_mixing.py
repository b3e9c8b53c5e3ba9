"""Operator 7: document rates that bring expected domain totals to target weights, in DataFrame functions only.

1. Half of the labelled rows (a bounded sample of them) gives each hashed word its log odds by domain.
2. Every text is measured once: the mean log odds of its words, and shares of kinds of characters and lines, as bins.
3. The other half's bins make a naive Bayes classifier, so words that were learnt by heart do not count as evidence.
4. A projected gradient step fits nonnegative document rates whose expected domain totals match the targets, or come as
   near to them as any rates can.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, let, packed, table

_GAP = "[\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class MixConfig:
    domain: str = "quality"  #: column of labels whose values are the domains
    targets: dict = field(default_factory=lambda: {0: 0.05, 1: 0.95})  #: share of the expected tokens of each domain
    tokens: float | None = None  #: tokens to reach; None: the most that need no domain's documents twice on average
    bins: int = 24  #: of each measure of a text
    buckets: int = 4096  #: hashed words
    max_labelled: int = 8000  #: labelled rows that words are learnt from, by hash of doc_id
    smoothing: float = 20.0  #: words that a bucket's share over all domains counts for
    tolerance: float = 1e-6  #: how much farther from the targets than the best rates, as a part of the target total
    seed: int = 7


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _GAP), lambda w: w != "")


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def measures(text: Column, weights: list[np.ndarray]) -> Column:
    """What the classifier sees of a text: numbers of words and characters, and the sum of its words' weights for each table of weights."""
    text = F.coalesce(text, F.lit(""))

    def count(chars: str) -> Column:
        return F.size(F.split(text, chars)) - 1

    def weight(w: np.ndarray, words: Column) -> Column:
        values = F.split(F.lit(",".join(f"{x:.5f}" for x in w)), ",").cast("array<double>")  # a constant of the plan
        return F.aggregate(words, F.lit(0.0), lambda total, x: total + F.get(values, _bucket(x, len(w))))

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).alias("words"), F.array(*[weight(w, words) for w in weights]).alias("sums"))

    return F.struct(
        F.length(text).alias("chars"),
        let(_words(text), of_words).alias("of"),
        count("[A-Z]").alias("upper"),
        count("[#*$%&|<>!]").alias("symbols"),
        count("[0-9]").alias("digits"),
        count("[.,;:?]").alias("stops"),
        let(F.split(text, "\n"), lambda x: F.struct(F.size(x).alias("lines"), F.size(F.array_distinct(x)).alias("distinct"))).alias("line"),
    )


def _bins(m: Column, bins: int, contrasts: int) -> Column:
    """One bin for each feature, an array of ints below bins."""
    words = m["of"]["words"].cast("double")

    def share(part: Column, whole: Column, scale: float) -> Column:
        x = part.cast("double") / F.greatest(whole.cast("double"), F.lit(1.0))
        return F.least(F.floor(F.sqrt(x * scale) * 3), F.lit(bins - 1)).cast("int")

    def mean(k: int) -> Column:
        x = F.get(m["of"]["sums"], F.lit(k)) / F.greatest(words, F.lit(1.0))
        return F.greatest(F.lit(0), F.least(F.floor((x + 1.5) * (bins / 3)), F.lit(bins - 1))).cast("int")

    return F.array(
        F.least(F.floor(F.log2(words + 1)), F.lit(bins - 1)).cast("int"),
        share(m["upper"], m["chars"], 10),
        share(m["symbols"], words, 2),
        share(m["digits"], m["chars"], 50),
        share(m["stops"], words, 5),
        share(m["line"]["lines"] - m["line"]["distinct"], m["line"]["lines"], 10),
        F.greatest(F.lit(0), F.least(F.floor(m["chars"].cast("double") / F.greatest(words, F.lit(1.0))) - 2, F.lit(bins - 1))).cast("int"),
        *[mean(k) for k in range(contrasts)],
    )


SHAPES = 7


class Mix:
    """A fitted mixture: posteriors and rates are plain columns over a text, so they apply to any table of documents."""

    def __init__(self, config: MixConfig, domains: list, logs: np.ndarray, prior: np.ndarray):
        self.config, self.domains, self.logs, self.prior = config, domains, logs, prior
        self.moves: list[np.ndarray] = []
        self.totals: dict = {}

    def posterior(self, bins: Column) -> list[Column]:
        """One column for each domain: naive Bayes over the bins."""
        scores = [sum((F.get(F.array(*[F.lit(float(x)) for x in self.logs[k, f]]), F.get(bins, F.lit(f))) for f in range(self.logs.shape[1])), F.lit(float(self.prior[k]))) for k in range(len(self.domains))]
        return [1 / sum((F.exp(F.greatest(F.least(other - own, F.lit(700.0)), F.lit(-700.0))) for other in scores), F.lit(0.0)) for own in scores]

    def rate(self, p: list[Column], more: np.ndarray | None = None) -> Column:
        """The rate after the move found, or the one given: a step along the gradient, cut at zero."""
        r = F.lit(1.0)
        for move in self.moves if more is None else [more]:
            r = F.greatest(F.lit(0.0), r - sum((p[k] * float(move[k]) for k in range(len(p))), F.lit(0.0)))
        return r

    def copies(self, rate: Column, doc_id: Column) -> Column:
        """Whole copies whose mean is the rate; a document's fraction is decided by its id's hash."""
        chance = F.pmod(F.xxhash64(doc_id.cast("string"), F.lit(self.config.seed)), F.lit(1 << 30)) / float(1 << 30)
        return F.floor(rate + chance).cast("int")


def word_weights(docs: DataFrame, known: DataFrame, domains: list, c: MixConfig) -> list[np.ndarray]:
    """Log odds of hashed words, each domain against the first one, from a bounded sample of labelled rows (d, domain)."""
    sample = F.broadcast(known.orderBy(F.xxhash64("d"), "d", "domain").limit(c.max_labelled))  # at most max_labelled rows
    words = docs.join(sample, F.col("doc_id") == F.col("d")).select("domain", F.explode(_words(F.coalesce("text", F.lit("")))).alias("w"))
    rows = words.groupBy("domain", _bucket(F.col("w"), c.buckets).alias("b")).agg(F.count("*").alias("n")).collect()  # domains x buckets rows at most
    n = np.zeros((len(domains), c.buckets))
    for r in rows:
        n[domains.index(r["domain"]), r["b"]] = r["n"]
    share = (n.sum(0) + 1) / (n.sum() + c.buckets)
    logs = np.log((n + c.smoothing * share) / (n.sum(1, keepdims=True) + c.smoothing))
    return [logs[k] - logs[0] for k in range(1, len(domains))]


def fit(docs: DataFrame, labels: DataFrame, config: MixConfig | None = None) -> tuple[Mix, DataFrame]:
    """The mixture for docs (doc_id, text) and its table: all columns of docs, n_tokens, bins and p, the array of posteriors.

    labels has doc_id and the domain column; rows with nulls or values without a target are not learnt from. Without
    labelled rows posteriors are the targets themselves. Null texts have no tokens. Targets that no rates meet are
    fitted as near as least squares allow, which the mixture's totals show. A text is measured once; a very long
    one is one row's array of words in memory. docs' other columns must not be called n_tokens, bins or p.
    """
    c = config or MixConfig()
    scratch = Scratch(docs.sparkSession, "mix")
    domains = sorted(c.targets, key=str)
    known = labels.where(F.col(c.domain).isin(domains) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("d"), F.col(c.domain).alias("domain")).distinct()
    known = known.withColumn("half", F.pmod(F.xxhash64("d", F.lit(c.seed)), F.lit(2)))
    weights = word_weights(docs, known.where("half = 0"), domains, c)
    names = [F.col(f"`{x}`") for x in docs.columns]
    measured = docs.select(*names, measures(F.col("text"), weights).alias("m"))
    base = scratch.keep(measured.select(*names, F.col("m.of.words").cast("long").alias("n_tokens"), _bins(F.col("m"), c.bins, len(weights)).alias("bins")), "measures")
    features = SHAPES + len(weights)
    rows = base.join(known.where("half = 1"), F.col("doc_id") == F.col("d")).select("domain", F.posexplode("bins").alias("feature", "bin")).groupBy("domain", "feature", "bin").agg(F.count("*").alias("n")).collect()
    n = np.zeros((len(domains), features, c.bins))  # domains x features x bins rows at most
    for r in rows:
        n[domains.index(r["domain"]), r["feature"], r["bin"]] = r["n"]
    size = n[:, 0].sum(1)
    share = np.array([c.targets[k] for k in domains], float)
    share /= share.sum()
    prior = np.log((size + 1) / (size.sum() + len(domains))) if size.sum() else np.log(np.maximum(share, 1e-9))
    mix = Mix(c, domains, np.log((n + 0.5) / (n.sum(2, keepdims=True) + 0.5 * c.bins)), prior)
    # rates depend on bins alone, and there are few different ones: steps go over bins with their tokens
    kinds = base.groupBy("bins").agg(F.sum("n_tokens").alias("n_tokens")).select("n_tokens", F.array(*mix.posterior(F.col("bins"))).alias("p"))
    _solve(mix, scratch.keep(kinds, "kinds", of=(base,)), share)
    return mix, base.withColumn("p", F.array(*mix.posterior(F.col("bins"))))


def _solve(mix: Mix, rows: DataFrame, share: np.ndarray) -> None:
    """The least-squares rates of rows (n_tokens, p), as one projected gradient step from equal rates.

    Rates r minimise |e - t|^2 / 2 + d / 2 * sum(n * (r - 1)^2) for expected totals e, targets t and n tokens, all as
    parts of all tokens. Their optimum is its own projected gradient step of length 1 / d, r = max(0, 1 - p . m) with
    m = (e - t) / d: the gradient is that of the place where the step ends, so the step may be as long as it likes. The
    few numbers m are found by Newton's method; an iteration is one aggregation over all documents, which tries several
    step lengths at once. d shrinks until e is proved to be as near to t as any nonnegative rates can bring it: for any y
    with p . y >= 0 in every row, no rates come nearer than sqrt(-|y|^2 - 2 t . y), and y is e - t, lifted until that holds.
    """
    c, k = mix.config, len(share)
    p = [F.get("p", F.lit(i)) for i in range(k)]
    n = F.col("n_tokens").cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    first = rows.agg(*[F.sum(n * x).alias(f"e{i}") for i, x in enumerate(p)]).first()
    equal = np.array([first[f"e{i}"] or 0.0 for i in range(k)])
    if equal.sum() <= 0:
        return
    total = c.tokens if c.tokens is not None else float(np.min(np.where(share > 0, np.where(equal > 0, equal, np.inf) / np.maximum(share, 1e-12), np.inf)))
    total = total if math.isfinite(total) else float(equal.sum())
    every = float(equal.sum())
    target, near = share * total / every, c.tolerance * total / every
    n = n / every

    def tried(moves: list[np.ndarray], d: float) -> tuple:
        """Of the moves the one with the least dual value: it, its value, gradient, second derivatives and expected totals."""
        cells = []
        for x, m in enumerate(moves):
            r = mix.rate(p, m)
            cells += [F.sum(n * r * r).alias(f"v{x}"), *[F.sum(n * r * p[i]).alias(f"e{x}_{i}") for i in range(k)]]
            cells += [F.sum(F.when(r > 0, n * p[i] * p[j]).otherwise(0.0)).alias(f"g{x}_{i}_{j}") for i, j in pairs]
        row, out = rows.agg(*cells).first(), []
        for x, m in enumerate(moves):
            e = np.array([row[f"e{x}_{i}"] for i in range(k)])
            moment = np.array([[row[f"g{x}_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
            out.append((row[f"v{x}"] / 2 + target @ m + d / 2 * (m @ m), m, target - e + d * m, moment + d * np.eye(k), e))
        return min(out, key=lambda o: o[0])

    def proved(e: np.ndarray) -> bool:
        """Whether no rates come nearer to the targets by more than the tolerance."""
        miss = e - target
        if np.linalg.norm(miss) <= near:
            return True
        least = rows.agg(F.min(sum((p[i] * float(miss[i]) for i in range(k)), F.lit(0.0))).alias("x")).first()["x"]
        y = miss + max(0.0, -least)
        return np.linalg.norm(miss) - math.sqrt(max(0.0, -(y @ y) - 2 * (target @ y))) <= near

    d, shrink, starts = 1e-2, 1e-2, [np.zeros(k)]
    while True:
        value, m, gradient, second, e = tried(starts, d)
        while np.abs(gradient).max() > near / 1000:
            step = np.linalg.solve(second, gradient)
            better = tried([m - step / 2**j for j in range(12)], d)
            if not better[0] < value:
                break  # as near as double precision comes
            value, m, gradient, second, e = better
        if proved(e):
            break
        if d < 1e-15:
            raise RuntimeError(f"rates did not converge: expected shares {e.tolist()} for targets {target.tolist()}")
        starts, d = [m, m / shrink], d * shrink
    mix.moves = [m] if m.any() else []
    mix.totals = {"target": dict(zip(mix.domains, (target * every).tolist(), strict=True)), "expected": dict(zip(mix.domains, (e * every).tolist(), strict=True))}


def mixed(docs: DataFrame, labels: DataFrame, config: MixConfig | None = None) -> DataFrame:
    """docs with each row as often as its rate asks for (0, 1 or more times); all columns as they were, whatever their names.

    Copies are decided by a hash of doc_id: rows that repeat an id are decided alike, all kept or all dropped, so a
    domain's total misses its target by up to such a group's tokens; a null doc_id is an id like others; an empty table
    gives no rows.
    """
    rows, unpacked = packed(docs)
    mix, base = fit(rows, labels, config)
    rate = mix.rate([F.get("p", F.lit(i)) for i in range(len(mix.domains))])
    kept = base.withColumn("copies", mix.copies(rate, F.col("doc_id"))).where("copies > 0")
    return unpacked(kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def rates(docs: DataFrame, labels: DataFrame, config: MixConfig | None = None) -> DataFrame:
    """(doc_id, n_tokens, p, rate, copies) for each row of docs."""
    mix, rows = fit(docs.select("doc_id", "text"), labels, config)
    rate = mix.rate([F.get("p", F.lit(i)) for i in range(len(mix.domains))])
    return rows.withColumn("rate", rate).withColumn("copies", mix.copies(F.col("rate"), F.col("doc_id"))).drop("bins", "text")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_tokens", F.round(F.get("p", F.lit(0)), 6).alias("p_low"), F.round(F.get("p", F.lit(1)), 6).alias("p_good"), F.round("rate", 6).alias("rate"), "copies")
