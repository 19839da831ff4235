"""Mixing sources to target weights with soft domain membership (DataFrame functions only).

Domains come from the labelled table: ``toxic``, ``low`` (quality 0) and ``clean``.  A naive-Bayes
classifier over hashed words, fitted on a bounded sample of labelled rows, gives every document a
posterior over domains (weak odds count as none, and a text's log odds are bounded, so that long texts
keep soft posteriors).  Nonnegative rates r then minimise

    sum_k (sum_i r_i t_i p_ik - target_k B)^2 / (2 s_k B^2) + ridge / 2 * sum_i t_i (r_i - 1)^2 / B

by projected gradient: t_i are the tokens, s_k the larger of the domain's share before mixing and its target
(so that steps stay stable where a domain is nearly absent), B the token budget, which is such that
the first domain, ``clean``, need not lose documents (see ``HEADROOM``).
A round is one aggregate of one number for each domain.  Where these rounds end with shares off their
targets (rare domains need many, and the ridge holds their rates back), the same problem with the
shares as constraints is solved: its rates are max(0, 1 + w . p), with one weight w_k for each domain
from damped Newton steps, each one aggregate of ten numbers.  Shares that cannot be met are reported as
a warning with the largest error.  In the gradient's rounds, rates are recomputed from the residuals of
all rounds so far in a fold over that short list, so no state is kept for documents.  ``copies`` are
the rates rounded by a hash of the doc_id.

Edge cases: null text has no token and takes no part in the fit, its rate stays 1; null labels are not
learned from; labels of a doc_id that repeats take the worst; without labels posteriors are the
prior; repeated rows are separate rows; an empty table gives an empty result; extra columns of
the input are not used and do not clash with the output's.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrack.llm.exprs import SPACE
from kinetrack.llm.storage import written

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.9, "low": 0.06, "toxic": 0.04}
#: Parameters: hash buckets of words, labelled texts of the sample, log odds that count, bound of a text's log odds.
BUCKETS, SAMPLE, LEAST, BOUND = 1 << 15, 6000, 0.7, 8.0
#: Pseudo-count of a domain's words, and occurrences from which a bucket's odds count.
STRENGTH, SEEN = 200.0, 5
#: The budget is this many times what makes the clean domain's mean rate 1.
HEADROOM = 1.03
#: Shares count as met within this part of their target.
NEAR = 0.005


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _exploded(rows: DataFrame, *keys: str) -> DataFrame:
    """A row for each word of each whole text, lower-cased; a text without words gives one null word."""
    word = F.explode_outer(F.split(F.lower(F.coalesce("text", F.lit(""))), SPACE))
    return rows.select(*keys, word.alias("word")).withColumn("word", F.nullif("word", F.lit("")))


def fit_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, list[float]]:
    """A table (bucket, log odds of each other domain against ``clean``), and the domains' log prior odds.

    The labelled sample is chosen by a hash of doc_id; the table has BUCKETS rows at most.
    """
    worst = F.when(F.max("toxic") == 1, "toxic").when(F.min("quality") == 0, "low").when(F.min("quality") == 1, "clean")
    own = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(worst.alias("domain")).where("domain IS NOT NULL")
    share = int(1_000_000 * min(1.0, sample / max(1, own.count())))
    own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    texts = written(docs.select("doc_id", "text").join(own, "doc_id").dropDuplicates(["text"]), "mixing-sample")
    each = _exploded(texts, "domain").where("word IS NOT NULL").withColumn("bucket", _bucket(F.col("word")))
    counts = each.groupBy("bucket").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"n_{d}") for d in DOMAINS])
    counts = written(counts, "mixing-buckets")
    total = counts.agg(*[F.coalesce(F.sum(f"n_{d}"), F.lit(0)).alias(d) for d in DOMAINS]).first()
    # shrunk towards the clean domain, so that a domain without words has no odds; few words are no evidence
    overall = sum((F.col(f"n_{d}") for d in DOMAINS), F.lit(0)) / max(1, sum(total))
    base = (F.col(f"n_{DOMAINS[0]}") + STRENGTH * overall) / (total[DOMAINS[0]] + STRENGTH)
    odds = {d: F.log((F.col(f"n_{d}") + STRENGTH * base) / (total[d] + STRENGTH) / base) for d in DOMAINS[1:]}
    seen = {d: F.when(x > 0, F.col(f"n_{d}")).otherwise(F.col(f"n_{DOMAINS[0]}")) >= SEEN for d, x in odds.items()}
    table = counts.select("bucket", *[F.when((F.abs(x) >= LEAST) & seen[d], x).otherwise(0.0).alias(d) for d, x in odds.items()])
    number = {r[0]: r[1] for r in texts.groupBy("domain").count().collect()}
    return table, [math.log((number.get(d, 0) + 1) / (number.get("clean", 0) + 1)) for d in DOMAINS[1:]]


def posteriors(docs: DataFrame, odds: DataFrame, prior: list[float]) -> DataFrame:
    """doc_id, n_tokens, p (array over DOMAINS), a row for each row of ``docs``.

    Words are exploded and summed up again in the same task, so the shuffle has a row for each
    document; the odds (BUCKETS rows at most) are broadcast.
    """
    rows = _exploded(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "row", "doc_id")
    rows = rows.withColumn("bucket", _bucket(F.col("word"))).join(F.broadcast(odds), "bucket", "left")
    sums = rows.groupBy("row", "doc_id").agg(F.count("word").alias("n_tokens"), *[F.coalesce(F.sum(d), F.lit(0.0)).alias(d) for d in DOMAINS[1:]])
    scores = F.array(F.lit(0.0), *[F.lit(x) + BOUND * F.tanh(F.col(d) / BOUND) for d, x in zip(DOMAINS[1:], prior, strict=True)])
    weights = F.transform(scores, F.exp)
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return sums.select("doc_id", "n_tokens", F.transform(weights, lambda x: x / total).alias("p"))


def rate(p: Column, residuals: list[list[float]], ridge: float) -> Column:
    """The rate after the rounds whose (scaled) residuals are given; starts at 1."""
    if not residuals:
        return F.lit(1.0)
    step = 1.0 / (1.0 + ridge)
    steps = F.lit(residuals)
    dot = lambda e: sum((F.get(p, k) * F.get(e, k) for k in range(len(DOMAINS))), F.lit(0.0))
    return F.aggregate(steps, F.lit(1.0), lambda r, e: F.greatest(F.lit(0.0), r - step * (dot(e) + ridge * (r - 1))))


def constrained_rate(p: Column, weights: list[float]) -> Column:
    """The rate that moves least from 1 (by tokens) among those that meet the shares."""
    return F.greatest(F.lit(0.0), sum((F.get(p, k) * F.lit(float(w)) for k, w in enumerate(weights)), F.lit(1.0)))


def _constrained(table: DataFrame, goal: list[float], budget: float, rounds: int = 60) -> tuple[list[float], float]:
    """Weights of ``constrained_rate`` with the least error, and that error as a part of its target.

    They are the minimum of sum_i t_i max(0, 1 + w . p_i)^2 / (2 B) - w . goal, whose gradient is the error of the shares.
    """
    n, t = len(goal), F.col("n_tokens")
    pairs = [(a, b) for a in range(n) for b in range(a, n)]
    p = lambda k: F.get("p", k)

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        r = constrained_rate(F.col("p"), w.tolist())
        on = F.when(r > 0, t).otherwise(0)
        found = table.agg(F.sum(t * r * r), *[F.sum(t * r * p(k)) for k in range(n)], *[F.sum(on * p(a) * p(b)) for a, b in pairs]).first()
        x = np.array([v or 0.0 for v in found]) / budget
        curve = np.zeros((n, n))
        for (a, b), v in zip(pairs, x[1 + n :], strict=True):
            curve[a, b] = curve[b, a] = v
        return x[0] / 2 - float(w @ goal), x[1 : 1 + n] - goal, curve

    goal = np.array(goal)
    off = lambda e: float((np.abs(e) / np.maximum(goal, 1e-2)).max())
    w = np.zeros(n)
    value, error, curve = at(w)
    best, least, left = w, off(error), rounds
    while left > 0 and least > NEAR / 50:
        step = np.linalg.lstsq(curve + 1e-9 * np.eye(n), -error, rcond=None)[0]
        size = 1.0
        while left > 0:
            left -= 1
            new = at(w + size * step)
            if new[0] <= value + 1e-4 * size * float(error @ step):
                break
            size /= 2
        else:
            break
        w, (value, error, curve) = w + size * step, new
        if off(error) < least:
            best, least = w, off(error)
    return best.tolist(), least


def fit_rates(table: DataFrame, targets: dict[str, float], rounds: int = 25, ridge: float = 1e-3, tolerance: float = 1e-4) -> tuple[list[list[float]], list[float] | None]:
    """Residuals of each gradient round, and the weights of ``constrained_rate`` where these rounds do not meet the shares."""
    weight = sum(targets.values())
    sums = lambda r: [F.sum(r * F.col("n_tokens") * F.get("p", k)).alias(d) for k, d in enumerate(DOMAINS)]
    start = table.agg(*sums(F.lit(1.0))).first()
    tokens = sum(x or 0.0 for x in start)
    if not tokens:
        return [], None
    first = targets.get(DOMAINS[0], 0.0) / weight
    budget = HEADROOM * start[0] / first if first > 0 and start[0] else tokens
    shares = [max(x / budget, targets.get(d, 0.0) / weight, 1e-3) for x, d in zip(start, DOMAINS, strict=True)]
    goal = [targets.get(d, 0.0) / weight for d in DOMAINS]
    off = lambda e: max(abs(x) / max(g, 1e-2) for x, g in zip(e, goal, strict=True))
    residuals: list[list[float]] = []
    for k in range(rounds + 1):
        now = table.agg(*sums(rate(F.col("p"), residuals, ridge))).first() if residuals else start
        error = [x / budget - targets.get(d, 0.0) / weight for x, d in zip(now, DOMAINS, strict=True)]
        still = residuals and max(abs(e / s - r) * s for e, s, r in zip(error, shares, residuals[-1], strict=True)) < tolerance / 10
        if max(map(abs, error)) < tolerance or still or k == rounds:
            break
        residuals.append([e / s for e, s in zip(error, shares, strict=True)])
    if off(error) <= NEAR:
        return residuals, None
    weights, least = _constrained(table, goal, budget)
    if least > NEAR:
        warnings.warn(f"mixing: shares are off their targets by up to {min(least, off(error)):.3g} of a target", stacklevel=2)
    return residuals, weights if least < off(error) else None


def copies(rate_: Column, doc_id: Column) -> Column:
    """The rate rounded up or down by a hash, so that its expectation stays."""
    return F.floor(rate_ + F.pmod(F.xxhash64(doc_id, F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)).cast("long")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, sample: int = SAMPLE, rounds: int = 25) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate, copies: a row for each row of ``docs``."""
    table = written(posteriors(docs, *fit_classifier(docs, labels, sample)), "mixing")
    residuals, weights = fit_rates(table, targets or TARGETS, rounds)
    value = rate(F.col("p"), residuals, 1e-3) if weights is None else constrained_rate(F.col("p"), weights)
    value = F.when(F.col("n_tokens") > 0, value).otherwise(F.lit(1.0))
    return table.withColumn("rate", value).select(
        "doc_id", "n_tokens", *[F.get("p", k).alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"),
    )
