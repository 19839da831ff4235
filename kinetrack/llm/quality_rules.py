"""Weak supervision of document quality (DataFrame functions only).

Rules vote good (1), bad (0) or abstain (-1).  A naive-Bayes label model without labels is
fitted by expectation-maximisation: each round is one aggregate over the counts of distinct
vote patterns (at most 3 ** rules rows, whatever the number of documents), of which only the
sums of the votes' posteriors reach the driver.  A document is kept if the posterior
probability of good quality reaches the threshold; no single rule decides.

Edge cases: a null or empty text has no words, its rules vote bad or abstain; with no document
at all the prior stays as given; repeated doc_ids are separate rows, a null doc_id is one like any
other; extra columns pass through ``keep_good`` whatever their names (its own keys have names that
are new in each call), and ``quality_rules`` returns none of them; very long texts are one row each.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrack.llm.exprs import SPACE, SYMBOLS, let, words
from kinetrack.llm.storage import written

_FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_short", "n_marks", "n_alpha")


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))


def _repeat_words(w: Column) -> Column:
    """Words covered by a 3-word window that occurs twice or more in the text.

    Windows are compared through 64-bit hashes with their positions, sorted in the row.
    """
    n = F.size(w)

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            hit = F.filter(
                F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])),
                lambda i: i.isNotNull(),
            )
            return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, marked))

    hashes = F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n < 3, F.lit(0)).otherwise(let(hashes, covered))


def with_features(docs: DataFrame) -> DataFrame:
    """Adds a struct ``q_features`` of counts (long) over each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    solid = F.regexp_replace(text, SPACE, "")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n_words"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.length(x) <= 3)).alias("n_short"),
            F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).alias("n_alpha"),
        )

    parts = docs.withColumn("q_words", let(words(F.col("text")), of_words)).withColumn("q_lines", _dup_lines(text))
    values = {
        "n_words": F.col("q_words.n_words"),
        "word_chars": F.length(solid),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_dup_lines": F.col("q_lines.dup"),
        "n_repeat_words": F.col("q_words.n_repeat_words"),
        "n_lines": F.col("q_lines.n"),
        "n_upper": F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", "")),
        "n_letters": F.length(F.regexp_replace(text, r"[^\p{L}]", "")),
        "n_short": F.col("q_words.n_short"),
        "n_alpha": F.col("q_words.n_alpha"),
        "n_marks": F.length(text) - F.length(F.translate(text, "!?", "")),
    }
    return parts.withColumn("q_features", F.struct(*[values[k].cast("long").alias(k) for k in _FEATURES])).drop("q_words", "q_lines")


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1)).otherwise(F.lit(-1))


def default_rules() -> dict[str, Column]:
    """Name -> vote.  Between its two limits a rule abstains."""
    f = F.col("q_features")
    words_, chars = F.greatest(f["n_words"], F.lit(1)), F.greatest(f["word_chars"], F.lit(1))
    mean = f["word_chars"] / words_
    return {
        "length": _vote(f["n_words"] >= 80, f["n_words"] < 50),
        "word_length": _vote(mean.between(3.5, 8.0), (mean < 2.5) | (mean > 14.0)),
        "symbols": _vote(f["n_symbols"] <= 0.01 * chars, f["n_symbols"] > 0.04 * chars),
        "marks": _vote(f["n_marks"] <= 0.01 * chars, f["n_marks"] > 0.05 * chars),
        "dup_lines": _vote(f["n_dup_lines"] <= 0.1 * F.greatest(f["n_lines"], F.lit(1)), f["n_dup_lines"] > 0.3 * f["n_lines"]),
        "repeats": _vote(f["n_repeat_words"] <= 0.15 * words_, f["n_repeat_words"] > 0.4 * words_),
        "upper": _vote(f["n_upper"] <= 0.1 * chars, f["n_upper"] > 0.3 * chars),
        "letters": _vote(f["n_letters"] >= 0.85 * chars, f["n_letters"] < 0.65 * chars),
        "alpha_words": _vote(f["n_alpha"] >= 0.9 * words_, f["n_alpha"] < 0.8 * words_),
        "short_words": _vote(f["n_short"] >= 0.1 * words_, f["n_short"] < 0.02 * words_),
    }


@dataclass(frozen=True)
class LabelModel:
    """prior: share of good documents.  For each rule: P(vote good | good, voted), P(vote bad | bad, voted)."""

    prior: float
    accuracies: dict[str, tuple[float, float]]

    def logit(self, votes: dict[str, Column]) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for k, v in votes.items():
            g, b = self.accuracies[k]
            total = total + F.when(v == 1, F.lit(math.log(g / (1 - b)))).when(v == 0, F.lit(math.log((1 - g) / b))).otherwise(F.lit(0.0))
        return total

    def posterior(self, votes: dict[str, Column]) -> Column:
        return 1 / (1 + F.exp(-self.logit(votes)))


def fit_label_model(patterns: DataFrame, rules: list[str], rounds: int = 15, prior: float = 0.8, smoothing: float = 10.0) -> LabelModel:
    """EM over ``patterns`` (a vote column for each rule, and ``n``).

    Good documents pass nearly every rule, while each kind of bad one fails a few: rules start with
    0.99 right votes on good and 0.3 on bad documents, and the two must sum to more than one, so a
    rule cannot turn round and the two classes cannot change places.
    """
    model = LabelModel(prior, {k: (0.99, 0.3) for k in rules})
    for _ in range(rounds):
        p = F.col("p") * F.col("n")
        q = (1 - F.col("p")) * F.col("n")
        sums = [F.sum(p).alias("good"), F.sum("n").alias("all")]
        for k in rules:
            v = F.col(k)
            sums += [
                F.sum(F.when(v == 1, p).otherwise(0.0)).alias(f"{k}_gg"), F.sum(F.when(v >= 0, p).otherwise(0.0)).alias(f"{k}_g"),
                F.sum(F.when(v == 0, q).otherwise(0.0)).alias(f"{k}_bb"), F.sum(F.when(v >= 0, q).otherwise(0.0)).alias(f"{k}_b"),
            ]
        s = patterns.withColumn("p", model.posterior({k: F.col(k) for k in rules})).agg(*sums).first()
        if not s["all"]:
            return model
        clip = lambda x, lo, hi: min(hi, max(lo, x))
        accuracies = {}
        for k in rules:
            good = clip((s[f"{k}_gg"] + 0.99 * smoothing) / (s[f"{k}_g"] + smoothing), 0.6, 0.9995)
            bad = clip((s[f"{k}_bb"] + 0.3 * smoothing) / (s[f"{k}_b"] + smoothing), 0.05, 0.99)
            accuracies[k] = (good, max(bad, 1.02 - good))
        new = LabelModel(clip(s["good"] / s["all"], 0.05, 0.99), accuracies)
        moved = max(abs(a - b) for k in rules for a, b in zip(new.accuracies[k], model.accuracies[k], strict=True))
        settled = max(moved, abs(new.prior - model.prior)) < 1e-4
        model = new
        if settled:
            break
    return model


def _found(model: LabelModel, votes: dict[str, Column], threshold: float) -> Column:
    f, quality = F.col("q_features"), model.posterior(votes)
    return F.struct(
        *[f[k].alias(k) for k in _FEATURES], base_failed(f).alias("base_failed"), (~base_failed(f) & (quality >= threshold)).alias("kept"),
        quality.alias("quality"), *[v.alias(f"vote_{k}") for k, v in votes.items()],
    )


def _patterns(rows: DataFrame, votes: dict[str, Column]) -> DataFrame:
    return written(rows.groupBy(*[v.alias(k) for k, v in votes.items()]).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "patterns")


def _judged(docs: DataFrame, keys: list[str], rules: dict[str, Column] | None, threshold: float, rounds: int) -> DataFrame:
    """``keys`` of each row with a struct ``q_rules``.

    Features are written once to the shared folder (a narrow table, without texts), as the label
    model needs a pass before the documents can be judged.
    """
    rules = rules or default_rules()
    rows = with_features(docs).select(*keys, "q_features").withColumns({f"q_vote_{k}": v for k, v in rules.items()})
    rows = written(rows, "quality")
    votes = {k: F.col(f"q_vote_{k}") for k in rules}
    model = fit_label_model(_patterns(rows, votes), list(rules), rounds)
    return rows.select(*keys, _found(model, votes, threshold).alias("q_rules"))


def quality_rules(docs: DataFrame, rules: dict[str, Column] | None = None, threshold: float = 0.5, rounds: int = 15) -> DataFrame:
    """doc_id, features, ``base_failed``, ``kept``, ``quality`` (posterior) and votes, a row for each row of ``docs``."""
    return _judged(docs, ["doc_id"], rules, threshold, rounds).select("doc_id", "q_rules.*")


def keep_good(docs: DataFrame, rules: dict[str, Column] | None = None, threshold: float = 0.5, rounds: int = 15) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    Rows meet their verdict by doc_id and a hash of the text, so that rows with equal doc_id stay apart.
    """
    own = uuid.uuid4().hex
    keys = {f"id_{own}": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), f"text_{own}": F.xxhash64("text")}
    judged = _judged(docs.select("doc_id", "text").withColumns(keys), list(keys), rules, threshold, rounds)
    kept = judged.where("q_rules.kept").select(*keys).distinct()
    return docs.withColumns(keys).join(kept, list(keys), "left_semi").drop(*keys)
