"""Quality classifier: a sparse ensemble of rules over text statistics.

Small regression trees are grown on a bounded sample of labelled rows. Every path from a root to a node is a rule,
a conjunction of comparisons; lasso logistic regression gives most rules weight zero. The rest compile into one Spark
expression, so scoring is a projection that Spark generates code for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import documents_of, saved, text_or_empty

SAMPLE = 20_000  # labelled rows that the rules are learned from, at most
TREES = 24
DEPTH = 3
LEAST = 8  # rows in a node
CANDIDATES = 24  # thresholds tried for each statistic
PENALTY = 0.002
STEPS = 400

# Signs that prose uses rarely, and those that it uses.
_SIGNS = "!%$&*#|<>{}[]=+~^_\\@"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text as Spark expressions; all are 0 for an empty one."""
    n = F.length(text)
    words = F.split(text, "[ \\n]")
    count = F.size(words)
    share = lambda amount: F.when(n > 0, amount / n).otherwise(F.lit(0.0))
    of_words = lambda amount: F.when(n > 0, amount / count).otherwise(F.lit(0.0))
    without = lambda signs: n - F.length(F.translate(text, signs, ""))
    again = F.size(F.filter(F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(count, F.lit(1))).alias("b")), lambda x: x["a"] == x["b"]))
    return {
        "log_chars": F.log1p(n.cast("double")),
        "sign_share": share(without(_SIGNS)),
        "upper_share": share(without(_UPPER)),
        "digit_share": share(without("0123456789")),
        "stop_share": share(without(".,;:")),
        "break_share": share(without("\n")),
        "word_chars": of_words(n.cast("double")),
        "distinct_words": of_words(F.size(F.array_distinct(words)).cast("double")),
        "repeated_next": of_words(again.cast("double")),
    }


STATISTICS = (
    "log_chars", "sign_share", "upper_share", "digit_share", "stop_share", "break_share", "word_chars", "distinct_words", "repeated_next",
)


@dataclass
class RuleModel:
    """Weighted rules; a rule is a tuple of (statistic number, above, threshold)."""

    bias: float
    rules: list[tuple[tuple[int, bool, float], ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self, values: dict[str, Column] | None = None) -> Column:
        """The score between 0 and 1 as an expression over the statistics: given ones, or columns of their names."""
        values = {name: F.col(name) for name in STATISTICS} if values is None else values
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            test = F.lit(True)
            for number, above, threshold in rule:
                value = values[STATISTICS[number]]
                test = test & (value > threshold if above else value <= threshold)
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, weight in zip(self.rules, self.weights):
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))


def holds(rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for number, above, threshold in rule:
        out &= x[:, number] > threshold if above else x[:, number] <= threshold
    return out


def _split(x: np.ndarray, y: np.ndarray, numbers: np.ndarray):
    """The comparison that lowers the squared error most, or None."""
    best, choice = 1e-9, None
    base = y.sum() ** 2 / len(y)
    for number in numbers:
        values = x[:, number]
        order = np.argsort(values, kind="stable")
        v, sums = values[order], np.cumsum(y[order])
        # Cut between distinct values only, at about evenly spread ranks.
        cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
        cuts = cuts[(cuts >= LEAST) & (cuts <= len(v) - LEAST)]
        if len(cuts) > CANDIDATES:
            cuts = cuts[np.linspace(0, len(cuts) - 1, CANDIDATES).astype(int)]
        if not len(cuts):
            continue
        left = sums[cuts - 1]
        gain = left**2 / cuts + (sums[-1] - left) ** 2 / (len(v) - cuts) - base
        at = int(np.argmax(gain))
        if gain[at] > best:
            cut = cuts[at]
            best, choice = gain[at], (int(number), float((v[cut - 1] + v[cut]) / 2))
    return choice


def _grow(x, y, rows, path, depth, rng, out) -> None:
    """Collect the path to each node below the root."""
    if path:
        out.append(tuple(path))
    if depth == 0 or len(rows) < 2 * LEAST:
        return
    numbers = rng.permutation(x.shape[1])[: max(2, 2 * x.shape[1] // 3)]
    choice = _split(x[rows], y[rows], numbers)
    if choice is None:
        return
    number, threshold = choice
    above = x[rows, number] > threshold
    _grow(x, y, rows[~above], [*path, (number, False, threshold)], depth - 1, rng, out)
    _grow(x, y, rows[above], [*path, (number, True, threshold)], depth - 1, rng, out)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> RuleModel:
    """Rules from boosted trees on half samples, then lasso logistic weights by accelerated proximal steps."""
    if not len(y):
        return RuleModel(bias=20.0)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(prior / (1 - prior)))
    if y.min() == y.max():
        return RuleModel(bias=bias)
    rng, total, found = np.random.default_rng(seed), np.full(len(y), bias), {}
    for _ in range(TREES):
        rows = rng.permutation(len(y))[: max(2 * LEAST, len(y) // 2)]
        rest = y - 1 / (1 + np.exp(-total))
        paths: list = []
        _grow(x, rest, rows, [], DEPTH, rng, paths)
        for rule in paths:
            found.setdefault(rule, None)
        # The tree's leaves move the residuals on.
        for rule in paths:
            if not any(other[: len(rule)] == rule and len(other) > len(rule) for other in paths):
                where = holds(rule, x)
                if where.any():
                    total[where] += 0.5 * np.clip(4 * rest[where].mean(), -4, 4)
    rules = list(found)
    if not rules:
        return RuleModel(bias=bias)
    a = np.stack([holds(r, x) for r in rules], 1).astype(float)
    spread = np.maximum(a.std(0), 0.02)
    a /= spread
    step = 4 * len(y) / (np.linalg.norm(np.c_[np.ones(len(y)), a], 2) ** 2)
    w = np.zeros(len(rules))
    b, w_at, b_at, t = bias, w.copy(), bias, 1.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(a @ w_at + b_at))) - y
        new = w_at - step * (a.T @ error) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        new_b = b_at - step * error.mean()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w_at, b_at = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    kept = np.flatnonzero(w)
    return RuleModel(float(b), [rules[i] for i in kept], [float(w[i] / spread[i]) for i in kept])


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = documents_of(docs, id_col, text_col)
    made = statistics(F.col("text"))
    return rows.select("doc_id", *[made[name].cast("double").alias(name) for name in STATISTICS])


def _sample(labels: DataFrame, usable: Column, label_col: str, sample: int) -> DataFrame:
    """doc_id and y of usable labels; where there are many, about `sample` of them by a hash of the id."""
    given = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("double").alias("y"))
    given = given.where(F.col("y").isin(0.0, 1.0) & usable).where(F.col("doc_id").isNotNull())
    share = min(1.0, 1.2 * sample / max(given.count(), 1))
    return given.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) <= int(share * (1 << 20)))


def learn(measured: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", sample: int = SAMPLE) -> RuleModel:
    """A model from at most `sample` labelled rows, chosen by a hash of the id; labels that are not usable are never read."""
    given = _sample(labels, usable, label_col, sample)
    rows = measured.join(given, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y", *STATISTICS).limit(sample).select("y", *STATISTICS).collect()
    data = np.array([tuple(r) for r in rows], float).reshape(len(rows), 1 + len(STATISTICS))
    return fit(data[:, 1:], data[:, 0])


def score_quality(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """One row per input row: doc_id and score, higher where label 1 is likelier.

    `labels` holds doc_id and the label column (0 or 1; other values and nulls are left out); `usable` is a condition
    on doc_id that a label must meet to be learned from, all by default. Null texts count as empty and are scored like any
    other; null ids and repeated rows stay. Without any label every score is 1 to nine digits, with labels of one
    class the score is their smoothed share. Only statistics of the text enter a score.
    """
    measured = saved(with_statistics(docs, id_col, text_col), "statistics")
    model = learn(measured, labels, F.lit(True) if usable is None else usable, label_col)
    return measured.select("doc_id", model.column().alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of `docs`, with all their columns, whose score is `threshold` or more.

    Learned from all usable labels as in score_quality; with none, every row stays. Statistics are taken once of each
    text, and beforehand of the sampled labelled ones.
    """
    wanted = _sample(labels, F.lit(True), label_col, SAMPLE).select("doc_id").distinct()
    sampled = documents_of(docs, id_col, text_col).join(wanted, "doc_id", "left_semi")
    model = learn(with_statistics(sampled), labels, F.lit(True), label_col)
    made = statistics(text_or_empty(docs[text_col]))
    # A variable of a lambda is computed once, where columns would be computed again for every rule.
    given = F.array(F.struct(*[made[name].cast("double").alias(name) for name in STATISTICS]))
    return docs.where(F.element_at(F.transform(given, lambda s: model.column({name: s[name] for name in STATISTICS})), 1) >= threshold)
