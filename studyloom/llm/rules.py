"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are boosted on a bounded sample of labelled rows. Every path of
every tree, from the root to any node, is a rule: a conjunction of bounds on
statistics. A lasso logistic regression keeps few of them, and the kept rules
are compiled into one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.llm.storage import with_columns
from studyloom.llm.text_stats import add_stats

#: Labelled rows that fitting takes at most: those with the least hash of their id.
SAMPLE = 20_000
TREES = 24
TREE_DEPTH = 3
LEAF_ROWS = 5
SHRINK = 0.3
#: Cut points tried for each statistic.
CUTS = 64
#: Lasso strengths tried, as shares of the least one that keeps no rule.
STRENGTHS = (0.3, 0.1, 0.03, 0.01, 0.003)

STATISTICS = ("word_length", "longest_word", "symbol_rate", "upper_rate", "digit_rate", "mark_rate", "repeat_rate", "duplicate_rate", "unique_rate", "line_length")


def statistics(s: str = "stats") -> dict[str, Column]:
    """STATISTICS of a text; 0 where there is nothing to divide by."""
    f = lambda name: F.col(f"{s}.{name}").cast("double")
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    made = (
        rate(f("word_chars"), f("n_words")), f("longest_word"), rate(f("n_symbols"), f("n_words")), rate(f("n_upper"), f("n_upper") + f("n_lower")),
        rate(f("n_digits"), f("word_chars")), rate(f("n_marks"), f("n_words")), rate(f("n_repeat_words"), f("n_words")),
        rate(f("n_dup_lines"), f("n_lines")), rate(f("n_unique"), f("n_words")), rate(f("n_words"), f("n_lines")),
    )
    return dict(zip(STATISTICS, made))


Rule = tuple[tuple[str, bool, float], ...]  # (statistic, over, bound): over is value > bound, else value <= bound


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, s: str = "stats") -> Column:
        """Probability of label 1, as a column expression over the statistics."""
        made = statistics(s)
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            held = F.lit(True)
            for name, over, bound in rule:
                held = held & ((made[name] > bound) if over else (made[name] <= bound))
            total = total + F.when(held, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, rule: Rule, out: list, step: np.ndarray) -> None:
    """Grow one tree on gradients; append (rule) for each node and add leaf values to ``step``."""
    value = grad[rows].sum() / (hess[rows].sum() + 1.0)
    best = None
    if depth < TREE_DEPTH and len(rows) >= 2 * LEAF_ROWS:
        parent = grad[rows].sum() ** 2 / (hess[rows].sum() + 1.0)
        for j in range(x.shape[1]):
            m = len(cuts[j])
            if not m:
                continue
            g = np.bincount(bins[rows, j], grad[rows], m + 1).cumsum()
            h = np.bincount(bins[rows, j], hess[rows], m + 1).cumsum()
            c = np.bincount(bins[rows, j], minlength=m + 1).cumsum()
            gain = g[:-1] ** 2 / (h[:-1] + 1.0) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1.0) - parent
            gain[(c[:-1] < LEAF_ROWS) | (c[-1] - c[:-1] < LEAF_ROWS)] = -1
            k = int(gain.argmax())
            if gain[k] > 1e-6 and (best is None or gain[k] > best[0] + 1e-12):
                best = (gain[k], j, k)
    if best is None:
        step[rows] = value
        return
    _, j, k = best
    low = bins[rows, j] <= k
    for over, part in ((False, rows[low]), (True, rows[~low])):
        longer = (*rule, (STATISTICS[j], over, float(cuts[j][k])))
        out.append(longer)
        _grow(x, bins, cuts, grad, hess, part, depth + 1, longer, out, step)


def _simple(rule: Rule) -> Rule:
    """One bound of each direction for a statistic, the tightest."""
    kept: dict[tuple[str, bool], float] = {}
    for name, over, bound in rule:
        old = kept.get((name, over))
        kept[name, over] = bound if old is None else max(old, bound) if over else min(old, bound)
    return tuple(sorted((n, o, b) for (n, o), b in kept.items()))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, over, bound in rule:
        v = x[:, STATISTICS.index(name)]
        out &= (v > bound) if over else (v <= bound)
    return out


def _lasso(r: np.ndarray, y: np.ndarray, strength: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for the mean logistic loss and an L1 penalty."""
    n, m = r.shape
    a = np.c_[np.ones(n), r]
    step = 4.0 / max(np.linalg.norm(a, 2) ** 2 / n, 1e-9)
    w = z = np.zeros(m + 1)
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -30, 30)))
        new = z - step * (a.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * strength, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Ensemble of rows of STATISTICS and labels 0 or 1. Without rows, or with one
    label only, it has no rules and the smoothed share of label 1 as its score."""
    base = (y.sum() + 0.5) / (len(y) + 1.0)
    bias = float(np.log(base / (1 - base)))
    if len(y) < 2 * LEAF_ROWS or y.min() == y.max():
        return Ensemble(bias, ())
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 1)[1:-1])) for j in range(x.shape[1])]
    # midway between neighbouring values, so that a bound is no row's own value
    cuts = [np.array([(c + v[np.searchsorted(v, c, "right")]) / 2 for c in cut if c < v[-1]]) for cut, v in ((cut, np.unique(x[:, j])) for j, cut in enumerate(cuts))]
    bins = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(x.shape[1])], axis=1)
    raw = np.full(len(y), bias)
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        nodes: list[Rule] = []
        step = np.zeros(len(y))
        _grow(x, bins, cuts, y - p, p * (1 - p), np.arange(len(y)), 0, (), nodes, step)
        raw = np.clip(raw + SHRINK * step, -8, 8)
        found.update(dict.fromkeys(map(_simple, nodes)))
    table, columns, rules = set(), [], []
    for rule in sorted(found, key=lambda r: (len(r), r)):
        column = holds(rule, x)
        mark = column.tobytes()
        if column.all() or not column.any() or mark in table or (~column).tobytes() in table:
            continue
        table.add(mark)
        columns.append(column)
        rules.append(rule)
    if not rules:
        return Ensemble(bias, ())
    r = np.stack(columns, axis=1).astype(np.float64)
    test = np.arange(len(y)) % 4 == 3
    top = np.abs((r - r.mean(0)).T @ (y - y.mean())).max() / len(y)
    losses = []
    for s in STRENGTHS:
        b, w = _lasso(r[~test], y[~test], s * top)
        p = np.clip(1 / (1 + np.exp(-np.clip(b + r[test] @ w, -30, 30))), 1e-6, 1 - 1e-6)
        losses.append(-np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)))
    b, w = _lasso(r, y, STRENGTHS[int(np.argmin(losses))] * top)
    return Ensemble(b, tuple((rule, float(v)) for rule, v in zip(rules, w) if abs(v) > 1e-4))


def fit_quality(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Ensemble:
    """Ensemble of the labelled documents for which ``may_learn`` holds, at most
    ``sample`` of them. Labels other than 0 and 1 and null ids don't count; of
    contradicting labels the greater share wins, of equal shares label 1."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.round(F.avg("quality")).cast("int").alias("_y"))
    picked = marks.where(may_learn).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(id_col, text).join(F.broadcast(picked), id_col)  # at most ``sample`` small rows
    made = add_stats(rows, text).select(F.col(id_col).alias("_k"), *[v.alias(k) for k, v in statistics().items()], "_y")
    got = made.dropDuplicates(["_k"]).orderBy("_k").toPandas()
    return fit_rules(got[list(STATISTICS)].to_numpy(np.float64), got["_y"].to_numpy(np.float64))


def score_quality(docs: DataFrame, model: Ensemble, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with score (0 to 1) and predicted (1 from 0.5 on).

    Null text counts as empty and is scored like any text; repeated rows stay
    repeated; an empty table gives an empty table; columns of ``docs`` named
    stats, score or predicted are replaced. Labels and other columns of ``docs``
    are never looked at."""
    rated = with_columns(add_stats(docs, text), {"score": model.score()})
    return with_columns(rated, {"predicted": (F.col("score") >= 0.5).cast("int")}).drop("stats")
