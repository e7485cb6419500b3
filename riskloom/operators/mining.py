"""Rule mining: single features, pairs of features, many labels, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binning import BinModel, fit_many
from .models import tree_rules
from .rules import Rule, effect_columns, report


def threshold_rules(models: dict[str, BinModel], precision: int = 10) -> list[Rule]:
    """``>=`` and ``<`` rules at every split, category rules, and a missing-value rule per feature."""
    out = []
    for f, m in models.items():
        if m.groups is not None:
            out += [Rule(f"{f} in {g!r}") for g in m.groups]
        else:
            out += [Rule(f"{f} {op} {s:.{precision}g}") for s in m.splits for op in (">=", "<")]
        out.append(Rule(f"{f}.isna()"))
    return out


def rule_quality(df: DataFrame, rules: list[Rule], label: str, by: list[str] | None = None, batch: int = 200) -> DataFrame:
    """(by..., rule, n, bad, support, precision, recall, f1, lift, ks) of the hit part of each rule; one scan per ``batch`` rules."""
    by, out = by or [], None
    for lo in range(0, max(len(rules), 1), batch):
        r = report(df, rules[lo : lo + batch], label, by).where("part = 'hit'")
        p, q = F.col("bad_rate"), F.col("bad_share")
        part = r.select(*by, "rule", "n", "bad", F.col("n_share").alias("support"), p.alias("precision"), q.alias("recall"), F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0).alias("f1"), "lift", F.abs(q - F.col("good_share")).alias("ks"))
        out = part if out is None else out.unionAll(part)
    return out


def mine_single(df: DataFrame, features: list[str], label: str, method: str = "mdlp", max_n_bins: int = 10, min_support: float = 0.01, min_lift: float = 1.1, top: int | None = None) -> DataFrame:
    """Threshold rules over every feature with enough support and lift, best lift first."""
    rules = threshold_rules(fit_many(df, features, label, method=method, max_n_bins=max_n_bins))
    found = rule_quality(df, rules, label).where((F.col("support") >= min_support) & (F.col("lift") >= min_lift)).orderBy(F.desc("lift"), "rule")
    return found if top is None else found.limit(top)


def cross_cells(df: DataFrame, a: BinModel, b: BinModel, label: str) -> DataFrame:
    """(bin_a, bin_b, n, bad, bad_rate, lift, ...) of the crossed bins of two features."""
    from pyspark.sql import Window

    cells = df.where(F.col(label).isNotNull()).groupBy(a.index().alias("bin_a"), b.index().alias("bin_b")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("bad"))
    every = Window.partitionBy(F.lit(0))
    cells = cells.select("*", F.sum("n").over(every).alias("tn"), F.sum("bad").over(every).alias("tb"))
    e = effect_columns(F.col("n"), F.col("bad"), F.col("tn"), F.col("tb"))
    return cells.select("bin_a", "bin_b", "n", "bad", *[e[k].alias(k) for k in ("n_share", "bad_rate", "lift", "bad_improve")])


def cross_matrix(df: DataFrame, a: BinModel, b: BinModel, label: str, value: str = "bad_rate") -> DataFrame:
    """Matrix with a row per bin of the first feature and a column per bin of the second."""
    bins = [*range(b.n_bins), -1, -2]
    return cross_cells(df, a, b, label).groupBy("bin_a").pivot("bin_b", bins).agg(F.max(value))


def _range(m: BinModel, i: int) -> str:
    if i == -1:
        return f"{m.feature}.isna()"
    if m.groups is not None:
        return f"{m.feature} in {m.groups[i]!r}"
    parts = ([f"{m.feature} >= {m.splits[i - 1]:.10g}"] if i else []) + ([f"{m.feature} < {m.splits[i]:.10g}"] if i < len(m.splits) else [])
    return " and ".join(parts) or f"{m.feature}.notna()"


def mine_pairs(df: DataFrame, pairs: list[tuple[str, str]], label: str, models: dict[str, BinModel], min_support: float = 0.01, min_lift: float = 1.2, top: int = 20) -> list[Rule]:
    """The crossed cells of highest lift as rules; weights are their lifts."""
    found = []
    for f, g in pairs:
        for r in cross_cells(df, models[f], models[g], label).where((F.col("n_share") >= min_support) & (F.col("lift") >= min_lift) & (F.col("bin_a") >= -1) & (F.col("bin_b") >= -1)).collect():
            found.append((r["lift"], f"({_range(models[f], r['bin_a'])}) and ({_range(models[g], r['bin_b'])})"))
    return [Rule(text, weight=float(lift)) for lift, text in sorted(found, key=lambda x: (-x[0], x[1]))[:top]]


def effectiveness(df: DataFrame, rules: list[Rule], label_col: str, y: str, min_lift: float = 1.5) -> DataFrame:
    """(rule, labels, effective, mean_lift, least_lift) over the labels of a long table."""
    t = report(df, rules, y, [label_col]).where("part = 'hit'")
    return t.groupBy("rule").agg(F.count("*").alias("labels"), F.count_if(F.col("lift") >= min_lift).alias("effective"), F.avg("lift").alias("mean_lift"), F.min("lift").alias("least_lift"))


def mine_trees(df: DataFrame, features: list[str], label: str, kind: str = "tree", min_support: float = 0.01, min_lift: float = 1.1, **params) -> DataFrame:
    """Paths of a tree, forest or boosting model as rules, with their quality."""
    rules = [Rule(text) for text in tree_rules(df, features, label, kind, **params)]
    return rule_quality(df, rules, label).where((F.col("support") >= min_support) & (F.col("lift") >= min_lift)).orderBy(F.desc("lift"), "rule")


def merge_intervals(intervals: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
