"""Rules: text predicates compiled to Columns, reports, sets, weighted voting, waterfalls."""

from __future__ import annotations

import functools
import json
import operator
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions


class RuleNotAppliedError(RuntimeError):
    """A result was asked for before the rule was applied."""


class Logic(Enum):
    AND = "and"
    OR = "or"


@dataclass
class Rule:
    """A boolean expression over columns, with ``&``, ``|``, ``^`` and ``~`` to combine."""

    expr: str
    name: str = ""
    weight: float = 1.0
    description: str = ""

    def __post_init__(self) -> None:
        expressions.parse(self.expr)
        self.name = self.name or self.expr

    @property
    def columns(self) -> list[str]:
        return expressions.columns_of(self.expr)

    @property
    def hit(self) -> Column:
        return expressions.predicate(self.expr)

    def predict(self, df: DataFrame, out: str = "hit") -> DataFrame:
        return df.withColumn(out, self.hit)

    def filter(self, df: DataFrame) -> DataFrame:
        return df.where(self.hit)

    def exclude(self, df: DataFrame) -> DataFrame:
        return df.where(~self.hit)

    def _join(self, other: Rule, op: str) -> Rule:
        return Rule(f"({self.expr}) {op} ({other.expr})")

    def __and__(self, other: Rule) -> Rule:
        return self._join(other, "and")

    def __or__(self, other: Rule) -> Rule:
        return self._join(other, "or")

    def __xor__(self, other: Rule) -> Rule:
        return self._join(other, "^")

    def __invert__(self) -> Rule:
        return Rule(f"not ({self.expr})")

    def simplified(self) -> Rule:
        return Rule(expressions.simplify(self.expr), self.name, self.weight, self.description)


def effect_columns(n: Column, bad: Column, total_n: Column, total_bad: Column, amount: bool = False) -> dict[str, Column]:
    """Shares, lift, improvement and rejection efficiency of a group that would be rejected."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    base, rate = ratio(total_bad, total_n), ratio(bad, n)
    rest = F.when(total_n > n, (total_bad - bad) / (total_n - n)).otherwise(0.0)
    improve = ratio(base - rest, base)
    share = ratio(n, total_n)
    return {
        "n_share": share, "good_share": ratio(n - bad, total_n - total_bad), "bad_share": ratio(bad, total_bad), "bad_rate": rate, "lift": ratio(rate, base), "bad_improve": improve,
        "risk_reject": share if amount else ratio(improve, share),
    }


def report(df: DataFrame, rules: list[Rule], label: str, by: list[str] | None = None, prior: Rule | None = None, amount: str | None = None, margins: bool = False) -> DataFrame:
    """(by..., rule, part, n, good, bad, ...): hit and miss rows of each rule, one scan for all rules.

    ``by`` may hold the ``label`` column of ``functions.labels.with_labels`` for
    many labels at once.  Rows that ``prior`` hits are taken out first.  An
    empty part has zeros.  A total row means no action: it improves nothing.
    """
    by = by or []
    rows = df.where(F.col(label).isNotNull())
    if prior is not None:
        rows = prior.exclude(rows)
    w = F.lit(1) if amount is None else F.col(amount).cast("double")
    measures = []
    for i, r in enumerate(rules):
        measures += [F.sum(F.when(r.hit, w).otherwise(0)).alias(f"n{i}"), F.sum(F.when(r.hit & (F.col(label) == 1), w).otherwise(0)).alias(f"b{i}")]
    wide = rows.groupBy(*by).agg(F.coalesce(F.sum(w), F.lit(0)).alias("tn"), F.coalesce(F.sum(F.when(F.col(label) == 1, w).otherwise(0)), F.lit(0)).alias("tb"), *measures)
    parts = []
    for i, r in enumerate(rules):
        n, b = F.coalesce(F.col(f"n{i}"), F.lit(0)), F.coalesce(F.col(f"b{i}"), F.lit(0))
        part = lambda name, x, y, r=r: F.struct(F.lit(r.name).alias("rule"), F.lit(name).alias("part"), x.alias("n"), y.alias("bad"))
        parts += [part("hit", n, b), part("miss", F.col("tn") - n, F.col("tb") - b)]
        if margins:
            parts.append(part("total", F.col("tn"), F.col("tb")))
    if not parts:
        parts = [F.struct(F.lit("").alias("rule"), F.lit("").alias("part"), F.lit(0).alias("n"), F.lit(0).alias("bad"))]
        wide = wide.limit(0)
    long = wide.select(*by, "tn", "tb", F.explode(F.array(*parts)).alias("p")).select(*by, "tn", "tb", "p.*")
    effects = effect_columns(F.col("n"), F.col("bad"), F.col("tn"), F.col("tb"), amount is not None)
    effects |= {c: F.when(F.col("part") == "total", 0.0).otherwise(effects[c]) for c in ("bad_improve", "risk_reject")}
    return long.select(*by, "rule", "part", "n", (F.col("n") - F.col("bad")).alias("good"), "bad", *[c.alias(k) for k, c in effects.items()])


def waterfall(df: DataFrame, rules: list[Rule], label: str, amount: str | None = None) -> DataFrame:
    """(position, rule, part, n, bad, bad_rate, lift, bad_improve): each rule sees only what earlier rules left.

    Rows: the original table, for each rule its hits and what remains, and all
    rules together.  One scan finds each row's first rule; the rest is a
    window over that small table.
    """
    first = F.coalesce(*[F.when(r.hit, i) for i, r in enumerate(rules)], F.lit(len(rules))) if rules else F.lit(0)
    w = F.lit(1) if amount is None else F.col(amount).cast("double")
    hits = df.where(F.col(label).isNotNull()).groupBy(first.alias("i")).agg(F.sum(w).alias("n"), F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("bad"))
    grid = df.sparkSession.createDataFrame([(i, r.name) for i, r in enumerate(rules)] + [(len(rules), None)], "i int, rule string")
    x = grid.join(F.broadcast(hits), "i", "left").na.fill(0, ["n", "bad"])
    order = Window.partitionBy(F.lit(0)).orderBy("i")
    every = Window.partitionBy(F.lit(0))
    x = x.select("i", "rule", "n", "bad", F.sum("n").over(every).alias("tn"), F.sum("bad").over(every).alias("tb"), F.sum("n").over(order).alias("cn"), F.sum("bad").over(order).alias("cb"))
    row = lambda position, rule, part, n, bad, of_n, of_bad: F.struct(*[c.alias(k) for c, k in zip((position, rule, F.lit(part), n, bad, of_n, of_bad), ("position", "rule", "part", "n", "bad", "of_n", "of_bad"))])
    i, n, bad, tn, tb, cn, cb = (F.col(c) for c in ("i", "n", "bad", "tn", "tb", "cn", "cb"))
    last = i == len(rules)
    rows = F.when(last, F.array(row(F.lit(0), F.lit("original"), "total", tn, tb, tn, tb), row(2 * i + 1, F.lit("all rules"), "hit", tn - n, tb - bad, tn, tb))).otherwise(
        F.array(row(2 * i + 1, F.col("rule"), "hit", n, bad, tn - cn + n, tb - cb + bad), row(2 * i + 2, F.concat(F.lit("remaining after "), F.col("rule")), "miss", tn - cn, tb - cb, tn - cn + n, tb - cb + bad))
    )
    out = x.select(F.explode(rows).alias("r")).select("r.*")
    e = effect_columns(F.col("n"), F.col("bad"), F.col("of_n"), F.col("of_bad"))
    return out.select("position", "rule", "part", "n", "bad", e["bad_rate"].alias("bad_rate"), e["lift"].alias("lift"), F.when(F.col("part") == "total", 0.0).otherwise(e["bad_improve"]).alias("bad_improve"))


@dataclass
class RuleSet:
    """Nested rules joined by AND or OR."""

    rules: list[Rule | RuleSet] = field(default_factory=list)
    logic: Logic = Logic.OR
    name: str = "rules"
    weight: float = 1.0

    @property
    def hit(self) -> Column:
        if not self.rules:
            return F.lit(False)
        return functools.reduce(operator.and_ if self.logic is Logic.AND else operator.or_, (r.hit for r in self.rules))

    def flat(self) -> list[Rule]:
        return [x for r in self.rules for x in (r.flat() if isinstance(r, RuleSet) else [r])]

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "logic": self.logic.value, "weight": self.weight, "rules": [json.loads(r.to_json()) if isinstance(r, RuleSet) else vars(r) for r in self.rules]})

    @classmethod
    def from_json(cls, text: str | dict) -> RuleSet:
        d = json.loads(text) if isinstance(text, str) else text
        return cls([cls.from_json(r) if "rules" in r else Rule(**r) for r in d["rules"]], Logic(d["logic"]), d["name"], d["weight"])


@dataclass
class RulesClassifier:
    """OR: weighted share of rules hit against a threshold; AND: all must hit."""

    rules: list[Rule]
    logic: Logic = Logic.OR
    threshold: float = 0.5

    @property
    def score(self) -> Column:
        if self.logic is Logic.AND:
            return functools.reduce(operator.and_, (r.hit for r in self.rules)).cast("double")
        total = sum(r.weight for r in self.rules)
        return functools.reduce(operator.add, (F.lit(r.weight) * r.hit.cast("double") for r in self.rules)) / F.lit(total or 1.0)

    @property
    def reasons(self) -> Column:
        return F.array_compact(F.array(*[F.when(r.hit, F.lit(r.name)) for r in self.rules]))

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"score": self.score, "prediction": (self.score >= (1.0 if self.logic is Logic.AND else self.threshold)).cast("int"), "reasons": self.reasons})

    def fit_weights(self, df: DataFrame, label: str) -> RulesClassifier:
        """Weights are the rules' lifts over one scan."""
        found = {r["rule"]: r["lift"] for r in report(df, self.rules, label).where("part = 'hit'").collect()}
        return RulesClassifier([Rule(r.expr, r.name, float(found[r.name]), r.description) for r in self.rules], self.logic, self.threshold)
