"""Pieces of oracle SQL (DuckDB dialect)."""

from __future__ import annotations

DIGITS = 6


def r(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), {DIGITS}) + 0.0 AS {name}"


def bin_of(x: str, splits: list[float] | None = None, edges: str | None = None, special: list[float] | None = None) -> str:
    """Bin number of ``x`` by literal splits or by a list column of edges."""
    count = " + ".join(f"CASE WHEN {x} >= {float(s)!r} THEN 1 ELSE 0 END" for s in splits) if splits else f"len(list_filter({edges}, lambda e: e <= {x}))" if edges else "0"
    codes = f"WHEN {x} IN ({', '.join(map(repr, map(float, special)))}) THEN -2 " if special else ""
    return f"CAST(CASE WHEN {x} IS NULL THEN -1 {codes}ELSE {count} END AS INTEGER)"


def bin_table(source: str, by: list[str] | None = None, amount: bool = False, ctes: str = "") -> str:
    """The full bin table from a SELECT of (by..., bin, n, bad)."""
    keys = "".join(f"{b}, " for b in by or [])
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    count = lambda e: f"CAST({e} AS DOUBLE)" if amount else f"CAST({e} AS BIGINT)"
    reject = "sn" if amount else "CASE WHEN sn > 0 THEN im / sn ELSE 0 END"
    c_reject = "csn" if amount else "CASE WHEN csn > 0 THEN cim / csn ELSE 0 END"
    show = (lambda e, n: r(e, n)) if amount else (lambda e, n: f"{count(e)} AS {n}")
    return f"""
WITH {ctes + ', ' if ctes else ''}src AS ({source}),
g AS (SELECT *, n - bad AS good, CASE WHEN bin >= 0 THEN bin WHEN bin = -1 THEN 10000000 ELSE 20000000 END AS k FROM src),
w AS (SELECT *, sum(n) OVER ({part}) AS tn, sum(bad) OVER ({part}) AS tb, sum(good) OVER ({part}) AS tg,
  sum(n) OVER o AS cn, sum(bad) OVER o AS cb, sum(good) OVER o AS cg,
  sum(CASE WHEN good = 0 THEN 1e-10 ELSE good END) OVER ({part}) AS ag, sum(CASE WHEN bad = 0 THEN 1e-10 ELSE bad END) OVER ({part}) AS ab
  FROM g WINDOW o AS ({part}ORDER BY k ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, CAST(n AS DOUBLE) / tn AS sn, CAST(cn AS DOUBLE) / tn AS csn, CAST(tb AS DOUBLE) / tn AS p,
  CASE WHEN n > 0 THEN CAST(bad AS DOUBLE) / n ELSE 0 END AS br, CASE WHEN cn > 0 THEN CAST(cb AS DOUBLE) / cn ELSE 0 END AS cbr,
  (CASE WHEN bad = 0 THEN 1e-10 ELSE bad END) / ab AS pb, (CASE WHEN good = 0 THEN 1e-10 ELSE good END) / ag AS pg,
  CASE WHEN tn > n THEN CAST(tb - bad AS DOUBLE) / (tn - n) ELSE 0 END AS rest, CASE WHEN tn > cn THEN CAST(tb - cb AS DOUBLE) / (tn - cn) ELSE 0 END AS crest FROM w),
f AS (SELECT *, CASE WHEN p > 0 THEN (p - rest) / p ELSE 0 END AS im, CASE WHEN p > 0 THEN (p - crest) / p ELSE 0 END AS cim,
  CASE WHEN tb > 0 AND tg > 0 THEN ln(pb / pg) ELSE 0 END AS wo, CASE WHEN tb > 0 AND tg > 0 THEN (pb - pg) * ln(pb / pg) ELSE 0 END AS ivb FROM e)
SELECT {keys}bin, {show('n', 'n')}, {show('good', 'good')}, {show('bad', 'bad')}, {r('sn', 'n_share')}, {r('CASE WHEN tg > 0 THEN good / tg ELSE 0 END', 'good_share')},
  {r('CASE WHEN tb > 0 THEN bad / tb ELSE 0 END', 'bad_share')}, {r('br', 'bad_rate')}, {r('wo', 'woe')}, {r('ivb', 'iv_bin')}, {r(f'sum(ivb) OVER ({part})', 'iv_total')},
  {r('CASE WHEN p > 0 THEN br / p ELSE 0 END', 'lift')}, {r('im', 'bad_improve')}, {r(reject, 'risk_reject')}, {r('CASE WHEN p > 0 THEN cbr / p ELSE 0 END', 'cum_lift')},
  {r('cim', 'cum_bad_improve')}, {r(c_reject, 'cum_risk_reject')}, {show('cg', 'cum_good')}, {show('cb', 'cum_bad')}, {r('abs(cb / (tb + 1e-10) - cg / (tg + 1e-10))', 'ks')}
FROM f
"""


def psi(e: str, a: str) -> str:
    return f"((greatest({a}, 1e-10) - greatest({e}, 1e-10)) * ln(greatest({a}, 1e-10) / greatest({e}, 1e-10)))"


EFFECTS = {
    "n_share": "CASE WHEN tn > 0 THEN n / tn ELSE 0 END",
    "good_share": "CASE WHEN tn - tb > 0 THEN (n - bad) / (tn - tb) ELSE 0 END",
    "bad_share": "CASE WHEN tb > 0 THEN bad / tb ELSE 0 END",
    "bad_rate": "CASE WHEN n > 0 THEN bad / n ELSE 0 END",
    "lift": "CASE WHEN tb > 0 AND n > 0 THEN (bad / n) / (tb / tn) ELSE 0 END",
    "bad_improve": "CASE WHEN tb > 0 THEN (tb / tn - CASE WHEN tn > n THEN (tb - bad) / (tn - n) ELSE 0 END) / (tb / tn) ELSE 0 END",
}
EFFECTS["risk_reject"] = f"CASE WHEN n > 0 THEN ({EFFECTS['bad_improve']}) / (n / tn) ELSE 0 END"
