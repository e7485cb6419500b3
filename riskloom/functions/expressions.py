"""Compiler from Python-like expression text to Columns.

Text is parsed with ``ast`` and only listed node types are accepted; nothing
is evaluated by Python.  A comparison with a missing value is false, and its
negation true, as in data frames that have no three-valued logic.
"""

from __future__ import annotations

import ast
import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}
_ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod}
_LOGIC = {ast.BitAnd: operator.and_, ast.BitOr: operator.or_}
#: Functions of derived columns.
_CALLS = {
    "where": lambda c, a, b: F.when(c, a).otherwise(b),
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "log10": F.log10, "log1p": F.log1p, "expm1": F.expm1, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "floor": F.floor, "ceil": F.ceil, "sign": F.signum, "power": F.pow, "minimum": F.least, "maximum": F.greatest, "round": F.bround,
    "clip": lambda x, lo, hi: F.greatest(F.least(x, hi), lo),
}


class ExpressionError(ValueError):
    """Text that is no supported expression."""


def parse(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"cannot parse {text!r}: {e.msg}") from e


def columns_of(text: str) -> list[str]:
    """Names that an expression reads, in order of appearance."""
    tree = parse(text)
    calls = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    names = [(n.lineno, n.col_offset, n.id) for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in calls]
    return list(dict.fromkeys(name for *_, name in sorted(names)))


def _is_logic(node: ast.expr) -> bool:
    return isinstance(node, (ast.Compare, ast.BoolOp)) or isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.Not, ast.Invert)) or isinstance(node, ast.BinOp) and isinstance(node.op, (ast.BitAnd, ast.BitOr, ast.BitXor)) or isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute)


def _true(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False))


def _known(c: Column) -> Column:
    """Neither NULL nor NaN."""
    return c.isNotNull() & (c.cast("string") != "NaN")


def _build(node: ast.expr) -> Column:
    match node:
        case ast.Constant(value=v) if v is None or isinstance(v, (bool, int, float, str)):
            return F.lit(v)
        case ast.Name(id=name):
            return F.col(f"`{name}`")
        case ast.BoolOp(op=op, values=values):
            return functools.reduce(operator.and_ if isinstance(op, ast.And) else operator.or_, map(_predicate, values))
        case ast.UnaryOp(op=ast.Not() | ast.Invert(), operand=x):
            return ~_predicate(x)
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -_build(x)
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return _build(x)
        case ast.BinOp(left=a, op=ast.BitXor(), right=b):
            return _predicate(a) != _predicate(b)
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _LOGIC:
            return _LOGIC[type(op)](_predicate(a), _predicate(b))
        case ast.BinOp(left=a, op=ast.Pow(), right=b):
            return F.pow(_build(a), _build(b))
        case ast.BinOp(left=a, op=ast.FloorDiv(), right=b):
            return F.floor(_build(a) / _build(b))
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _ARITHMETIC:
            return _ARITHMETIC[type(op)](_build(a), _build(b))
        case ast.Compare(left=first, ops=ops, comparators=rest):
            parts = []
            for a, op, b in zip([first, *rest], ops, rest):
                if isinstance(op, (ast.In, ast.NotIn)):
                    inside = _true(_build(a).isin(*_values(b)))
                    parts.append(inside if isinstance(op, ast.In) else ~inside)
                elif type(op) not in _COMPARE:
                    raise ExpressionError(f"unsupported comparison {ast.unparse(node)!r}")
                else:
                    x, y = _build(a), _build(b)
                    test = _true(_COMPARE[type(op)](x, y)) & _known(x) & _known(y)
                    parts.append(test if not isinstance(op, ast.NotEq) else ~(_true(x == y) & _known(x) & _known(y)))
            return functools.reduce(operator.and_, parts)
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _CALLS:
            if name == "where" and len(args) == 3:
                return _CALLS[name](_predicate(args[0]), _build(args[1]), _build(args[2]))
            return _CALLS[name](*map(_build, args))
        case ast.Call(func=ast.Attribute(value=x, attr=method), args=args, keywords=[]):
            c = _build(x)
            match method, args:
                case ("isna" | "isnull"), []:
                    return ~_known(c)
                case ("notna" | "notnull"), []:
                    return _known(c)
                case "isin", [values]:
                    return _true(c.isin(*_values(values)))
                case "between", [lo, hi]:
                    return _true(c.between(_build(lo), _build(hi))) & _known(c)
    raise ExpressionError(f"unsupported expression {ast.unparse(node)!r}")


def _values(node: ast.expr) -> list:
    if isinstance(node, (ast.List, ast.Tuple, ast.Set)):
        return [ast.literal_eval(x) for x in node.elts]
    raise ExpressionError("membership needs a literal list")


def _predicate(node: ast.expr) -> Column:
    c = _build(node)
    return c if _is_logic(node) else _true(c)


def predicate(text: str) -> Column:
    """Boolean Column that is never NULL."""
    return _predicate(parse(text))


def value(text: str) -> Column:
    """Column of a derived value."""
    return _build(parse(text))


def derive(df, derivings: list[tuple[str, str]] | dict[str, str]):
    """Add columns by (name, expression); all expressions read the input columns only."""
    pairs = list(derivings.items()) if isinstance(derivings, dict) else derivings
    missing = sorted({c for _, text in pairs for c in columns_of(text)} - {*df.columns})
    if missing:
        raise ExpressionError(f"unknown columns {missing}")
    return df.withColumns({name: value(text) for name, text in pairs})


def simplify(text: str) -> str:
    """Display form without double negation, repeats, or absorbed terms; only sound laws are used."""

    def walk(node: ast.expr) -> ast.expr:
        match node:
            case ast.UnaryOp(op=ast.Not() | ast.Invert(), operand=ast.UnaryOp(op=ast.Not() | ast.Invert(), operand=x)):
                return walk(x)
            case ast.UnaryOp(op=ast.Not() | ast.Invert(), operand=x):
                return ast.UnaryOp(ast.Not(), walk(x))
            case ast.BoolOp(op=op, values=values):
                return join(op, [walk(v) for v in values])
            case ast.BinOp(left=a, op=(ast.BitAnd() | ast.BitOr()) as op, right=b):
                return join(ast.And() if isinstance(op, ast.BitAnd) else ast.Or(), [walk(a), walk(b)])
        return node

    def join(op: ast.boolop, values: list[ast.expr]) -> ast.expr:
        flat: dict[str, ast.expr] = {}
        for v in values:
            for x in v.values if isinstance(v, ast.BoolOp) and type(v.op) is type(op) else [v]:
                flat[ast.unparse(x)] = x
        other = ast.Or if isinstance(op, ast.And) else ast.And
        kept = [x for x in flat.values() if not (isinstance(x, ast.BoolOp) and isinstance(x.op, other) and any(ast.unparse(y) in flat for y in x.values))]
        return kept[0] if len(kept) == 1 else ast.BoolOp(op, kept)

    return ast.unparse(walk(parse(text)))
