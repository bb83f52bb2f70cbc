"""The expression language of ``filter`` and ``select_expression``, compiled to Spark columns.

Arithmetic ``+ - * / // % **``, comparisons (also chained), ``and or not & | ~``, ``in``/``not in`` and
``==`` with lists, string and number literals, math functions, names in backquotes, and ``@name`` for Python variables.
A missing value is not equal to anything: ``!=`` is true on it, other comparisons are false.
Division by zero is null.
"""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp, "log": F.log, "expm1": F.expm1, "log1p": F.log1p, "sqrt": F.sqrt, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "arccosh": F.acosh, "arcsinh": F.asinh, "arctanh": F.atanh, "abs": F.abs, "log10": F.log10, "arctan2": F.atan2, "floor": F.floor, "ceil": F.ceil,
}


class ExpressionError(ValueError):
    """The text isn't an expression of the language."""


def _prepare(text: str) -> tuple[str, dict[str, str]]:
    """Python source with quoted names and variables made plain names, and ``&``/``|`` made ``and``/``or``."""
    quoted: dict[str, str] = {}
    out, i = [], 0
    while i < len(text):
        ch = text[i]
        if ch in "\"'":
            j = i + 1
            while j < len(text) and text[j] != ch:
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif ch == "`":
            j = text.find("`", i + 1)
            if j < 0:
                raise ExpressionError(f"open backquote in {text!r}")
            quoted[name := f"__quoted_{len(quoted)}"] = text[i + 1 : j]
            out.append(name)
            i = j + 1
        elif ch == "@":
            out.append("__local_")
            i += 1
        else:
            out.append(ch)
            i += 1
    source = "".join(out).strip()
    try:
        words = {"&": "and", "|": "or"}
        tokens = [(tokenize.NAME, words[t.string]) if t.type == tokenize.OP and t.string in words else (t.type, t.string) for t in tokenize.generate_tokens(io.StringIO(source).readline)]
    except (tokenize.TokenError, IndentationError) as e:
        raise ExpressionError(f"{text!r}: {e}") from None
    return tokenize.untokenize(tokens), quoted


class _Compiler:
    def __init__(self, columns: Mapping[str, Column], env: Mapping[str, Any], quoted: Mapping[str, str]) -> None:
        self.columns, self.env, self.quoted = columns, env, quoted

    def name(self, n: ast.Name) -> Any:
        if n.id in self.quoted:
            key = self.quoted[n.id]
        elif n.id.startswith("__local_"):
            if n.id[8:] not in self.env:
                raise ExpressionError(f"unknown variable @{n.id[8:]}")
            return self.env[n.id[8:]]
        else:
            key = n.id
        if key not in self.columns:
            raise ExpressionError(f"unknown column {key!r}")
        return self.columns[key]

    @staticmethod
    def column(x: Any) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    def visit(self, n: ast.expr, sure: bool = False) -> Any:
        """``sure``: null truth values must become false here, as they are under a negation."""
        match n:
            case ast.Constant(value=v):
                return v
            case ast.Name():
                return self.name(n)
            case ast.List(elts=e) | ast.Tuple(elts=e):
                return [self.visit(x) for x in e]
            case ast.BoolOp(op=op, values=v):
                parts = [self.column(self.visit(x, sure)) for x in v]
                out = parts[0]
                for p in parts[1:]:
                    out = out & p if isinstance(op, ast.And) else out | p
                return out
            case ast.UnaryOp(op=ast.Not() | ast.Invert(), operand=x):
                return ~self.column(self.visit(x, True))
            case ast.UnaryOp(op=ast.USub(), operand=x):
                v = self.visit(x)
                return -v
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return self.visit(x)
            case ast.BinOp(left=a, op=op, right=b):
                return self.arithmetic(op, self.visit(a), self.visit(b))
            case ast.Compare(left=a, ops=ops, comparators=cs):
                values = [self.visit(x) for x in [a, *cs]]
                out = None
                for op, x, y in zip(ops, values, values[1:]):
                    c = self.compare(op, x, y)
                    c = F.coalesce(c, F.lit(False)) if sure else c
                    out = c if out is None else out & c
                return out
            case ast.Call(func=ast.Name(id=f), args=args, keywords=[]) if f in FUNCTIONS:
                return FUNCTIONS[f](*[self.column(self.visit(x)) for x in args])
        raise ExpressionError(f"not supported: {ast.unparse(n)}")

    def arithmetic(self, op: ast.operator, x: Any, y: Any) -> Any:
        a, b = self.column(x), self.column(y)
        match op:
            case ast.Add():
                return F.concat(a, b) if isinstance(x, str) or isinstance(y, str) else a + b
            case ast.Sub():
                return a - b
            case ast.Mult():
                return a * b
            case ast.Div():
                return F.try_divide(a.cast("double"), b)
            case ast.FloorDiv():
                return F.floor(F.try_divide(a.cast("double"), b))
            case ast.Mod():
                m = F.try_mod(a, b)
                return F.when((m != 0) & (F.signum(m.cast("double")) != F.signum(b.cast("double"))), m + b).otherwise(m)
            case ast.Pow():
                return F.pow(a, b)
        raise ExpressionError(f"operator {type(op).__name__} isn't supported")

    def compare(self, op: ast.cmpop, x: Any, y: Any) -> Column:
        if isinstance(x, list) and not isinstance(y, list):
            x, y = y, x
        if isinstance(y, (list, tuple, set)):
            inside = F.coalesce(self.column(x).isin([v for v in y if v is not None]), F.lit(False))
            match op:
                case ast.In() | ast.Eq():
                    return self.column(x).isin([v for v in y if v is not None])
                case ast.NotIn() | ast.NotEq():
                    return ~inside
            raise ExpressionError("a list can only be compared with == != in")
        a, b = self.column(x), self.column(y)
        match op:
            case ast.Eq():
                return a == b
            case ast.NotEq():
                return ~a.eqNullSafe(b)
            case ast.Lt():
                return a < b
            case ast.LtE():
                return a <= b
            case ast.Gt():
                return a > b
            case ast.GtE():
                return a >= b
        raise ExpressionError(f"comparison {type(op).__name__} isn't supported")


def compile_expression(text: str, columns: Mapping[str, Column], env: Mapping[str, Any] | None = None) -> Column:
    """The Spark column of an expression over ``columns``; ``env`` holds the Python variables for ``@``."""
    if not text or not text.strip():
        raise ExpressionError("empty expression")
    source, quoted = _prepare(text)
    try:
        tree = ast.parse(source.strip(), mode="eval")
    except SyntaxError as e:
        raise ExpressionError(f"{text!r}: {e.msg}") from None
    return _Compiler.column(_Compiler(columns, env or {}, quoted).visit(tree.body))


def split_assignment(text: str) -> tuple[str | None, str]:
    """(name, expression) of ``name = expression``; (None, text) if it assigns nothing."""
    depth, quote = 0, ""
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'`":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch == "=" and not depth:
            if text[i + 1 : i + 2] == "=" or (i and text[i - 1] in "=!<>"):
                return None, text
            return text[:i].strip().strip("`"), text[i + 1 :].strip()
    return None, text
