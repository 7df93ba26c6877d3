"""A template language that compiles to columns.

``{{ path }}`` with dots, indexes, literals and the filters lower, upper, trim, length, replace, join, default,
regex_replace and truncate_middle; ``{% if a == b %}`` with elif and else, ``and``, ``or``, ``not``, ``in`` and the
comparisons; ``{% for x in path %}`` over arrays. Names are columns; an unknown one is an error when the plan is
made. Booleans are written True and False. Anything else is refused.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import processors as P

_PART = re.compile(r"(\{\{.*?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)


class UnsupportedTemplate(ValueError):
    pass


FILTERS: dict[str, Callable[..., Column]] = {
    "lower": F.lower,
    "upper": F.upper,
    "trim": P.strip,
    "length": F.length,
    "replace": lambda x, a, b: F.replace(x, F.lit(a), F.lit(b)),
    "join": lambda x, sep="": F.array_join(x, sep),
    "default": lambda x, value="": F.coalesce(x, F.lit(value)),
    "regex_replace": P.regex_replace,
    "truncate_middle": P.truncate_middle,
}


class Template:
    """A compiled template: ``Template(source)(df)`` is a string column of ``df``."""

    def __init__(self, source: str):
        self.parts = [p for p in _PART.split(source) if p and not p.startswith("{#")]

    def __call__(self, df: DataFrame | None = None, **names: Column) -> Column:
        scope = {c: F.col(f"`{c}`") for c in df.columns} if df is not None else {}
        kinds = dict(df.dtypes) if df is not None else {}
        out, at = self._block(0, scope | names, kinds, ())
        if at < len(self.parts):
            raise UnsupportedTemplate(f"unexpected {self.parts[at]!r}")
        return out

    def _block(self, at: int, scope: dict, kinds: dict, ends: tuple[str, ...]) -> tuple[Column, int]:
        out: list[Column] = []
        while at < len(self.parts):
            part = self.parts[at]
            if part.startswith("{{"):
                out.append(_written(part[2:-2].strip(), scope, kinds))
                at += 1
            elif part.startswith("{%"):
                words = part[2:-2].strip("- \n\t")
                head = words.split(None, 1)[0]
                if head in ends:
                    break
                if head == "if":
                    value, at = self._if(at, scope, kinds)
                elif head == "for":
                    value, at = self._for(at, words, scope, kinds)
                else:
                    raise UnsupportedTemplate(part)
                out.append(value)
            else:
                out.append(F.lit(part))
                at += 1
        return (F.concat(*out) if len(out) > 1 else out[0] if out else F.lit("")), at

    def _if(self, at: int, scope: dict, kinds: dict) -> tuple[Column, int]:
        cases: list[tuple[Column | None, Column]] = []
        while True:
            words = self.parts[at][2:-2].strip("- \n\t")
            head, _, rest = words.partition(" ")
            if head == "endif":
                break
            test = None if head == "else" else _truth(rest, scope)
            body, at = self._block(at + 1, scope, kinds, ("elif", "else", "endif"))
            if at >= len(self.parts):
                raise UnsupportedTemplate("an if without endif")
            cases.append((test, body))
        out = F.lit("")
        for test, body in reversed(cases):
            out = body if test is None else F.when(F.coalesce(test, F.lit(False)), body).otherwise(out)
        return out, at + 1

    def _for(self, at: int, words: str, scope: dict, kinds: dict) -> tuple[Column, int]:
        m = re.fullmatch(r"for\s+(\w+)\s+in\s+(.+)", words, re.S)
        if not m:
            raise UnsupportedTemplate(words)
        end: list[int] = []

        def body(x: Column) -> Column:
            value, stop = self._block(at + 1, scope | {m[1]: x}, kinds, ("endfor",))
            end.append(stop)
            return value

        column = F.array_join(F.transform(_value(m[2], scope), body), "")
        if end[0] >= len(self.parts):
            raise UnsupportedTemplate("a for without endfor")
        return column, end[0] + 1


def _tree(source: str) -> ast.expr:
    try:
        return ast.parse(source.strip(), mode="eval").body
    except SyntaxError as e:
        raise UnsupportedTemplate(source) from e


def _filters(source: str) -> list[str]:
    """The parts between bars outside quotes and brackets."""
    out, depth, quote, start = [], 0, "", 0
    for k, c in enumerate(source):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "|" and not depth:
            out.append(source[start:k])
            start = k + 1
    return [*out, source[start:]]


def _value(source: str, scope: dict) -> Column:
    first, *rest = _filters(source)
    column = _column(_tree(first), scope)
    for f in rest:
        tree = _tree(f)
        name = tree.func.id if isinstance(tree, ast.Call) else getattr(tree, "id", None)
        if name not in FILTERS:
            raise UnsupportedTemplate(f"no filter {f.strip()!r}")
        args = [ast.literal_eval(a) for a in tree.args] if isinstance(tree, ast.Call) else []
        more = {k.arg: ast.literal_eval(k.value) for k in tree.keywords} if isinstance(tree, ast.Call) else {}
        column = FILTERS[name](column, *args, **more)
    return column


def _column(node: ast.expr, scope: dict) -> Column:
    if isinstance(node, ast.Constant):
        return F.lit(node.value)
    if isinstance(node, ast.Name):
        if node.id not in scope:
            raise UnsupportedTemplate(f"{node.id!r} is undefined")
        return scope[node.id]
    if isinstance(node, ast.Attribute):
        return _column(node.value, scope)[node.attr]
    if isinstance(node, ast.Subscript):
        base = F.array(*[_column(e, scope) for e in node.value.elts]) if isinstance(node.value, ast.List) else _column(node.value, scope)
        if isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
            return base[node.slice.value]
        index = _column(node.slice, scope).cast("int")
        return F.element_at(base, F.when(index < 0, index).otherwise(index + 1))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return -_column(node.operand, scope)
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add | ast.Sub | ast.Mult):
        a, b = _column(node.left, scope), _column(node.right, scope)
        return a + b if isinstance(node.op, ast.Add) else a - b if isinstance(node.op, ast.Sub) else a * b
    raise UnsupportedTemplate(ast.unparse(node))


def _truth(source: str, scope: dict) -> Column:
    def test(node: ast.expr) -> Column:
        if isinstance(node, ast.BoolOp):
            parts = [test(v) for v in node.values]
            out = parts[0]
            for p in parts[1:]:
                out = (out & p) if isinstance(node.op, ast.And) else (out | p)
            return out
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~test(node.operand)
        if isinstance(node, ast.Compare) and len(node.ops) == 1:
            op, right = node.ops[0], node.comparators[0]
            left = _column(node.left, scope)
            if isinstance(op, ast.In | ast.NotIn):
                inside = left.isin(*[ast.literal_eval(e) for e in right.elts]) if isinstance(right, ast.List | ast.Tuple) else F.contains(_column(right, scope), left)
                return inside if isinstance(op, ast.In) else ~inside
            b = _column(right, scope)
            how = {ast.Eq: lambda: left.eqNullSafe(b), ast.NotEq: lambda: ~left.eqNullSafe(b), ast.Gt: lambda: left > b, ast.GtE: lambda: left >= b, ast.Lt: lambda: left < b, ast.LtE: lambda: left <= b}
            if type(op) in how:
                return how[type(op)]()
        return _column(node, scope).cast("boolean")

    return test(_tree(source))


def _written(source: str, scope: dict, kinds: dict) -> Column:
    """An expression as text; comparisons and boolean columns are written True or False."""
    tree = _tree(_filters(source)[0])
    if isinstance(tree, ast.Compare | ast.BoolOp) or (isinstance(tree, ast.UnaryOp) and isinstance(tree.op, ast.Not)) or kinds.get(getattr(tree, "id", "")) == "boolean":
        return F.initcap(_truth(source, scope).cast("string"))
    return _value(source, scope).cast("string")


def render(source: str) -> P.Processor:
    """A processor that renders a template with the variable ``text``."""
    template = Template(source)
    return lambda text: template(text=text)
