"""Expressions of the configuration language, read as syntax trees; nothing is handed to ``eval``."""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable, Mapping
from typing import Any

_BINARY: dict[type, Callable] = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv,
    ast.Mod: operator.mod, ast.Pow: operator.pow, ast.BitAnd: operator.and_, ast.BitOr: operator.or_,
}
_COMPARE: dict[type, Callable] = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}


class Refused(ValueError):
    """An expression uses what the language doesn't have."""


class Interpreter:
    """Evaluates one expression over given names. ``methods``: for a type, the attributes that may be read."""

    def __init__(self, names: Mapping[str, Any], methods: Mapping[type, set[str]]) -> None:
        self.names, self.methods = names, methods

    def run(self, text: str) -> Any:
        try:
            tree = ast.parse(f"({text.strip()}\n)", mode="eval")
        except SyntaxError as e:
            raise Refused(f"can't read {text!r}: {e.msg}") from e
        return self.visit(tree.body)

    def visit(self, node: ast.AST) -> Any:
        f = getattr(self, f"on_{type(node).__name__.lower()}", None)
        if f is None:
            raise Refused(f"{type(node).__name__} isn't part of the language")
        return f(node)

    def on_constant(self, node: ast.Constant) -> Any:
        if node.value is not None and not isinstance(node.value, (str, int, float, bool)):
            raise Refused(f"constant {node.value!r} isn't part of the language")
        return node.value

    def on_name(self, node: ast.Name) -> Any:
        if node.id not in self.names:
            raise Refused(f"unknown name '{node.id}'")
        return self.names[node.id]

    def on_list(self, node: ast.List) -> list:
        return [self.visit(x) for x in node.elts]

    def on_tuple(self, node: ast.Tuple) -> tuple:
        return tuple(self.visit(x) for x in node.elts)

    def on_dict(self, node: ast.Dict) -> dict:
        return {self.visit(k): self.visit(v) for k, v in zip(node.keys, node.values)}

    def on_binop(self, node: ast.BinOp) -> Any:
        f = _BINARY.get(type(node.op))
        if f is None:
            raise Refused(f"operator {type(node.op).__name__} isn't part of the language")
        left, right = self.visit(node.left), self.visit(node.right)
        plain = (str, int, float, list, tuple)
        if isinstance(left, plain) and isinstance(right, plain):
            if f is operator.pow and abs(right) > 64 or f is operator.mul and not (isinstance(left, (int, float)) and isinstance(right, (int, float))):
                raise Refused("constants this large aren't part of the language")
        return f(left, right)

    def on_unaryop(self, node: ast.UnaryOp) -> Any:
        x = self.visit(node.operand)
        if isinstance(node.op, ast.USub):
            return -x
        if isinstance(node.op, ast.UAdd):
            return x
        return (not x) if isinstance(x, bool) else ~x

    def on_boolop(self, node: ast.BoolOp) -> Any:
        f = operator.and_ if isinstance(node.op, ast.And) else operator.or_
        out = self.visit(node.values[0])
        for x in node.values[1:]:
            out = f(out, self.visit(x))
        return out

    def on_compare(self, node: ast.Compare) -> Any:
        left, out = self.visit(node.left), None
        for op, right_node in zip(node.ops, node.comparators):
            right = self.visit(right_node)
            if isinstance(op, (ast.In, ast.NotIn)):
                part = left.is_in(right) if hasattr(left, "is_in") else left in right
                part = part if isinstance(op, ast.In) else ~part if hasattr(part, "column") else not part
            elif type(op) in _COMPARE:
                part = _COMPARE[type(op)](left, right)
            else:
                raise Refused(f"comparison {type(op).__name__} isn't part of the language")
            out = part if out is None else out & part
            left = right
        return out

    def on_ifexp(self, node: ast.IfExp) -> Any:
        raise Refused("use when(condition, a, b)")

    def on_subscript(self, node: ast.Subscript) -> Any:
        base = self.visit(node.value)
        if not isinstance(base, (dict, list, tuple)):
            raise Refused("only lists and dictionaries have items")
        return base[self.visit(node.slice)]

    def on_attribute(self, node: ast.Attribute) -> Any:
        base = self.visit(node.value)
        allowed = next((names for kind, names in self.methods.items() if isinstance(base, kind)), set())
        if node.attr.startswith("_") or node.attr not in allowed:
            raise Refused(f"'{node.attr}' isn't part of the language")
        return getattr(base, node.attr)

    def on_call(self, node: ast.Call) -> Any:
        f = self.visit(node.func)
        if not callable(f):
            raise Refused("only functions can be called")
        if any(k.arg is None for k in node.keywords) or any(isinstance(a, ast.Starred) for a in node.args):
            raise Refused("arguments can't be unpacked")
        return f(*[self.visit(a) for a in node.args], **{k.arg: self.visit(k.value) for k in node.keywords})
