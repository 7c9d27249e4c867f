"""Texts with variables and calls: ``${NAME:-default}`` and ``{today(format='yyyymmdd')}``."""

from __future__ import annotations

import ast
import importlib
import os
import re
from collections.abc import Mapping
from datetime import datetime, timezone
from typing import Any

from weirflow.registry import template_functions

VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")
CALL = re.compile(r"(?<!\$)\{([A-Za-z_]\w*\([^{}]*\))\}")


def substitute(x: Any, variables: Mapping[str, str] | None = None) -> Any:
    """Variables in all texts of a structure; one that is neither set nor has a default stays as it is."""
    env = os.environ if variables is None else variables
    if isinstance(x, str):
        return VARIABLE.sub(lambda m: env.get(m[1], m[2] if m[2] is not None else m[0]), x)
    if isinstance(x, dict):
        return {k: substitute(v, env) for k, v in x.items()}
    return [substitute(v, env) for v in x] if isinstance(x, list) else x


def _day(pattern: str) -> str:
    now = datetime.now(timezone.utc)
    return re.sub("yyyy|yy|mm|dd", lambda m: now.strftime({"yyyy": "%Y", "yy": "%y", "mm": "%m", "dd": "%d"}[m[0]]), pattern)


@template_functions.register("rdd")
def rdd(fmt: str = "yyyy/mm/dd") -> str:
    return _day(fmt)


@template_functions.register("today")
def today(format: str = "yyyymmdd") -> str:  # noqa: A002 - the name in templates
    return _day(format)


def template_function(f):  # noqa: ANN001, ANN201
    """Make a function callable in templates under its own name."""
    return template_functions.register(f.__name__)(f)


def load_modules(*names: str) -> int:
    """Import modules that register functions."""
    for n in names:
        importlib.import_module(n)
    return len(names)


def _call(text: str) -> str:
    node = ast.parse(text, mode="eval").body
    if not isinstance(node, ast.Call) or not isinstance(node.func, ast.Name):
        raise ValueError(f"not a call: {text!r}")
    if node.func.id not in template_functions:
        raise ValueError(f"unknown template function '{node.func.id}'; known: {', '.join(template_functions)}")
    args = [ast.literal_eval(a) for a in node.args]
    return str(template_functions.get(node.func.id)(*args, **{k.arg: ast.literal_eval(k.value) for k in node.keywords}))


def render(text: str, variables: Mapping[str, str] | None = None) -> str:
    return CALL.sub(lambda m: _call(m[1]), substitute(text, variables))
