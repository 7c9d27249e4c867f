"""Named extension points; a name is taken once."""

from __future__ import annotations

from collections.abc import Callable, Iterator


class Registry:
    def __init__(self, kind: str) -> None:
        self.kind, self._of = kind, {}

    def register(self, name: str) -> Callable:
        """Decorator: keep a callable or class under a name."""

        def keep(item):  # noqa: ANN001, ANN202
            if name in self._of:
                raise ValueError(f"{self.kind} '{name}' is registered already")
            self._of[name] = item
            return item

        return keep

    def get(self, name: str):  # noqa: ANN201
        if name not in self._of:
            raise ValueError(f"no {self.kind} '{name}'; known: {', '.join(sorted(self._of)) or 'none'}")
        return self._of[name]

    def remove(self, name: str) -> None:
        self._of.pop(name, None)

    def __contains__(self, name: str) -> bool:
        return name in self._of

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self._of))


column_functions = Registry("column function")
template_functions = Registry("template function")
rules = Registry("validation rule")
checks = Registry("validation plugin")
sources = Registry("source")
connections = Registry("connection")
sinks = Registry("stream sink")
triggers = Registry("trigger")
stores = Registry("table store")
