"""Flow definitions: ``a >> b``, ``b << a``, ``[a, b] >> c``, ``a, b >> c`` and ``a | b >> c``.

``>>`` makes the right side depend on the left, ``<<`` the reverse; lists fan out and in; ``a | b`` means whichever of them
there is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Flow:
    """upstream: node -> nodes it depends on. optional: nodes whose upstreams needn't all be there."""

    upstream: dict[str, list[str]] = field(default_factory=dict)
    optional: set[str] = field(default_factory=set)

    def add(self, node: str, *needs: str) -> None:
        have = self.upstream.setdefault(node, [])
        for n in needs:
            self.upstream.setdefault(n, [])
            if n not in have:
                have.append(n)

    def order(self) -> list[str]:
        """All nodes, upstreams first; in the order of definition otherwise. Cycles are refused."""
        out: list[str] = []
        state: dict[str, int] = {}

        def visit(n: str, path: tuple[str, ...]) -> None:
            if state.get(n) == 2:
                return
            if state.get(n) == 1:
                raise ValueError(f"cycle: {' >> '.join([*path[path.index(n) :], n])}")
            state[n] = 1
            for u in self.upstream[n]:
                visit(u, (*path, n))
            state[n] = 2
            out.append(n)

        for n in self.upstream:
            visit(n, ())
        return out


def _names(segment: str) -> tuple[list[str], bool]:
    text = segment.strip()
    if text.startswith("[") != text.endswith("]"):
        raise ValueError(f"unbalanced list in flow: {segment!r}")
    text = text.strip("[]")
    either = "|" in text
    names = [n.strip() for n in re.split(r"[,|]", text)]
    if not all(re.fullmatch(r"[\w./-]+", n) for n in names):
        raise ValueError(f"malformed flow segment: {segment!r}")
    return names, either


def parse_flow(definition: str) -> Flow:
    parts = re.split(r"(>>|<<)", " ".join(definition.split()))
    segments, arrows = parts[0::2], parts[1::2]
    if not all(s.strip() for s in segments):
        raise ValueError(f"malformed flow: {definition!r}")
    flow = Flow()
    parsed = [_names(s) for s in segments]
    for names, _ in parsed:
        for n in names:
            flow.add(n)
    for (left, left_either), arrow, (right, right_either) in zip(parsed, arrows, parsed[1:]):
        above, below, either = (left, right, left_either) if arrow == ">>" else (right, left, right_either)
        for b in below:
            flow.add(b, *above)
            if either:
                flow.optional.add(b)
    return flow


def combine(flows: list[Flow]) -> Flow:
    """The union of flows. A node fed by exactly one, different upstream in several of them takes whichever there is."""
    out = Flow()
    feeds: dict[str, list[tuple[str, ...]]] = {}
    for f in flows:
        out.optional |= f.optional
        for node, needs in f.upstream.items():
            out.add(node, *needs)
            if needs:
                feeds.setdefault(node, []).append(tuple(needs))
    out.optional |= {n for n, ways in feeds.items() if len(set(ways)) > 1 and all(len(w) == 1 for w in ways)}
    return out


def lineage(columns: dict[str, frozenset[str]], upstreams: dict[str, list[str]]) -> dict[str, dict[str, list[str]]]:
    """Output column -> upstream -> its columns, from the fields that expressions read."""
    return {out: {u: sorted(refs & set(has)) for u, has in upstreams.items() if refs & set(has)} for out, refs in columns.items()}
