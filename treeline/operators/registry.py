"""Query ops by name, and pipelines of them: ``gather=ksu;sort=0:s:a;limit=10``."""

from __future__ import annotations

from collections.abc import Callable

from treeline.plans.rows import Rows

OPS: dict[str, Callable[[Rows, str], Rows]] = {}


def op(*names: str):
    def add(f):
        for n in names:
            OPS[n] = f
        return f

    return add


def split_ops(text: str) -> list[tuple[str, str]]:
    """(op, arguments) of a pipeline; ``;`` inside brackets or braces separates nothing."""
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c in "{[(") - (c in "}])")
        if c == ";" and depth <= 0:
            out.append(now)
            now = ""
        else:
            now += c
    return [(n.strip(), a) for n, _, a in (x.partition("=") for x in [*out, now]) if n.strip()]


def run(rows: Rows, pipeline: str) -> Rows:
    from treeline.operators import aggregate, order, project, rolling, series  # noqa: F401  they register themselves

    for name, args in split_ops(pipeline):
        if name not in OPS:
            raise ValueError(f"no op named {name!r}")
        rows = OPS[name](rows, args)
    return rows
