"""Column names that can't clash with a caller's own."""

from __future__ import annotations

from collections.abc import Iterable


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted``, each with as many leading underscores as it takes to differ
    from all of ``taken`` (Spark compares column names without case)."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out
