"""Names of columns: free names, wide prediction columns, group columns."""

from __future__ import annotations

import re
from collections.abc import Iterable


def free_name(base: str, taken: Iterable[str]) -> str:
    """base, or base_1, base_2, ... if it is taken."""
    used, name, k = set(taken), base, 0
    while name in used:
        k += 1
        name = f"{base}_{k}"
    return name


def free_names(prefix: str, labels: list[str], taken: Iterable[str]) -> dict[str, str]:
    """A free column name for each label; a label given twice is an error."""
    if len(set(labels)) < len(labels):
        raise ValueError("group labels must differ")
    used, out = set(taken), {}
    for label in labels:
        out[label] = free_name(prefix + label, used)
        used.add(out[label])
    return out


def top_k_of(columns: Iterable[str]) -> int:
    """The largest i of prob_i; all pairs token_1, prob_1 to token_k, prob_k must be there."""
    names = {c.strip() for c in columns}
    found = [int(m[1]) for c in names if (m := re.fullmatch(r"prob_(\d+)", c))]
    if not found:
        raise ValueError("no column prob_1")
    k = max(found)
    missing = [c for i in range(1, k + 1) for c in (f"token_{i}", f"prob_{i}") if c not in names]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return k


def group_columns(columns: list[str]) -> list[str]:
    """What stands after the last prob_k and has a name."""
    k = top_k_of(columns)
    at = [c.strip() for c in columns].index(f"prob_{k}")
    return [c for c in columns[at + 1 :] if c.strip()]


def bound_columns(wanted: list[str], columns: list[str]) -> dict[str, str]:
    """The column of each wanted name: the same name, else the first that holds it (a stray mark before the name, say)."""
    out = {}
    for name in wanted:
        holding = [c for c in columns if c == name] or [c for c in columns if name in c]
        if not holding:
            raise ValueError(f"no column {name}")
        out[name] = holding[0]
    return out


def require(columns: Iterable[str], needed: Iterable[str]) -> None:
    missing = sorted(set(needed) - set(columns))
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
