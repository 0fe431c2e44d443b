"""Choice of row pairs to report: enough to connect equal bases in every column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def choose(rows: dict[int, str], reference: int | None) -> set[tuple[int, int]]:
    """Pairs for one block: the reference with every row that shares a column with it; then, column by
    column and base by base, each component that the pairs so far leave apart is tied to the hub, the
    member with the most bases (the smallest name on ties), through its own best member."""
    size = {r: len(a) - a.count("-") for r, a in rows.items()}
    rank = lambda r: (-size[r], r)
    width = max(map(len, rows.values()), default=0)
    pairs: set[tuple[int, int]] = set()
    if reference in rows:
        own = rows[reference]
        for r, a in rows.items():
            if r != reference and any(x != "-" and y != "-" for x, y in zip(own, a)):
                pairs.add((min(r, reference), max(r, reference)))
    for col in range(width):
        groups: dict[str, list[int]] = {}
        for r in sorted(rows):
            base = rows[r][col].upper() if col < len(rows[r]) else "-"
            if base not in "-X":
                groups.setdefault(base, []).append(r)
        for base in sorted(groups):
            members = groups[base]
            if len(members) < 2:
                continue
            root = {r: r for r in members}

            def find(r: int, root: dict = root) -> int:
                while root[r] != r:
                    r = root[r]
                return r

            for i, a in enumerate(members):
                for b in members[i + 1 :]:
                    if (a, b) in pairs:
                        root[find(b)] = find(a)
            hub = min(members, key=rank)
            parts: dict[int, list[int]] = {}
            for r in members:
                parts.setdefault(find(r), []).append(r)
            for top, part in parts.items():
                if top != find(hub):
                    best = min(part, key=rank)
                    pairs.add((min(best, hub), max(best, hub)))
    return pairs


def connected(rows: DataFrame, reference: int | None = None) -> DataFrame:
    """rows(block, row, aligned) to (block, left, right)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = sorted(choose(dict(zip(pdf["row"].tolist(), pdf["aligned"].tolist())), reference))
        return pd.DataFrame({"block": pdf["block"].iloc[0], "left": [p[0] for p in found], "right": [p[1] for p in found]})

    return rows.groupBy("block").applyInPandas(run, "block long, left long, right long")


def is_connected(rows: dict[int, str], pairs: set[tuple[int, int]]) -> bool:
    """Whether the pairs connect every column's group of equal bases."""
    for col in range(max(map(len, rows.values()), default=0)):
        groups: dict[str, set[int]] = {}
        for r, a in rows.items():
            if a[col].upper() not in "-X":
                groups.setdefault(a[col].upper(), set()).add(r)
        for members in groups.values():
            seen, todo = set(), [min(members)]
            while todo:
                r = todo.pop()
                if r not in seen:
                    seen.add(r)
                    todo += [b if a == r else a for a, b in pairs if r in (a, b) and {a, b} <= members]
            if seen != members:
                return False
    return True
