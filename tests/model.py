"""A plain-Python model of the visible tree, written from the rules; for comparison only."""

from __future__ import annotations

import math


def ids(path):
    return tuple(int(x) for x in path)


def visible(nodes, controls, selected):
    """nodes: {path tuple: weight}; selected: set of path tuples. Levels of rows in display order."""
    levels = [[((), {"weight": nodes[()], "rank": 0, "min": 0.0, "max": 1.0})]]
    for control in controls:
        parents = [p for p, _ in levels[-1] if p == () or p in selected]
        parents.sort(key=ids)
        if not parents:
            break
        children = {p: [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p and q[-1] not in control.exclude] for p in parents}
        shown, left = [], control.limit_n
        forced = [q for p in parents for q in sorted(children[p], key=ids) if q in selected]
        for i in control.include:
            forced += [p + (i,) for p in parents if p + (i,) in children[p] and p + (i,) not in forced]
        shown = forced[: max(left, 0)]
        left -= len(shown)
        for k, p in enumerate(parents):
            quota = math.floor(left / (len(parents) - k) + 0.5)
            rest = [q for q in children[p] if q not in forced]
            rest.sort(key=lambda q: (-nodes[q] if control.show_top else nodes[q], int(q[-1])))
            shown += rest[:quota]
            left -= len(rest[:quota])
        above = dict(levels[-1])
        by_id_down = sorted(shown, key=lambda q: q[-1], reverse=True)
        ordered = sorted(by_id_down, key=lambda q: (above[q[:-1]]["rank"], nodes[q]))
        rows, before, seen = [], 0.0, {}
        for rank, q in enumerate(ordered):
            p = above[q[:-1]]
            n = sum(r[:-1] == q[:-1] for r in ordered)
            k, run = seen.get(q[:-1], (0, 0.0))
            step = (p["max"] - p["min"]) / n
            rows.append((q, {"weight": nodes[q], "rank": rank, "offset": before, "sibling_rank": k, "sibling_offset": run, "min": p["min"] + k * step, "max": p["min"] + (k + 1) * step}))
            before += nodes[q]
            seen[q[:-1]] = (k + 1, run + nodes[q])
        levels.append(rows)
    return levels
