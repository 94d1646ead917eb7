"""Plain-Python re-statement of the search rules, for small random corpora."""

from __future__ import annotations

import math
import re

WEIGHTS = {"title": 10.0, "stem": 2.0, "folder": 4.0, "body": 1.0}
RAW = re.compile(r"[^\W_]+")


def toks(text: str) -> list[str]:
    return [t.lower() for t in RAW.findall(text)]


def places(tokens: list[str], leaf: dict) -> list[int]:
    want = leaf["tokens"]
    out = []
    for i in range(len(tokens) - len(want) + 1):
        ok = all(
            tokens[i + k].startswith(w) if leaf["prefix"] and k == len(want) - 1 else tokens[i + k] == w
            for k, w in enumerate(want)
        )
        if ok and want:
            out.append(i)
    return out


def leaf_of(node) -> dict:
    return {"tokens": list(node.tokens), "prefix": node.is_prefix, "fields": node.columns}


def frequency(doc: dict, leaf: dict) -> float:
    return sum(WEIGHTS[f] * len(places(toks(doc[f]), leaf)) for f in leaf["fields"])


def holds(doc: dict, node) -> bool:
    name = type(node).__name__
    if name == "AllOf":
        return all(holds(doc, p) for p in node.parts)
    if name == "AnyOf":
        return any(holds(doc, p) for p in node.parts)
    if name == "ButNot":
        return holds(doc, node.keep) and not holds(doc, node.drop)
    return frequency(doc, leaf_of(node)) > 0


def counting(doc: dict, node) -> list:
    """Leaf occurrences that count for a document: every node above them matches it."""
    if not holds(doc, node):
        return []
    name = type(node).__name__
    if name in ("AllOf", "AnyOf"):
        return [leaf for p in node.parts for leaf in counting(doc, p)]
    if name == "ButNot":
        return counting(doc, node.keep)
    return [node]


def scores(docs: list[dict], node) -> dict[str, float]:
    lengths = {d["path"]: sum(len(toks(d[f])) for f in WEIGHTS) for d in docs}
    average = sum(lengths.values()) / len(docs)
    out = {}
    for d in docs:
        if not holds(d, node):
            continue
        total = 0.0
        for leaf in counting(d, node):
            n = sum(frequency(o, leaf_of(leaf)) > 0 for o in docs)
            idf = math.log((len(docs) - n + 0.5) / (n + 0.5))
            idf = idf if idf > 0 else 1e-6
            f = frequency(d, leaf_of(leaf))
            total += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lengths[d["path"]] / average))
        out[d["path"]] = -total
    return out


def snippet(doc: dict, node, n: int = 16) -> str:
    body = doc["body"]
    spans = [(m.start(), m.end()) for m in RAW.finditer(body)]
    tokens = toks(body)
    size = len(tokens)
    leaves = []
    for leaf in counting(doc, node):
        if leaf not in leaves:
            leaves.append(leaf)
    hits = sorted(
        (o, k, o + len(leaf.tokens) - 1)
        for k, leaf in enumerate(leaves)
        if "body" in leaf.columns
        for o in places(tokens, leaf_of(leaf))
    )

    def rate(p: int):
        inside = [h for h in hits if p <= h[0] < p + n]
        kinds = len({h[1] for h in inside})
        return kinds * 1000 + len(inside) - kinds, inside

    begins = [0]
    for i in range(1, size):
        gap = body[spans[i - 1][1] : spans[i][0]]
        bare = gap.rstrip(" \t\r\n")
        if bare != gap and bare[-1:] in (".", ":"):
            begins.append(i)
    best, start = -1, 0
    for o, _, _ in hits:
        points, inside = rate(o)
        if points > best:
            lo, hi = inside[0][0], inside[-1][2] + 1
            best = points
            start = max(min(lo - math.trunc((n - (hi - lo)) / 2), size - n), 0)
        s = max(b for b in begins if b <= o)
        if size > n and s < o:
            points = rate(s)[0] + (120 if s == 0 else 100)
            if points > best:
                best, start = points, s
    stop = min(start + n, size)
    merged: list[list[int]] = []
    for o, _, last in hits:
        if merged and o <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([o, last])
    shown = [(a, min(b, stop - 1)) for a, b in merged if start <= a < stop]
    opens, closes = {a for a, _ in shown}, {b for _, b in shown}
    out = "…" if start > 0 else body[: spans[0][0]] if size else body
    for p in range(start, stop):
        if p > start:
            out += body[spans[p - 1][1] : spans[p][0]]
        out += (">>" if p in opens else "") + body[spans[p][0] : spans[p][1]] + ("<<" if p in closes else "")
    if size:
        out += "…" if stop < size else body[spans[-1][1] :]
    return out
