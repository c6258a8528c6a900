"""Small tables with every awkward row, and plain versions of what the operators promise."""

from __future__ import annotations

import re

import pandas as pd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, kept long, __row long, node long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def row(doc_id, text, source="a", **more):
    return (doc_id, text, "en", source, len(text or ""), more.get("h", "x"), 7, 8, 9)


def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with names the operators use."""
    long = " ".join(f"long{i} tail" for i in range(9000))
    rows = [
        row(1, "same text here"), row(2, "same text here"), row(2, "same text here"), row(3, None), row(4, ""), row(5, " \n\t "), row(None, "same text here", None),
        row(6, long, "b"), row(7, long + " end", "b"), row(8, "ünï çödé 日本 text\nwith  lines\n", "c"), row(9, "x", None), row(-5, "x", "b"), row(2, "other text of the same id", "c"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text: str | None, width: int = 5) -> frozenset:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def components(docs: pd.DataFrame) -> dict:
    """doc_id -> least doc_id that links of similarity 0.75 reach, by comparing all pairs that share a shingle."""
    sets = {k: shingles(t) for k, t in zip(docs.doc_id, docs.text, strict=True)}
    up = {k: k for k in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    holders: dict = {}
    for k, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(k)
    pairs: dict = {}
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    for (a, b), n in pairs.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {k: top(k) for k in sets}
