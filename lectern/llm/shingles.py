"""Word shingles as 64-bit hashes, whole batches at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
_P = np.uint64(0x9E3779B97F4A7C15)
_SPACES = "\t\n\x0b\x0c\r"


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that leaves no visible order."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts (A-Z in lower case, null: empty), and where each text's words begin, with the end."""
    import xxhash

    texts = pc.ascii_lower(pc.fill_null(texts, ""))
    for c in _SPACES:
        texts = pc.replace_substring(texts, c, " ")
    if not len(texts):
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    lists = pc.split_pattern(texts, " ")
    at = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    which = np.asarray(coded.indices, dtype=np.int64)
    real = np.ones(len(names), bool)
    if "" in names:
        real[names.index("")] = False
    some = real[which]
    return hashed[which[some]], np.concatenate(([0], np.cumsum(some)))[at]


def sequence(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in text order, and where each text's begin: words - width + 1 of them, one of all words where there are fewer, none without words."""
    words, at = word_hashes(texts)
    n = np.diff(at)
    size = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out = np.concatenate(([0], np.cumsum(size)))
    total = len(words)
    if not total:
        return np.empty(0, np.uint64), out
    h = np.zeros(max(total - width + 1, 0), np.uint64)
    for i in range(width):
        h = h * _P + words[i : total - width + 1 + i] if len(h) else h
    long = n >= width
    starts = np.repeat(at[:-1][long], size[long])
    place = np.arange(len(starts)) - np.repeat(np.cumsum(size[long]) - size[long], size[long])
    made = np.empty(out[-1], np.uint64)
    where = np.repeat(out[:-1][long], size[long]) + place
    made[where] = h[starts + place] if len(starts) else h[:0]
    for i in np.flatnonzero((n > 0) & (n < width)):
        x = n[i : i + 1].astype(np.uint64)
        for j in range(at[i], at[i + 1]):
            x = x * _P + words[j : j + 1]
        made[out[i]] = x[0]
    return mix(made), out


def distinct(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The set of shingle hashes of each text, ascending."""
    flat, at = sequence(texts, width)
    return [np.unique(flat[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
