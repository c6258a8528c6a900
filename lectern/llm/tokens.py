"""Exact token ids through the tokenizers library, one white-space chunk at a time.

Both public vocabularies used here split text by a pattern that never lets a
token reach from a character that isn't white space into one that is. A text is
therefore cut in front of white space, each different chunk is encoded once, and
the ids of a text's chunks are joined. A bounded memo keeps ids between batches.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WS_RE2 = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CHUNK = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: The longest chunk that the memo keeps: longer ones seldom come again.
MEMO_CHARS = 12
#: Entries of the memo (about 200 bytes each) and bytes of text encoded at a time, where nothing else is said.
MEMO, GROUP_CHARS = 600_000, 5_000_000

#: What stands between chunks that are encoded together, and how many are.
SEPARATOR, JOINED = "\u2063", 64

_ENCODERS: dict[tuple, ChunkEncoder] = {}


class ChunkEncoder:
    """spaced: white space goes with the word behind it (byte-level vocabularies); else it is dropped."""

    def __init__(self, vocabulary: str, spaced: bool, most: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced = Tokenizer.from_str(vocabulary), spaced
        self.memo: dict[str, bytes] = {}
        self.most = most

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), and where each text's ids begin, with the end."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        at = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        which = np.asarray(coded.indices, dtype=np.int64)
        keys = coded.dictionary.to_pylist()
        if self.spaced:
            # A text's first chunk has no space in front; a text with two spaces in a row is cut by the pattern.
            odd = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, f"[{_WS_RE2}][{_WS_RE2}]")))
            first = lists.flatten().take(pa.array(at[:-1])).dictionary_encode()
            which = which.copy()
            which[at[:-1]] = len(keys) + np.asarray(first.indices, dtype=np.int64)
            keys = [k if k[:1] == "\n" else " " + k for k in keys] + first.dictionary.to_pylist()
            if len(odd):
                which, at, keys = self._cut(texts, odd, which, at, keys)
        sizes, flat = self._ids(keys)
        begins = np.cumsum(sizes) - sizes
        n = sizes[which]
        ends = np.cumsum(n)
        ids = np.empty(0, "<u4")
        if len(n) and ends[-1]:
            small = np.int32 if max(ends[-1], len(flat)) < 1 << 31 else np.int64
            place = np.repeat((begins[which] - ends + n).astype(small), n)
            place += np.arange(ends[-1], dtype=small)
            ids = flat[place]
        return ids, np.concatenate(([0], ends))[at]

    def _cut(self, texts, odd, which, at, keys):
        parts = np.split(which, at[1:-1])
        own: dict[str, int] = {}
        for i in odd:
            parts[i] = np.array([len(keys) + own.setdefault(c, len(own)) for c in _CHUNK.findall(texts[i].as_py())], np.int64)
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)]), keys + list(own)

    def _ids(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memo) > self.most:
            self.memo.clear()
        got = list(map(self.memo.get, keys))
        new = [i for i, x in enumerate(got) if x is None]
        for j in range(0, len(new), 50_000):
            part = new[j : j + 50_000]
            for i, ids in zip(part, self._encoded([keys[i] for i in part]), strict=True):
                got[i] = ids
                if len(keys[i]) <= MEMO_CHARS:
                    self.memo[keys[i]] = ids
        return np.fromiter(map(len, got), np.int64, len(got)) // 4, np.frombuffer(b"".join(got), "<u4")


    def _encoded(self, keys: list[str]) -> list[bytes]:
        """The ids of each chunk. Where white space is dropped, many go to the library as one text with a mark between them."""
        one = lambda some: [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        if self.spaced:
            return one(keys)
        between = one([SEPARATOR])[0]
        sets = [keys[i : i + JOINED] for i in range(0, len(keys), JOINED)]
        out: list[bytes] = []
        for own, ids in zip(sets, one([f" {SEPARATOR} ".join(own) for own in sets]), strict=True):
            parts = ids.split(between) if between else []
            # A chunk that holds the mark, or bytes that only look like it, shows by the count or by a part of odd length.
            out += parts if len(parts) == len(own) and all(len(x) % 4 == 0 for x in parts) and not any(SEPARATOR in x for x in own) else one(own)
        return out


def encoder(vocabulary: str, spaced: bool, most: int = MEMO) -> ChunkEncoder:
    """One encoder for each Python worker and vocabulary."""
    key = (hash(vocabulary), spaced, most)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ChunkEncoder(vocabulary, spaced, most)
    return _ENCODERS[key]


def groups(texts: pa.Array, chars: int = GROUP_CHARS):
    """Index ranges of texts that together have about so many bytes."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    first, held = 0, 0
    for i, n in enumerate(size):
        held += n
        if held >= chars:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(size):
        yield first, len(size)
