"""Pieces of SQL that the oracles of several queries share."""

from __future__ import annotations

from collections.abc import Sequence


def names(words: Sequence[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '([a-z0-9_]+)', 1)"


def clean(x: str) -> str:
    x = f"replace(replace(coalesce({x}, ''), chr(160), ' '), chr(8203), '')"
    x = rf"regexp_replace({x}, '\.{{4,}}(\s*([A-Z]-)?[0-9]+(-[0-9]+)?\s*)$', ' \1', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def lookup_key(x: str) -> str:
    return f"trim(regexp_replace(replace({fold(x)}, 'modelling', 'modeling'), '[^a-z0-9]+', ' ', 'g'))"


def terms(x: str, stop: Sequence[str], longer_than: int = 2) -> str:
    return f"list_filter({tokens(x)}, lambda t: length(t) > {longer_than} AND t NOT IN {names(stop)})"


def distinct_terms(x: str, stop: Sequence[str], longer_than: int = 2) -> str:
    return f"list_distinct({terms(x, stop, longer_than)})"


def sentences(x: str) -> str:
    marked = rf"regexp_replace(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), '\n{{2,}}', chr(1), 'g')"
    return rf"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


def blocks() -> str:
    """page_id, pos, tag, text of the headings, paragraphs and list items of pages."""
    return r"""
    SELECT page_id, pos, substr(raw, 2, position('>' IN raw) - 2) AS tag,
           trim(regexp_replace(regexp_replace(regexp_replace(raw, '<(/[a-z0-9]*|b|br|a href=.[^>]*)>', ' ', 'g'), '^ *<[a-z0-9]+>', ''), '\s+', ' ', 'g')) AS text
    FROM (SELECT page_id, unnest(range(1, len(r) + 1)) AS pos, unnest(r) AS raw
          FROM (SELECT page_id, regexp_extract_all(html, '(<(h1|p|li)>[^<]*(<(b|br|/b|a href="[^"]*"|/a)>[^<]*)*)', 1) AS r FROM pages))
    """
