"""Main text of web pages by differencing each page with the nearest page of its host.

Pages are ordered by host and URL path. A page's partner is the nearest page before or
behind it, at most REACH pages away, that doesn't say nearly the same; of the two, the
one whose path begins more alike. Where all within REACH say nearly the same, the
search goes on to the ends of the host. A longest common subsequence aligns all lines of the
two, and lines that both have are deleted. Markup is the exact check that follows:
what stands in the article element stays also when the partner has it, since two
articles may hold the same sentence, and what is left of menus, footers, adverts and
the like goes also when the partner doesn't have it. Pages of a host without other
text are cleaned by markup alone.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from bisect import bisect_right
from collections import Counter
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import memory, scratch

OPEN, ARTICLE, FURNITURE = 0, 1, 2
#: Share of the larger page's text, furniture apart, from which two pages are the same page.
SAME = 0.9
#: How many pages away, in URL order, a partner is looked for at first.
REACH = 8
#: Parts of the URL order for each task, and keys looked at for each part to find its bounds.
PARTS, SAMPLED = 4, 32

#: Elements whose content is no text (the second also end where they aren't closed), those that begin and end a block, those without content.
RAW = "noscript template textarea select button svg iframe object title".split()
CODE = "script style".split()
BLOCK = frozenset("address article aside blockquote body dd head details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, and words of class, id and role, that mark a part beside the article.
FURNITURE_TAGS = frozenset("head nav footer aside form dialog menu".split())
FURNITURE_WORDS = frozenset("ad ads advert adverts advertisement sponsored sponsor promo banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social newsletter subscribe signup login search pagination pager comment comments disqus respond replies reply contentinfo complementary".split())

#: Words that, at the end of a marked name, say no more than that it is a box.
BOX_WORDS = frozenset("area articles bar block body bottom box button buttons column container content form group icons inner item items left link links list panel posts region right section slot stories strip text top unit wrap wrapper".split())
#: Words in front of a name that turn it round, and those whose header is the article's own.
NOT_WORDS, OWN_WORDS = frozenset("has hide no not show with without".split()), frozenset("article content entry post story".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(" + "|".join(CODE) + r")(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(" + "|".join(RAW) + r")(?=[\s/>])[^>]*(?<!/)>.*?</\2\s*>"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""",
    re.S | re.I,
)
_MARK = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


def _beside(name: str) -> bool:
    """Whether a class, id or role marks a part beside the article: "nav", "site-footer", "share_buttons"; not "with-sidebar" or "notice-period"."""
    words = [w for w in _SPLIT.split(name) if w]
    if not words or words[0] in NOT_WORDS or (words[0] in OWN_WORDS and words[-1] == "header"):
        return False
    while len(words) > 1 and (words[-1] in BOX_WORDS or words[-1].isdigit()):
        words.pop()
    return words[-1] in FURNITURE_WORDS


def _zone(tag: str, attributes: str, outer: int) -> int:
    if outer == FURNITURE:
        return FURNITURE
    names: list[str] = []
    if "=" in attributes:
        for value in _MARK.findall(attributes):
            names += value.strip("\"'").lower().split()
    if "articlebody" in names:
        return ARTICLE
    if tag in ("article", "main") or "main" in names:
        return ARTICLE
    if tag in FURNITURE_TAGS or (tag == "header" and outer != ARTICLE) or (tag not in ("html", "body") and any(map(_beside, names))):
        return FURNITURE
    return outer


def lines(page: str | None) -> list[tuple[str, int]]:
    """The blocks of a page that hold text, in order, each with its zone. White space is one space, references are decoded."""
    found: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    held: list[str] = []
    zone = OPEN

    def close() -> None:
        if held:
            line = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if line:
                found.append((line, zone))

    def pop() -> None:
        name, _ = stack.pop()
        opened[name] -= 1

    at, page = 0, page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = (m[4] or "").lower()
        if not tag or tag in RAW:  # one that isn't closed, or closes itself, holds nothing
            continue
        if stack and stack[-1][0] == "head" and tag in BLOCK:  # a head ends where the body begins, with or without its end tag
            pop()
        if tag in BLOCK:
            close()
        elif tag == "br":
            held.append(" ")
        if m[3]:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag not in VOID and not m[5].endswith("/"):
            if tag in BLOCK and stack and opened.get("p") and stack[-1][0] in ("p", "b", "i", "em", "strong", "a", "span"):
                while opened["p"] and stack[-1][0] not in BLOCK - {"p"}:  # a block ends an open paragraph
                    pop()
            stack.append((tag, _zone(tag, m[5], stack[-1][1] if stack else OPEN)))
            opened[tag] = opened.get(tag, 0) + 1
        now = stack[-1][1] if stack else OPEN
        if now != zone:
            close()
            zone = now
    if at < len(page):
        held.append(page[at:])
    close()
    return found


def common(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence of a and b, by bit vectors."""
    if not a or not b:
        return set()
    match: dict[str, int] = {}
    for i, x in enumerate(a):
        match[x] = match.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, rows = full, [full]
    for y in b:
        u = v & match.get(y, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    found, i, j = set(), len(a), len(b)
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            found.add(i - 1)
            i, j = i - 1, j - 1
    return found


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def same_page(a: list[tuple[str, int]], b: list[tuple[str, int]]) -> bool:
    """Whether two pages have so many lines in common that these are their text and not the site's furniture."""
    if a == b:
        return True
    one, two = (Counter(x for x, z in page if z != FURNITURE) for page in (a, b))
    chars = lambda bag: sum(len(x) * n for x, n in bag.items())
    return chars(one & two) >= SAME * max(1, chars(one), chars(two))


def main_text(own: list[tuple[str, int]], other: list[tuple[str, int]] | None) -> tuple[str, int]:
    """own without the lines that other has too, then by markup; and how many lines outside the article the difference deleted."""
    shared = common([x for x, _ in own], [x for x, _ in other]) if other else set()
    kept = [x for i, (x, z) in enumerate(own) if z == ARTICLE or (z == OPEN and i not in shared)]
    return "\n".join(kept), sum(own[i][1] != ARTICLE for i in shared)


def _keyed(pages: DataFrame) -> DataFrame:
    """pages with host, path and key: host, path and page_id as one string that sorts like them."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[^:/?#]+://([^/?#]*)", 1), F.lit("")))
    path = F.coalesce(F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), F.lit(""))
    page = F.coalesce(F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit(""))
    own = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"), F.coalesce("html", F.lit("")).alias("html"), host.alias("host"), path.alias("path"))
    return own.withColumn("key", F.concat_ws("\u0001", "host", "path", page))


def _parts(keyed: DataFrame, n: int) -> tuple[list[str], dict[str, list[int]]]:
    """Bounds of n parts of the order of keys, and the keys that other parts look at too, with these parts.

    The driver gets SAMPLED keys a part to choose bounds from, and the REACH first and last of each part.
    """
    keys = keyed.select("key")
    some = max(1, keys.count() // (n * SAMPLED))
    sample = sorted({r["key"] for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(some)) == 0).collect()})
    bounds = [sample[len(sample) * i // n] for i in range(1, n)] if len(sample) >= n else sample
    bounds = sorted(set(bounds))
    shared = keys.sparkSession.sparkContext.broadcast(bounds)

    def ends(batches):
        found: dict[int, list[str]] = {}
        for batch in batches:
            new: dict[int, list[str]] = {}
            for k in batch.column(0).to_pylist():
                new.setdefault(bisect_right(shared.value, k), []).append(k)
            for p, own in new.items():
                own = sorted(found.get(p, []) + own)
                found[p] = own if len(own) <= 2 * REACH else own[:REACH] + own[-REACH:]
        rows = [(p, k) for p, own in found.items() for k in own]
        yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in rows], pa.int32()), "key": pa.array([k for _, k in rows], pa.string())})

    ours = F.sort_array(F.collect_list("key"))
    ends_of = keys.mapInArrow(ends, "part int, key string").groupBy("part").agg(ours.alias("keys"))
    outer = F.when(F.size("keys") > 2 * REACH, F.concat(F.slice("keys", 1, REACH), F.slice("keys", -REACH, REACH))).otherwise(F.col("keys"))
    held = ends_of.select("part", outer.alias("keys")).orderBy("part").collect()
    looked: dict[str, set[int]] = {}
    flat: list[tuple[int, str]] = []
    for r in held:
        flat += [(r["part"], k) for k in r["keys"]]
    for i, (part, _) in enumerate(flat):
        # Walks out from each end of a part until REACH keys of other parts have been seen.
        for step in (-1, 1):
            j = i + step
            if not 0 <= j < len(flat) or flat[j][0] == part:
                continue
            for _ in range(REACH):
                if not 0 <= j < len(flat):
                    break
                looked.setdefault(flat[j][1], set()).add(part)
                j += step
    return bounds, {k: sorted(p) for k, p in looked.items()}


def _said(page: list[tuple[str, int]]) -> str:
    return "\n".join(f"{z}{x}" for x, z in page)


def _lines(said: str) -> list[tuple[str, int]]:
    return [(x[1:], int(x[0])) for x in said.split("\n")] if said else []


def _farther(keyed: DataFrame, rest: DataFrame) -> DataFrame:
    """key, h, text, n_chars, near_url, n_deleted of the pages of rest (host, key, alone: the hash of what it says) whose host has a page that doesn't say nearly the same.

    Neighbours that say just the same are one run. Each round looks REACH times as
    many runs away, for each side until a partner or the host's end is found; what two
    pages say is compared once in a round.
    """

    def parse(batches):
        for batch in batches:
            said = [_said(lines(x)) for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(said, pa.string()), pa.array([hashlib.md5(x.encode()).hexdigest() for x in said])], ["host", "key", "url", "path", "said", "h"])

    own = keyed.join(rest.select("host").distinct(), "host", "left_semi").select("host", "key", "url", "path", "html")
    pages = scratch.keep(own.mapInArrow(memory.tidy(parse), "host string, key string, url string, path string, said string, h string"), "pages-host")
    order = Window.partitionBy("host").orderBy("key", "h")
    new = F.coalesce((F.col("h") != F.lag("h").over(order)).cast("int"), F.lit(1))
    placed = pages.select("host", "key", "h").distinct().withColumn("new", new).withColumn("run", F.sum("new").over(order)).select("host", "key", "h", "run")
    placed = scratch.keep(placed, "pages-runs")
    runs = placed.groupBy("host", "run", "h").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    texts = pages.groupBy("host", "h").agg(F.min("said").alias("said"))
    ends = runs.groupBy("host").agg(F.max("run").alias("end"))
    ask = placed.join(rest.select(F.col("key").alias("k"), "alone").distinct(), (F.col("key") == F.col("k")) & (F.col("h") == F.col("alone")), "left_semi").select("host", "run", "h").distinct().join(ends, "host")
    sides = F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")
    open_, low, met = scratch.keep(ask.select("*", sides), "pages-open"), 0, []

    def differ(batches):
        for batch in batches:
            unlike = [not same_page(_lines(a), _lines(b)) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(unlike, pa.bool_())) for c in batch.columns[:3]], ["host", "h", "h2"])

    while True:
        high = max(REACH, low * REACH)
        room = F.when(F.col("side") > 0, F.col("end") - F.col("run")).otherwise(F.col("run") - 1)
        open_ = open_.where(room > low)
        if open_.isEmpty():
            break
        asked = open_.select("host", "run", "h", "side", F.explode(F.sequence(F.lit(low + 1).cast("long"), F.least(room, F.lit(high).cast("long")))).alias("far"))
        asked = asked.withColumn("to", F.col("run") + F.col("side") * F.col("far")).join(runs.select("host", F.col("run").alias("to"), F.col("h").alias("h2")), ["host", "to"])
        both = asked.where("h <> h2").select("host", "h", "h2").distinct().join(texts, ["host", "h"]).join(texts.select("host", F.col("h").alias("h2"), F.col("said").alias("said2")), ["host", "h2"])
        unlike = both.select("host", "h", "h2", "said", "said2").mapInArrow(memory.tidy(differ), "host string, h string, h2 string")
        now = scratch.keep(asked.join(unlike, ["host", "h", "h2"]).groupBy("host", "run", "side").agg(F.min("far").alias("far")), "pages-met")
        met.append(now)
        open_, low = scratch.keep(open_.join(now, ["host", "run", "side"], "left_anti"), "pages-open"), high
    hits = functools.reduce(DataFrame.unionByName, met) if met else ask.select("host", "run", F.lit(0).alias("side"), F.lit(0).cast("long").alias("far")).limit(0)
    hits = hits.withColumn("to", F.col("run") + F.col("side") * F.col("far")).join(runs.select("host", F.col("run").alias("to"), "first", "last", F.col("h").alias("h2")), ["host", "to"])
    one = pages.groupBy("host", "key", "h").agg(F.min(F.struct("path", "url", "said")).alias("page"))
    partner = hits.select("host", "run", "side", F.when(F.col("side") > 0, F.col("first")).otherwise(F.col("last")).alias("key"), F.col("h2").alias("h")).join(one, ["host", "key", "h"])
    partner = partner.groupBy("host", "run").agg(F.sort_array(F.collect_list(F.struct("side", "page"))).alias("near"))
    asking = placed.join(rest.select(F.col("key").alias("k"), "alone").distinct(), (F.col("key") == F.col("k")) & (F.col("h") == F.col("alone")), "left_semi")
    table = asking.join(partner, ["host", "run"]).join(one, ["host", "key", "h"]).select("key", "h", "page", "near")

    def clean(batches):
        for batch in batches:
            out = []
            for key, h, page, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                other = max((x["page"] for x in near), key=lambda x: _alike(x["path"], page["path"]))
                text, deleted = main_text(_lines(page["said"]), _lines(other["said"]))
                out.append((key, h, text, len(text), other["url"], deleted))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["key", "h", "text", "n_chars", "near_url", "n_deleted"])

    return table.mapInArrow(memory.tidy(clean), "key string, h string, text string, n_chars long, near_url string, n_deleted long")


def extract(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars, near_url, n_deleted of every row of pages (page_id, url, html; other columns are ignored).

    Null html is empty and gives an empty text; a null URL has an empty host and
    path. Rows with the same URL are neighbours like others. Pages that are nearly
    the same (one page under several addresses) are no partners of each other; a page
    whose host has no other one is cleaned by markup alone. Texts don't depend on
    the number of parts: pages go to tasks by parts of the order of (host, path,
    page_id), so that a host with very many pages spreads, and the REACH pages beside
    a part go there as well. n_deleted is the number of lines outside the article
    that the difference deleted.
    """
    spark = pages.sparkSession
    n = parts or PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(pages)
    shared = spark.sparkContext.broadcast(_parts(keyed, n))
    kinds = {"part": pa.int32(), "key": pa.string(), "own": pa.bool_(), "page_id": pa.int64(), "url": pa.string(), "host": pa.string(), "path": pa.string(), "said": pa.string()}

    def parse(batches):
        bounds, looked = shared.value
        for batch in batches:
            rows = []
            for page_id, url, page, host, path, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                said = _said(lines(page))
                part = bisect_right(bounds, key)
                rows += [(p, key, p == part, page_id, url, host, path, said) for p in {part, *looked.get(key, ())}]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds.values(), strict=True)], list(kinds))

    def measure(batches):
        bounds, looked = shared.value
        for batch in batches:
            rows = []
            for page, host, key in zip(*(c.to_pylist() for c in batch.columns[2:4]), batch.column(5).to_pylist(), strict=True):
                found = lines(page)
                size, part = sum(len(x) for x, z in found if z != FURNITURE), bisect_right(bounds, key)
                rows += [(p, key, p == part, host, size, hashlib.md5(_said(found).encode()).hexdigest()) for p in {part, *looked.get(key, ())}]
            kinds = {"part": pa.int32(), "key": pa.string(), "own": pa.bool_(), "host": pa.string(), "n": pa.int64(), "h": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds.values())], list(kinds))

    def lone(batches):
        alike = lambda x, y: x[5] == y[5] or min(x[4], y[4]) >= SAME * max(1, x[4], y[4])
        page_rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, part in groupby(page_rows, key=lambda x: x[0]):
            part = list(part)
            out = []
            for i, x in enumerate(part):
                if x[2]:
                    near = [y for y in part[max(0, i - REACH) : i] + part[i + 1 : i + 1 + REACH] if y[3] == x[3]]
                    if near and all(alike(x, y) for y in near):
                        out.append((x[3], x[1], x[5]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(3)], ["host", "key", "alone"])

    def clean(batches):
        rows: list[tuple] = []
        size = 0

        def partner(page, others):
            return next((x for x in others if x[5] == page[5] and not same_page(x[7], page[7])), None)

        def decide(around, at):
            page = around[at]
            near = [x for x in (partner(page, reversed(around[max(0, at - REACH) : at])), partner(page, around[at + 1 : at + 1 + REACH])) if x is not None]
            other = max(near, key=lambda x: _alike(x[6], page[6]), default=None)
            text, deleted = main_text(page[7], other and other[7])
            alone = None if other else hashlib.md5(_said(page[7]).encode()).hexdigest()
            return page[3], page[4], text, len(text), other and other[4], deleted, page[5], page[1], alone

        def batch_of(rows):
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "text", "n_chars", "near_url", "n_deleted", "host", "key", "alone"])

        window: list[tuple] = []  # pages of one part: REACH decided ones, then those that wait for REACH behind them
        done = 0

        def settle(upto):
            nonlocal done, size
            while done < upto:
                if window[done][2]:
                    rows.append(decide(window, done))
                    size += rows[-1][3]
                done += 1
            drop = max(0, done - REACH)
            del window[:drop]
            done -= drop

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if window and window[-1][0] != row[0]:
                    settle(len(window))
                    window.clear()
                    done = 0
                page = (*row[:7], _lines(row[7]))
                window.append(page)
                settle(len(window) - REACH)
                if len(rows) >= 4000 or size > 8_000_000:
                    yield batch_of(rows)
                    rows, size = [], 0
        settle(len(window))
        if rows:
            yield batch_of(rows)

    said = keyed.mapInArrow(memory.tidy(parse), "part int, key string, own boolean, page_id long, url string, host string, path string, said string")
    dealt = said.repartition(n, "part").sortWithinPartitions("part", "key", "url", "said")
    cleaned = dealt.mapInArrow(memory.tidy(clean), "page_id long, url string, text string, n_chars long, near_url string, n_deleted long, host string, key string, alone string")
    names = ["page_id", "url", "text", "n_chars", "near_url", "n_deleted"]
    # Pages that may have no partner within REACH, by the sizes of what they say: few, and found without moving texts.
    sized = keyed.mapInArrow(memory.tidy(measure), "part int, key string, own boolean, host string, n long, h string")
    rest = scratch.keep(sized.repartition(n, "part").sortWithinPartitions("part", "key", "h").mapInArrow(memory.tidy(lone), "host string, key string, alone string"), "pages-alike")
    if rest.isEmpty():
        return cleaned.select(names)
    found = scratch.keep(_farther(keyed, rest), "pages-far")
    rest = cleaned.where("alone IS NOT NULL")
    changed = rest.select("page_id", "url", F.col("key").alias("k"), "alone", *(F.col(c).alias("_" + c) for c in names[2:])).join(found, (F.col("k") == F.col("key")) & (F.col("alone") == F.col("h")), "left")
    changed = changed.select("page_id", "url", *(F.when(F.col("h").isNull(), F.col("_" + c)).otherwise(F.col(c)).alias(c) for c in names[2:]))
    return cleaned.where("alone IS NULL").select(names).unionByName(changed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
