"""Main text of web pages: page structure, and per host a suffix array of what structure leaves open.

A page is cut into blocks in one pass over its tags. Scripts, styles, navigation, forms, headers,
footers, sidebars, notices, adverts and reader comments are known by their elements, roles and class
names and go. Structure vouches for the paragraphs, headings, list items, cells, quotations and captions in an
``article`` or ``main`` element: they stay as they are. All other blocks are open: those of pages without
such an element, loose text inside of one, and blocks of ``OUTSIDE_TOKENS`` or more beside it (an article may be
a teaser). The open token streams of a host are concatenated over its pages, a suffix array finds token
strings of ``min_tokens`` or more that occur on two distinct pages, and the tokens those cover are
boilerplate. So is, outside of an article, a whole block of ``BLOCK_TOKENS`` or more that is a block of another
distinct page. Shorter strings that pages share within their blocks are prose. The unique runs are kept; a
block beside an article is kept if nothing of it is repeated. Blocks stay in page order.

The token streams of all pages go through the array, those of vouched blocks too: they say what a repeated string
is. Open text that structure vouches for on another page is a copy of prose and stays, however many pages
have it; beside an article it is an excerpt or teaser of another and goes. Vouched blocks stay themselves.

Pages of a host are sorted in groups of about ``group_pages``, dealt by a hash, so a host with a
third of all pages is many tasks and a task's stream is bounded by its group. Hosts of several groups
that have open text exchange the digests of all their windows and blocks: those of open text that two distinct
pages or a vouched block anywhere on the host have are joined back to the pages, so a group is a unit of work
only. Pages with the same blocks count as one page, so copies of a page do not erase each other.

Null html is empty and gives empty text. Null urls are one host. Repeated ids and rows are rows of
their own. Extra columns are ignored; an empty table gives no rows. Broken markup: an unclosed
comment or script hides the rest of the page, an unclosed navigation ends at an article or where the
element around it is closed.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import Written

MIN_TOKENS = 50
BLOCK_TOKENS = 4
OUTSIDE_TOKENS = 25
GROUP_PAGES = 1_000
#: What is known of a block: vouched for, loose in an article, beside one, or of a page without one.
PROSE, LOOSE, BESIDE, OPEN = range(4)

# Element and class names that say what a part of a page is.
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "xmp")
GONE = set(
    "head title nav aside footer form button select dialog menu fieldset input label option audio video map".split()
)
GONE_OUTSIDE = {"header"}
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
NAMES = (
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice alert announcement newsletter subscribe subscription signup login popup modal overlay "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager comment comments "
    "commentlist respond disqus replies reply share sharing social related recommended toolbar footer "
    "masthead topbar skip widget widgets"
).split()
COMMENTS = re.compile(r"comment|disqus|respond|repl(?:y|ies)")
_NAME = re.compile(r"(?:%s)(?:[-_].*|s?\d*)|(?:site|page|main|global|top|bottom|left|right|user|reader|post|blog|cookie|email)[-_](?:%s|header)" % (("|".join(NAMES),) * 2))
# Elements that hold prose, and those whose end ends what was left open inside.
_HOLDERS = set("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption blockquote pre summary address".split())
_CONTAINERS = set("article main section div body html table ul ol dl td li center details figure blockquote".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_ATTRIBUTES = r"(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
_HIDDEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)%s(?<=/)>|<(%s)%s>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>" % (_ATTRIBUTES, "|".join(RAW), _ATTRIBUTES),
    re.S | re.I,
)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")


def _unwanted(tag: str, attributes: str, in_main: bool) -> bool:
    """Whether an element is no part of the main text, by its name, role or class."""
    if tag in GONE or (tag in GONE_OUTSIDE and not in_main):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    if re.search(r"(?:^|\s)hidden(?:\s|$|=)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", attributes, re.I):
        return True
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id"):
            for word in value.split():
                if _NAME.fullmatch(word) or (tag == "article" and COMMENTS.search(word)):
                    return tag != "article" or bool(COMMENTS.search(word))
    return False


def page_blocks(page: str) -> list[tuple[str, int]]:
    """The blocks of a page in order, and what is known of each."""
    page = _HIDDEN.sub(lambda m: "" if m[0].startswith("<!--") else " ", page)
    blocks: list[tuple[str, int]] = []
    text: list[str] = []
    main: list[str] = []  # open article and main elements
    around: Counter[str] = Counter()  # open containers
    within: Counter[str] = Counter()  # and those opened in what is skipped
    holder = skip = ""
    depth = 0
    comments = False

    def close() -> None:
        if text:
            block = " ".join(entities.unescape("".join(text)).split())
            if block:
                blocks.append((block, OPEN if not main else PROSE if holder in _HOLDERS else LOOSE))
            text.clear()

    at = 0
    for match in _TAG.finditer(page):
        if not skip and match.start() > at:
            text.append(page[at : match.start()])
        at = match.end()
        closing, tag, attributes = match[1], match[2].lower(), match[3]
        if skip:
            if tag in ("article", "main") and not closing and not comments and not main:
                skip = ""  # navigation that was never closed
            elif closing and tag in _CONTAINERS and tag != skip and not within[tag] and around[tag]:
                skip = ""  # the element around it ends
            else:
                if tag == skip:
                    depth += -1 if closing else not attributes.endswith("/")
                    if depth == 0:
                        skip = ""
                elif tag in _CONTAINERS and not attributes.endswith("/"):
                    within[tag] += -1 if closing and within[tag] else not closing
                continue
        if closing:
            if tag in BLOCK:
                close()
                holder = ""
            around[tag] -= around[tag] > 0
            if main and tag == main[-1]:
                main.pop()
            continue
        if tag in BLOCK:
            close()
            holder = holder if tag in _VOID else tag
        if _unwanted(tag, attributes, bool(main)):
            close()
            if tag not in _VOID and not attributes.endswith("/"):
                skip, depth = tag, 1
                within.clear()
                comments = bool(COMMENTS.search(attributes.lower()))
        elif tag in ("article", "main"):
            main.append(tag)
        if tag in _CONTAINERS and not skip:
            around[tag] += 1
    if not skip:
        text.append(page[at:])
    close()
    if any(kind != OPEN for _, kind in blocks):
        # beside an article only long blocks are asked about
        return [
            (block, BESIDE if kind == OPEN else kind)
            for block, kind in blocks
            if kind != OPEN or block.count(" ") + 1 >= OUTSIDE_TOKENS
        ]
    return blocks


def string_evidence(
    streams: list[list[int]], owners: list[int], vouched: list[bool], length: int
) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per stream, which tokens lie in a string of *length* tokens that open streams of two owners have, and which
    in one that a vouched stream has.

    The streams are concatenated; the suffix array is sorted to *length* tokens by doubling ranks.
    Strings that cross the end of a stream are unlike all others.
    """
    sizes = np.array([len(s) for s in streams], np.int64)
    if sizes.sum() < length:
        return [np.zeros(n, bool) for n in sizes], [np.zeros(n, bool) for n in sizes]
    tokens = np.concatenate([np.array(s, np.int64) for s in streams])
    stream = np.repeat(np.arange(len(streams)), sizes)
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1] + 1
    have = 1
    while have < length:
        step = min(have, length - have)  # ranks of `have` tokens overlap at the last step
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 2) + later, return_inverse=True)[1] + 1
        have += step
    at = np.flatnonzero(stream[: n - length + 1] == stream[length - 1 :])
    ends = np.cumsum(sizes)

    def covered(starts: np.ndarray) -> list[np.ndarray]:
        depth = np.zeros(n + 1, np.int64)
        np.add.at(depth, starts, 1)
        np.add.at(depth, starts + length, -1)
        mask = np.cumsum(depth[:-1]) > 0
        return [mask[e - k : e] for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]

    if not len(at):
        return covered(at), covered(at)
    array = at[np.argsort(rank[at], kind="stable")]
    ranks = rank[array]
    first = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
    held = np.array(vouched, bool)[stream[array]]
    of = np.array(owners, np.int64)[stream[array]]
    least = np.minimum.reduceat(np.where(held, len(streams), of), first)
    apart = least < np.maximum.reduceat(np.where(held, -1, of), first)
    sure = np.logical_or.reduceat(held, first)
    many = np.diff(np.append(first, len(array)))
    return covered(array[np.repeat(apart, many)]), covered(array[np.repeat(sure, many)])


def repeated_tokens(streams: list[list[int]], length: int) -> list[np.ndarray]:
    """Per stream, which tokens lie in a string of *length* tokens that another stream has as well."""
    return string_evidence(streams, list(range(len(streams))), [False] * len(streams), length)[0]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [page_blocks(page or "") for page in batch.column(3).to_pylist()]
        blocks, kinds = [[t for t, _ in page] for page in found], [[k for _, k in page] for page in found]
        stream = [_stream(b, k) for b, k in zip(blocks, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:3], pa.array(stream, pa.int64()),
                pa.array(blocks, pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.int32())),
            ],
            names=["page_id", "url", "host", "stream", "blocks", "kinds"],
        )


def _stream(blocks: list[str], kinds: list[int]) -> int:
    """The identity of a page: its blocks, open and vouched for."""
    parts = [" ".join(b for b, k in zip(blocks, kinds, strict=True) if (k == PROSE) == sure) for sure in (False, True)]
    return xxhash.xxh64_intdigest("\0".join(parts).encode(), 3) - (1 << 63)


def _digests(blocks: list[str], length: int) -> tuple[list[int], list[int]]:
    """Signed digests of each window of *length* tokens of a page, and of each block."""
    words = [w for b in blocks for w in b.split(" ")]
    joined = " ".join(words).encode()
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1 if words else np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1)) if words else ends
    windows = zip(starts[: max(0, len(words) - length + 1)].tolist(), ends[length - 1 :].tolist(), strict=True)
    return (
        [xxhash.xxh64_intdigest(joined[a:b], 1) - (1 << 63) for a, b in windows],
        [xxhash.xxh64_intdigest(b.encode(), 2) - (1 << 63) for b in blocks],
    )


def _shared_digests(pages: DataFrame, length: int) -> DataFrame:
    """``(host, stream, shared, vouched)``: the digests of the open text of *pages* ``(host, stream, blocks, kinds)``
    that the open text of another page of its host has, and those that vouched text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (blocks, kinds) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                for sure in (False, True):
                    own = [b for b, k in zip(blocks, kinds, strict=True) if (k == PROSE) == sure]
                    windows, whole = _digests(own, length)
                    long = [d for d, b in zip(whole, own, strict=True) if b.count(" ") + 1 >= BLOCK_TOKENS]
                    found = list({*windows, *long})
                    row = [batch.column(c).slice(i, 1).take(pa.array([0] * len(found), pa.int64())) for c in range(2)]
                    yield pa.RecordBatch.from_arrays(
                        [*row, pa.array(found, pa.int64()), pa.array([sure] * len(found), pa.bool_())],
                        names=["host", "stream", "d", "sure"],
                    )

    digests = pages.select("host", "stream", "blocks", "kinds").mapInArrow(run, "host string, stream long, d long, sure boolean")
    owner = F.when(~F.col("sure"), F.col("stream"))
    known = (
        digests.groupBy("host", "d")
        .agg((F.min(owner) < F.max(owner)).alias("apart"), F.bool_or("sure").alias("held"), F.min(owner).alias("open"))
        .where("open is not null and (apart or held)")
        .drop("open")
    )
    return (
        digests.where("not sure")
        .join(known, ["host", "d"])
        .groupBy("host", "stream")
        .agg(F.collect_set(F.when(F.col("apart"), F.col("d"))).alias("shared"), F.collect_set(F.when(F.col("held"), F.col("d"))).alias("vouched"))
    )


def _unique_runs(length: int):
    def clean(group: pa.Table) -> pa.Table:
        numbers: dict[str, int] = {}
        all_blocks, all_kinds = group.column("blocks").to_pylist(), group.column("kinds").to_pylist()
        pages: list[list[list[int]]] = []  # the open blocks of each page
        distinct: dict[tuple, int] = {}  # pages by their open and vouched tokens
        number: list[int] = []
        sure_blocks: set[tuple] = set()
        for bs, ks in zip(all_blocks, all_kinds, strict=True):
            told = [[numbers.setdefault(w, len(numbers)) for w in b.split(" ")] for b in bs]
            sure = [t for t, k in zip(told, ks, strict=True) if k == PROSE]
            pages.append([t for t, k in zip(told, ks, strict=True) if k != PROSE])
            sure_blocks.update(tuple(t) for t in sure if len(t) >= BLOCK_TOKENS)
            streams = tuple(tuple(x for block in blocks for x in block) for blocks in (pages[-1], sure))
            number.append(distinct.setdefault(streams, len(distinct)))
        both = [list(s) for pair in distinct for s in pair]
        repeated, held = string_evidence(both, [i // 2 for i in range(len(both))], [i % 2 == 1 for i in range(len(both))], length)
        owners: dict[tuple, set[int]] = {}
        for page, own in zip(pages, number, strict=True):
            for block in page:
                owners.setdefault(tuple(block), set()).add(own)
        texts = []
        told_shared, told_vouched = group.column("shared").to_pylist(), group.column("vouched").to_pylist()
        for bs, ks, page, own, shared, vouched in zip(all_blocks, all_kinds, pages, number, told_shared, told_vouched, strict=True):
            mask, prose = repeated[2 * own].copy(), held[2 * own].copy()
            shared, vouched = set(shared or ()), set(vouched or ())
            opened = [b for b, k in zip(bs, ks, strict=True) if k != PROSE] if shared or vouched else []
            windows, digests = _digests(opened, length)
            for i, d in enumerate(windows):
                if d in shared:
                    mask[i : i + length] = True
                if d in vouched:
                    prose[i : i + length] = True
            kept, at, n = [], 0, 0
            for block, kind in zip(bs, ks, strict=True):
                if kind == PROSE:
                    kept.append(block)
                    continue
                mine = page[n]
                gone, copy = mask[at : at + len(mine)], prose[at : at + len(mine)]
                long = len(mine) >= BLOCK_TOKENS
                copied = long and (len(owners[tuple(mine)]) > 1 or bool(digests) and digests[n] in shared)
                copy_of_prose = long and (tuple(mine) in sure_blocks or bool(digests) and digests[n] in vouched)
                at, n = at + len(mine), n + 1
                if kind == BESIDE:
                    if not (copied or copy_of_prose or gone.any() or copy.any()):
                        kept.append(block)
                elif copy_of_prose:
                    kept.append(block)
                elif kind == LOOSE or not copied:
                    kept += [w for w, drop in zip(block.split(" "), (gone & ~copy).tolist(), strict=True) if not drop]
            texts.append(" ".join(kept))
        return pa.table({"page_id": group.column("page_id"), "url": group.column("url"), "text": pa.array(texts, pa.string())})

    return clean


def main_text(
    pages: DataFrame,
    min_tokens: int = MIN_TOKENS,
    group_pages: int = GROUP_PAGES,
    *,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of *pages*."""
    kind = pages.schema[key].dataType.simpleString()
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    named = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))

    def parsed(rows: DataFrame) -> DataFrame:
        shape = f"page_id {kind}, url string, host string, stream long, blocks array<string>, kinds array<int>"
        return rows.select("page_id", "url", "host", "html").mapInArrow(_parse, shape)

    # at most one host in group_pages rows has several groups, so these tables may be broadcast
    count = F.ceil(F.count("*") / group_pages).cast("int").alias("groups")
    large = Written(named.groupBy("host").agg(count).where("groups > 1"), "hosts")
    grouped = F.broadcast(large.read())
    asked = Written(
        parsed(named.join(grouped, "host", "left_semi")).where(F.exists("kinds", lambda k: k != PROSE)).select("host").distinct(),
        "asked",
    )
    exchanging = F.broadcast(asked.read())
    none = F.lit(None).cast("array<long>")
    alone = parsed(named.join(exchanging, "host", "left_anti")).withColumns({"shared": none, "vouched": none})
    several = parsed(named.join(exchanging, "host", "left_semi"))
    joined = several.join(_shared_digests(several, min_tokens), ["host", "stream"], "left").select(*alone.columns)
    return (
        alone.unionByName(joined)
        .join(grouped, "host", "left")
        .withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("groups", F.lit(1))))
        .groupBy("host", "part")
        .applyInArrow(_unique_runs(min_tokens), f"page_id {kind}, url string, text string")
        .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
    )
