"""Main text of web pages by differencing with the page of the nearest address.

A page is cut into lines, one for each block of text. Lines inside elements that never hold
main text (menus, headers, footers, sidebars, forms, notices, adverts, comments of readers) go
at once, by the element's name, role, class or id, or since they are hidden. Words in a class or
id frame nothing that holds an article or main element. Inside an article only a class or id that
is such a word as a whole frames, and only if the element holds neither a headline nor half of
the page's marked text. An article that is marked as a comment or an advert is no main element
but a frame. Of the rest, lines inside an article or main element stay. All others are compared: within a host pages are ordered by the path of their
address, each is paired with the neighbour whose path has the longer common beginning (the one
before on a tie), their lines are aligned by a longest common subsequence, and shared lines are
deleted as the site's frame. A page that would lose all its lines keeps them: a copy of a whole
page says nothing about frames.

Lines of a marked article are not compared, since articles share passages with each other: in
the given pages differencing would delete such passages and could not delete menus, whose
entries differ from page to page.

Neighbours are found over a range-sorted table of addresses and line digests, so a host with
most of the pages is many tasks; only the rows at the edges of ranges are matched up apart. Null
and empty pages have no text. Null addresses are a host of their own; null ids and repeated
rows are pages like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abstain_eval.llm.common import tasks, written
from abstain_eval.session import cut_lineage

RAW = "script style noscript template svg iframe object textarea select option title annotation canvas audio video".split()
FRAME = set("nav header footer aside form button dialog menu head".split())
MAIN = {"article", "main"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img input link meta "
    "math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mphantom menclose".split()
)
FRAME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alertdialog", "alert"}
FRAME_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|popup|modal|newsletter|"
    r"subscribe|signup|login|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|side-bar|widget|header|masthead|footer|copyright|comments?|replies|disqus|"
    r"respond|share|social|related|recommended|pagination|pager|tags?|toolbar|search)(?:$|[\s_-])",
    re.I,
)
#: Names of headers, which frame nothing inside a main element: they hold its headline there.
HEADER_WORDS = re.compile(r"header|masthead|banner", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)", re.S
)
RAW_END = {name: re.compile(rf"</{name}\s*>|$", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
MAIN_TAG = re.compile(r"<(?:article|main)(?=[\s/>])", re.I)
INVISIBLE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
#: Whole classes or ids that frame inside an article, and those that make an article itself a frame.
COMMENTS = set("comment comments comment-list commentlist comment-body comments-area reply replies disqus disqus_thread respond".split())
ADVERTS = set("ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsored-content promo promotion".split())
ASIDES = set(
    "banner cookie cookies cookie-notice cookie-banner consent popup modal newsletter newsletter-signup subscribe signup login menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar share sharing share-buttons social social-share related related-posts related-articles recommended pagination pager toolbar search".split()
)
#: Elements that a start tag of the same kind closes.
SELF_CLOSING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}


def attributes_of(text: str) -> dict[str, str]:
    """Attributes by lower-case name; one without a value is empty, and the first of a name counts."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), "".join(values))
    return out


def labels_of(attributes: dict[str, str]) -> set[str]:
    """The classes and the id of an element, whole and in lower case."""
    return {*attributes.get("class", "").lower().split(), attributes.get("id", "").strip().lower()}


def is_main(name: str, attributes: str) -> bool:
    """An article or main element, unless it is marked as a reader's comment or an advert."""
    if name not in MAIN:
        return False
    return not attributes or labels_of(attributes_of(attributes)).isdisjoint(COMMENTS | ADVERTS)


def is_frame(name: str, attributes: str, inside: str = "", holds_main: bool = False, holds_text: bool = False) -> bool:
    """Whether an element frames.

    `inside`: "article" or "main" if it stands in one; `holds_main`: if one stands in it;
    `holds_text`: if it holds a headline or half of the page's marked text.
    """
    if name in FRAME and not (name == "header" and inside) and not (name == "form" and holds_main):
        return True
    if not attributes or attributes.isspace() or name in ("body", "html"):
        return False
    found = attributes_of(attributes)
    if "hidden" in found or INVISIBLE.search(found.get("style", "")):
        return True
    if name in MAIN:
        return not is_main(name, attributes)
    if found.get("role", "").strip().lower() in FRAME_ROLES:
        return True
    if holds_main:
        return False
    if inside == "article":
        return not holds_text and not labels_of(found).isdisjoint(COMMENTS | ADVERTS | ASIDES)
    values = [HEADER_WORDS.sub("", v) if inside else v for v in (found.get("class", ""), found.get("id", ""))]
    return any(FRAME_WORDS.search(v) for v in values)


class Holdings:
    """By the end of its start tag, what each element of a page holds; found in one pass over the page."""

    def __init__(self, source: str):
        self.main: set[int] = set()
        self.headline: set[int] = set()
        self.text: dict[int, int] = {}  # characters of marked text
        self.marked = 0
        open_elements: list[tuple[str, bool, bool, int, int]] = []  # name, no frame, main, place, marked text before it
        names: dict[str, int] = {}
        mains = at = 0

        def leave() -> str:
            nonlocal mains
            name, _, main, place, before = open_elements.pop()
            self.text[place] = self.marked - before
            mains -= main
            names[name] -= 1
            return name

        while found := TOKEN.search(source, at):
            if mains:
                self.marked += found.start() - at
            at = found.end()
            if found[2] is None:
                continue
            name = found[2].lower()
            if found[1]:
                if names.get(name):
                    while leave() != name:
                        pass
                continue
            if name in RAW_END and not found[3].rstrip().endswith("/"):
                at = RAW_END[name].search(source, at).end()
                continue
            if name in VOID:
                continue
            if name in SELF_CLOSING and (gone := _same_open(open_elements, name)) is not None:
                _, _, _, place, before = open_elements.pop(gone)
                self.text[place] = self.marked - before
                names[name] -= 1
            main = is_main(name, found[3])
            # What holds a holder is known already.
            for holders, holds in ((self.main, main), (self.headline, name == "h1")):
                if holds:
                    for element in reversed(open_elements):
                        if element[3] in holders:
                            break
                        holders.add(element[3])
            open_elements.append((name, False, main, at, self.marked))
            names[name] = names.get(name, 0) + 1
            mains += main
        while open_elements:
            leave()

    def substance(self, place: int) -> bool:
        """Whether an element holds a headline or half of the marked text."""
        return place in self.headline or 2 * self.text.get(place, 0) >= max(self.marked, 1)


def lines(page: str | None) -> list[tuple[str, bool]]:
    """(text, whether it stands in a marked article) of the page's blocks outside frames."""
    out: list[tuple[str, bool]] = []
    open_elements: list[tuple[str, bool, bool]] = []  # name, frame, main
    names: dict[str, int] = {}
    frames = mains = articles = 0
    holdings: Holdings | None = None  # found when the first element that may frame comes before or in an article
    buffer: list[str] = []
    source = page or ""
    last_main = max((found.start() for found in MAIN_TAG.finditer(source)), default=-1)

    def close_block() -> None:
        if buffer:
            text = "".join(buffer)
            text = SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip()
            buffer.clear()
            if text:
                out.append((text, mains > 0))

    at = 0
    while True:
        found = TOKEN.search(source, at)
        end = found.start() if found else len(source)
        if end > at and not frames:
            buffer.append(source[at:end])
        if not found:
            break
        at = found.end()
        if found[2] is None:
            continue
        name = found[2].lower()
        if found[1]:
            if names.get(name):
                if name not in INLINE:
                    close_block()
                while open_elements:
                    other, frame, main = open_elements.pop()
                    names[other] -= 1
                    frames -= frame
                    mains -= main
                    articles -= main and other == "article"
                    if other == name:
                        break
            continue
        if name == "br" and not frames:
            buffer.append(" ")
        elif name not in INLINE and name not in RAW:
            close_block()
        if name in RAW_END and not found[3].rstrip().endswith("/"):
            at = RAW_END[name].search(source, at).end()
            continue
        if name in VOID:
            continue
        if name in SELF_CLOSING and (gone := _same_open(open_elements, name)) is not None:
            del open_elements[gone]
            names[name] -= 1
        main, inside = is_main(name, found[3]), "article" if articles else "main" if mains else ""
        frame = is_frame(name, found[3], inside)
        if frame and (at <= last_main or articles):
            holdings = holdings or Holdings(source)
            frame = is_frame(name, found[3], inside, at in holdings.main, holdings.substance(at))
        open_elements.append((name, frame, main))
        names[name] = names.get(name, 0) + 1
        frames += frame
        mains += main
        articles += main and name == "article"
    close_block()
    return out


def _same_open(open_elements: list[tuple], name: str) -> int | None:
    """Place of an open element of that kind if only inline elements stand inside it. Neither is a frame or main."""
    for i in range(len(open_elements) - 1, -1, -1):
        other, frame, main = open_elements[i][:3]
        if frame or main:
            return None
        if other == name:
            return i
        if other not in INLINE:
            return None
    return None


def shared_lines(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which lines of `own` belong to a longest common subsequence with `other`.

    Bits of one big integer stand for the lines of `other`. Where rows of bits would need more
    than 64 MB the alignment is split in half at the best place, so memory stays bounded.
    """
    keep = np.zeros(len(own), bool)
    _align(own.tolist(), other.tolist(), keep)
    return keep


def _rows(own: list[int], other: list[int], store: bool) -> list[int]:
    places: dict[int, int] = {}
    for i, value in enumerate(other):
        places[value] = places.get(value, 0) | 1 << i
    full = (1 << len(other)) - 1
    row, rows = full, []
    for value in own:
        match = places.get(value, 0)
        step = row & match
        row = ((row + step) | (row - step)) & full
        if store:
            rows.append(row)
    return rows if store else [row]


def _lengths(row: int, n: int) -> np.ndarray:
    """Length of the subsequence with every beginning of the other lines."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _align(own: list[int], other: list[int], keep: np.ndarray) -> None:
    """Mark lines of `own` in `keep`, a view of the whole answer."""
    known = set(other)
    if not own or not other or known.isdisjoint(own):
        return
    if len(own) == 1:
        keep[0] = True
        return
    if len(own) * len(other) > 8 * 64_000_000:
        half = len(own) // 2
        ahead = _lengths(_rows(own[:half], other, False)[0], len(other))
        back = _lengths(_rows(own[half:][::-1], other[::-1], False)[0], len(other))[::-1]
        cut = int(np.argmax(ahead + back))
        _align(own[:half], other[:cut], keep[:half])
        _align(own[half:], other[cut:], keep[half:])
        return
    rows = _rows(own, other, True)
    j = len(other)
    for i in range(len(own) - 1, -1, -1):
        if not j:
            break
        # Zero bits mark where the subsequence grows; line i counts if it makes one more of them.
        mask = (1 << j) - 1
        grown = ~rows[i] & mask
        before = ~rows[i - 1] & mask if i else 0
        if grown.bit_count() > before.bit_count():
            keep[i] = True
            j = grown.bit_length() - 1


LINES = "page_id long, url string, code long, texts array<string>, marked array<boolean>, digests array<long>"


def page_lines(pages: DataFrame) -> DataFrame:
    """Lines of each page, whether each is in a marked article, and digests of those that are not."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lines(p) for p in batch.column("html").to_pylist()]
            texts = [[t for t, _ in page] for page in found]
            marked = [[m for _, m in page] for page in found]
            digests = [[xxhash.xxh64_intdigest(t.encode()) - (1 << 63) for t, m in page if not m] for page in found]
            columns = [batch.column(n) for n in ("page_id", "url", "code")]
            kinds = [pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
            columns += [pa.array(v, k) for v, k in zip((texts, marked, digests), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "code", "texts", "marked", "digests"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.withColumn("code", F.xxhash64("page_id", "url", "html")).mapInArrow(cut, LINES)


def host_and_path(url: Column) -> list[Column]:
    """Lower-case host without port, and the path without query and fragment."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return [F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")]


def common_beginning(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def dropped_lines(rows: pd.DataFrame) -> pd.Series:
    """Which lines of each page its nearest neighbour shares; null if none goes."""
    out = []
    for r in rows.itertuples(index=False):
        near = [n for n in (r.before, r.after) if n is not None and n["host"] == r.host]
        near.sort(key=lambda n: -common_beginning(n["path"], r.path))  # stable: the page before wins ties
        own = np.array(r.digests, np.int64)
        shared = shared_lines(own, np.array(near[0]["digests"], np.int64)) if near else np.zeros(len(own), bool)
        if not shared.any() or (shared.all() and not any(r.marked)):
            out.append(None)
            continue
        rest = iter(shared.tolist())
        out.append([False if m else next(rest) for m in r.marked])
    return pd.Series(out, dtype=object)


def frame_lines(parsed: DataFrame) -> DataFrame:
    """(code, dropped) of the pages that lose lines to their nearest neighbour."""
    keys = parsed.select("code", *host_and_path(F.col("url")), "marked", "digests").dropDuplicates(["code"])
    keys = cut_lineage(keys)
    order = ["host", "path", "code"]
    ranged = keys.repartitionByRange(tasks(keys), *order).withColumn("part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    page = F.struct(*order, "digests")
    within = Window.partitionBy("part").orderBy(*order)
    # A row for each range: the last page before it and the first one after it.
    edges = ranged.groupBy("part").agg(F.min(page).alias("first"), F.max(page).alias("last"))
    along = Window.orderBy("part")
    edges = edges.select("part", F.lag("last").over(along).alias("earlier"), F.lead("first").over(along).alias("later"))
    placed = ranged.withColumns({"before": F.lag(page).over(within), "after": F.lead(page).over(within)}).join(F.broadcast(edges), "part")
    placed = placed.filter(F.size("digests") > 0).select(
        "code", F.struct("host", "path", "marked", "digests", F.coalesce("before", "earlier").alias("before"), F.coalesce("after", "later").alias("after")).alias("r")
    )
    return placed.select("code", dropped_lines("r").alias("dropped")).filter("dropped is not null")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    parsed = written(page_lines(pages), "lines")  # pages are parsed once
    frames = written(frame_lines(parsed), "frame-lines")
    joined = parsed.join(frames, "code", "left")
    kept = F.filter("texts", lambda t, i: ~F.coalesce(F.get("dropped", i), F.lit(False)))
    return joined.select("page_id", "url", F.concat_ws("\n\n", kept).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
