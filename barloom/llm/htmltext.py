"""Main text of web pages: markup, and differencing with the page of the nearest URL.

Pages are sorted by host and path, so a page's neighbour in that order has the longest common URL start within
the host. Text lines (blocks) of both are aligned by longest common subsequence, and lines that both have
are template and go. Markup decides first: scripts, styles and forms never hold text of the article, nor
do menus, headers, footers, sidebars, notices, adverts and comments that their tag, role or class names.
Where a page marks its article, the marked lines are the text; differencing decides on pages that mark none.

Neighbours are found on keys and line hashes alone, range-sorted over all partitions with the last page of a
partition handed to the next, so a host of any size is split and the result does not depend on the partitions.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm.common import bytes_of, decoded, map_batches, utf8
from barloom.llm.urlfilter import url_parts
from barloom.session import cut

# Names of HTML elements and words that sites use for parts other than the article.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea",
       "select", "title")
DROPPED = {"nav", "header", "footer", "aside", "form", "head", "button", "dialog", "menu", "audio", "video"}
MAIN = {"article", "main"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "br", "hr", "table", "tr",
          "td", "th", "thead", "tbody", "tfoot", "caption", "pre", "blockquote", "section", "article", "main", "body",
          "html", "address", "figcaption", "details", "summary", "fieldset", "legend", "center", "nav", "header",
          "footer", "aside", "form", "head", "figure", "dialog", "menu"}
# Elements that their class or id can drop inside a marked article; headings, paragraphs and the like stay.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "article", "main", "details", "fieldset", "center", "address"}
VOID = {"br", "hr", "img", "input", "meta", "link", "source", "track", "wbr", "area", "base", "col", "embed", "param"}
# Elements whose end tag may be left out, and the opening tags that end them.
ENDED_BY = {
    "p": BLOCKS - {"br", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "body", "html",
                   "figcaption", "summary", "legend", "head"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody"},
    "th": {"td", "th", "tr", "tbody"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body"},
}
DROPPED_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored",
                 "promo", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer",
                 "header", "masthead", "cookie", "cookies", "consent", "notice", "notices", "newsletter", "subscribe",
                 "popup", "modal", "comment", "comments", "reply", "replies", "disqus", "share", "sharing", "social",
                 "related", "recommended", "widget", "toolbar", "pagination", "pager", "login", "signup", "alert"}
# Words after which the word before names the part: "ad-box" is an ad, "ad-free-content" and "market-share-table" are not.
FRAME_WORDS = {"area", "articles", "bar", "block", "body", "bottom", "box", "buttons", "center", "col", "column", "container",
               "content", "desktop", "form", "group", "icons", "inner", "item", "items", "large", "left", "links", "list", "mobile",
               "outer", "overlay", "panel", "posts", "right", "row", "section", "slot", "small", "stories", "text", "thread",
               "tools", "top", "unit", "wrap", "wrapper", "zone"}
COMMENT_WORDS = {"comment", "comments", "reply", "replies", "disqus"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form"}
SPACE = re.compile(r"[\s\x00]+")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:(?:[^>]*[\s\"'])?/>|[^>]*>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>",
    re.S | re.I)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


COMPLETE = re.compile(r"\A<!--.*-->\Z|\A<!\[CDATA\[.*\]\]>\Z|\A<(?!!--|!\[CDATA\[)[!?][^>]*>\Z"
                      r"|\A<(\w+)(?:(?:[^>]*[\s\"'])?/>|.*</\1\s*>)\Z", re.S | re.I)


def _part(name: str) -> str:
    """The word of a class or id that says what it is: the last that is neither a frame word nor the denied one of ``has-x``."""
    words = re.split(r"[^a-z]+", re.sub(r"(?:has|with|no|without)[-_][a-z]+", "", name))
    words = [word for word in words if len(word) > 1]
    free = "free" in words
    while len(words) > 1 and words[-1] in FRAME_WORDS and not free:
        words.pop()
    return words[-1] if words else ""


def _unwanted(tag: str, attrs: str, marked: bool = False) -> bool:
    """Whether tag, role, ``hidden`` or class and id words drop an element; ``marked``: it lies in a marked article.

    The header of a marked article is its own title. Elements that mark an article go only as readers' comments.
    """
    if tag in DROPPED and not (marked and tag == "header"):
        return True
    if not attrs or tag in ("body", "html"):
        return False
    words = COMMENT_WORDS if tag in MAIN else DROPPED_WORDS
    for name, *values in ATTRIBUTE.findall(attrs):
        value, name = "".join(values).lower(), name.lower()
        if name in ("class", "id"):
            if not (marked and tag not in CONTAINERS) and any(_part(own) in words for own in value.split()):
                return True
        elif tag in MAIN:
            continue
        elif name == "role":
            if value in DROPPED_ROLES:
                return True
        elif name == "hidden" or value == "true":
            return True
    return False


def _ends(tokens: list[re.Match]) -> dict[int, tuple[int, bool]]:
    """Where the element of each opening tag ends, by places of tokens, and whether its own end tag is there.

    An element without it ends at the end tag of an element around it, at an opening tag that ends it (``ENDED_BY``), or with
    the page. End tags of inline elements do not end blocks, except those whose end tag may be left out.
    """
    ends: dict[int, tuple[int, bool]] = {}
    stack: list[tuple[str, int]] = []
    levels: dict[str, list[int]] = {}  # levels of the open elements of each name
    open_blocks: list[int] = []
    barriers: list[int] = [-1]  # levels of blocks that end tags of inline elements do not end

    def pop(level: int, at: int) -> None:
        while len(stack) > level:
            tag, begin = stack.pop()
            levels[tag].pop()
            if tag in BLOCKS:
                open_blocks.pop()
                if tag not in ENDED_BY:
                    barriers.pop()
            ends[begin] = at, False

    for at, token in enumerate(tokens):
        if token["tag"] is None:
            continue
        tag = token["tag"].lower()
        if token["close"]:
            if levels.get(tag) and (tag in BLOCKS or levels[tag][-1] > barriers[-1]):
                level = levels[tag][-1]
                begin = stack[level][1]
                pop(level, at)
                ends[begin] = at, True
            continue
        if tag in BLOCKS:
            while open_blocks and tag in ENDED_BY.get(stack[open_blocks[-1]][0], ()):
                pop(open_blocks[-1], at)
        if tag not in VOID and not (token["attrs"] or "").rstrip().endswith("/"):
            if tag in BLOCKS:
                open_blocks.append(len(stack))
                if tag not in ENDED_BY:
                    barriers.append(len(stack))
            levels.setdefault(tag, []).append(len(stack))
            stack.append((tag, at))
    pop(0, len(tokens))
    return ends


def _tokens(page: str) -> tuple[list[re.Match], int]:
    """The tags, comments and raw elements of a page, and where its text ends.

    Behind the last ``>`` no tag ends, so none is sought there and broken markup costs no second scan; an unfinished
    comment, section or raw element takes the rest of the page with it.
    """
    stop = page.rfind(">") + 1
    tokens = list(TOKEN.finditer(page, 0, stop))
    if tokens and tokens[-1].end() == stop and tokens[-1]["tag"] is None and not COMPLETE.search(tokens[-1].group()):
        return tokens, tokens[-1].end()
    broken = [at for at in (page.find(start, stop) for start in ("<!--", "<![CDATA[")) if at >= 0]
    return tokens, min(broken, default=len(page))


def blocks(page: str) -> tuple[list[str], list[bool]]:
    """Text blocks outside unwanted elements, and whether each lies in an element that marks the article.

    An unwanted element without its end tag ends as ``_ends`` says, or at an opening ``article`` or ``main`` before.
    """
    texts: list[str] = []
    marked: list[bool] = []
    parts: list[str] = []
    main, at = 0, 0
    until, whole = -1, False  # the token that ends an unwanted element, and whether it is the element's own
    tokens, stop = _tokens(page)
    ends: dict[int, tuple[int, bool]] | None = None

    def close() -> None:
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                texts.append(text)
                marked.append(main > 0)

    for place, token in enumerate(tokens):
        if place > until and token.start() > at:
            parts.append(page[at:token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(token["close"])
        if place < until and (whole or closing or tag not in MAIN) or place == until and whole:
            continue
        until = min(until, place)
        if tag in BLOCKS:
            close()
        attrs = token["attrs"] or ""
        if tag in MAIN:
            if closing:
                main = max(0, main - 1)
                continue
        if closing or tag in VOID:
            continue
        if _unwanted(tag, attrs, main > 0):
            close()
            if not attrs.rstrip().endswith("/"):
                ends = _ends(tokens) if ends is None else ends
                until, whole = ends[place]
        elif tag in MAIN:
            main += 1
    if until < len(tokens) and at < stop:
        parts.append(page[at:stop])
    close()
    return texts, marked


def shared_lines(own: list[int], other: list[int]) -> list[int]:
    """Places in ``own`` of a longest common subsequence with ``other``.

    Common starts and ends are matched first; the rest goes through the sequence of matches of both (places of
    ``other`` in descending order for every line of ``own``), whose longest rising run is the answer.
    """
    from bisect import bisect_left

    start, stop, tail = 0, len(own), len(other)
    while start < stop and start < tail and own[start] == other[start]:
        start += 1
    while stop > start and tail > start and own[stop - 1] == other[tail - 1]:
        stop, tail = stop - 1, tail - 1
    places: dict[int, list[int]] = {}
    for place in range(tail - 1, start - 1, -1):
        places.setdefault(other[place], []).append(place)
    ends: list[int] = []  # smallest last place of a run of each length
    nodes: list[tuple] = []
    for line in range(start, stop):
        for place in places.get(own[line], ()):
            length = bisect_left(ends, place)
            node = (line, nodes[length - 1] if length else None)
            if length == len(ends):
                ends.append(place)
                nodes.append(node)
            else:
                ends[length], nodes[length] = place, node
    middle, node = [], nodes[-1] if nodes else None
    while node is not None:
        middle.append(node[0])
        node = node[1]
    return [*range(start), *reversed(middle), *range(stop, len(own))]


def _parsed(pages: DataFrame) -> DataFrame:
    """Adds ``lines, marked, hashes`` to ``_id, _url, _row, host, path, _html``; ``_html`` goes.

    ``hashes`` are of all lines, ``lines`` the marked ones where there are some.
    """
    kept = [name for name in pages.columns if name != "_html"]
    kinds = ", ".join(f"{name} {pages.schema[name].dataType.simpleString()}" for name in kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        for batch in batches:
            texts, marks, hashes = [], [], []
            for data in bytes_of(batch, "_html"):
                text, mark = blocks(decoded(data))
                marks.append(any(mark))
                hashes.append([xxhash.xxh64_intdigest(line.encode("utf-8", "replace")) - (1 << 63) for line in text])
                texts.append([line for line, main in zip(text, mark) if main] if marks[-1] else text)
            yield {**{name: batch.column(name) for name in kept}, "lines": texts, "marked": marks, "hashes": hashes}

    return map_batches(pages, work, f"{kinds}, lines array<string>, marked boolean, hashes array<long>")


def neighbours(keyed: DataFrame) -> DataFrame:
    """``_row, hashes, other`` of pages that are not ``marked``: ``other`` are the hashes of the host's nearest page of any kind.

    The nearer of the two pages beside a page is the one with the longer common path start, the earlier if both are equal.
    """
    order = ["host", "path", "_row"]
    sorted_ = cut(
        keyed.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
    )
    page = F.struct(*order, "hashes")
    inside = Window.partitionBy("part").orderBy(*order)
    ends = sorted_.groupBy("part").agg(F.max(page).alias("last"), F.min(page).alias("first"))
    parts = Window.orderBy("part")
    edges = ends.select("part", F.lag("last").over(parts).alias("before_part"),
                        F.lead("first").over(parts).alias("after_part"))

    def common(side: str):
        same = F.col(f"{side}.host") == F.col("host")
        length = F.length("path")
        start = F.aggregate(
            F.sequence(F.lit(1), F.greatest(length, F.lit(1))), F.lit(0),
            lambda known, at: F.when((known == at - 1) & (at <= length) & (
                F.substring(F.col("path"), at, F.lit(1)) == F.substring(F.col(f"{side}.path"), at, F.lit(1))
            ), at).otherwise(known))
        return F.when(same, start).otherwise(-1)

    return (
        sorted_.join(edges, "part")
        .withColumn("before", F.coalesce(F.lag(page).over(inside), "before_part"))
        .withColumn("after", F.coalesce(F.lead(page).over(inside), "after_part"))
        .where("NOT marked")
        .withColumn("start_before", F.coalesce(common("before"), F.lit(-1)))
        .withColumn("start_after", F.coalesce(common("after"), F.lit(-1)))
        .select("_row", "hashes", F.when(F.greatest("start_before", "start_after") >= 0, F.when(
            F.col("start_before") >= F.col("start_after"), F.col("before.hashes")).otherwise(F.col("after.hashes"))
        ).alias("other"))
    )


def _differences(pairs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        for batch in batches:
            own, other = batch.column("hashes").to_pylist(), batch.column("other").to_pylist()
            yield {"_row": batch.column(0), "shared": [shared_lines(a, b or []) for a, b in zip(own, other)]}

    return map_batches(pairs.select("_row", "hashes", "other"), work, "_row long, shared array<int>")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """``<id_col>, url, text, n_chars`` for every row.

    Defined cases: null and empty html give an empty text; a null URL belongs to the host without a name; rows that
    repeat id, URL and html are one page for pairing and get equal results; a page alone on its host keeps all
    its lines; an empty table gives an empty result; other columns are ignored.
    """
    row = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(url_col), F.lit("")),
                     utf8(html_col))
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), row.alias("_row"),
                        host.alias("host"), path.alias("path"), utf8(html_col).alias("_html"))
    parsed = _parsed(rows)
    keyed = parsed.select("_row", "host", "path", "marked", "hashes").dropDuplicates(["_row"])
    shared = _differences(neighbours(keyed))
    lines = F.when(F.col("shared").isNull() | (F.size("shared") == 0), F.col("lines")).otherwise(
        F.filter("lines", lambda line, at: ~F.array_contains("shared", at)))
    return (
        parsed.select("_id", "_url", "_row", "lines").join(shared, "_row", "left")
        .select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), F.array_join(lines, " ").alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
