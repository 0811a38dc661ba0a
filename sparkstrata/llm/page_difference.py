"""Main text of web pages by nearest-URL page differencing.

Pages are paired by URL path within each host: a page's partner is the one of
the nearest pages of another path before and after it in path order whose path
has the longest common start. The text lines (blocks) of both are aligned by a
longest common subsequence, on every page. Lines that the pages share are the
site's and not the article's, and go. Of elements that the page itself marks as
articles those stay that the partner hasn't got as a whole, and these keep their
shared lines too, which two articles have. Elements whose tag, role, class or id says that they are menus, headers, footers,
sidebars, notices, adverts, forms or reader comments go as a whole, because such
parts may also differ from page to page.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkstrata.llm.common import arrow_schema, materialize, record_batch, sliced
from sparkstrata.llm.ordered import in_one_task, in_ranges

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content is no text.
RAW = {"script", "style", "title", "template", "textarea", "noscript", "iframe", "svg", "math", "object", "select", "button", "canvas", "audio", "video", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that begin and end a block of text.
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements whose open ones are tracked; others only mark up words.
CONTAINERS = BLOCKS - {"p", "hr", "li", "dd", "dt", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "h1", "h2", "h3", "h4", "h5", "h6"}
NOT_TEXT = {"nav", "footer", "aside", "form", "dialog", "menu"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Words of a class or id that name a part which is not the article.
PARTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "paywall", "menu", "nav", "navbar",
    "navigation", "breadcrumb", "breadcrumbs", "sidebar", "aside", "widget", "widgets", "related", "recommended", "recommendations", "share",
    "sharing", "social", "comment", "comments", "disqus", "reply", "replies", "respond", "footer", "masthead", "topbar", "toolbar", "newsletter",
    "subscribe", "subscription", "signup", "login", "search", "pagination", "pager", "copyright", "skip", "disclaimer",
}
#: With these words a class or id speaks of the page's frame around the article too.
FRAME = {"has", "with", "no", "without", "layout", "page", "wrapper", "container", "body", "site", "main", "content"}
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

SITE, OPEN, MARKED = 0, 1, 2  # not the article's; neither marked; inside the first marked article (3: the second, ...)


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(text)}


def _zone(tag: str, attributes: str, zone: int) -> int:
    """Zone of the content of an element inside ``zone``."""
    if zone == SITE or tag in NOT_TEXT:
        return SITE
    if tag == "header" and zone < MARKED:
        return SITE
    marked = max(zone, MARKED) if tag in ("article", "main") else zone
    if not attributes.strip() or tag in ("html", "body"):
        return marked
    own = _attributes(attributes)
    role = own.get("role", "").lower()
    style = own.get("style", "").replace(" ", "").lower()
    if role in ROLES or "hidden" in own or "display:none" in style:
        return SITE
    names = {x.lower() for x in NAMES.findall(f"{own.get('class', '')} {own.get('id', '')}")}
    if names & PARTS and (not names & FRAME or names & {"comment", "comments", "cookie", "ad", "ads"}) and tag != "main":
        return SITE
    return max(zone, MARKED) if role in ("main", "article") or own.get("itemprop") == "articleBody" else marked


def lines(page: str) -> list[tuple[str, int]]:
    """(text, zone) of each non-empty block in page order: references decoded, white space runs made one space.

    Marked elements are numbered from ``MARKED`` on: the outermost ones, and
    articles inside one that is no article.
    """
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    stack: list[tuple[str, int, bool]] = []
    zone, at, n = OPEN, 0, len(page)
    inside, number = False, MARKED  # in an article; the next marked element's number

    def end_block() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append((text, zone))

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                buffer.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, closes = m[2].lower(), bool(m[1])
        if tag in RAW and not closes:
            end = re.compile(rf"</{tag}\b[^>]*>" if tag != "head" else r"</head\s*>|<body\b", re.I).search(page, at)
            if not m[3].endswith("/"):
                if end is not None:
                    at = end.start() if end[0][1] != "/" else end.end()
                elif tag not in ("head", "select", "button", "object", "noscript"):
                    at = n
            if tag == "button" or tag == "select":
                buffer.append(" ")
            continue
        if tag in BLOCKS:
            end_block()
        elif tag == "br":
            buffer.append(" ")
        if tag not in CONTAINERS or tag in VOID:
            continue
        if not closes:
            if not m[3].endswith("/") or tag == "article":
                stack.append((tag, zone, inside))
                outer, zone = zone, _zone(tag, m[3], zone)
                if zone >= MARKED and (outer < MARKED or tag == "article" and not inside):
                    zone, number, inside = number, number + 1, tag == "article"
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    _, zone, inside = stack[k]
                    del stack[k:]
                    break
    end_block()
    return out


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    start, end_a, end_b = 0, len(a), len(b)
    while start < min(end_a, end_b) and a[start] == b[start]:
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    out = {*range(start), *range(end_a, len(a))}
    where: dict[int, list[int]] = {}
    for j in range(end_b - 1, start - 1, -1):
        where.setdefault(b[j], []).append(j)
    tails: list[int] = []  # least last position in b of a common subsequence of each length
    nodes: list[tuple] = []
    for i in range(start, end_a):
        for j in where.get(a[i], ()):
            k = bisect.bisect_left(tails, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[k], nodes[k] = j, node
    node = nodes[-1] if nodes else None
    while node:
        out.add(node[0])
        node = node[1]
    return out


def _common_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def kept_lines(zones: list[int], hashes: list[int], partner: list[int] | None) -> list[bool]:
    """Which lines of a page stay, by its difference from the partner (no lines: it has none).

    The lines stay that are no named part of the site and that the partner
    hasn't got. Where the page marks articles, those stay of which such a line
    is left, with their shared lines and without what lies outside them. If
    the partner has all lines, or all articles, the pages are copies and nothing
    is taken away for that.
    """
    shared = common_lines(hashes, partner) if partner else set()
    left = [z != SITE and k not in shared for k, z in enumerate(zones)]
    if articles := {z for z in zones if z >= MARKED}:
        own = {z for z, stays in zip(zones, left) if stays and z >= MARKED} or articles
        return [z in own for z in zones]
    return left if any(left) else [z != SITE for z in zones]


#: Pages of one path that wait in memory for the next path.
WAITING = 256


def _nearest(host: str, path: str, others: list[tuple | None]) -> list[int] | None:
    """Line hashes of the page (host, path, hashes) of the same host whose path has the longest common start, the first of equals."""
    best = None
    for x in others:
        if x and x[0] == host and x[1] != path:
            n = _common_start(x[1], path)
            if best is None or n > best[0]:
                best = (n, x[2])
    return best[1] if best else None


def _hashes(blob: bytes) -> list[int]:
    return np.frombuffer(blob, np.uint64).tolist()


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page from its whole html.

    Null html is empty and gives an empty text. Pages without a url, or with one
    that names no host, belong to one host without name and have no partner
    unless their paths differ. Pages with the same path and query of a host are
    no partners, so the nearest others before and after them are; of two that
    are equally near the one before is taken. Repeated pages are each extracted.
    Tags that never end, or that end what wasn't begun, are passed over, and text
    after an unclosed script or comment is no text. No rows give no rows.

    Pages are parsed where they lie, and hashes of their lines are dealt by
    ranges of host and path. Pages that wait for a path of another range, or of
    whose path there are many, are passed on, and get their partners from the
    ends of the ranges. What comes back for each page says which of its lines
    stay, and these are read from the page itself.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^#]*)", 1)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page_id, own_url = F.col("page_id").cast("long"), F.col("url").cast("string")
    # rows that agree on both are one page, whose lines stay or go alike
    ids = (F.xxhash64(html).alias("hash"), F.xxhash64(page_id, F.lit("of"), own_url).alias("place"))
    keyed = pages.select(host.alias("host"), path.alias("path"), page_id.alias("page_id"), *ids, html.alias("html"))
    columns = "page_id long, url string, text string, n_chars long"
    # kind 0: a result; 1: a page that waits; 2: an end of a range; 3: a page after many of one path
    read = "page_id long, host string, path string, hash long, place long, hashes binary, zones binary"
    decided = "hash long, place long, stays binary"
    schema = f"{decided}, kind int, part int, run long, side int, host string, path string, hashes binary, zones binary, before_path string, before binary"
    arrow, plain, parsed_as, stays_as = arrow_schema(schema), arrow_schema(columns), arrow_schema(read), arrow_schema(decided)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 256):
            hashes, zones = [], []
            for page in part.column("html").to_pylist():
                own = lines(page)
                hashes.append(np.array([xxhash.xxh64_intdigest(t) for t, _ in own], np.uint64).tobytes())
                zones.append(np.array([z for _, z in own], np.int32).tobytes())
            yield record_batch({k: part.column(k) for k in parsed_as.names[:5]} | {"hashes": hashes, "zones": zones}, parsed_as)

    def stays(zones: bytes, hashes: list[int], partner: list[int] | None) -> bytes:
        return np.packbits(np.array(kept_lines(np.frombuffer(zones, np.int32).tolist(), hashes, partner), bool)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held: list[dict] = []  # pages of the path at hand, which wait for the next path
        before: list[dict | None] = [None, None]  # the last pages of the two paths before
        row: dict | None = None
        part, number, many = 0, -1, False

        def batch() -> pa.RecordBatch:
            out = record_batch({k: [r.get(k) for r in rows] for k in arrow.names}, arrow)
            rows.clear()
            return out

        def known(x: dict | None) -> tuple | None:
            return x and (x["host"], x["path"], _hashes(x["hashes"]))

        def end(x: dict, side: int, n: int, kind: int = 2) -> None:
            rows.append({"kind": kind, "part": part, "run": n, "side": side, "host": x["host"], "path": x["path"], "hashes": x["hashes"]})

        def wait() -> None:
            """Pass on the pages that wait."""
            last = before[1]
            for x in held:
                own = {k: x[k] for k in ("hash", "place", "host", "path", "hashes", "zones")}
                rows.append(own | {"kind": 1, "part": part, "run": number, "before_path": last and last["host"] + "\x00" + last["path"], "before": last and last["hashes"]})
            held.clear()

        def next_path(x: dict) -> None:
            nonlocal before, number, many
            if row is not None:
                if number == 0:
                    wait()
                near = [known(before[1]), known(x)]
                for y in held:
                    partner = _nearest(y["host"], y["path"], near)
                    rows.append({"hash": y["hash"], "place": y["place"], "stays": stays(y["zones"], _hashes(y["hashes"]), partner), "kind": 0})
                held.clear()
                if many or number == 0:
                    end(x, 1, number, 3)
                before = [before[1], row]
            number, many = number + 1, False
            if number < 2:
                end(x, number, number)

        for b in sliced(batches, 256):
            for x in b.to_pylist():
                part = x["part"]
                if row is None or (x["host"], x["path"]) != (row["host"], row["path"]):
                    next_path(x)
                row = x
                held.append(x)
                if len(held) >= WAITING:
                    wait()
                    many = True
            if rows:
                yield batch()
        if row is not None:
            wait()
            end(row, 3, number)
            if before[1] is not None:
                end(before[1], 2, number - 1)
            yield batch()

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For the first and the last path of each range, the nearest page of another path in the ranges before and after."""
        ends: dict[int, list[tuple]] = {}
        for b in batches:
            for x in b.to_pylist():
                ends.setdefault(x["part"], []).append((x["side"], x["run"], x["host"], x["path"], x["hashes"]))
        order = sorted(ends)
        out = arrow_schema(found)
        for k, p in enumerate(order):
            own = sorted(ends[p])
            for (side, n, host, path, _), others, wanted in ((own[0], order[:k][::-1], (3, 2)), (own[-1], order[k + 1 :], (0, 1))):
                hit = next((y for q in others for w in wanted for y in sorted(ends[q]) if y[0] == w and y[2:4] != (host, path)), None)
                if hit:
                    yield record_batch({"part": [p], "run": [n], "after": [wanted[0] == 0], "at": [hit[2] + "\x00" + hit[3]], "its": [hit[4]]}, out)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.to_pylist():
                near = [(*at.split("\x00", 1), _hashes(its)) for at, its in ((x["before_path"], x["before"]), (x["after_path"], x["after"])) if at is not None]
                rows.append((x["hash"], x["place"], stays(x["zones"], _hashes(x["hashes"]), _nearest(x["host"], x["path"], near))))
            if rows:
                yield record_batch(dict(zip(stays_as.names, zip(*rows))), stays_as)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 256):
            found = []
            for page, bits in zip(b.column("html").to_pylist(), b.column("stays").to_pylist()):
                own = lines(page)
                keep = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).tolist()
                found.append("\n\n".join(t for (t, _), k in zip(own, keep) if k))
            yield record_batch({"page_id": b.column("page_id"), "url": b.column("url"), "text": found, "n_chars": list(map(len, found))}, plain)

    found = "part int, run long, after boolean, at string, its binary"
    parsed = keyed.mapInArrow(parse, read)
    dealt = in_ranges(materialize(parsed, "lines"), ["host", "path", "page_id", "hash"], ["place"])
    done = materialize(dealt.mapInArrow(run, schema), "pages")
    far = in_one_task(done.where("kind = 2").select("part", "run", "side", "host", "path", "hashes"), "part", "side").mapInArrow(partners, found)
    near = done.where("kind = 3").select("part", "run", F.lit(True).alias("after"), F.concat("host", F.lit("\x00"), "path").alias("at"), F.col("hashes").alias("its"))
    both = far.unionByName(near)
    one = lambda after, at, its: both.where("after" if after else "not after").select("part", "run", F.col("at").alias(at), F.col("its").alias(its))
    waiting = done.where("kind = 1").withColumnsRenamed({"before_path": "own_path", "before": "own_before"})
    waiting = waiting.join(one(False, "far_path", "far"), ["part", "run"], "left").join(one(True, "after_path", "after"), ["part", "run"], "left")
    waiting = waiting.withColumn("before_path", F.coalesce("own_path", "far_path")).withColumn("before", F.coalesce("own_before", "far"))
    late = waiting.select("hash", "place", "host", "path", "hashes", "zones", "before_path", "before", "after_path", "after").mapInArrow(finish, decided)
    each = done.where("kind = 0").select(*stays_as.names).unionByName(late).groupBy("hash", "place").agg(F.min("stays").alias("stays"))
    whole = pages.select(page_id.alias("page_id"), own_url.alias("url"), html.alias("html"), *ids)
    return whole.join(each, ["hash", "place"]).select("page_id", "url", "html", "stays").mapInArrow(cut, columns)
