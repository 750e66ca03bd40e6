"""Main text of web pages by differencing each page with its nearest neighbour.

Pages of a host are put in order of their URL paths, and each is paired with the one of its
two neighbours whose path has the longer beginning in common (the earlier one of equals).
Pages of a host with the same lines count as one, so that a page isn't compared with another
crawl of itself. The text lines of a pair are aligned by a longest common subsequence; lines
that both pages share are the site's template and are deleted.

Differencing alone would also delete what two articles have in common, and keep a menu that
differs from page to page. The page's own markup therefore has a veto, both ways: a shared
line stays inside an article or main element unless the other page has it where markup
says nothing, and lines inside navigation, forms, adverts and the like go even if they
aren't shared. Where an
article or main element holds the bulk of what is left, the rest goes too.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrilith.llm.common import slices, strings
from metrilith.operators.tables import Scratch

#: A comment or a tag. An attribute's quotes may hold anything; outside of them a tag ends
#: before the next "<", so that broken ones cost no search to the page's end; what looks like
#: a tag up to there is markup even if no ">" ends it.
_TAG = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<[/!?a-zA-Z][^<>]*+>|</?[a-zA-Z][^<>]*+(?=<)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is no article text.
DROPPED = frozenset("aside button canvas dialog footer form head iframe menu nav noscript object script select style svg template textarea title".split())
#: Of these, the ones whose content isn't markup.
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark what isn't the article.
MARKS = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu menubar modal nav navbar navigation newsletter notice pagination popup promo related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar topbar topmenu widget".split())
_ROLES = frozenset("banner complementary contentinfo navigation search".split())
#: Words that turn a mark into a remark on the page's layout.
_LAYOUT = frozenset("body content has is layout main no not page with without wrap wrapper".split())
#: Words beside which a mark in the same name stays one; beside others the name is about something else.
_BESIDE = frozenset("a area article articles bar block bottom box button buttons col column container desktop fixed form global group icons inner item items label left link links list media mobile news outer overlay panel policy popular post posts primary right row secondary section short site slot stories story text thread title top unit user web".split())
#: Names, without hyphens, of what stands above an article; inside one they are part of it.
_ABOVE = frozenset("header siteheader pageheader globalheader topheader topbar topnav topmenu menubar".split())
#: Elements that end without an end tag, and the elements whose beginning ends them; a p ends where any block begins.
_IMPLIED = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}}
#: What markup says of a line: it isn't the article's, nothing, it is the article's.
OUTSIDE, OPEN, INSIDE = 0, 1, 2
_RAW_END = {name: re.compile(rf"</{name}\b[^<>]*+>", re.I) for name in RAW}


def _marked(attributes: str, body: bool, main: int) -> bool:
    """Whether a class, id or role says that an element isn't the article's.

    A name counts if its words are marks and words that may stand beside them: "share-links"
    is one, "share-prices" isn't. An article or main element needs a mark for its whole name,
    as its class may hold the article's subjects.
    """
    for found in _ATTRIBUTE.findall(attributes):
        for token in "".join(found).lower().split():
            if body:
                if token in MARKS:
                    return True
                continue
            words = set(_WORD.findall(token))
            if token in _ROLES or words & MARKS and not words & _LAYOUT and words <= MARKS | _BESIDE:
                return True
            if not main and token.replace("-", "").replace("_", "") in _ABOVE:
                return True
    return False


def text_lines(page: str) -> list[tuple[str, int]]:
    """The text blocks of a page, and what markup says of each.

    An element that is marked by its class ends to be so where an article or main element
    begins in it: wrappers are often named after one of their parts.
    """
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    dropped: str | None = None
    by_name = False
    depth = main = inner = 0
    at, n = 0, len(page)

    def close():
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, OUTSIDE if dropped else INSIDE if main else OPEN))
        parts.clear()

    while at < n:
        m = _TAG.search(page, at)
        end = m.start() if m else n
        if end > at:
            parts.append(page[at:end])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        closing = bool(m[1])
        body = name in ("article", "main")
        if name in BLOCKS or name == dropped:
            close()
        if dropped in _IMPLIED and name in BLOCKS:
            # an element of this kind ends by its own end tag, by what begins after it or by the end of what it stands in
            around = name == dropped or name not in _IMPLIED or name == "tr" and dropped in ("td", "th")
            if not inner and (around if closing else name in _IMPLIED[dropped]):
                dropped = None
                if name in _IMPLIED and closing:
                    continue
            elif name not in _IMPLIED:
                inner += -1 if closing else 1
        if dropped:
            if name == dropped and dropped not in _IMPLIED and not m[0].endswith("/>"):
                depth += -1 if closing else 1
                if not depth:
                    close()
                    dropped = None
            elif body and not by_name and not closing and not _marked(m[3] or "", True, main):
                dropped = None
                main += 1
            elif name in RAW and not closing:
                stop = _RAW_END[name].search(page, at)
                at = stop.end() if stop else n
            continue
        if closing:
            if body and main:
                main -= 1
            continue
        if name in VOID or m[0].endswith("/>"):
            continue
        marked = bool(m[3]) and name not in ("html", "body") and "articlebody" not in m[3].lower() and _marked(m[3], body, main)
        if body and not marked:
            main += 1
        elif name in RAW:
            close()
            stop = _RAW_END[name].search(page, at)
            at = stop.end() if stop else n
        elif name in DROPPED or name == "header" and not main or marked:
            close()
            dropped, depth, inner, by_name = name, 1, 0, name in DROPPED or name == "header"
    close()
    return out


def _lengths(a: list, b: list) -> list[int]:
    """For each beginning of `b` the length of its longest common subsequence with `a`, by bit rows."""
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        u = row & places.get(x, 0)
        row = (row + u | row - u) & full
    out, total = [0], 0
    for j in range(len(b)):
        total += not row >> j & 1
        out.append(total)
    return out


def common_lines(a: list, b: list) -> list[int]:
    """Places in `a` of a longest common subsequence with `b`, in linear memory.

    Equal beginnings and ends are matched first and what only one side has is left out;
    the rest is halved at the place of `b` where both halves together are longest.
    """
    out: list[int] = []
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    out += range(first)
    tail = range(len(a) - last, len(a))
    known = set(b[first : len(b) - last]) & set(a[first : len(a) - last])
    at = [k for k in range(first, len(a) - last) if a[k] in known]
    stack = [(at, [x for x in b[first : len(b) - last] if x in known])]
    middle: list[int] = []
    while stack:
        own, other = stack.pop()
        if not own or not other:
            continue
        if len(own) == 1:
            middle += own if a[own[0]] in other else []
            continue
        half = len(own) // 2
        left = _lengths([a[k] for k in own[:half]], other)
        right = _lengths([a[k] for k in reversed(own[half:])], other[::-1])
        cut = max(range(len(other) + 1), key=lambda j: left[j] + right[len(other) - j])
        stack += [(own[:half], other[:cut]), (own[half:], other[cut:])]
    return [*out, *sorted(middle), *tail]


def removed_lines(own: list, kinds: list, theirs: list, their_kinds: list) -> list[int]:
    """Places of the lines in `own` that a longest common subsequence shares with `theirs`.

    A line inside an article or main element goes only if the other page's markup leaves it
    open: both articles may hold it, and an advert may quote one.
    """
    gone, j = [], 0
    for k in common_lines(own, theirs):
        while theirs[j] != own[k]:  # the subsequence stands in `theirs` in order
            j += 1
        if kinds[k] != INSIDE or their_kinds[j] == OPEN:
            gone.append(k)
        j += 1
    return gone


def main_text(lines: list[tuple[str, int]], gone=()) -> str:
    """The lines that are left once shared ones are gone and markup has had its say."""
    left = [(t, kind) for k, (t, kind) in enumerate(lines) if kind != OUTSIDE and k not in gone]
    inside = sum(len(t) for t, kind in left if kind == INSIDE)
    if inside and 2 * inside >= sum(len(t) for t, _ in left):
        left = [x for x in left if x[1] == INSIDE]
    return "\n".join(t for t, _ in left)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user and port; null if it has none."""
    found = F.lower(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def path_of(url: Column) -> Column:
    """Path and query of a URL, without the fragment."""
    return F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)


def nearest_pages(pages: DataFrame, kept: Scratch) -> DataFrame:
    """(node, other): for each content of a host its neighbour in the host's order of paths.

    `pages` has node, host and path. The order is one distributed sort of the paths; places
    in it are numbered from the sizes of its parts, and neighbours meet in joins on those
    numbers, so that a host of any size stays spread out. Pages without a host and a
    host's only content have no neighbour.
    """
    keys = pages.filter("host is not null").groupBy("host", "node").agg(F.min("path").alias("path"))
    keys = kept.write(keys.orderBy("host", "path", "node").withColumn("at", F.monotonically_increasing_id()), "page-order")
    part = F.shiftright("at", 33)
    before, offsets = 0, []
    for k, n in sorted(keys.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):  # one row for each task
        offsets.append((k, before))
        before += n
    offsets = keys.sparkSession.createDataFrame(offsets, "part bigint, before bigint")
    placed = keys.withColumn("part", part).join(F.broadcast(offsets), "part").select("host", "path", "node", (F.col("before") + F.col("at") - F.shiftleft("part", 33)).alias("place"))
    two = placed.select(F.col("host").alias("host2"), F.col("path").alias("path2"), F.col("node").alias("node2"), (F.col("place") - 1).alias("place"))
    met = placed.join(two, "place").filter("host = host2")
    # the length of the common beginning: up to the first place that differs
    n = F.least(F.length("path"), F.length("path2"))
    same = F.coalesce(F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substring("path", k, F.lit(1)) == F.substring("path2", k, F.lit(1))), False), F.lit(0))
    met = met.select("host", "node", "node2", F.when(same == 0, n).otherwise(same - 1).alias("same"))
    each = met.select("host", "node", F.col("node2").alias("other"), "same", F.lit(0).alias("before")).unionByName(met.select("host", F.col("node2").alias("node"), F.col("node").alias("other"), "same", F.lit(1).alias("before")))
    return each.groupBy("host", "node").agg(F.max_by("other", F.struct("same", "before")).alias("other"))


_PARSED = "row bigint, host string, path string, node bigint, hashes array<bigint>, kinds array<int>"


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_lines, n_shared) of every row of `pages`.

    Text is the kept lines joined by line ends: empty for a null or empty page. n_lines
    counts all text lines, n_shared those that differencing deletes. Repeated rows give a
    row each; a page without a neighbour keeps what markup lets stand. Rows are told apart
    by page_id, url and content, and any of these may be null.

    Pages are read twice, once for the hashes of their lines and once for the text, and
    only hashes are shuffled: that costs less than keeping or moving the lines.
    """
    kept = Scratch(pages.sparkSession, "pages")
    text = F.col("html").cast("string")
    row = F.xxhash64(F.col("page_id").cast("bigint"), F.col("url").cast("string"), text).alias("row")
    rows = pages.select(row, F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), text.alias("html"))

    def parse(batches):
        for batch in slices(batches, "html"):
            found = [text_lines(x) for x in strings(batch.column("html"))]
            hashes = [[xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) for t, _ in x] for x in found]
            node = [xxhash.xxh64_intdigest(repr(h)) - (1 << 63) for h in hashes]
            kinds = [[k for _, k in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("host"), batch.column("path"), pa.array(node, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(kinds, pa.list_(pa.int32()))], names=["row", "host", "path", "node", "hashes", "kinds"])

    def differ(batches):
        for batch in batches:
            nodes, hosts, gone = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("host", "node", "hashes", "kinds", "theirs", "their_kinds"))
            for host, node, *lines in zip(*columns, strict=True):
                if found := removed_lines(*lines):
                    hosts.append(host), nodes.append(node), gone.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(nodes, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["host", "node", "gone"])

    def finish(batches):
        for batch in slices(batches, "html"):
            text, n_lines, n_shared = [], [], []
            for page, gone in zip(strings(batch.column("html")), batch.column("gone").to_pylist(), strict=True):
                lines, gone = text_lines(page), set(gone or ())
                text.append(main_text(lines, gone)), n_lines.append(len(lines)), n_shared.append(len(gone))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(n_lines, pa.int32()), pa.array(n_shared, pa.int32())], names=["page_id", "url", "text", "n_lines", "n_shared"])

    keyed = rows.select("row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    parsed = kept.write(keyed.mapInArrow(parse, _PARSED), "parsed")
    pairs = nearest_pages(parsed.select("host", "path", "node"), kept)
    lines = parsed.groupBy("host", "node").agg(F.min("hashes").alias("hashes"), F.min("kinds").alias("kinds"))
    theirs = lines.select("host", F.col("node").alias("other"), F.col("hashes").alias("theirs"), F.col("kinds").alias("their_kinds"))
    both = pairs.join(lines, ["host", "node"]).join(theirs, ["host", "other"])
    decided = both.select("host", "node", "hashes", "kinds", "theirs", "their_kinds").mapInArrow(differ, "host string, node bigint, gone array<int>")
    gone = kept.write(parsed.select("row", "host", "node").distinct().join(decided, ["host", "node"]).groupBy("row").agg(F.min("gone").alias("gone")), "gone")
    kept.drop(parsed)
    return rows.join(gone, "row", "left").mapInArrow(finish, "page_id bigint, url string, text string, n_lines int, n_shared int")
