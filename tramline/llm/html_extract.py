"""Main text of web pages by a site style tree.

Pages of one host are merged: a style node is a path of tags and classes from the root, with all pages that have it.

* Presentation importance: the entropy, over the pages with the node, of the sets of child styles directly below it.
* Content importance: one minus the mean entropy of the texts below it.  A text on n of the m pages with its own node has
  entropy log n / log m, so one that is on all of them has 1 and one of a single page 0.
* A node's importance is a weighted mean of both; 0 is a template, 1 is content of its page's own.

Evidence comes first: a branch that enough pages share and whose importance is low goes, whatever it is called.  What
is left goes if its element or role says that it is no article (nav, footer, aside, form, ...) or its class says advert or comment;
those differ from page to page, which no entropy can tell from an article.  Other telling classes (header, share, notice, ...) are
a prior only: a branch of high importance that is prose stays.  Where fewer than LEAST_PAGES pages have a node the tree knows
nothing, and the prior decides.  Pages with the same text count once, so a host full of copies doesn't look like a template.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, column_of, written

#: With at least LEAST_PAGES different pages, a branch under LOW is a template, one from HIGH on its page's own content.
LOW, HIGH, LEAST_PAGES = 0.7, 0.85, 4
#: Share of presentation in a node's importance; code points that a prose block has on average at least.
PRESENTATION, PROSE_CHARS = 0.1, 80

# Element names of HTML by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp svg math object".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th figure figcaption article main b i em strong span a body html center".split())
_DROPPED = frozenset("head nav footer aside form button select dialog menu canvas audio video fieldset label option".split())
_ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_OTHER_VOICES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side-bar|menu|nav|navbar|navigation|footer"
    r"|comments?|commentlist|disqus|respond|replies|reply|related|recommended|recommendations)(?:$|[\s_-])",
    re.I,
)
_PRIOR = re.compile(
    r"(?:^|[\s_-])(?:breadcrumbs?|header|masthead|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter"
    r"|subscribe|subscription|signup|sign-up|login|search|share|sharing|social|widget|toolbar|pagination|pager|skip|copyright|tags)(?:$|[\s_-])",
    re.I,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>",
    re.S,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_DIGITS = re.compile(r"\d+")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host_of(url):
    """Lower-case host of a URL column; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def blocks(page: str) -> list[tuple[tuple[str, ...], str, bool, bool, int]]:
    """Every text block in page order: path of style nodes, text, inside article or main, dropped by its name, and the
    depth of the outermost branch with a class of the prior (0: none)."""
    out: list[tuple[tuple[str, ...], str, bool, bool, int]] = []
    stack: list[tuple[str, tuple[str, ...], bool, bool, int]] = [("", (), False, False, 0)]
    held: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split()) if held else ""
        held.clear()
        if text:
            out.append((stack[-1][1], text, *stack[-1][2:]))

    def close(name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                if any(s[0] in _BLOCK for s in stack[k:]):
                    flush()
                del stack[k:]
                return

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = m["tag"] or m["tag2"]
        if name is None:
            if m[0].startswith("<![CDATA["):
                held.append(m[0][9:-3])
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            close(name)
            continue
        if name in _BLOCK:
            flush()
            for ended in _ENDS.get(name, "p" if name not in ("html", "head", "body") else "").split():
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == ended:
                        del stack[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "table", "dl", "select", "div", "section", "article") and ended != "p":
                        break
                    if stack[k][0] in ("div", "section", "article", "td", "li", "blockquote"):
                        break
        attrs = m["attrs"] if m["tag"] else m["attrs2"]
        if name in _RAW:
            if not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            held.append(" ")
            continue
        if name in _VOID:
            held.append(" ")
            continue
        if attrs.rstrip().endswith("/") and name not in _BLOCK:
            continue
        _, path, main, gone, doubt = stack[-1]
        sign = name
        if attrs.strip():
            own = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(attrs)}
            label = f"{own.get('class', '')} {own.get('id', '')}".strip()
            if label:
                sign += "." + _DIGITS.sub("0", ".".join(sorted(set(label.lower().split()))))
                if name not in ("html", "body", "article", "main"):
                    gone = gone or bool(_OTHER_VOICES.search(label))
                    doubt = doubt or (len(path) + 1 if _PRIOR.search(label) else 0)
            gone = gone or own.get("role", "").lower() in _ROLES or "hidden" in own or own.get("aria-hidden") == "true"
            gone = gone or "display:none" in own.get("style", "").replace(" ", "").lower()
        gone = gone or name in _DROPPED or (name == "header" and not main)
        stack.append((name, (*path, sign), main or name in ("article", "main"), gone, doubt))
    flush()
    return out


def _feature(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


_STYLE = pa.schema([("host", pa.string()), ("page", pa.int64()), ("path", pa.string()), ("below", pa.bool_()), ("feature", pa.int64())])
_STYLE_DDL = "host string, page long, path string, below boolean, feature long"


def page_features(page: str) -> tuple[int, set[tuple[str, bool, int]]]:
    """A digest of the page's text, and (path, below, feature): below, one row a node with its set of direct child styles;
    else one row for each text right under a node."""
    own = blocks(page)
    children: dict[tuple[str, ...], set[str]] = {}
    out: set[tuple[str, bool, int]] = set()
    for path, text, *_ in own:
        out.add((">".join(path), False, _feature(text)))
        children.setdefault(path, set())
        for k in range(len(path)):
            children.setdefault(path[:k], set()).add(path[k])
    out.update((">".join(path), True, _feature("|".join(sorted(below)))) for path, below in children.items() if path)
    return _feature("\n".join(b[1] for b in own)), out


def _style(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: set[tuple] = set()
        for host, page in zip(column_of(batch, "host").to_pylist(), column_of(batch, "html").to_pylist(), strict=True):
            digest, own = page_features(page or "")
            rows.update((host, digest, *r) for r in own)
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _STYLE, strict=True)], schema=_STYLE)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, content, presentation, importance) of every node of the hosts' style trees, inner nodes too.

    Everything is counted by (host, path, feature) with partial sums first, so a large host costs no single task.
    """
    seen = arrow_map(pages.select(host_of(F.col("url")).alias("host"), "html"), _style, _STYLE_DDL).distinct()
    counted = written(seen.groupBy("host", "path", "below", "feature").agg(F.count("*").alias("n")), "style")
    # Every page with a node has one row of child styles there, so their counts add up to the node's pages.
    shape = counted.where("below").groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("n_log_n"))
    log_m = F.log(F.greatest(F.col("pages"), F.lit(2)))
    alone = F.col("pages") < 2
    spread = (F.col("pages") * F.log("pages") - F.col("n_log_n")) / (F.col("pages") * log_m)
    shape = written(shape.select("host", "path", "pages", F.when(alone, 1.0).otherwise(F.greatest(F.lit(0.0), spread)).alias("presentation")), "shape")
    texts = counted.where("not below").groupBy("host", "path").agg(F.count("*").alias("texts"), F.sum(F.log("n")).alias("log_n"))
    entropy = F.when(alone, 0.0).otherwise(F.col("log_n") / log_m)
    texts = texts.join(shape.select("host", "path", "pages"), ["host", "path"]).select("host", "path", "texts", entropy.alias("entropy"))
    parts = F.split("path", ">")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ">"))
    under = texts.select("host", F.explode(prefixes).alias("path"), "texts", "entropy").groupBy("host", "path").agg(
        (1 - F.sum("entropy") / F.sum("texts")).alias("content")
    )
    importance = (1 - PRESENTATION) * F.col("content") + PRESENTATION * F.col("presentation")
    return shape.join(under, ["host", "path"]).withColumn("importance", importance)


def evidence(tree: DataFrame) -> DataFrame:
    """(host, low, own): paths that are templates, and paths with content of their pages' own."""
    known = tree.where((F.col("pages") >= LEAST_PAGES) & ((F.col("importance") < LOW) | (F.col("importance") >= HIGH)))
    paths = lambda test: F.sort_array(F.collect_set(F.when(test, F.col("path"))))
    return known.groupBy("host").agg(paths(F.col("importance") < LOW).alias("low"), paths(F.col("importance") >= HIGH).alias("own"))


def main_text(page: str | None, low: frozenset[str], own: frozenset[str] = frozenset()) -> str:
    """Blocks of the article (of the page, if it has none), without templates and other voices, joined by newlines."""
    found = blocks(page or "")
    length: dict[str, list[int]] = {}
    for path, text, _, _, doubt in found:
        if doubt:
            length.setdefault(">".join(path[:doubt]), []).append(len(text))

    def stays(path: tuple[str, ...], main: bool, gone: bool, doubt: int) -> bool:
        # Inside an article, prose goes only with a container of its own that is low, never for its own texts.
        ends = [k for k in range(1, len(path) + 1) if not (main and path[k - 1].split(".")[0] in _PROSE)] if low else []
        if any(">".join(path[:k]) in low for k in ends) or gone:
            return False
        if not doubt:
            return True
        branch = ">".join(path[:doubt])
        return branch in own and sum(length[branch]) >= PROSE_CHARS * len(length[branch])

    kept = [(text, main) for path, text, main, gone, doubt in found if stays(path, main, gone, doubt)]
    if any(main for _, main in kept):
        kept = [b for b in kept if b[1]]
    return "\n".join(text for text, _ in kept)


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            main_text(page, frozenset(low or ()), frozenset(own or ()))
            for page, low, own in zip(*(column_of(batch, c).to_pylist() for c in ("html", "low", "own")), strict=True)
        ]
        yield pa.record_batch(
            [column_of(batch, "page_id"), column_of(batch, "url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=_TEXT
        )


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Character references are decoded; white space inside a block becomes one space; blocks are joined by a newline.  A
    null or empty html gives an empty text, a null url a host of its own; repeated rows are extracted each.  An empty table
    gives no rows; other columns are ignored.  Two scans of the pages; the second meets the host's evidence, which is broadcast
    while small; beyond, Spark splits a hot host's pages.  Nodes on fewer than LEAST_PAGES pages have no evidence.
    """
    known = written(evidence(style_tree(pages)), "evidence").withColumnRenamed("host", "k_host")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    joined = rows.join(known, F.col("host") == F.col("k_host"), "left").select("page_id", "url", "html", "low", "own")
    return arrow_map(joined, _extracted, "page_id long, url string, text string, n_chars long")
