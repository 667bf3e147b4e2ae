"""Main text of web pages by a site style tree.

Pages of a host are merged in one style tree: a node is a style path (tags with their classes from the body down), and
holds the child layouts that pages show there and the contents of its text blocks. The importance of a node is an entropy: of
its layouts (presentation) and of its contents, each over the pages of the host that have the node, as a share of the largest
possible. A menu that is the same on every page has next to none; a branch whose presentation and content both fall
below ``LEAST_IMPORTANCE`` over at least ``LEAST_PAGES`` pages is removed from each page of the host. A host whose pages are
alike as a whole shows nothing about their parts, so nothing is removed there: a mirrored article isn't taken for a menu.

A host with few pages gives no evidence, so nodes have a prior as well: elements that are never content (script, style,
nav, form and the like) and elements whose class, id or role names them as menu, advert, notice or comments weigh 0, the
page's own article or main element weighs 1, and all else 0.5. All pages of a host are in its tree, and importance counts by weight: a
branch of an article goes at half the importance at which another one goes, and a block beside an article stays where the
tree has found it important on at least ``LEAST_PAGES`` pages.

Defined results: null and empty html give the empty text, broken or unclosed markup is read as far as it goes, pages
without any text give the empty text; repeated pages repeat their result and count as pages of their host; every page is read whole, of
any length; a null url is of the host without a name. An empty table gives an empty result. Branches of equal importance are judged
alike, so there are no ties. Other columns pass through, but for one named like the text's, which is replaced; names that begin with
two underscores are kept for the way there.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Set
from types import MappingProxyType

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import stored

LEAST_PAGES = 4
LEAST_IMPORTANCE = 0.35
#: Verdicts of the trees are broadcast when they are no more than this; else pages meet them in a join.
MAX_BROADCAST_ROWS = 100_000

PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|noscript|template|iframe|svg|select|textarea|object|title|head)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?:.*?</(?P=raw)\s*>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/)?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")

#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSE_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption html body legend summary".split())
NEVER = frozenset("nav footer aside form menu button dialog input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner menu menus nav navbar navigation breadcrumb breadcrumbs sidebar rail footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay subscribe subscription newsletter signup login share sharing social related recommended recommendations teaser teasers comment comments disqus reply replies respond responses widget widgets toolbar pagination pager disclaimer copyright skip toc tags complementary contentinfo search".split()
)
#: Names that make an element noise even if it is named as content too.
STRONG_NOISE = frozenset("ad ads adv advert adverts advertisement sponsor sponsored nav navbar menu footer cookie cookies comment comments reply replies related recommended newsletter teaser teasers promo share social".split())
CONTENT = frozenset("content article post entry story text body".split())
HEADERS = frozenset(["header"])
MAIN_NAMES = frozenset(["main", "article"])


class Node:
    __slots__ = ("importance", "path", "tag")

    def __init__(self, tag: str, path: str, importance: float):
        self.tag, self.path, self.importance = tag, path, importance


def _names(attrs: str) -> tuple[set[str], set[str], str, bool]:
    """Parts of the names in class, id and role; these names; the classes; whether the element is hidden."""
    parts: set[str] = set()
    whole: set[str] = set()
    classes, hidden = "", False
    if not attrs or attrs.isspace():
        return parts, whole, classes, hidden
    for key, *values in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            hidden = True
        elif key in ("class", "id", "role"):
            parts.update(p.lower() for p in NAME_PARTS.findall(value))
            whole.update(value.lower().split())
            if key == "class":
                classes = ".".join(sorted(value.lower().split()))
    return parts, whole, classes, hidden


def blocks(page: str) -> list[tuple[str, float, str]]:
    """Text blocks in page order: style path, prior importance (0, 1, or 0.5 where the tree decides) and text."""
    out: list[tuple[str, float, str]] = []
    stack: list[Node] = [Node("", "", 0.5)]
    held: list[str] = []
    at = 0
    block = stack[0]

    def flush() -> None:
        nonlocal held
        if held:
            text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                out.append((block.path, block.importance, text))
            held = []

    for match in PIECE.finditer(page):
        if match.start() > at and stack[-1].importance > 0:
            held.append(page[at : match.start()])
        at = match.end()
        if match["raw"]:
            if match["raw"].lower() not in ("head", "title"):
                held.append(" " if held else "")
            continue
        tag = match["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            held.append(" ")
            continue
        if match["end"]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                if any(n.tag in BLOCKS for n in stack[depth:]):
                    flush()
                del stack[depth:]
                block = next(n for n in reversed(stack) if n.tag in BLOCKS or not n.tag)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        parts, whole, classes, hidden = _names(match["attrs"])
        if tag in CLOSE_P and (depth := next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in BLOCKS), 0)) and stack[depth].tag == "p":
            flush()
            del stack[depth:]
        parent = stack[-1]
        inside = any(n.tag in MAIN_NAMES and n.importance == 1 for n in stack)
        named = STRONG_NOISE if inside or tag in MAIN_NAMES or parts & CONTENT else NOISE
        if hidden or inside and whole & NOISE and not parts & CONTENT or parts & named and tag not in ("html", "body"):
            importance = 0.0
        elif tag in MAIN_NAMES or "main" in parts and tag in ("div", "section") and not inside:
            noise = any(n.importance == 0 and n.tag not in NEVER for n in stack)
            importance = 0.0 if noise else 1.0
        elif tag in NEVER or (tag in HEADERS or "header" in parts) and not inside:
            importance = 0.0
        elif inside and parent.importance == 1 and tag in HEADERS:
            importance = 1.0
        else:
            importance = parent.importance
        node = Node("main" if importance == 1 and tag in ("div", "section") and "main" in parts else tag, f"{parent.path}/{tag}{'.' + classes if classes else ''}", importance)
        if tag in BLOCKS:
            flush()
        if match["attrs"].endswith("/") and tag not in BLOCKS:
            continue
        stack.append(node)
        if tag in BLOCKS:
            block = node
    if at < len(page) and stack[-1].importance > 0:
        held.append(page[at:])
    flush()
    return out


def importance(layouts: list[int], contents: list[int]) -> float:
    """The larger of the presentation's and the content's entropy, each as a share of the largest for so many pages."""

    def entropy(counts: list[int]) -> float:
        total = sum(counts)
        return -sum(c / total * math.log(c / total) for c in counts) / math.log(total) if total > 1 else 1.0

    return max(entropy(layouts), entropy(contents))


def main_text(page: str, removed: Mapping[str, float] = MappingProxyType({}), kept: Set[str] = frozenset()) -> str:
    """Text of the page's main part: what the priors and the tree leave.

    ``removed`` has the importance of the branches that the tree finds low; ``kept`` has what stays beside an article.
    """
    found = blocks(page)
    marked = any(w == 1 for _, w, _ in found)
    texts = []
    for path, weight, text in found:
        if not weight or marked and weight < 1 and path not in kept:
            continue
        if not any(_below(path, r) and 2 * weight * low < LEAST_IMPORTANCE for r, low in removed.items()):
            texts.append(text)
    return "\n".join(texts)


def _below(path: str, branch: str) -> bool:
    return path == branch or path.startswith(branch + "/")


def _told(rows: list) -> tuple[dict[str, float], frozenset[str]]:
    """Verdicts of a host as ``main_text`` takes them."""
    low = {r["path"]: r["importance"] for r in rows if r["importance"] < LEAST_IMPORTANCE}
    return low, frozenset(r["path"] for r in rows if r["path"] not in low)


def host_column(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, "(?s)\\A.*?://([^/?#]*)", 1), F.lit("")))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, path, pages, importance, outside`` of the nodes that priors leave, over all pages; ``outside``: it has blocks beside an article.

    Tasks count (host, path, layout, content) before the shuffle; a hot host is many such keys, and a key is a sum.
    """
    schema = "host string, path string, kind int, value long, pages long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = blocks(page or "")
                marked = any(w == 1 for _, w, _ in found)
                nodes: dict[str, list[str]] = {}
                for path, w, text in found:
                    if w > 0:
                        nodes.setdefault(path, []).append(text)
                for path in {p for p, w, _ in found if marked and 0 < w < 1}:
                    seen[host, path, 2, 0] += 1
                # every branch above a block has the blocks' layout and content too
                branches: dict[str, tuple[list, list]] = {}
                for path, texts in nodes.items():
                    steps = path.split("/")
                    number = _number("\n".join(texts))
                    for i in range(2, len(steps) + 1):
                        a, b = branches.setdefault("/".join(steps[:i]), ([], []))
                        a.append((steps[i:], len(texts)))
                        b.append(number)
                for path, (layout, content) in branches.items():
                    seen[host, path, 0, _number(str(layout))] += 1
                    seen[host, path, 1, _number(str(content))] += 1
                if len(seen) > 200_000:
                    yield _rows(seen)
                    seen = Counter()
        yield _rows(seen)

    parsed = pages.select(host_column(F.col(url_col)).alias("host"), html_col).mapInArrow(run, schema)
    counted = parsed.groupBy("host", "path", "kind", "value").agg(F.sum("pages").alias("n"))
    log_sum = counted.groupBy("host", "path", "kind").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s"), F.count(F.lit(1)).alias("distinct"))
    entropy = F.when(F.col("pages") > 1, (F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages")).otherwise(1.0)
    per_node = log_sum.withColumn("e", entropy).groupBy("host", "path")
    return per_node.agg(F.max(F.when(F.col("kind") < 2, F.col("pages"))).alias("pages"), F.max(F.when(F.col("kind") < 2, F.col("e"))).alias("importance"), (F.max("kind") == 2).alias("outside"))


def _number(text: str) -> int:
    import zlib

    data = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) << 31 | zlib.adler32(data) >> 1


def _rows(seen: Counter) -> pa.RecordBatch:
    keys = list(seen)
    columns = [[k[i] for k in keys] for i in range(4)]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["host", "path", "kind", "value", "pages"])


def verdicts(tree: DataFrame, least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """``host, path, importance`` of the branches that the tree finds low, and of important ones beside articles, on hosts whose pages differ as a whole."""
    differs = tree.where((F.length("path") - F.length(F.translate("path", "/", "")) == 1) & (F.col("importance") >= least_importance)).select(F.col("host").alias("__host")).distinct()
    told = tree.where((F.col("pages") >= least_pages) & ((F.col("importance") < least_importance) | F.col("outside")))
    return told.join(differs, told.host == F.col("__host"), "left_semi").select("host", "path", "importance")


def extracted(pages: DataFrame, keep: list[str] | None = None, url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` (or the columns ``keep``) with the main text of each page."""
    spark = pages.sparkSession
    low = stored(verdicts(stored(style_tree(pages, url_col, html_col), "tree")), "verdicts")
    small = low.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    keep = [c for c in (pages.columns if keep is None else keep) if c != text_col]
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField(text_col, T.StringType())])
    source = pages.select(*keep, host_column(F.col(url_col)).alias("__host"), F.col(html_col).alias("__html"))
    told = F.collect_set(F.struct("path", "importance"))
    table: dict[str, tuple[dict[str, float], frozenset[str]]] = {}
    if small:
        for row in low.groupBy("host").agg(told.alias("paths")).collect():
            table[row.host] = _told(row.paths)
        source = source.withColumn("__paths", F.lit(None).cast("array<struct<path:string,importance:double>>"))
    else:
        per_host = low.groupBy("host").agg(told.alias("__paths")).withColumnRenamed("host", "__h")
        source = source.join(per_host, F.col("__host") == F.col("__h"), "left").drop("__h")
    carried = spark.sparkContext.broadcast(table)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(keep)
            texts = [main_text(page or "", *(_told(paths) if paths else carried.value.get(host, ({}, frozenset())))) for host, page, paths in zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist(), batch.column(k + 2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(texts, pa.string())], names=names)

    return source.mapInArrow(run, schema)
