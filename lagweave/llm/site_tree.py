"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node is the path of element names
and classes from the root. Two entropies over the host's pages (copies count
once) make a node's importance. Presentation: how much the child sequences under
the node vary from page to page. Content: how little each text under the node is
spread evenly over the pages. Inner nodes weigh both, with the weight of the
children falling as there are more of them. Branches whose importance stays under
``threshold`` on at least ``min_pages`` pages are the site's own and are removed
from each page. Fewer pages, m, show less: there such a branch goes where it is
outside of article and main elements and has less than m / min_pages of the page's
prose (text outside of links). Elements whose tag or role says that they are menus,
forms and the like, or which are hidden, go. Class and id words of notices,
adverts, comments and the like are a prior only: a branch with one stays if its
importance (1 where the host has no other page with it) times its share of the
page's prose is ``NAMED`` or more. Where article and main elements
hold half of the prose that is left, the page's text is there; where they hold less,
as a card or a teaser does, it is all that is left. (Prose of branches with such a word
counts ``NAMED`` times.)

Statistics cover all pages and are pre-aggregated; what a page needs back is its
host's list of removed nodes, joined by host, so that one host with a third of all
pages is an ordinary skewed join side. Pages are parsed alone.

Blocks: text between starts and ends of block elements, character references
decoded, runs of white space (line breaks included) one space, trimmed; empty
blocks go, the others are joined by two newlines. A null or empty page, or one
without main text, gives an empty string. A null url is a host of its own.
Repeated rows are extracted alike. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept, pieces, small_batches

#: Fixed values of HTML: elements without content, elements of raw text, blocks, and which open elements a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp noembed svg template".split())
BLOCKS = frozenset("address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Elements, roles and class words of what isn't main text.
NOISE_TAGS = frozenset("nav footer aside form button select input label dialog menu object applet audio video canvas datalist head".split()) | RAW
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments comentarios commentaires consent cookie cookies disclaimer discussion disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pagination paywall popup promo promotion recommended related replies reply responses share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget".split())

#: Importance times share of the page's prose from which a branch with such a word stays.
NAMED = 0.1

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORDS = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _hash(parent: int, *parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"), seed=parent & 0xFFFFFFFFFFFFFFFF)


class Node:
    __slots__ = ("block", "children", "name", "named", "noise", "path", "main")

    def __init__(self, name: str, path: int, noise: bool, main: bool, named: bool = False):
        self.name, self.path, self.noise, self.main, self.named = name, path, noise, main, named
        self.block = name in BLOCKS
        self.children: list[str] = []


def _attributes(raw: str) -> dict[str, str]:
    if "=" not in raw and "hidden" not in raw:
        return {}
    return {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTR.findall(raw)}


def _is_noise(name: str, attrs: dict[str, str], main: bool) -> bool:
    if name in NOISE_TAGS or (name == "header" and not main):
        return True
    if not attrs:
        return False
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role") in NOISE_ROLES or bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))


def _is_named(name: str, attrs: dict[str, str], main: bool) -> bool:
    if not attrs:
        return False
    if name in ("html", "body", "article", "main") and not main and name != "article":
        return False
    words = {w for a in ("class", "id") for w in _WORDS.split(_CAMEL.sub(" ", attrs.get(a, "")).lower())}
    return bool(words & NOISE_WORDS) or (not main and "header" in words)


def parse(html: str) -> Iterator[tuple[Node, list[Node], str | None]]:
    """(node, open nodes, text) of each text, and of each end of a node with text None; in page order."""
    root = Node("", 0, False, False)
    stack = [root]
    at, n = 0, len(html)

    def close(to: int) -> Iterator:
        while len(stack) > to:
            node = stack.pop()
            yield node, stack, None

    while at < n:
        lt = html.find("<", at)
        m = _TOKEN.match(html, lt) if lt >= 0 else None
        end = n if lt < 0 else lt
        if lt >= 0 and m is None:  # a sign, not a tag
            end = lt + 1
        if end > at:
            yield stack[-1], stack, html[at:end]
        at = end
        if m is None:
            continue
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name or (m[2] is None and not html.endswith(">", 0, at)):
            continue  # a comment, or a tag that the page's end cuts off
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    yield from close(k)
                    break
            continue
        raw = m[3] if m[2] else m[6]
        if name in BLOCKS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    yield from close(k)
                    break
                if stack[k].block:
                    break
        if name in ENDS:
            last = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in SCOPE[name]:
                    break
                if stack[k].name in ENDS[name]:
                    last = k
            if last:
                yield from close(last)
        up = stack[-1]
        attrs = _attributes(raw)
        kind = " ".join(sorted(re.sub(r"\d+", "", attrs.get("class", "")).split()))
        main = up.main or (name in ("article", "main") and not up.noise)
        noise = up.noise or _is_noise(name, attrs, up.main)
        node = Node(name, _hash(up.path, name, kind), noise, main and not noise, _is_named(name, attrs, up.main))
        up.children.append(f"{name}.{kind}" if kind else name)
        if name in VOID or raw.endswith("/"):
            if name in BLOCKS or name == "br":
                yield node, stack, "\n" if name == "br" else None
            if name in VOID:
                continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else n
            continue
        stack.append(node)
    yield from close(1)


def page_features(html: str) -> tuple[list[tuple[int, int, int]], int]:
    """(path, kind, feature) of a page's nodes: kind 0 child sequences, kind 1 texts, kind 2 the parent's path, kind 3 one of NOISE_WORDS; and a hash of them all."""
    out: set[tuple[int, int, int]] = set()
    for node, stack, text in parse(html):
        if text is None:
            out.add((node.path, 0, _hash(1, *node.children)))
            out.update((node.path, 2, up.path) for up in stack)
            if node.named:
                out.add((node.path, 3, 0))
            continue
        words = " ".join(unescape(text).split())
        if words:
            out.add((stack[-1].path, 1, _hash(2, words)))
    rows = sorted(out)
    return rows, _hash(3, repr(rows))


def main_text(html: str, host: dict[int, tuple[float, float]] | None = None) -> str:
    """The page's main text; host: by path, the shares of the page's prose under which a branch goes for what the site's pages show (above 1: always), and for its name."""
    host = host or {}
    items: list[tuple | None] = []
    held: dict[Node, int] = {}
    total = 0
    for node, stack, text in parse(html):
        if text is None:
            if node.block:
                items.append(None)
            continue
        if any(x.noise or (x.path in host and host[x.path][0] > 1) for x in (node, *stack)):
            continue
        text = " " if node.name == "br" and text == "\n" else unescape(text)
        prose = 0 if any(x.name == "a" for x in stack) else len(" ".join(text.split()))
        total += prose
        doubtful = [x for x in stack if x.named or x.path in host]
        for x in doubtful:
            held[x] = held.get(x, 0) + prose
        items.append((text, prose, next((x for x in reversed(stack) if x.block), stack[0]), stack[-1].main, doubtful))
    gone = set()
    for x, prose in held.items():
        share = prose / total if total else 0.0
        site, name = host.get(x.path, (0.0, NAMED))
        if (x.named and share < name) or (not x.main and share < site):
            gone.add(x)
    blocks: list[tuple[bool, str]] = []
    parts: list[str] = []
    is_main = False
    amount = {True: 0, False: 0}

    def flush() -> None:
        words = " ".join("".join(parts).split())
        if words:
            blocks.append((is_main, words))
        parts.clear()

    owner: Node | None = None
    for item in items:
        if item is None:
            flush()
            continue
        text, prose, block, main, doubtful = item
        if gone and any(x in gone for x in doubtful):
            continue
        if block is not owner:
            flush()
            owner, is_main = block, main
        amount[main] += prose * (NAMED if any(x.named for x in doubtful) else 1)
        parts.append(text)
    flush()
    only = any(main for main, _ in blocks) and amount[True] >= amount[False]
    return "\n\n".join(words for main, words in blocks if main or not only)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def removed_nodes(pages: DataFrame, threshold: float, min_pages: int, gamma: float = 0.9) -> DataFrame:
    """host, removed (path, site, name: see :func:`main_text`) of the hosts that have such nodes; pages: host, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            seen: dict[tuple[str, int], list] = {}
            for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                rows, mark = page_features(html or "")
                if rows:
                    seen.setdefault((host, mark), rows)
            flat = [(h, m, *r) for (h, m), rows in seen.items() for r in rows]
            if flat:
                cols = list(zip(*flat, strict=True))
                signed = lambda c: pa.array([x - (1 << 64) if x >> 63 else x for x in c], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), signed(cols[1]), signed(cols[2]), pa.array(cols[3], pa.int32()), signed(cols[4])], ["host", "page", "path", "kind", "feature"])

    rows = small_batches(pages).mapInArrow(run, "host string, page bigint, path bigint, kind int, feature bigint")
    # Copies of a page count once: a (page, path, kind, feature) is one row. Then pages of each feature.
    used = kept(rows.distinct().groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("k")), "site-features")
    m = F.col("m").cast("double")
    k = F.col("k").cast("double")
    on = used.where("kind = 0").groupBy("host", "path").agg(F.sum("k").alias("m0"), F.count(F.lit(1)).alias("styles"), F.sum(k * F.log(k)).alias("klogk"))
    node = on.withColumn("m", F.col("m0")).select("host", "path", "m", "styles", F.when(m > 1, (F.log(m) - F.col("klogk") / m) / F.log(m)).otherwise(1.0).alias("node_imp"))
    texts = used.where("kind = 1").join(node.select("host", "path", "m"), ["host", "path"])
    leaf = texts.groupBy("host", "path").agg(F.avg(F.when(m > 1, 1 - F.log(F.least(k, m)) / F.log(m)).otherwise(1.0)).alias("text_imp"), F.count(F.lit(1)).alias("texts"))
    above = used.where("kind = 2").select("host", "path", F.col("feature").alias("up"))
    own = node.join(leaf, ["host", "path"], "left")
    held = own.where("texts is not null")
    below = held.join(above, ["host", "path"]).groupBy("host", F.col("up").alias("path")).agg(F.avg("text_imp").alias("below"), F.max("text_imp").alias("best"))
    both = own.join(below, ["host", "path"], "left")
    weight = F.pow(F.lit(gamma), F.col("styles"))
    content = F.coalesce(F.col("below"), F.col("text_imp"), F.lit(0.0))
    # No branch goes that holds a text node of importance.
    both = both.withColumn("imp", F.greatest((1 - weight) * F.col("node_imp") + weight * content, F.coalesce("best", F.lit(0.0)), F.coalesce("text_imp", F.lit(0.0))))
    named = used.where("kind = 3").select("host", "path", F.lit(True).alias("named"))
    both = both.join(named, ["host", "path"], "left").where("m > 1")
    site = F.when(F.col("imp") < threshold, F.when(F.col("m") >= min_pages, 2.0).otherwise(F.col("m") / min_pages)).otherwise(0.0)
    name = F.when(F.col("named"), F.least(NAMED / F.greatest("imp", F.lit(1e-9)), F.lit(2.0))).otherwise(NAMED)
    both = both.select("host", "path", site.alias("site"), name.alias("name")).where((F.col("site") > 0) | (F.col("name") > NAMED * 1.01))
    return both.groupBy("host").agg(F.collect_list(F.struct("path", "site", "name")).alias("removed"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.05, min_pages: int = 10) -> DataFrame:
    """One row per row of pages: id, url, text, n_chars (code points)."""
    id_type = dict(pages.dtypes)[id_col]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    # Written first, so that its size is known: small, it goes to every task and no page is shuffled.
    low = kept(removed_nodes(rows.select("host", "html"), threshold, min_pages).withColumnRenamed("host", "of"), "site-removed")
    told = rows.join(low, F.col("host") == F.col("of"), "left").select("id", "url", "html", "removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, dict] = {}
        for part in pieces(batches, 2):
            texts = []
            for html, removed in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                key = tuple((x["path"], x["site"], x["name"]) for x in removed or ())
                if key not in known:
                    known.clear()
                    known[key] = {path & 0xFFFFFFFFFFFFFFFF: (site, name) for path, site, name in key}
                texts.append(main_text(html or "", known[key]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return told.mapInArrow(run, f"`{id_col}` {id_type}, `{url_col}` string, text string, n_chars bigint")
