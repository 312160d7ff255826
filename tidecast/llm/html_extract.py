"""Main text of web pages by consensus paths of their host.

Every page scores its containers and votes for the generalised tag-class path of the best; the
votes are counted per host in Spark; each page is then extracted again along its host's winning
path, from the elements and blocks that its one parse left, together with its own best container.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import Scratch, table
from tidecast.llm.url_filters import host_of

#: Starts of comments, declarations and tags, and a tag from its name on: quotes count only after
#: an equals sign, and one that nothing closes belongs to an unquoted value. Every character is
#: passed once, so that broken pages cost no more than others.
_START = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_DECLARATION = re.compile(r"<[!?][^>]*>")
_TAG = re.compile(r"""<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)>""")
_ATTR = re.compile(r"""([^\s=/"'>]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+))""")
_ZEROS = re.compile(r"&#0++(?=[0-9])")
_LONG_NUMBER = re.compile(r"&#[0-9]{8,}+;?")
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("article main section div td center body html blockquote".split())
_OUT_TAGS = frozenset(
    "head title script style noscript template iframe object embed svg canvas nav header footer aside form button select input "
    "textarea menu dialog noframes noembed".split()
)
_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner sidebar sidebars aside "
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices gdpr popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment "
    "comments disqus reply replies respond discussion toolbar pagination pager alert toast complementary contentinfo search".split()
)
_DIGITS = re.compile(r"\d+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in _RAW}
#: Tags that no class or id removes, and heads of text that only a few words remove.
_KEEP = frozenset("html body main".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NEGATED = re.compile(r"(?:^|[^a-z])(?:no|has|with|without)[-_]?[a-z]+")
#: Classes that name a post's subject or kind, whatever word follows.
_NAMED = re.compile(r"(?<![^\s])(?:tag|category|cat|type|format)[-_]\S+")
#: Words of elements that are left out even where they hold most of a page's text.
_READERS = frozenset("comment comments disqus reply replies respond discussion".split())
#: Unlinked characters that make a block a passage of its own, beside the article in the body itself.
_PASSAGE = 40
_BODY = frozenset(["", "html", "body"])
#: What keeps a paragraph that is open around it from ending.
_SHIELDS = ("table", "td", "th", "caption", "button")
#: An opening tag that ends an open paragraph, list item, cell or row.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table"}, "option": {"select"}}


@dataclass(slots=True)
class Node:
    """An element: its parent, the nearest block and the nearest container (itself included)."""

    tag: str
    shape: str
    parent: int
    out: bool
    block: int = 0
    box: int = 0
    words: frozenset[str] = frozenset()
    gone: bool = False
    chars: int = 0


@dataclass
class Page:
    """Elements of a page in order, and its blocks of text as (element, text, characters in links)."""

    nodes: list[Node] = field(default_factory=lambda: [Node("", "", -1, False)])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def up(self, i: int):
        while i >= 0:
            yield i
            i = self.nodes[i].parent


def _plain(raw: str) -> str:
    """``raw`` with character references decoded; numbers of any length are read."""
    if "&#" in raw:
        raw = _LONG_NUMBER.sub("\ufffd", _ZEROS.sub("&#", raw))
    return html_lib.unescape(raw)


def _out_words(tag: str, classes: str) -> frozenset[str]:
    """Words of class, id and role for which an element would be left out."""
    if tag in _KEEP or tag in _HEADS:
        return frozenset()
    return _OUT_WORDS.intersection(re.findall("[a-z]+", _NEGATED.sub(" ", _NAMED.sub(" ", classes))))


def _spared(page: Page) -> set[int]:
    """Elements with words to leave out that hold the page's article, main, h1 or most of its text."""
    chars, holds = [n.chars for n in page.nodes], [False] * len(page.nodes)
    for k in range(len(page.nodes) - 1, 0, -1):
        n = page.nodes[k]
        chars[n.parent] += chars[k]
        here = not n.gone and (n.tag in ("main", "h1") or (n.tag == "article" and not n.words))
        holds[n.parent] |= holds[k] or here
    most = [2 * c > chars[0] for c in chars]
    return {k for k, n in enumerate(page.nodes) if n.words and (n.tag == "article" or holds[k] or (most[k] and n.words.isdisjoint(_READERS)))}


def parse(html: str) -> Page:
    """Elements and blocks of ``html``; unclosed and misplaced tags are tolerated as browsers do.

    Elements are left out by tag, or by words of their class, id or role unless they hold the
    page's article; if nothing is left, by tag only.
    """
    page = _parse(html, set())
    if spared := _spared(page):
        page = _parse(html, spared)
    if not page.blocks and any(n.words for n in page.nodes):
        page = _parse(html, set(range(len(page.nodes))))
    return page


def _parse(html: str, spared: set[int]) -> Page:
    page = Page()
    nodes = page.nodes
    stack = [0]
    places: dict[str, list[int]] = defaultdict(list)
    text: list[str] = []
    linked = 0

    def nearest(tags) -> int:
        """Place in the stack of the innermost open element among ``tags``, 0 if none is open."""
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def flush() -> None:
        nonlocal linked
        if text:
            clean = " ".join("".join(text).split())
            if clean and not nodes[stack[-1]].out:
                page.blocks.append((nodes[stack[-1]].block, clean, min(linked, len(clean))))
            text.clear()
            linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        top = nodes[stack[-1]]
        if raw and not top.gone:
            top.chars += len(raw.strip())
        if raw and not top.out:
            plain = _plain(raw)
            text.append(plain)
            if places["a"]:
                linked += len(plain.strip())

    def close(to: int) -> None:
        if any(nodes[i].tag in _BLOCK or nodes[i].out for i in stack[to:]):
            flush()
        while len(stack) > to:
            places[nodes[stack.pop()].tag].pop()

    at = 0
    while start := _START.search(html, at):
        kind = start[0][1]
        m = (_COMMENT if start[0] == "<!--" else _DECLARATION if kind in "!?" else _TAG).match(html, start.start())
        if m is None:
            break
        add(html[at : m.start()])
        at = m.end()
        if kind in "!?":
            continue
        tag, attrs = m["tag"].lower(), m["attrs"]
        if m["end"]:
            if where := nearest([tag]):
                close(where)
            elif tag in _BLOCK:
                flush()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in _BLOCK:
            k = nearest(["p"])
            if k > nearest(_SHIELDS):
                close(k)
            else:
                flush()
        if tag in _ENDS:
            k = nearest(_ENDS[tag])
            if k > nearest(_SCOPE[tag] - _ENDS[tag]):
                close(k)
        named = {}
        if "=" in attrs:
            for name, *value in _ATTR.findall(attrs):
                named.setdefault(name.lower(), "".join(value).lower())
        parent = stack[-1]
        up = nodes[parent]
        words = _out_words(tag, " ".join(named[k] for k in ("class", "id", "role") if k in named))
        own_head = tag == "header" and bool(places["article"] or places["main"])
        gone = up.gone or (tag in _OUT_TAGS and tag not in _KEEP and not own_head)
        out = up.out or gone or (bool(words) and len(nodes) not in spared)
        if out and not up.out and tag in _BLOCK:
            flush()
        if tag in _VOID or (attrs.endswith("/") and tag not in _BLOCK):
            continue
        me = len(nodes)
        shape = ".".join([tag, *(_DIGITS.sub("", c) for c in named.get("class", "").replace("/", ":").split())]) if tag in _BLOCK else ""
        nodes.append(Node(tag, shape, parent, out, me if shape else up.block, me if tag in _CONTAINER else up.box, words, gone))
        places[tag].append(len(stack))
        stack.append(me)
        if tag in _RAW:
            end = _RAW_END[tag].search(html, at)
            if not gone:
                add(html[at : end.start() if end else len(html)])
            at = end.end() if end else len(html)
            close(len(stack) - 1)
    add(html[at:])
    close(1)
    flush()
    return page


def _linked(chars: int, linked: int) -> bool:
    return 3 * linked > chars


def own_parts(page: Page) -> tuple[int, set[int], set[int]]:
    """The page's best container, the elements beside it that belong to it, and bare blocks that do.

    Best is the element with the most unlinked text of its own (all of a block's to its container,
    half to the next), or an article or main element around it. On the way up from it everything
    beside it that is not mostly links is taken too: in the body itself only what stands there
    without a container or holds a passage, and beside an article or main element only headings
    of the first order.
    """
    nodes = page.nodes
    score, chars, linked = ([0] * len(nodes) for _ in range(3))
    passage, heading = [False] * len(nodes), [n.tag == "h1" and not n.out for n in nodes]
    for i, text, in_links in page.blocks:
        worth = max(0, len(text) - in_links)
        box = nodes[i].box
        score[box] += 2 * worth
        if box:
            score[nodes[nodes[box].parent].box] += worth
        chars[i] += len(text)
        linked[i] += in_links
        passage[i] |= worth >= _PASSAGE
    best = max(range(len(nodes)), key=lambda k: (score[k], -k))
    above = list(page.up(best))
    best = next((k for tag in ("article", "main") for k in above if nodes[k].tag == tag), best)
    for k in range(len(nodes) - 1, 0, -1):
        up = nodes[k].parent
        chars[up] += chars[k]
        linked[up] += linked[k]
        passage[up] |= passage[k]
        heading[up] |= heading[k]
    line = set(page.up(best))
    sectioned = nodes[best].tag in ("article", "main")

    def joins(k: int, around: str, apart: bool, says: bool, title: bool) -> bool:
        if sectioned:
            return title and around not in _BODY
        return around not in _BODY or says or not apart

    beside = {
        k
        for k, n in enumerate(nodes)
        if k and k not in line and n.parent in line and n.parent != best and chars[k] and not _linked(chars[k], linked[k])
        and joins(k, nodes[n.parent].tag, n.tag in _CONTAINER, passage[k], heading[k])
    }
    bare = {
        j
        for j, (i, text, in_links) in enumerate(page.blocks)
        if i in line and i != best and not sectioned and not _linked(len(text), in_links)
    }
    return best, beside, bare


def skeleton(html: str) -> dict:
    """What extraction needs of a page, from one parse: the tag-class path of its best container
    and that one's characters; shape and parent of every block element that holds text; element,
    text, linked characters of every block and whether it belongs to the page's own main text.
    """
    page = parse(html)
    nodes = page.nodes
    best, beside, bare = own_parts(page)
    inside, own = [False] * len(nodes), [False] * len(nodes)
    for k, n in enumerate(nodes):
        inside[k] = k == best or (k > 0 and inside[n.parent])
        own[k] = k == best or k in beside or (k > 0 and own[n.parent])
    used = {0}
    for i, _, _ in page.blocks:
        while i not in used:
            used.add(i)
            i = nodes[nodes[i].parent].block
    number = {k: j for j, k in enumerate(sorted(used))}
    shapes, k = [], nodes[best].block
    while k:
        shapes.append(nodes[k].shape)
        k = nodes[nodes[k].parent].block
    return {
        "path": "".join("/" + x for x in reversed(shapes)),
        "chars": sum(len(text) for i, text, _ in page.blocks if inside[i]),
        "shapes": [nodes[k].shape for k in number],
        "parents": [number[nodes[nodes[k].parent].block] if k else -1 for k in number],
        "at": [number[i] for i, _, _ in page.blocks],
        "texts": [text for _, text, _ in page.blocks],
        "linked": [n for _, _, n in page.blocks],
        "own": [own[i] or j in bare for j, (i, _, _) in enumerate(page.blocks)],
    }


def extract(page: dict, path: str | None) -> str:
    """The page's own main text and that of every element on ``path`` that is not mostly links,
    in page order, from the page's skeleton."""
    root = [-1] * len(page["shapes"])
    if path is not None:
        parts = path.split("/")[1:]
        depth = [0] * len(root)
        for k, (shape, up) in enumerate(zip(page["shapes"], page["parents"], strict=True)):
            if k:
                d = depth[up]
                depth[k] = d + 1 if 0 <= d < len(parts) and parts[d] == shape else -1
                root[k] = root[up]
            if depth[k] == len(parts):
                root[k] = k
    chars, linked = [0] * len(root), [0] * len(root)
    for i, text, n in zip(page["at"], page["texts"], page["linked"], strict=True):
        if root[i] >= 0:
            chars[root[i]] += len(text)
            linked[root[i]] += n
    ok = [root[k] >= 0 and not _linked(chars[root[k]], linked[root[k]]) for k in range(len(root))]
    return "\n".join(text for i, text, own in zip(page["at"], page["texts"], page["own"], strict=True) if own or ok[i])


_PARTS = {
    "path": pa.string(),
    "chars": pa.int64(),
    "shapes": pa.list_(pa.string()),
    "parents": pa.list_(pa.int32()),
    "at": pa.list_(pa.int32()),
    "texts": pa.list_(pa.string()),
    "linked": pa.list_(pa.int32()),
    "own": pa.list_(pa.bool_()),
}
_SKELETON = "struct<path:string,chars:bigint,shapes:array<string>,parents:array<int>,at:array<int>,texts:array<string>,linked:array<int>,own:array<boolean>>"


def _skeletons(html: pa.Array) -> pa.Array:
    found = [skeleton(x.as_py() or "") for x in html]
    return pa.StructArray.from_arrays([pa.array([f[k] for f in found], t) for k, t in _PARTS.items()], list(_PARTS))


def _texts(pages: pa.Array, path: pa.Array) -> pa.Array:
    return pa.array([extract(x.as_py(), p.as_py()) for x, p in zip(pages, path, strict=True)], pa.string())


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    Every page is parsed once and its skeleton written; votes and texts come from it. Null or
    empty html, or a page without text outside the parts left out: an empty text. From a tag
    that never ends on, the rest of a page is text. Pages without a host form a host of their
    own. Most votes win, then most characters, then the last path in order. Repeated rows vote
    each; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "html")
    parsed, text = F.arrow_udf(_skeletons, _SKELETON), F.arrow_udf(_texts, "string")
    rows = scratch.write(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), parsed("html").alias("page")), "pages")
    votes = rows.where("page.chars > 0").groupBy("host", F.col("page.path").alias("path"))
    counted = votes.agg(F.count("*").alias("n"), F.sum("page.chars").alias("chars"))
    won = counted.groupBy("host").agg(F.max(F.struct("n", "chars", "path")).alias("w")).select(F.col("host").alias("of_host"), F.col("w.path").alias("path"))
    won = scratch.write(won, "paths")
    out = rows.join(won, rows["host"] == won["of_host"], "left").select("page_id", "url", text("page", "path").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
