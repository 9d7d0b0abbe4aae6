"""Main text of HTML pages by minimum-cut labelling.

A page is cut into blocks of text. A log-linear classifier rates each block as content
or boilerplate by where it stands (nav, article, a class that says "sidebar", ...), its
length, link share and punctuation; its log-odds are the capacity of the block's edge to
the source (content) or the sink (boilerplate). Blocks that follow each other, and blocks
of one parent, are tied by smoothness edges that weaken with their distance in the tree.
The maximum flow's cut labels the blocks: what stays linked to the source is the text.
"""

from __future__ import annotations

import html
import re
from collections import deque

from pyspark.sql import DataFrame

from duebook.llm.common import append_columns

#: Names of HTML elements.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl "
            "dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
            "legend li main menu nav ol optgroup p pre search section summary table tbody td "
            "tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes noscript".split())
SKIPPED = set("head template object svg math canvas audio video button select option "
              "datalist".split())
CLOSES_P = BLOCK - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr",
                    "legend", "optgroup"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An open one of these ends where the next of its kind begins, up to the container.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}),
            "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
            "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
            "option": ({"option"}, {"select", "datalist"})}

BOILERPLATE_TAGS = set("nav footer aside form menu dialog search fieldset".split())
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search dialog alert "
                        "alertdialog menu menubar form toolbar status".split())
BOILERPLATE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo "
    "promotion promoted banner cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup share sharing social follow related "
    "recommended recommendations trending popular sidebar side aside nav navbar navigation menu "
    "breadcrumb breadcrumbs footer foot masthead topbar toolbar comment comments commentlist "
    "disqus respond reply replies widget widgets login register search form copyright legal "
    "disclaimer pagination pager skip tags".split())
CONTENT_WORDS = set("article content post entry story articlebody maincontent".split())

#: Log-odds for content, by feature.
BIAS = -0.6
IN_ARTICLE = 2.5
IN_CONTENT = 1.2
BOILERPLATE = -7.0
IN_HEADER = -4.0
ARTICLE_HEADER = -0.5
LINKED = -5.0           # by the share of the text in links
PER_WORD, MOST_WORDS = 0.06, 40
SENTENCE = 0.6
PARAGRAPH = 0.5
HEADING = 0.8
UNCLEAR = -1.5
LIST_ITEM = -0.3
#: Capacities of smoothness edges.
FOLLOWS = 0.5
SAME_PARENT = 0.6

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Place:
    """What an element's own and outer tags say about the text in it."""
    __slots__ = ("tag", "number", "bad_tag", "bad_name", "header", "article", "content",
                 "skipped", "linked", "path")

    def __init__(self, tag, number, outer=None):
        self.tag, self.number = tag, number
        for name in ("bad_tag", "bad_name", "header", "article", "content", "skipped", "linked"):
            setattr(self, name, getattr(outer, name) if outer else False)
        self.path = (outer.path if outer else ())


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "")
            for m in ATTRIBUTE.finditer(text)}


def place_of(tag: str, attrs: str, outer: Place, number: int) -> Place:
    here = Place(tag, number, outer)
    if tag in BLOCK:
        here.path = (*outer.path, number) if len(outer.path) < 64 else outer.path
    if tag in SKIPPED:
        here.skipped = True
    elif tag == "a":
        here.linked = True
    elif tag in ("article", "main"):
        here.article, here.bad_name, here.header = True, False, False
    elif tag in BOILERPLATE_TAGS:
        here.bad_tag = True
    elif tag == "header":
        here.header = True
    if attrs and tag not in ("html", "body"):
        given = attributes(attrs)
        role = given.get("role", "").lower()
        if role in BOILERPLATE_ROLES:
            here.bad_tag = True
        elif role in ("main", "article"):
            here.article, here.bad_name, here.header = True, False, False
        if ("hidden" in given or given.get("aria-hidden", "").lower() == "true"
                or HIDDEN.search(given.get("style", ""))):
            here.skipped = True
        named = {w.lower() for w in TOKEN.findall(
            f"{given.get('class', '')} {given.get('id', '')}")}
        if tag not in ("article", "main"):
            if named & BOILERPLATE_WORDS:
                here.bad_name = True
            elif "header" in named:
                here.header = True
            elif named & CONTENT_WORDS or "articlebody" in given.get("itemprop", "").lower():
                here.content = True
    return here


class Block:
    __slots__ = ("text", "odds", "path")


def rated(words: list[str], place: Place, tag: str, linked: float) -> Block:
    """A block of text with the log-odds that it is content."""
    block = Block()
    block.text, block.path = " ".join(words), place.path
    odds = BIAS + PER_WORD * min(len(words), MOST_WORDS) + LINKED * linked
    if block.text[-1] in ".!?…:;\"'”»)" and len(words) > 2:
        odds += SENTENCE
    odds += {"p": PARAGRAPH, "li": LIST_ITEM}.get(tag, 0.0)
    if tag in HEADINGS:
        odds += HEADING
    if place.article:
        odds += IN_ARTICLE
    elif place.content:
        odds += IN_CONTENT
    if place.bad_tag or place.bad_name:
        odds += BOILERPLATE
    elif place.header:
        odds += ARTICLE_HEADER if place.article else IN_HEADER
    block.odds = odds
    return block


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order; never fails on broken markup."""
    stack = [Place("", 0)]
    open_ = {}
    out: list[Block] = []
    parts: list[str] = []
    state = {"linked": 0, "all": 0, "numbers": 0}

    def text(raw):
        if raw and not stack[-1].skipped:
            value = html.unescape(raw) if "&" in raw else raw
            parts.append(value)
            size = len(value.strip())
            state["all"] += size
            if stack[-1].linked:
                state["linked"] += size

    def flush():
        words = "".join(parts).split()
        if words:
            holder = next((p for p in reversed(stack) if p.tag in BLOCK), stack[0])
            out.append(rated(words, holder, holder.tag, state["linked"] / max(1, state["all"])))
        parts.clear()
        state["linked"] = state["all"] = 0

    def pop():
        gone = stack.pop()
        open_[gone.tag] -= 1

    def close(names, until=()):
        """Close up to the nearest open element of these names, if one is open."""
        if any(open_.get(n) for n in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in names:
                    if any(p.tag in BLOCK for p in stack[i:]):
                        flush()
                    while len(stack) > i:
                        pop()
                    return
                if stack[i].tag in until:
                    return

    at = 0
    while True:
        found = TAG.search(page, at)
        if found is None:
            text(page[at:])
            break
        text(page[at:found.start()])
        at = found.end()
        if found["cdata"] is not None:
            text(found["cdata"])
            continue
        tag = (found["name"] or found["name2"] or "").lower()
        if not tag:
            continue
        end, attrs = found["end"] or found["end2"], found["attrs"] or found["attrs2"] or ""
        if end:
            if tag == "br":
                parts.append(" ")
            elif tag in BLOCK:
                flush()
                close({tag})
            else:
                close({tag}, BLOCK)
            continue
        if tag in RAW:
            stop = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if tag in CLOSES_P and open_.get("p"):
            close({"p"}, {"td", "th", "table", "button", "object"})
        if tag in SIBLINGS:
            names, until = SIBLINGS[tag]
            close(names, until)
        if tag in BLOCK:
            flush()
        elif tag == "br":
            parts.append(" ")
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        if len(stack) > 512:
            continue
        state["numbers"] += 1
        stack.append(place_of(tag, attrs, stack[-1], state["numbers"]))
        open_[tag] = open_.get(tag, 0) + 1
    flush()
    return out


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: to the next block, and to the next one of the same parent."""
    edges, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            a, b = blocks[i - 1].path, block.path
            same = 0
            while same < len(a) and same < len(b) and a[same] == b[same]:
                same += 1
            steps = len(a) + len(b) - 2 * same
            edges.append((i - 1, i, FOLLOWS * 2.0 ** -max(0, steps - 2)))
        parent = block.path[:-1]
        if parent in last:
            edges.append((last[parent], i, SAME_PARENT))
        last[parent] = i
    return edges


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut: node i is tied to the
    source by odds[i] where that is above 0, and to the sink by -odds[i] where below; the
    edges are undirected. Dinic's maximum flow."""
    n = len(odds)
    source, sink = n, n + 1
    near: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    left: list[float] = []

    def join(a, b, there, back):
        near[a].append(len(to))
        to.append(b)
        left.append(there)
        near[b].append(len(to))
        to.append(a)
        left.append(back)

    for i, value in enumerate(odds):
        if value > 0:
            join(source, i, value, 0.0)
        elif value < 0:
            join(i, sink, -value, 0.0)
    for a, b, capacity in edges:
        join(a, b, capacity, capacity)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in near[u]:
                v = to[e]
                if level[v] < 0 and left[e] > tiny:
                    level[v] = level[u] + 1
                    queue.append(v)
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(left[e] for e in path)
                cut = 0
                for k in range(len(path) - 1, -1, -1):
                    e = path[k]
                    left[e] -= flow
                    left[e ^ 1] += flow
                    if left[e] <= tiny:
                        cut = k
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[u] < len(near[u]):
                e = near[u][turn[u]]
                if left[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            else:
                if u == source:
                    break
                level[u] = -1
                e = path.pop()
                u = to[e ^ 1]
                continue
            path.append(e)
            u = to[e]


def main_text(page: str) -> tuple[str, int, int]:
    """The content blocks' texts, joined by line feeds; the numbers of blocks and of
    content blocks."""
    blocks = blocks_of(page)
    if not blocks:
        return "", 0, 0
    content = minimum_cut([b.odds for b in blocks], edges_of(blocks))
    kept = [b.text for b, keep in zip(blocks, content) if keep]
    if not kept:        # nothing stands out: all that has no sign of boilerplate
        kept = [b.text for b in blocks if b.odds > UNCLEAR]
    return "\n".join(kept), len(blocks), len(kept)


def extract(pages: DataFrame) -> DataFrame:
    """`pages` with text (the main text of `html`), n_chars (its code points), n_blocks and
    n_content, in place of html. A null or empty page, or one without any text, gives an
    empty text; a text without markup is one block. Equal rows each give a row."""
    def make(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("html")).to_pylist()
            found = [main_text(x or "") for x in column]
            yield [[f[0] for f in found], [len(f[0]) for f in found],
                   [f[1] for f in found], [f[2] for f in found]]

    return append_columns(pages, "text string, n_chars long, n_blocks int, n_content int", make,
                          consumed=("html",))
