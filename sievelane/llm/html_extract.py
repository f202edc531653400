"""Main text of web pages by wrapper induction over pages of the same host.

Every page becomes a tree of its block elements; neighbours of one shape fold into one repeated node. The trees of a host's
pages are aligned by simple tree matching: the best order-preserving
pairing of children, weighted by how many nodes match below, found by dynamic programming. Aligned nodes
merge into the host's wrapper, which counts, for each node, the pages that have it and how much text and
link text it holds there. Then every page is aligned with its host's whole wrapper, and the pages that have a text at a node are
counted exactly, by host, node and text. A text that stays constant over nearly all pages is template, and so are all texts
of a node that shows few different ones on many pages; nodes whose text varies are slots.

From the wrapper's root, the main region is the child that holds at least half of the varying text outside links, and so on, until
the text stands in prose elements or several children share it. Prose elements beside the way down (titles,
leads) belong to it. Menus, adverts and reader comments vary, too, so slots that say by tag, role, class or id that
they are one never count; without such names they are left out where they lie outside the region or rotate.

All pages take part in their host's wrapper: each task folds its own pages, then the partial wrappers
of a host are merged in two steps. A wrapper keeps the WRAPPER_NODES nodes that most pages have; nodes that few pages have
count as slots where they stand. A host with a single page gets its region from that page alone.
"""

from __future__ import annotations

import html as _html
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, Plain, bounded, materialise, release, trim
from .url_filter import host_of

TOKEN = re.compile(r"""<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<(?=/?[a-zA-Z!])[^>]*$""")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: A start tag closes the open elements named here, as if their end tag stood before it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "select", "article", "section", "div", "body", "main", "aside", "nav", "footer", "header", "form", "blockquote"}
#: Elements that hold no prose.
DROP_TAGS = {"head", "form", "button", "select", "fieldset", "dialog", "noscript", "template", "svg", "math", "canvas", "object", "audio", "video", "map", *RAW}
#: Elements that say what they are.
SAY_TAGS = {"nav", "footer", "aside", "menu"}
PROSE = {"p", "ul", "ol", "li", "dl", "dt", "dd", "table", "tbody", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6"}
HEADINGS = {"h1", "h2", "h3"}
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
DROP_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "banner", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "footer", "header", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related",
    "comment", "comments", "commentlist", "respond", "disqus", "replies", "pagination", "pager", "widget", "toolbar",
}
HEADER_WORDS = {"header", "banner", "masthead"}
#: A text is template when so many of a host's pages have it at the same node, of at least so many pages.
CONSTANT_SHARE, CONSTANT_PAGES = 0.9, 5
#: All texts of a node are template when it has at most so many different ones for each that it shows, on at least so many pages.
ROTATING_SHARE, ROTATING_PAGES = 0.1, 20
#: Nodes of a wrapper.
WRAPPER_NODES = 400
#: Elements nested deeper are taken as part of the one at this depth, but for those that are dropped or say that they aren't content.
DEEPEST = 80
#: Cells of an alignment's table that are held at once.
TABLE = 1 << 20


class Node:
    """``drop``: by its tag or as hidden; ``told``: it says that it isn't content."""

    __slots__ = ("tag", "key", "drop", "told", "children", "links", "at")

    def __init__(self, tag: str, key: str = "", drop: bool = False, told: bool = False):
        self.tag, self.key, self.drop, self.told = tag, key or tag, drop, told
        self.children: list[Node | str] = []
        self.links = 0
        self.at = -1  # the wrapper's node

    def nodes(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def has(self, tags: set[str]) -> bool:
        return any(c.tag in tags or c.has(tags) for c in self.nodes())


def _traits(tag: str, attrs: str) -> tuple[str, bool, bool, bool]:
    """(key, dropped, says that it isn't content, only because it is a header)."""
    if not attrs or attrs == "/":
        return tag, tag in DROP_TAGS, tag in SAY_TAGS, False
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attrs)}
    words = set(re.findall(r"[a-z]+", f"{found.get('class', '')} {found.get('id', '')}".lower()))
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    said = words & DROP_WORDS
    role = found.get("role", "").lower() in DROP_ROLES
    header = bool(said) and said <= HEADER_WORDS and not (hidden or role or tag in DROP_TAGS or tag in SAY_TAGS)
    names = re.sub(r"[0-9]+", "", found.get("class", "")).split()
    return f"{tag}.{names[0]}" if names else tag, tag in DROP_TAGS or hidden, bool(said) or role or tag in SAY_TAGS, header


def parse(source: str) -> Node:
    """The block elements of a page, with the text between them; inline elements leave only their text."""
    root = Node("#page")
    stack: list[Node] = [root]
    buffer: list[str] = []
    at = links = 0
    skip: list[str] = []  # open inline elements that are dropped
    deep: set[Node] = set()  # elements at DEEPEST with others below

    def flush() -> None:
        nonlocal links
        text = " ".join(_html.unescape("".join(buffer)).split())
        if text:
            stack[-1].children.append(text)
            stack[-1].links += min(links, len(text))
        buffer.clear()
        links = 0

    low = None
    in_link = False
    while True:
        m = TOKEN.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if text and not skip:
            buffer.append(text)
            links += len(text) if in_link else 0
        if m is None:
            break
        at = m.end()
        if m[0] == "<!--":
            end = source.find("-->", at)
            at = len(source) if end < 0 else end + 3
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = (m[1] or m[4]) == "/"
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            if skip:
                if closing and tag == skip[-1]:
                    skip.pop()
                elif not closing and tag == skip[-1]:
                    skip.append(tag)
            elif not closing and (attrs := m[3] or m[6]) and any(_traits(tag, attrs)[1:3]):
                skip.append(tag)
            continue
        if tag in VOID:
            if not closing and not skip:
                buffer.append(" ")
                if tag == "hr":
                    flush()
            continue
        if not closing and tag in RAW:
            low = low or source.lower()
            end = low.find(f"</{tag}", at)
            close = -1 if end < 0 else source.find(">", end)
            at = len(source) if close < 0 else close + 1
            continue
        skip.clear()
        flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    in_link = False
                    break
            continue
        shut = CLOSES.get(tag)
        if shut:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in shut:
                    del stack[i:]
                elif stack[i].tag in SCOPE:
                    break
        elif stack[-1].tag == "p":
            stack.pop()
        key, drop, told, header = _traits(tag, m[3] or m[6] or "")
        open_ = not (m[3] or m[6] or "").endswith("/") or tag not in ("svg", "math")
        if len(stack) > DEEPEST:
            if tag in ("article", "main", "h1"):
                for x in reversed(stack):
                    if not isinstance(x.children, _Aside) or x.children.main:
                        break
                    x.children.main = True
            if open_:
                top = stack[-1].top if isinstance(stack[-1], _Inner) else stack[-1]
                deep.add(top)
                stack.append(_Inner(tag, stack[-1], top, drop, told))
            continue
        node = Node(tag, key, drop, told)
        if header:
            node.key += "#header"
        stack[-1].children.append(node)
        if open_:
            stack.append(node)
    flush()
    for node in deep:
        node.children = list(_spread(node.children))
    _settle(root, False)
    return root


class _Aside(list):
    """What stands in an element below DEEPEST that is dropped or says that it isn't content; ``main``: it holds an article, a main part or
    a first heading, so it stays unless it is dropped."""

    __slots__ = ("drop", "main")

    def __init__(self, drop: bool):
        super().__init__()
        self.drop, self.main = drop, False


class _Inner(Node):
    """An element below DEEPEST: an end tag finds it, its text goes to ``top``, the element at that depth, if it isn't put aside."""

    __slots__ = ("top",)

    def __init__(self, tag: str, above: Node, top: Node, drop: bool, told: bool):
        self.tag, self.key, self.drop, self.told, self.at = tag, tag, False, False, -1
        self.children, self.links, self.top = above.children, 0, top
        if drop or told:
            self.children = _Aside(drop)
            above.children.append(self.children)


def _spread(children: list) -> Iterator:
    """``children`` without what was put aside for good; not by recursion, since it may be nested deep."""
    todo = [iter(children)]
    while todo:
        c = next(todo[-1], None)
        if c is None:
            todo.pop()
        elif not isinstance(c, _Aside):
            yield c
        elif c.main and not c.drop:
            todo.append(iter(c))


def _settle(node: Node, inside: bool) -> None:
    """Words don't exclude what holds the page's main part: a page with a sidebar, the header of an article."""
    for c in node.nodes():
        own = inside or c.tag in ("article", "main")
        if c.tag == "header":
            c.told = c.told or not (inside and c.has({"h1", "h2"}))
        if c.told and c.tag not in SAY_TAGS:
            if c.tag in ("html", "body") or c.has({"article", "main"}) or (c.has({"h1"}) and ("#header" not in c.key or inside)):
                c.told = False
        if c.told:
            c.key += "!"
        _settle(c, own)


def text_key(text: str) -> int:
    data = text.encode("utf-8", "replace")
    return (zlib.crc32(data) - (1 << 31)) << 32 | zlib.crc32(data[::-1])


# A wrapper node: [key, pages, text outside links, link text, shape, children, ...]; that of a page ends with the page's own nodes


def fold(node: Node) -> list:
    """A page's tree as a wrapper of one page; neighbours of one shape become one node."""
    out: list = [node.key, 1, -node.links, node.links, "", [], [node]]
    shapes: list[str] = []
    for c in node.children:
        if isinstance(c, str):
            out[2] += len(c)
        elif not c.drop:
            own = fold(c)
            if out[5] and out[5][-1][4] == own[4]:
                _add(out[5][-1], own)
            else:
                out[5].append(own)
                shapes.append(own[4])
    out[4] = f"{node.key}({' '.join(shapes)})" if len(shapes) < 8 else f"{node.key}({zlib.crc32(' '.join(shapes).encode()):x})"
    return out


def _add(a: list, b: list) -> None:
    """``b`` of a's shape, on the same page, into ``a``."""
    a[2], a[3] = a[2] + b[2], a[3] + b[3]
    a[6] += b[6]
    for x, y in zip(a[5], b[5], strict=True):
        _add(x, y)


def match(a: list, b: list, memo: dict) -> int:
    """Simple tree matching: the most nodes that pair up with order and parents kept."""
    if a[0] != b[0]:
        return 0
    at = (id(a), id(b))
    if at not in memo:
        memo[at] = 1 + (int(_rows(_weights(a[5], b[5], memo))[-1, -1]) if a[5] and b[5] else 0)
    return memo[at]


def _weights(xs: list, ys: list, memo: dict) -> np.ndarray:
    where: dict[str, list[int]] = {}
    for j, y in enumerate(ys):
        where.setdefault(y[0], []).append(j)
    w = np.zeros((len(xs), len(ys)), np.int32)
    for i, x in enumerate(xs):
        for j in where.get(x[0], ()):
            w[i, j] = match(x, ys[j], memo)
    return w


def _rows(w: np.ndarray) -> np.ndarray:
    """best[i, j]: the weight of the best order-preserving pairing of the first i and j children."""
    best = np.zeros((w.shape[0] + 1, w.shape[1] + 1), np.int32)
    for i in range(w.shape[0]):
        np.maximum(best[i, 1:], best[i, :-1] + w[i], out=best[i + 1, 1:])
        np.maximum.accumulate(best[i + 1], out=best[i + 1])
    return best


def _align(xs: list, ys: list, memo: dict) -> list[tuple[int, int]]:
    """The best pairing of two rows of children; a long row is halved where the best pairings of both halves meet, so no table
    grows beyond TABLE cells."""
    if not xs or not ys:
        return []
    if len(xs) > 1 and len(xs) * len(ys) > TABLE:
        half = len(xs) // 2
        before, behind = np.zeros(len(ys) + 1, np.int32), np.zeros(len(ys) + 1, np.int32)
        for x in xs[:half]:
            w = _weights([x], ys, memo)[0]
            before[1:] = np.maximum.accumulate(np.maximum(before[1:], before[:-1] + w))
        for x in reversed(xs[half:]):
            w = _weights([x], ys, memo)[0][::-1]
            behind[1:] = np.maximum.accumulate(np.maximum(behind[1:], behind[:-1] + w))
        cut = int(np.argmax(before + behind[::-1]))
        return _align(xs[:half], ys[:cut], memo) + [(i + half, j + cut) for i, j in _align(xs[half:], ys[cut:], memo)]
    w = _weights(xs, ys, memo)
    best = _rows(w)
    pairs, i, j = [], len(xs), len(ys)
    while i and j:
        if w[i - 1, j - 1] and best[i, j] == best[i - 1, j - 1] + w[i - 1, j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i, j] == best[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def merge(a: list, b: list, memo: dict | None = None) -> list:
    """``b`` into ``a``: aligned nodes add up, the others take their place in order."""
    memo = {} if memo is None else memo
    a[1], a[2], a[3] = a[1] + b[1], a[2] + b[2], a[3] + b[3]
    pairs = _align(a[5], b[5], memo)
    children, i, j = [], 0, 0
    for p, q in [*pairs, (len(a[5]), len(b[5]))]:
        children += a[5][i:p] + b[5][j:q]
        if p < len(a[5]) and q < len(b[5]):
            children.append(merge(a[5][p], b[5][q], memo))
        i, j = p + 1, q + 1
    a[5] = children
    return a


def _walk(wrapper: list) -> Iterator[list]:
    yield wrapper
    for c in wrapper[5]:
        yield from _walk(c)


def prune(wrapper: list, most: int = WRAPPER_NODES) -> list:
    """``wrapper`` with the ``most`` nodes that most pages have; a node has no more pages than the one above it."""
    pages = sorted((n[1] for n in _walk(wrapper)), reverse=True)
    if len(pages) > most:
        least = pages[most - 1] + (pages[most] == pages[most - 1])
        for n in list(_walk(wrapper)):
            n[5] = [c for c in n[5] if c[1] >= least]
    return wrapper


def bare(wrapper: list) -> list:
    """A wrapper without what belongs to one page only."""
    return [*wrapper[:4], "", [bare(c) for c in wrapper[5]]]


def numbered(wrapper: list) -> list[list]:
    """The nodes; a node's number is its place."""
    return list(_walk(wrapper))


def place(page: list, wrapper: list, number: dict[int, int]) -> None:
    """Align a page with its wrapper: its nodes learn the numbers of the wrapper's. ``number``: by id() of the wrapper's nodes."""
    memo: dict = {}
    todo = [(page, wrapper)]
    while todo:
        a, b = todo.pop()
        for node in a[6]:
            node.at = number[id(b)]
        todo += [(a[5][i], b[5][j]) for i, j in _align(a[5], b[5], memo)]


def content(wrapper: list, constant: dict[int, int], rotating: set[int]) -> list[int]:
    """The numbers of the wrapper's nodes that are content.

    ``constant``: characters of template texts, by node; ``rotating``: nodes all of whose text is template.
    """
    nodes = numbered(wrapper)
    number = {id(n): i for i, n in enumerate(nodes)}
    mass = [0] * len(nodes)
    size = [1] * len(nodes)
    linked = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        out = n[0].endswith("!")
        mass[i] = 0 if out or i in rotating else max(0, n[2] - constant.get(i, 0))
        linked[i] = 0 if out else n[3]
        for c in n[5]:
            k = number[id(c)]
            size[i] += size[k]
            if not out:
                mass[i] += mass[k]
                linked[i] += linked[k]
    tag = [re.split(r"[.#!]", n[0])[0] for n in nodes]
    heading = lambda k: any(tag[x] in HEADINGS for x in range(k, k + size[k]))
    links = lambda k: linked[k] > mass[k]
    keep: set[int] = set()

    def take(k: int) -> None:
        """The node and what is below, but for what says that it isn't content."""
        todo = [k]
        while todo:
            x = todo.pop()
            if not nodes[x][0].endswith("!"):
                keep.add(x)
                todo += [number[id(c)] for c in nodes[x][5]]

    at = 0
    while True:
        below = [number[id(c)] for c in nodes[at][5]]
        named = [k for k in below if tag[k] in ("article", "main") and mass[k] > 0.3 * mass[at]]
        best = max(named or below, key=lambda k: mass[k], default=-1)
        if best >= 0 and mass[at] and tag[best] not in PROSE and (len(named) == 1 or 2 * mass[best] >= mass[at]) and (tag[at] not in ("article", "main") or mass[best] >= 0.9 * mass[at]):
            for k in below:
                if k != best and (tag[k] in PROSE or tag[at] in ("article", "main")) and not links(k):
                    take(k)
            at = best
            continue
        if tag[at] in ("article", "main"):
            take(at)
            return sorted(keep - {k for k in below if links(k) and tag[k] not in PROSE for k in range(k, k + size[k])})
        keep.add(at)
        for k in below:
            if tag[k] in PROSE or 10 * mass[k] >= mass[at] or heading(k):
                if not links(k) or tag[k] in HEADINGS:
                    take(k)
        return sorted(keep)


class Rule:
    """A host's wrapper, the numbers of its content nodes, and what text at them is template."""

    def __init__(self, wrapper: list, keep: list[int], rotating: list[int] = (), constant: list[tuple[int, int]] = ()):
        self.wrapper, self.keep, self.rotating, self.constant = wrapper, set(keep), set(rotating), {tuple(x) for x in constant}
        self.number = {id(n): i for i, n in enumerate(numbered(wrapper))}

    @staticmethod
    def of_page(page: list) -> Rule:
        return Rule(page, content(page, {}, set()))

    @staticmethod
    def load(text: str) -> Rule:
        return Rule(**json.loads(text))


def _collect(root: Node, rule: Rule) -> list[tuple[str, bool]]:
    """(text, whether it is template) of a placed page's content, in page order; a node that the wrapper hasn't is content where
    the one above is."""
    out: list[tuple[str, bool]] = []
    todo: list[tuple[Node | str, bool, int]] = [(root, False, -1)]
    while todo:
        x, inside, at = todo.pop()
        if isinstance(x, str):
            if inside:
                out.append((x, at in rule.rotating or (bool(rule.constant) and (at, text_key(x)) in rule.constant)))
        elif not x.drop:
            own = x.at in rule.keep if x.at >= 0 else inside and not x.told
            todo += [(c, own, x.at) for c in reversed(x.children)]
    return out


def extract_text(source: str | None, rule: Rule | None = None) -> str:
    """The main text of a page: blocks joined by line feeds; '' for none. Without a rule all that isn't dropped by its tag."""
    if not source:
        return ""
    root = parse(source)
    if rule is None:
        return "\n".join(_all_texts(root))
    page = fold(root)
    place(page, rule.wrapper, rule.number)
    got = _collect(root, rule)
    if not got:  # a page of another kind
        own = Rule.of_page(page)
        place(page, page, own.number)
        got = _collect(root, own)
    varying = [t for t, template in got if not template]
    if 2 * sum(map(len, varying)) < sum(len(t) for t, _ in got):  # near copies of one page share most of it, a template doesn't
        varying = [t for t, _ in got]
    return "\n".join(varying)


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, rule as JSON) for every host, from all its pages."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers: dict[str, list] = {}
        for batch in batches:
            for host, source in zip(batch.column(0), batch.column(1), strict=True):
                host, own = host.as_py(), bare(fold(parse(source.as_py())))
                wrappers[host] = merge(wrappers[host], own) if host in wrappers else own
                if len(wrappers[host][5]) and wrappers[host][1] % 64 == 0:
                    prune(wrappers[host], 2 * WRAPPER_NODES)
                if len(wrappers) >= 5_000:
                    yield _wrapper_batch(wrappers)
                    wrappers = {}
        yield _wrapper_batch(wrappers)
        trim()

    def merged(table: pa.Table) -> pa.Table:
        total = None
        for x in sorted(table["wrapper"].to_pylist()):  # in any order of arrival the same
            total = json.loads(x) if total is None else prune(merge(total, json.loads(x)), 2 * WRAPPER_NODES)
        return pa.table({"host": table["host"].slice(0, 1), "wrapper": pa.array([json.dumps(prune(total))], pa.string()), "pages": pa.array([total[1]], pa.int64())})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int, int, int], int] = {}
        known = _Known(lambda x: Rule(json.loads(x), []))
        for batch in batches:
            for host, source, wrapper in zip(*batch.columns, strict=True):
                host, root, rule = host.as_py(), parse(source.as_py()), known[wrapper.as_py()]
                place(fold(root), rule.wrapper, rule.number)
                for node, text, size in _texts(root):
                    counts[host, node, text, size] = counts.get((host, node, text, size), 0) + 1
                if len(counts) >= 100_000:
                    yield _count_batch(counts)
                    counts = {}
        yield _count_batch(counts)
        trim()

    def ruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules = []
            for text, constant, rotating in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                chars: dict[int, int] = {}
                for c in constant or ():
                    chars[c["node"]] = chars.get(c["node"], 0) + c["n"] * c["size"]
                wrapper = json.loads(text)
                keep = content(wrapper, chars, set(rotating or ()))
                rules.append(json.dumps({"wrapper": wrapper, "keep": keep, "rotating": sorted(set(rotating or ()) & set(keep)), "constant": sorted((c["node"], c["text"]) for c in constant or () if c["node"] in set(keep))}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rules, pa.string())], names=["host", "rule"])

    rows = pages.filter(F.length(html_col) > 0).select(host_of(F.coalesce(url_col, F.lit(""))).alias("host"), F.col(html_col).alias("html"))
    parts = rows.mapInArrow(partial, "host string, wrapper string, pages long")
    some = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(16))).applyInArrow(merged, "host string, wrapper string, pages long")
    hosts = materialise(some.groupBy("host").applyInArrow(merged, "host string, wrapper string, pages long"))
    side = hosts.select("host", "wrapper")
    counts = rows.join(_small(side, "wrapper"), "host").mapInArrow(counted, "host string, node int, text long, size int, n long")
    counts = materialise(counts.groupBy("host", "node", "text", "size").agg(F.sum("n").alias("n")))
    large = hosts.filter(F.col("pages") >= CONSTANT_PAGES).select("host", "pages")
    often = counts.filter(F.col("n") >= CONSTANT_SHARE * CONSTANT_PAGES)
    constant = often.join(bounded(large, 128), "host").filter(F.col("n") >= CONSTANT_SHARE * F.col("pages"))
    constant = constant.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "text", "size", "n"))).alias("constant"))  # at most a page's texts / 0.9
    shown = counts.groupBy("host", "node").agg(F.count("*").alias("different"), F.sum("n").alias("shown"))
    rotating = shown.filter((F.col("different") <= ROTATING_SHARE * F.col("shown")) & (F.col("shown") >= ROTATING_PAGES))
    rotating = rotating.groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("rotating"))  # at most WRAPPER_NODES
    judged = side.join(constant, "host", "left").join(rotating, "host", "left")
    out = materialise(judged.mapInArrow(ruled, "host string, rule string"))
    release(counts)
    release(hosts)
    return out


def _texts(root: Node) -> set[tuple[int, int, int]]:
    """(node of the wrapper, text key, size) of a placed page's texts."""
    out: set[tuple[int, int, int]] = set()
    todo = [root]
    while todo:
        x = todo.pop()
        if not x.drop and x.at >= 0:
            for c in x.children:
                if isinstance(c, str):
                    out.add((x.at, text_key(c), len(c)))
                else:
                    todo.append(c)
    return out


def _all_texts(root: Node) -> Iterator[str]:
    todo: list[Node | str] = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        elif not x.drop:
            todo += reversed(x.children)


class _Known(dict):
    """What has been made of a text, for some thousand texts."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str):
        if len(self) >= 2_000:
            self.clear()
        self[key] = self.make(key)
        return self[key]


def _small(side: DataFrame, column: str) -> DataFrame:
    """``side``, to be broadcast if the bytes of its ``column`` were counted and are few."""
    size = side.agg(F.coalesce(F.sum(F.length(column) + F.length("host") + 64), F.lit(0))).first()[0]
    return F.broadcast(side) if 2 * size <= BROADCAST_BYTES else side


def _count_batch(counts: dict[tuple[str, int, int, int], int]) -> pa.RecordBatch:
    host, node, text, size = zip(*counts, strict=True) if counts else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(node, pa.int32()), pa.array(text, pa.int64()), pa.array(size, pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["host", "node", "text", "size", "n"])


def _wrapper_batch(wrappers: dict[str, list]) -> pa.RecordBatch:
    texts = [json.dumps(prune(w, 2 * WRAPPER_NODES)) for w in wrappers.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(wrappers), pa.string()), pa.array(texts, pa.string()), pa.array([w[1] for w in wrappers.values()], pa.int64())], names=["host", "wrapper", "pages"])


NEW = ["text", "n_chars"]


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``pages`` (all but the html), then text string and n_chars long.

    Null and empty html give ''. Pages without a host (null url, no ``://``) form a host of their own.
    Copies and near copies of a page that make up nearly all of a host stay whole: where template would be most of the
    text, all of it is kept. Pages of any length are taken whole; elements nested deeper than DEEPEST count as part of the one there.
    Rows stay as they are, repeated or not. A kept column with a new one's name comes out with ``_in`` behind it.
    """
    keep = [c for c in pages.columns if c != html_col] if keep is None else keep
    plain = Plain(pages, keep, NEW)
    url, source = plain.at(url_col), plain.at(html_col)
    side = induce(plain.rows, url, source).select(F.col("host").alias("_host"), F.col("rule").alias("_rule"))
    size = side.agg(F.coalesce(F.sum(F.length("_rule") + F.length("_host") + 64), F.lit(0))).first()[0]
    rows = plain.rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(plain.kept)], host_of(F.coalesce(F.col(url), F.lit(""))).alias("_host"), F.col(source).alias("_html"))
    joined = rows.join(F.broadcast(side) if 2 * size <= BROADCAST_BYTES else side, "_host", "left").drop("_host")
    schema = plain.schema(T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(Rule.load)
        for batch in batches:
            texts = []
            for html, rule in zip(*batch.columns[-2:], strict=True):
                html, rule = html.as_py(), rule.as_py()
                texts.append(extract_text(html, known[rule]) if html and rule else "")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)
        trim()

    return joined.mapInArrow(run, schema)
