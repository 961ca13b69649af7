"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a tree of block elements with text slots.  Neighbouring elements that
repeat, alone or as groups, are folded into one repeated node.  Aligning two
such trees level by level gives a wrapper: what both have is required, what one
has is optional, text that differs is a variable slot and text that never does
is part of the template.  Wrappers align with pages and with each other alike,
so the pages of a host are folded into one wrapper in any order: within tasks,
to which they are dealt by their texts, then between tasks.  Pages of a host
with equal texts count as one.

Every page is aligned with its host's wrapper, and what its nodes match decides
about their text: slots whose text is the same on the host's pages are template,
nodes that are mostly links on all of them are menus, varying slots are content.
Tags and class names are further witnesses, weighed against what a node holds
on the host's pages; a text that matches nothing follows the node around it,
and a wrapper without varying text has no content.
"""

from __future__ import annotations

import html
import json
import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborist.llm.common import fresh
from arborist.session import cut_lineage

# Names of HTML elements and usual words of class names.
RAW = frozenset("script style noscript template textarea iframe svg canvas object select head title".split())
VOID = frozenset("br img hr meta link input area base col embed source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var img wbr br".split()
)
BOILERPLATE = frozenset("nav header footer aside form button menu dialog fieldset".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS_END_P = frozenset(
    "address article aside blockquote dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split()
)
# Of these, a class name's part is enough for the first kind; the second needs its place or its links to agree.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies consent disqus modal nav navbar navigation "
    "newsletter pagination popup promo promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe widget widgets".split()
)
WEAK = frozenset("banner byline footer header menu notice notices pager skip toolbar".split())
PROSE = frozenset("article main p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption td th dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW_END = {tag: re.compile(rf"</{tag}(?![a-z0-9:-])", re.I | re.A) for tag in RAW}
BODY = re.compile("<body", re.I | re.A)
NUMBERED = re.compile(r"[^\s_-]*\d[^\s_-]*")
TEMPLATE_SHARE = 0.5  # of a host's pages of different texts: a text that so many have, and always the same, is template
CERTAIN_PAGES, CERTAIN_SHARE = 4, 0.8  # so many agree that it is template even at the edge of an article
RUNNING = 80  # characters of a block of running text
RARE_CHILDREN = 200  # beyond, children of labels that hardly a page has share one node per tag
DEPTH = 1 << 20  # of Python calls: trees are as deep as the page
CUT = -4  # evidence at which a node is cut off


class Node:
    """Wrapper or page node: how many pages have it, whether it repeats, its text and blocks of text, its children."""

    __slots__ = ("label", "pages", "repeats", "chars", "link_chars", "units", "constant", "children")

    def __init__(self, label: str):
        self.label, self.pages, self.repeats, self.chars, self.link_chars, self.units = label, 1, False, 0, 0, 0
        self.constant: str | None = None  # digest of the text; "" where it varies
        self.children: list[Node] = []

    def pack(self) -> list:
        """The tree as a flat list, node by node from the top, so that its depth doesn't matter."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            out.append([node.label, node.pages, int(node.repeats), node.chars, node.link_chars, node.units, node.constant, len(node.children)])
            stack.extend(reversed(node.children))
        return out

    @staticmethod
    def unpack(rows: list) -> Node:
        top = Node("")
        open_nodes: list[tuple[Node, int]] = [(top, 1)]
        for label, pages, repeats, chars, link_chars, units, constant, children in rows:
            node = Node(label)
            node.pages, node.repeats, node.chars, node.link_chars, node.units, node.constant = pages, bool(repeats), chars, link_chars, units, constant
            parent, left = open_nodes.pop()
            parent.children.append(node)
            if left > 1:
                open_nodes.append((parent, left - 1))
            if children:
                open_nodes.append((node, children))
        return top.children[0]


def label_of(tag: str, attrs: str) -> str:
    """Tag with class, id and role; parts of names with digits, which number or hash things, are one sign."""
    found = {}
    for name, *values in ATTRIBUTE.findall(attrs) if attrs else ():
        found.setdefault(name.lower(), next((v for v in values if v), "").lower())
    parts = [" ".join(NUMBERED.sub("#", found[n]).split()) for n in ("class", "id", "role") if found.get(n)]
    return " ".join([tag, *parts])


@lru_cache(maxsize=4096)
def witness(label: str) -> tuple[str, int, bool, bool]:
    """(tag, what class, id and role say against the node, whether they say so weakly, whether it is marked as an article)."""
    tag, _, rest = label.partition(" ")
    if label.startswith("(") or tag in ("body", "html", "#text", "#page"):
        return tag, 0, False, False
    marked = tag in ("article", "main") or "main" in rest.split()
    whole = {t.strip("#-_") for t in rest.split()}
    parts = {p for t in whole for p in re.split(r"[-_#]+", t)} if tag not in PROSE else whole
    against = 6 if whole & (STRONG | WEAK) or parts & STRONG else 0
    if tag == "form":
        against += 6
    return tag, against, not against and bool(parts & WEAK), marked


def article(label: str) -> bool:
    return witness(label)[3]


def holds_article(node: Node) -> bool:
    stack = list(node.children)
    while stack:
        c = stack.pop()
        _, against, _, marked = witness(c.label)
        if marked and not against:
            return True
        stack.extend(c.children)
    return False


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", tag, attributes), ("close", tag, "") and ("text", text, "") of a page, raw elements left out."""
    at, size = 0, len(page)
    for_match = TOKEN.search
    while at < size:
        m = for_match(page, at)
        if m is None:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            yield "close", tag, ""
        elif tag in RAW:
            end = RAW_END[tag].search(page, at)
            if end is not None:
                closing = page.find(">", end.end())
                at = size if closing < 0 else closing + 1
            elif tag == "head":
                body = BODY.search(page, at)
                at = body.start() if body else at
            else:
                at = size
        else:
            yield "open", tag, m["attrs"]


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The page's tree of block elements, and its texts in order, each with the node whose slot it fills."""
    root = Node("#page")
    stack: list[Node] = [root]
    tags: list[str] = ["#page"]
    texts: list[tuple[Node, str]] = []
    run: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            node = stack[-1]
            slot = next((c for c in node.children[-1:] if c.label == "#text"), None)
            if slot is None:
                slot = Node("#text")
                node.children.append(slot)
            slot.chars += len(text)
            slot.units += 1
            slot.link_chars += min(linked, len(text))
            mark = blake2b(text.encode(), digest_size=8).hexdigest()
            slot.constant = mark if slot.constant is None else blake2b((slot.constant + mark).encode(), digest_size=8).hexdigest()
            texts.append((slot, text))
        linked = 0

    def close(at: int) -> None:
        flush()
        del stack[at:], tags[at:]

    for kind, value, attrs in events(page):
        if kind == "text":
            run.append(value)
            linked += len(value) if links else 0
        elif value in INLINE:
            if value == "br":
                run.append(" ")
            elif value == "a":
                links = max(0, links + (1 if kind == "open" else -1))
        elif kind == "open":
            links = 0
            ends = SELF_CLOSING.get(value, set()) | ({"p"} if value in BLOCKS_END_P else set())
            for at in range(len(tags) - 1, 0, -1):
                if tags[at] in ends:
                    close(at)
                    break
                if tags[at] in ("ul", "ol", "table", "div", "section", "article", "body"):
                    break
            flush()
            if value in VOID:
                continue
            node = Node(label_of(value, attrs))
            stack[-1].children.append(node)
            stack.append(node)
            tags.append(value)
        else:
            links = 0
            flush()
            for at in range(len(tags) - 1, 0, -1):
                if tags[at] == value:
                    close(at)
                    break
    flush()
    return root, texts


def merge(a: Node, b: Node, same_page: bool = False) -> Node:
    """What matches both `a` and `b`; `same_page`: they repeat within one page."""
    out = Node(a.label)
    out.pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    out.repeats = a.repeats or b.repeats or same_page
    out.chars, out.link_chars, out.units = a.chars + b.chars, a.link_chars + b.link_chars, a.units + b.units
    out.constant = a.constant if a.constant == b.constant else ""
    out.children = [x if y is None else y if x is None else merge(x, y, same_page) for x, y in align(regroup(a.children, b.children), regroup(b.children, a.children))]
    if len(out.children) > RARE_CHILDREN:
        out.children = gather_rare(out.children, out.pages)
    return out


def any_label(label: str) -> str:
    """The label of all nodes of a tag whose own labels are rare."""
    return label.partition(" ")[0] + " *"


def gather_rare(children: list[Node], pages: int) -> list[Node]:
    """Children with labels of their own that hardly a page has, as one node per tag."""
    out: list[Node] = []
    rare: dict[str, Node] = {}
    for c in children:
        label = any_label(c.label)
        if c.label.startswith(("(", "#")) or (c.label != label and 50 * c.pages > pages):
            out.append(c)
            continue
        held = rare.get(label)
        c.label = label
        if held is None:
            rare[label] = c
            out.append(c)
        else:
            total = held.pages + c.pages
            absorb(held, c, {})
            held.pages = total
    return out


def align(a: list[Node], b: list[Node]) -> list[tuple[Node | None, Node | None]]:
    """Pairs of two sibling lists by a longest common subsequence of labels; what has no partner is optional.

    A row of the usual table is the number whose bit i says that a[i] lengthens
    the subsequence of a[i:] and b[j:].  Every so many rows are kept and those
    between made again, so memory grows with len(a) * sqrt(len(b)) bits.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head].label == b[head].label:
        head += 1
    pairs: list[tuple[Node | None, Node | None]] = list(zip(a[:head], b[:head], strict=True))
    a, b = a[head:], b[head:]
    if a and b:
        n, m = len(a), len(b)
        places: dict[str, list[int]] = {}
        for i, x in enumerate(a):
            places.setdefault(x.label, []).append(n - 1 - i)
        ones = (1 << n) - 1

        @lru_cache(maxsize=256)
        def held(label: str) -> int:
            bits = bytearray(n // 8 + 1)
            for k in places.get(label, ()):
                bits[k >> 3] |= 1 << (k & 7)
            return int.from_bytes(bits, "little")

        def above(row: int, j: int) -> int:
            """Row j from row j + 1; a zero at bit n - 1 - i says that a[i] lengthens."""
            same = row & held(b[j].label)
            return ((row + same) | (row - same)) & ones

        step = isqrt(m) + 1
        kept = {m: ones}
        row = ones
        for j in range(m - 1, -1, -1):
            row = above(row, j)
            if j % step == 0:
                kept[j] = row
        i = j = 0
        rows: dict[int, bytes] = {}
        while i < n and j < m:
            if j not in rows:
                rows, top = {}, min(m, (j // step + 1) * step)
                row = kept[top]
                for k in range(top - 1, j - 1, -1):
                    row = above(row, k)
                    rows[k] = row.to_bytes(n // 8 + 1, "little")
            at = n - 1 - i
            if a[i].label == b[j].label:
                pairs.append((a[i], b[j]))
                i, j = i + 1, j + 1
            elif rows[j][at >> 3] >> (at & 7) & 1:
                pairs.append((a[i], None))
                i += 1
            else:
                pairs.append((None, b[j]))
                j += 1
        a, b = a[i:], b[j:]
    return pairs + [(x, None) for x in a] + [(None, y) for y in b]


def group_of(nodes: list[Node]) -> Node:
    group = Node("(" + "|".join(n.label for n in nodes) + ")")
    group.pages = max(n.pages for n in nodes)
    group.children = nodes
    return group


def regroup(own: list[Node], other: list[Node]) -> list[Node]:
    """Siblings with single occurrences of groups that `other` found to repeat put into groups as well."""
    for pattern in {n.label: [c.label for c in n.children] for n in other if n.label.startswith("(")}.values():
        out, k = [], 0
        while k < len(own):
            if [n.label for n in own[k : k + len(pattern)]] == pattern:
                out.append(group_of(own[k : k + len(pattern)]))
                k += len(pattern)
            else:
                out.append(own[k])
                k += 1
        own = out
    return own


def fold(node: Node, place: dict[int, Node], longest: int = 4) -> Node:
    """The page's tree with neighbouring repeats folded, single elements first, then groups of up to `longest`.

    `place` follows where each original node went.
    """
    node.children = [fold(c, place, longest) for c in node.children]
    for period in range(1, longest + 1):
        out: list[Node] = []
        own, k = node.children, 0
        labels = [c.label for c in own]
        while k < len(own):
            times = 1
            while labels[k : k + period] == labels[k + times * period : k + (times + 1) * period]:
                times += 1
            if times < 2 or len(labels[k : k + period]) < period:
                out.append(own[k])
                k += 1
                continue
            units = [own[k + t * period] if period == 1 else group_of(own[k + t * period : k + (t + 1) * period]) for t in range(times)]
            total = units[0]
            for u in units[1:]:
                total = absorb(total, u, place)
            total.repeats = True
            out.append(total)
            k += times * period
        node.children = out
    return node


def absorb(into: Node, other: Node, place: dict[int, Node]) -> Node:
    """Merge `other` into `into`, in place, as a repeat on the same page."""
    place[id(other)] = into
    into.repeats = into.repeats or other.repeats
    into.chars, into.link_chars, into.units = into.chars + other.chars, into.link_chars + other.link_chars, into.units + other.units
    into.constant = into.constant if into.constant == other.constant else ""
    children = []
    for x, y in align(regroup(into.children, other.children), regroup(other.children, into.children)):
        if x is not None and y is not None:
            absorb(x, y, place)
        children.append(y if x is None else x)
    into.children = children
    return into


def page_tree(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """Folded tree of a page, and its texts with the folded nodes that they belong to."""
    root, texts = parse(page)
    place: dict[int, Node] = {}
    keep = [root]  # ids must stay taken while `place` is in use
    _hold(root, keep)
    root = fold(root, place)

    def final(node: Node) -> Node:
        while id(node) in place:
            node = place[id(node)]
        return node

    return root, [(final(slot), text) for slot, text in texts]


def _hold(node: Node, keep: list[Node]) -> None:
    stack = [node]
    while stack:
        children = stack.pop().children
        keep.extend(children)
        stack.extend(children)


class Host:
    """A wrapper with what its nodes hold on all pages of the host."""

    def __init__(self, wrapper: Node):
        self.wrapper = wrapper
        self.sizes: dict[int, tuple[int, int, int, int]] = {}  # characters, those in links, varying ones, running text that varies
        order, stack = [], [wrapper]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.children)
        for node in reversed(order):
            below = [self.sizes[id(c)] for c in node.children]
            varies = node.label == "#text" and not self.template(node)
            own = (node.chars, node.link_chars, node.chars * varies, max(0, node.chars - 2 * node.link_chars) * varies)
            self.sizes[id(node)] = tuple(map(sum, zip(own, *below)))
        total = self.sizes[id(wrapper)][3]
        self.central = {id(n) for n in order if total and 2 * self.sizes[id(n)][3] > total}

    def template(self, slot: Node, certain: bool = False) -> bool:
        """Whether a text slot is part of the template: the same on two different pages at least, and on enough of them."""
        least = CERTAIN_PAGES if certain else 2
        share = CERTAIN_SHARE if certain else TEMPLATE_SHARE
        return bool(slot.constant) and slot.pages >= max(least, share * self.wrapper.pages)


def extract(page: str, host: Host) -> str:
    """Texts of the article of a page, a line each, as the host's wrapper tells them.

    Text is kept where its slot in the wrapper varies over the host, and cut off
    where the evidence about a node around it is against it: tags, class names,
    links on the host's pages, place.  What a node holds outweighs its names: an
    article, or most of the varying text of the host.  All marked regions of the
    page are its article, in which only what nearly all of many pages have at
    its edges is template.  On a page without text in any, it is the part
    with most of the text that varies, and beside it all text that varies and is
    not mostly links; a host with a single text has no variation to go by, and
    there only running text and headings beside the main part are kept.
    """
    root, texts = page_tree(page)
    partner: dict[int, Node] = {id(root): host.wrapper}
    around: dict[int, Node] = {}  # of nodes without a partner: that of the nearest node above them
    masses: dict[tuple[int, bool], int] = {}
    lone = host.wrapper.pages < 2
    chosen: set[int] = set()
    stack = [(root, host.wrapper)]
    while stack:
        p, w = stack.pop()
        named: dict[str, Node] = {}
        for c in w.children:
            named.setdefault(c.label, c)
        for x, y in align(regroup(p.children, w.children), regroup(w.children, p.children)):
            if x is None:
                continue
            y = y or named.get(x.label) or named.get(any_label(x.label))
            if y is not None:
                partner[id(x)] = y
                stack.append((x, y))
                continue
            below = [x]
            while below:
                n = below.pop()
                around[id(n)] = w
                below.extend(n.children)

    def template(p: Node, certain: bool = False) -> bool:
        w = partner.get(id(p))
        if w is None:  # follows the node around it
            w = around.get(id(p))
            return w is None or not host.sizes[id(w)][2]
        return host.template(w, certain)

    def link_share(p: Node) -> float:
        """Share of links in a node's text, on the pages of the host that have it."""
        w = partner.get(id(p))
        if w is None:
            chars = links = 0
            below = [p]
            while below:
                n = below.pop()
                chars, links = chars + n.chars, links + n.link_chars
                below.extend(n.children)
        else:
            chars, links = host.sizes[id(w)][:2]
        return links / chars if chars else 0.0

    def evidence(p: Node, marked: bool, names: bool, edge: bool) -> int:
        """What tells against a node (negative), `edge`: no running text of its parent on one side of it."""
        tag, against, weak, _ = witness(p.label)
        out = 0
        if tag in BOILERPLATE and tag != "form" and not (tag == "header" and marked):
            out -= 8
        if names and (against or weak):
            if weak:
                against = 2 + 2 * (edge or link_share(p) > 0.2)
            if id(partner.get(id(p))) in host.central or (not marked and (article(p.label) or holds_article(p))):
                against = 0
            out -= against
        return out

    def kept(p: Node, marked: bool, names: bool) -> list[Node]:
        """Children that nothing tells against; in their order."""
        edges = set()
        for side in (p.children, reversed(p.children)):
            for c in side:
                if c.label != "#text" and witness(c.label)[2]:
                    edges.add(id(c))
                elif c.units and c.chars >= RUNNING or c.children:
                    break
        return [c for c in p.children if c.label == "#text" or evidence(c, marked, names, id(c) in edges) > CUT]

    def mass(p: Node, names: bool) -> int:
        """Characters of running text below a node that vary between pages."""
        if (id(p), names) not in masses:
            total = 0 if p.label != "#text" or template(p) else max(0, p.chars - 2 * p.link_chars)
            for c in kept(p, False, names):
                total += mass(c, names)
            masses[id(p), names] = total
        return masses[id(p), names]

    def collect(p: Node, marked: bool, names: bool) -> None:
        if p.label == "#text":
            if not template(p) or (marked and id(p) in partner):
                chosen.add(id(p))
            return
        for c in kept(p, marked, names):
            collect(c, marked, names)

    def trim(region: Node) -> None:
        """Leave out what is certainly template before and after the other text of a region."""
        inside = []
        below = [region]
        while below:
            n = below.pop()
            if id(n) in chosen:
                inside.append(n)
            below.extend(reversed(n.children))
        own = [n for n in inside if not template(n, True)]
        if own:
            first, last = inside.index(own[0]), inside.index(own[-1])
            chosen.difference_update(id(n) for n in inside[:first] + inside[last + 1 :])

    def leads(p: Node, inner: set[int]) -> bool:
        below = list(p.children)
        while below:
            n = below.pop()
            if id(n) in inner:
                return True
            below.extend(n.children)
        return False

    def beside(p: Node, inner: set[int], marked: bool, names: bool) -> None:
        """All of the `inner` nodes; of what is around them, text that varies and is not mostly links."""
        fine = {id(c) for c in kept(p, marked, names)}
        for c in p.children:
            if id(c) in inner:
                take(c, names) if marked else collect(c, False, names)
            elif leads(c, inner):
                beside(c, inner, marked, names)
            elif id(c) not in fine or link_share(c) > 0.5:
                continue
            elif c.label == "#text":
                if not template(c) and not (lone and c.chars < RUNNING * c.units and witness(p.label)[0] not in HEADINGS):
                    chosen.add(id(c))
            else:
                beside(c, set(), marked, names)

    def regions(node: Node, names: bool) -> list[Node]:
        """The outermost article regions below `node` that nothing around them tells against."""
        out, below = [], [node]
        while below:
            n = below.pop()
            if article(n.label):
                out.append(n)
            else:
                below.extend(reversed(kept(n, False, names)))
        return out

    def take(region: Node, names: bool) -> None:
        """A marked region; one that is no article itself may hold articles among other things."""
        inner: list[Node] = []
        if region.label.partition(" ")[0] != "article":
            for c in kept(region, True, True):
                inner += regions(c, True)
        if inner:
            beside(region, {id(r) for r in inner}, True, names)
        else:
            collect(region, True, names)
            trim(region)

    def dominant(names: bool) -> Node:
        """Where most of the running text that varies is; link lists within it are no boilerplate."""
        region = root
        while True:
            inner = [c for c in kept(region, False, names) if c.label != "#text"]
            child = max(inner, key=lambda c: mass(c, names), default=None)
            total = mass(region, names)
            if child is None or not total or mass(child, names) < 0.6 * total or child.repeats or any(c.label == "#text" for c in child.children):
                return region
            region = child

    for names in (True, False):  # a page whose text is all below such names keeps it
        for region in regions(root, True):
            take(region, names)
        if not chosen:
            region = dominant(names)
            if region is root:
                beside(root, set(), False, names)
            else:
                beside(root, {id(region)}, False, names)
        if chosen:
            break
    return "\n".join(text for slot, text in texts if id(slot) in chosen)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; an empty string where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


TREES = pa.schema([("host", pa.string()), ("salt", pa.int32()), ("content", pa.binary()), ("wrapper", pa.string())])
WRAPPERS = pa.schema([("host", pa.string()), ("wrapper", pa.string())])


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", salts: int = 64) -> DataFrame:
    """One wrapper per host, from all its pages of different texts: host, wrapper (JSON).

    Trees, which hold no text, are dealt by the digest of their page's texts, so copies
    meet and count once.  A task reads its trees in order, one at a time.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEPTH)
        seen: set[tuple[str, bytes]] = set()
        for batch in batches:
            rows = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree, texts = page_tree(page)
                content = blake2b("\n".join(text for _, text in texts).encode(), digest_size=16).digest()
                if (host, content) not in seen:
                    seen.add((host, content))
                    rows.append((host, content[0] % salts, content, json.dumps(tree.pack())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 4, TREES, strict=True)], schema=TREES)

    def fold_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEPTH)
        host: str | None = None
        last, total = b"", Node("#page")
        done: list[tuple[str, str]] = []
        for batch in batches:
            for h, content, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if h == host and content == last:
                    continue
                tree = Node.unpack(json.loads(text))
                if h == host:
                    total = merge(total, tree)
                else:
                    if host is not None:
                        done.append((host, json.dumps(total.pack())))
                    host, total = h, tree
                last = content
        if host is not None:
            done.append((host, json.dumps(total.pack())))
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in done], pa.string()), pa.array([w for _, w in done], pa.string())], schema=WRAPPERS)

    def join(table: pa.Table) -> pa.Table:
        sys.setrecursionlimit(DEPTH)
        total: Node | None = None
        for text in sorted(table["wrapper"].to_pylist()):
            node = Node.unpack(json.loads(text))
            total = node if total is None else merge(total, node)
        return pa.table([table["host"][:1].combine_chunks(), pa.array([json.dumps(total.pack())])], schema=WRAPPERS)

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("page"))
    trees = rows.mapInArrow(learn, "host STRING, salt INT, content BINARY, wrapper STRING")
    dealt = trees.repartition("host", "salt").sortWithinPartitions("host", "content", "wrapper")
    kind = "host STRING, wrapper STRING"
    return dealt.mapInArrow(fold_trees, kind).groupBy("host").applyInArrow(join, kind)


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All rows of `pages` with `main_text`, the article of the whole page.

    Blocks are lines in page order; character references are decoded and white
    space within a block is one space.  Nothing else is dropped or cut.  A null
    or empty page has an empty text.  Pages without a host in their URL, a null
    one included, share a wrapper.  Repeated pages and other columns are kept
    as they are; an added column that clashes with one of them gets a leading
    underscore.  An empty table gives an empty result.

    Wrappers are a row per host.  They are stored, so that the join is planned
    from their size: below Spark's broadcast limit pages stay where they are,
    above it both sides are shuffled and a host with many pages is split.
    """
    text, host_name, page_name, wrapper_name = fresh(pages, "main_text", "host", "page", "wrapper")
    wrappers = cut_lineage(infer_wrappers(pages, url_col, html_col))
    source = pages.withColumns({host_name: host_of(F.col(url_col)), page_name: F.coalesce(F.col(html_col), F.lit(""))})
    joined = source.join(wrappers.toDF(host_name, wrapper_name), host_name)
    kept = pages.columns
    names = [*kept, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEPTH)
        known: dict[str, Host] = {}
        for batch in batches:
            out = []
            for page, packed in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist(), strict=True):
                if packed not in known:
                    if len(known) > 256:
                        known.clear()
                    known[packed] = Host(Node.unpack(json.loads(packed)))
                out.append(extract(page, known[packed]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, pa.string())], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields), f"`{text}` STRING"])
    return joined.select(*kept, page_name, wrapper_name).mapInArrow(run, schema)
