"""HTML extraction by wrapper induction.

A few pages of each host are parsed to trees of blocks and aligned by simple tree matching into the host's tree of slots. Every page of the
host is then aligned with that tree, and each slot is judged by what it held on all of them: the path of slots that hold most of the
varying text leads to the article; slots beside that path which stand on most pages in one shape with little text that repeats itself, or are
lists of links, are template, as are slots whose text is the same everywhere. Beside an article element, shape decides without repeats. Kinds of elements (nav, footer, form, ...) are a prior. A name of a class, id
or role counts only where an alignment agrees: in the slot itself, or, on hosts with too few pages, in how the corpus's other hosts used it.
"""

from __future__ import annotations

import html
import json
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwright.llm.common import cut

#: Reference keys (rows) and templates (characters in all) that may be broadcast, as counted; above that, pages are shuffled to them, each
#: host's in so many salted parts.
MOST_KEYS, MOST_CHARS, SALTS = 200_000, 32 << 20, 64
#: Pages a host's tree of slots is induced from: those with the smallest hashes, each different page once. All pages are then counted on it.
REFERENCES = 8
#: Pages that must have a slot before it is judged.
AGREEING = 3
#: Shares of pages: a slot's usual place or shape; a text that is the same everywhere. Characters of a short slot; share of links in a menu.
USUAL, SAME, SHORT, LINKS = 0.6, 0.9, 400, 0.6
#: Hosts whose alignments must have judged a name, and the share of them that must agree.
NAMED_HOSTS, NAMED_SHARE = 3, 0.8
#: Pairs of shapes, and templates, that a task remembers before it starts afresh.
CACHE, TEMPLATES_HELD = 200_000, 2000

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template svg".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
BLOCK = CLOSES_P | frozenset("html head body li dt dd tr td th caption thead tbody tfoot option title".split())
CLOSES_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Kinds that hold running text: never template for their shape alone.
TEXT_KINDS = frozenset("h1 h2 h3 h4 h5 h6 hgroup p blockquote pre figure figcaption article main dl dt dd table tr td th".split())
# Elements that are not the article, and names (of class, id or role) that speak against it.
NOT_CONTENT = frozenset("head nav footer aside form script style noscript noembed noframes title iframe button select template svg dialog textarea input object canvas".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup "
    "sidebar side aside complementary menu nav navbar navigation topbar breadcrumb breadcrumbs pagination pager footer contentinfo header masthead comment comments reply replies respond disqus discussion related recommended share sharing social widget toolbar search login skip".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTRS = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

# Trees are walked by plain Python calls, which take no room on the C stack.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


class Node:
    """An element: tag, label (tag and class), names (tokens of class, id and role), kids (Nodes and strings)."""

    __slots__ = ("kids", "label", "names", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.kids, self.names, self.label = tag, [], (), tag
        if "=" in attrs:
            found = [(k.lower(), v.strip("\"'").lower()) for k, v in ATTRS.findall(attrs)]
            if found:
                self.names = tuple(sorted({w for _, v in found for w in v.split()}))
                self.label = tag + "." + " ".join(v for k, v in found if k == "class")


def parse(page: str) -> Node:
    """A tree of the page. Unclosed, misnested and cut-off markup gives a tree as well; comments and declarations are dropped."""
    root = Node("#root")
    stack, pos = [root], 0
    opened: Counter = Counter()  # open elements by tag

    def close(i: int) -> None:
        for n in stack[i:]:
            opened[n.tag] -= 1
        del stack[i:]

    while True:
        m = TOKEN.search(page, pos)
        if m is None:
            break
        if m.start() > pos:
            stack[-1].kids.append(html.unescape(page[pos : m.start()]))
        pos = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if opened[tag] > 0:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
            continue
        if tag in CLOSES_P:
            if opened["p"] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag in BLOCK:
                        break
        elif tag in CLOSES_SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag or tag in ("td", "th") and stack[i].tag in ("td", "th") or tag in ("dt", "dd") and stack[i].tag in ("dt", "dd"):
                    close(i)
                    break
                if stack[i].tag in CLOSES_SAME[tag]:
                    break
        node = Node(tag, m.group(3))
        stack[-1].kids.append(node)
        if tag in VOID or m.group(3).endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|$)", re.I).search(page, pos)
            node.kids.append(page[pos : end.start() if end else len(page)])
            pos = end.end() if end else len(page)
            continue
        stack.append(node)
        opened[tag] += 1
    if pos < len(page):
        stack[-1].kids.append(html.unescape(page[pos:]))
    return root


class Tree:
    """A block of a page for matching: its label, own text (that of no block inside it) and the blocks in it; size (blocks), shape and full
    are hashes of its labels, and of its labels and texts. links: characters of own text that stand in links."""

    __slots__ = ("full", "kids", "label", "links", "node", "shape", "size", "text")


def tree(node: Node) -> Tree:
    """The blocks of a page; what is never text is left out, inline elements are seen through."""
    t = Tree()
    t.node, t.label, t.kids = node, node.label, []
    parts: list[str] = []
    t.links = 0
    todo = [(k, node.tag == "a") for k in reversed(node.kids)]
    while todo:
        k, linked = todo.pop()
        if isinstance(k, str):
            parts.append(k)
            t.links += len(k) if linked else 0
        elif k.tag in BLOCK:
            if k.tag not in ("head", "title"):
                t.kids.append(tree(k))
                parts.append(" ")
        elif k.tag == "br":
            parts.append(" ")
        elif k.tag not in VOID and k.tag not in NOT_CONTENT:
            todo += [(x, linked or k.tag == "a") for x in reversed(k.kids)]
    t.text = " ".join("".join(parts).split())
    shape, full, t.size = xxhash.xxh64(t.label), xxhash.xxh64(t.text), 1
    for k in t.kids:
        shape.update(k.shape.to_bytes(8, "little"))
        full.update(k.full.to_bytes(8, "little"))
        t.size += k.size
    t.shape = shape.intdigest() >> 1
    full.update(t.shape.to_bytes(8, "little"))
    t.full = full.intdigest() >> 1
    return t


Memo = dict[tuple[int, int], int]


def match(a: Tree, b: Tree, memo: Memo) -> int:
    """Simple tree matching: the size of the largest order-keeping mapping of equal labels, top down."""
    if a.label != b.label:
        return 0
    if a.shape == b.shape:
        return a.size
    key = (a.shape, b.shape)
    if key not in memo:
        memo[key] = 1 + _weight(a.kids, b.kids, memo)
    return memo[key]


def _ends(xs: list[Tree], ys: list[Tree], same: str) -> tuple[int, int]:
    """How many first and how many last children are equal in `same`; to map equal ones there is as good as anything."""
    n, a, b = min(len(xs), len(ys)), 0, 0
    while a < n and getattr(xs[a], same) == getattr(ys[a], same):
        a += 1
    while b < n - a and getattr(xs[-1 - b], same) == getattr(ys[-1 - b], same):
        b += 1
    return a, b


class _Rows:
    """The table of a matching of children, row by row: best[j] of the rows so far with the first j of ys."""

    def __init__(self, ys: list[Tree], memo: Memo):
        shapes: dict[int, int] = {}
        self.of = np.array([shapes.setdefault(y.shape, len(shapes)) for y in ys], np.int64)
        self.kinds = [ys[i] for i in np.unique(self.of, return_index=True)[1].tolist()]
        self.memo, self.known = memo, {}

    def after(self, last: np.ndarray, x: Tree) -> np.ndarray:
        if x.shape not in self.known:
            self.known[x.shape] = np.array([match(x, y, self.memo) for y in self.kinds], np.int64)[self.of]
        return np.append(0, np.maximum.accumulate(np.maximum(last[1:], last[:-1] + self.known[x.shape])))


def _weight(xs: list[Tree], ys: list[Tree], memo: Memo) -> int:
    a, b = _ends(xs, ys, "shape")
    out = sum(x.size for x in xs[:a]) + sum(x.size for x in xs[len(xs) - b :])
    xs, ys = xs[a : len(xs) - b], ys[a : len(ys) - b]
    if not xs or not ys:
        return out
    rows, last = _Rows(ys, memo), np.zeros(len(ys) + 1, np.int64)
    for x in xs:
        last = rows.after(last, x)
    return out + int(last[-1])


def _mapped(xs: list[Tree], ys: list[Tree], memo: Memo) -> list[tuple[int, int]]:
    """The pairs of children that simple tree matching maps. Of the table's rows only some are kept; the others are made again on the way back."""
    a, b = _ends(xs, ys, "shape")
    out = [(k, k) for k in range(a)]
    tail = [(len(xs) - k, len(ys) - k) for k in range(b, 0, -1)]
    xs, ys = xs[a : len(xs) - b], ys[a : len(ys) - b]
    i, j, back = len(xs), len(ys), []
    if i and j:
        step, table, kept, last = math.isqrt(i) + 1, _Rows(ys, memo), [], np.zeros(j + 1, np.int64)
        for k, x in enumerate(xs):
            if k % step == 0:
                kept.append(last)
            last = table.after(last, x)
        while i and j:
            lo = (i - 1) // step * step
            rows = [kept[lo // step]]
            for x in xs[lo:i]:
                rows.append(table.after(rows[-1], x))
            while i > lo and j:
                if rows[i - lo][j] == rows[i - lo - 1][j]:
                    i -= 1
                elif rows[i - lo][j] == rows[i - lo][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    back.append((a + i, a + j))
    return out + back[::-1] + tail


def aligned(xs: list[Tree], ys: list[Tree], memo: Memo) -> list[tuple[int, int]]:
    """Pairs of children: equal sub-trees, texts included, at both ends and where they stand once on either side, in the longest common
    order; between them what simple tree matching maps."""
    a, b = _ends(xs, ys, "full")
    m, n = len(xs) - b, len(ys) - b
    at: dict[int, int] = {}
    for i in range(a, m):
        at[xs[i].full] = -1 if xs[i].full in at or not xs[i].text and not xs[i].kids else i
    there: dict[int, int] = {}
    for j in range(a, n):
        there[ys[j].full] = -1 if ys[j].full in there else j
    found = sorted((i, there[h]) for h, i in at.items() if i >= 0 and there.get(h, -1) >= 0)
    tops: list[int] = []  # longest run of rising places: piles, and of each pair the one before it
    piles: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(found):
        lo, hi = 0, len(tops)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if tops[mid] < j else (lo, mid)
        tops[lo : lo + 1], piles[lo : lo + 1] = [j], [k]
        before.append(piles[lo - 1] if lo else -1)
    anchors, k = [], piles[-1] if piles else -1
    while k >= 0:
        anchors.append(found[k])
        k = before[k]
    out, i, j = [(k, k) for k in range(a)], a, a
    for x, y in [*anchors[::-1], (m, n)]:
        out += [(i + p, j + q) for p, q in _mapped(xs[i:x], ys[j:y], memo)]
        if x < m:
            out.append((x, y))
        i, j = x + 1, y + 1
    return out + [(m + k, n + k) for k in range(b)]


class Slot:
    """A place of a host's pages: what was aligned there on the reference pages."""

    __slots__ = ("full", "kids", "label", "names", "shape", "shapes", "size", "tag", "text", "texts")


def _slot(t: Tree) -> Slot:
    s = Slot()
    s.label, s.tag, s.names, s.shape, s.full, s.size, s.text = t.label, t.node.tag, t.node.names, t.shape, t.full, t.size, t.text
    s.shapes, s.texts, s.kids = Counter([t.shape]), Counter([t.text]), []
    for k in t.kids:
        s.kids.append(_slot(k))
    return s


def _merge(into: Slot, t: Tree, memo: Memo) -> None:
    into.shapes[t.shape] += 1
    into.texts[t.text] += 1
    pairs = aligned(into.kids, t.kids, memo)
    for i, j in pairs:
        _merge(into.kids[i], t.kids[j], memo)
    mapped, kids, at = {j: i for i, j in pairs}, [], 0
    for j, k in enumerate(t.kids):  # unmatched children go in where they stand
        if j in mapped:
            kids += into.kids[at : mapped[j] + 1]
            at = mapped[j] + 1
        else:
            kids.append(_slot(k))
    grown = len(pairs) < len(t.kids)
    into.kids = kids + into.kids[at:]
    if grown:
        digest = xxhash.xxh64(into.label)
        for k in into.kids:
            digest.update(k.shape.to_bytes(8, "little"))
        into.shape = digest.intdigest() >> 1
        into.full = xxhash.xxh64_intdigest(f"{into.shape}:{into.text}") >> 1
    into.size = 1 + sum(k.size for k in into.kids)


def induce(pages: list[str]) -> list[list]:
    """The host's slots in document order, from its reference pages: label, number of the slot around (-1: none), tag, names, and the most
    common shape and text."""
    trees = [tree(parse(p)) for p in pages]
    if not trees:
        return []
    root, memo = _slot(trees[0]), {}
    for t in trees[1:]:
        _merge(root, t, memo)
    out: list[list] = []
    todo = [(root, -1)]
    while todo:
        s, up = todo.pop()
        most = lambda c: min(c.items(), key=lambda x: (-x[1], x[0]))[0]
        todo += [(k, len(out)) for k in reversed(s.kids)]
        out.append([s.label, up, s.tag, list(s.names), most(s.shapes), most(s.texts)])
    return out


class Wrapper:
    """A host's slots, as trees to align pages with. Once they are judged: drop, of each slot, whether it is template (and all in it), and
    top, the slot that holds the article."""

    def __init__(self, slots: list[list], drop: list[int] | None = None, top: int = 0):
        self.slots, self.drop, self.top, self.memo = slots, drop, top, {}
        self.openings = [opening(s[5]) for s in slots]
        self.trees = []
        for label, up, _, _, _, text in slots:
            t = Tree()
            t.node, t.label, t.text, t.kids, t.size = len(self.trees), label, text, [], 1
            self.trees.append(t)
            if up >= 0:
                self.trees[up].kids.append(t)
        for t in reversed(self.trees):
            shape, full = xxhash.xxh64(t.label), xxhash.xxh64(t.text)
            for k in t.kids:
                shape.update(k.shape.to_bytes(8, "little"))
                full.update(k.full.to_bytes(8, "little"))
                t.size += k.size
            t.shape = shape.intdigest() >> 1
            full.update(t.shape.to_bytes(8, "little"))
            t.full = full.intdigest() >> 1

    def placed(self, page: Tree) -> list[tuple[int, Tree]]:
        """(slot, block of the page) of all blocks that have a slot."""
        if len(self.memo) > CACHE:
            self.memo = {}
        out, todo = [], [(self.trees[0], page)] if self.trees else []
        while todo:
            t, own = todo.pop()
            out.append((t.node, own))
            todo += [(t.kids[i], own.kids[j]) for i, j in aligned(t.kids, own.kids, self.memo)]
        return out


#: What is counted of a slot: pages that have it, characters of its text (that of blocks without a slot in it, too) and those in links, pages
#: with its most common text, with its most common shape and with a text that opens like that one, and the least and greatest key of pages
#: with that text.
COUNTS = ("n", "chars", "links", "same", "shaped", "kin", "low", "high")


def opening(text: str) -> str:
    """The first two words, or a first one that is a mark."""
    words = text.split(None, 2)[:2]
    return words[0] if words and not any(c.isalnum() for c in words[0]) else " ".join(words)


def counted(wrapper: Wrapper, page: str, into: dict[int, list[int]]) -> None:
    """Adds a page to the counts of its host's slots."""
    root = tree(parse(page))
    pairs = wrapper.placed(root)
    slot_of = {id(own): s for s, own in pairs}
    whole = 0  # of all its texts: what stands beside a text tells its page from the host's others
    extra: Counter = Counter()
    todo = [(root, -1)]
    while todo:
        t, inside = todo.pop()
        inside = slot_of.get(id(t), inside)
        extra[inside] += len(t.text)
        whole += xxhash.xxh64_intdigest(t.text)
        todo += [(k, inside) for k in t.kids]
    for s, own in pairs:
        _, _, _, _, shape, text = wrapper.slots[s]
        c = into.setdefault(s, [0, 0, 0, 0, 0, 0, 1 << 62, -1])
        c[0] += 1
        c[1] += extra[s]
        c[2] += own.links
        c[4] += own.shape == shape
        c[5] += bool(text) and (own.text == text or opening(own.text) == wrapper.openings[s])
        if own.text == text:
            key = (whole - xxhash.xxh64_intdigest(text)) % (1 << 62)
            c[3] += 1
            c[6], c[7] = min(c[6], key), max(c[7], key)


def judged(slots: list[list], counts: dict[int, list[int]]) -> tuple[list[int], int, list[tuple[str, bool]]]:
    """(1 for each slot that is template, the article's slot, the names of blocks with whether they were template), from the counts of all
    pages."""
    none = [0, 0, 0, 0, 0, 0, 1 << 62, -1]
    c = [counts.get(s, none) for s in range(len(slots))]
    up, kids = [s[1] for s in slots], [[] for _ in slots]
    for s, u in enumerate(up):
        if u >= 0:
            kids[u].append(s)
    parts = lambda s: {w for name in slots[s][3] for w in re.split(r"[^a-z0-9]+", name)}
    named = [any(w in NAMES for w in s[3]) for s in slots]
    hinted = [not NAMES.isdisjoint(parts(s)) for s in range(len(slots))]
    # Of each slot with all in it: characters, those in links, and those that vary from page to page.
    fixed = [bool(slots[s][5]) and x[0] >= AGREEING and x[3] >= max(AGREEING, SAME * x[0]) and x[6] < x[7] for s, x in enumerate(c)]
    chars, links, varying = [x[1] for x in c], [x[2] for x in c], [x[1] * (1 - max(0, x[3] - 1) / max(1, x[0] - 1)) if slots[s][5] else float(x[1]) for s, x in enumerate(c)]
    for s in range(len(slots) - 1, 0, -1):
        chars[up[s]] += chars[s]
        links[up[s]] += links[s]
        varying[up[s]] += varying[s]
    shaped = lambda s: c[s][0] >= AGREEING and c[s][4] >= 0.8 * c[s][0]
    drop = [0] * len(slots)
    if not slots or c[0][0] < AGREEING:
        return drop, 0, []
    volume = lambda s: (varying[s] + 0.25 * chars[s]) * (0.1 if hinted[s] and not slots[s][2] == "body" or slots[s][2] in NOT_CONTENT else 1.0)
    path = [0]
    while True:
        v = path[-1]
        best = max(kids[v], key=volume, default=None)
        if best is None or slots[v][2] == "article" or slots[best][2] in TEXT_KINDS - {"article", "main", "table", "tr", "td"} or volume(best) < 0.5 * volume(v) or c[best][0] < 0.5 * c[v][0]:
            break
        path.append(best)
    top = path[-1]
    content = chars[top] / max(1, c[top][0])
    copies = varying[top] < 0.5 * chars[top]  # an article that is mostly one text: pages that copy each other don't make it template
    on_path = set(path)
    # Without an article element to say where the text is, a block beside the path has to repeat itself, too, in all its text, in one of a few
    # texts or in how it opens (a notice that names the host, say): text of the page's own stays.
    told = any(slots[v][2] == "article" for v in path)
    repeats = lambda s: told or c[s][3] >= AGREEING and c[s][6] < c[s][7] or varying[s] <= 0.5 * chars[s] or c[s][5] >= USUAL * c[s][0]
    says: list[tuple[str, bool]] = []
    for v in path[:-1]:
        for s in kids[v]:
            if s in on_path or c[s][0] < AGREEING:
                continue
            mean = chars[s] / c[s][0]
            usual = c[s][0] >= USUAL * c[v][0]
            menu = links[s] >= LINKS * max(1, chars[s]) and chars[s] > 0
            small = mean <= min(SHORT, 0.5 * content) and (menu or repeats(s) or hinted[s])
            if slots[s][2] not in TEXT_KINDS and mean <= content and (usual and small and (shaped(s) or menu) or hinted[s] and (small or menu or named[s])) or menu and usual and small:
                drop[s] = 1
    for s in range(1, len(slots)):
        if drop[up[s]]:
            drop[s] = 1
        elif s not in on_path:
            inside = _inside(s, top, up)
            if fixed[s] and not kids[s] and (not copies and (not inside or c[s][3] >= 0.5 * c[top][0]) or not inside and slots[s][2] not in TEXT_KINDS):
                drop[s] = 1
            elif inside and slots[s][2] not in TEXT_KINDS and hinted[s] and c[s][0] >= AGREEING and chars[s] / c[s][0] <= 0.5 * content and (named[s] or shaped(s) and chars[s] / c[s][0] <= SHORT):
                drop[s] = 1
    for s in range(len(slots)):
        if c[s][0] >= AGREEING and slots[s][2] in BLOCK and not drop[max(0, up[s])]:
            says += [(w, bool(drop[s])) for w in slots[s][3] if w in NAMES]
    return drop, top, says


def _inside(s: int, top: int, up: list[int]) -> bool:
    while s > top:
        s = up[s]
    return s == top


def content(page: str, wrapper: Wrapper | None = None, names: frozenset[str] = frozenset()) -> str:
    """The article's blocks, joined by newlines. wrapper: a judged one; without it, or where a page has nothing in the article's slot, the
    outermost article elements (else main elements) are the article, if there are any. names: those that alignments found to be template."""
    root = parse(page)
    dropped: set[int] = set()
    slotted: set[int] = set()
    fits = False
    if wrapper is not None and wrapper.trees:
        for s, own in wrapper.placed(tree(root)):
            fits = fits or s == wrapper.top
            slotted.add(id(own.node))
            if wrapper.drop[s]:
                dropped.add(id(own.node))
    starts = [root] if fits else [n for n in _articles(root, names) if _text_of([n], dropped, slotted, names)] or [root]
    return _text_of(starts, dropped, slotted, names)


def _boiler(n: Node, inside: bool, names: frozenset[str]) -> bool:
    """Whether an element without a slot is no article: by its kind, or by a name that alignments agree on."""
    if n.tag in NOT_CONTENT or n.tag == "header" and not inside:
        return True
    return bool(names) and n.tag in BLOCK and n.tag not in TEXT_KINDS and n.tag not in ("html", "body") and not names.isdisjoint(n.names)


def _articles(root: Node, names: frozenset[str]) -> list[Node]:
    """The outermost article elements that are not inside boilerplate; without any, the outermost main elements."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo: list[tuple[Node, frozenset]] = [(root, frozenset())]
    while todo:
        n, seen = todo.pop()
        inner = []
        for k in n.kids:
            if not isinstance(k, str) and not _boiler(k, bool(seen), names):
                if k.tag in found and k.tag not in seen:
                    found[k.tag].append(k)
                inner.append((k, seen | {k.tag} if k.tag in found else seen))
        todo += reversed(inner)
    return found["article"] or found["main"]


def _text_of(starts: list[Node], dropped: set[int], slotted: set[int], names: frozenset[str]) -> str:
    blocks: list[list[str]] = []
    todo: list = [(n, False) for n in reversed(starts)]
    while todo:
        n, inside = todo.pop()
        if isinstance(n, str):
            if blocks:
                blocks[-1].append(n)
            continue
        if n is None:
            blocks.append([])
            continue
        block = n.tag in BLOCK or n.tag == "#root"
        inside = inside or n.tag in ("article", "main")
        if block:
            blocks.append([])
            todo.append((None, inside))
        for k in reversed(n.kids):
            if isinstance(k, str):
                todo.append((k, inside))
            elif k.tag == "br":
                todo.append((" ", inside))
            elif id(k) not in dropped and k.tag not in VOID and not _boiler(k, inside, frozenset() if id(k) in slotted else names):
                todo.append((k, inside))
    return "\n".join(t for b in blocks if (t := " ".join("".join(b).split())))


SCHEMA = "page_id long, url string, text string, n_chars long"
INDUCED = "_host string, _slots string"
TEMPLATES = "_host string, _template string, _names array<struct<name:string,template:boolean>>"


def references(keyed: DataFrame, most: int = REFERENCES) -> DataFrame:
    """_host, _h: the `most` smallest hashes of each host's different pages, chosen over all of them; no task holds more of a host."""

    def listed(best: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name for name, own in best.items() for _ in own], pa.string()), pa.array([h for own in best.values() for h in own], pa.int64())], ["_host", "_h"])

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list[int]] = {}
        for batch in batches:
            for name, h in zip(batch.column("_host").to_pylist(), batch.column("_h").to_pylist(), strict=True):
                own = best.setdefault(name, [])
                if h not in own and (len(own) < most or h < own[-1]):
                    own.append(h)
                    own.sort()
                    del own[most:]
            if len(best) > MOST_KEYS:
                yield listed(best)
                best = {}
        yield listed(best)

    least = keyed.select("_host", "_h").mapInArrow(smallest, "_host string, _h long").groupBy("_host").agg(F.collect_set("_h").alias("_all"))
    return least.select("_host", F.explode(F.slice(F.array_sort("_all"), 1, most)).alias("_h"))


def _with_host_rows(pages: DataFrame, per_host: DataFrame, column: str) -> DataFrame:
    """pages with the column of per_host (a row per host; null where there is none): broadcast if it is small, as counted, else shuffled,
    each host's pages in SALTS parts."""
    if (per_host.agg(F.sum(F.length("_host") + F.length(column))).first()[0] or 0) <= MOST_CHARS:
        return pages.join(F.broadcast(per_host), "_host", "left")
    salted = per_host.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("_salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_salt"], "left").drop("_salt")


def templates(pages: DataFrame, most: int = REFERENCES) -> DataFrame:
    """TEMPLATES of each host with AGREEING different pages (pages: _host, html): its slots are induced from up to `most` reference pages,
    then counted and judged over all pages."""
    keyed = pages.select("_host", "html", F.xxhash64("html").alias("_h"))
    least = cut(references(keyed, most))
    few = F.broadcast(least) if least.count() <= MOST_KEYS else least
    chosen = keyed.join(few, ["_host", "_h"]).groupBy("_host", "_h").agg(F.first("html").alias("html"))

    def host(key: tuple, group: pa.Table) -> pa.Table:
        slots = induce(sorted(group.column("html").to_pylist())) if group.num_rows >= AGREEING else []
        return pa.table({"_host": pa.array([key[0].as_py()] if slots else [], pa.string()), "_slots": pa.array([json.dumps(slots)] if slots else [], pa.string())})

    induced = cut(chosen.groupBy("_host").applyInArrow(host, INDUCED))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers: dict[str, Wrapper] = {}
        sums: dict[str, dict[int, list[int]]] = {}

        def out() -> pa.RecordBatch:
            rows = [(h, s, *c) for h, own in sums.items() for s, c in own.items()]
            types = [pa.string(), *[pa.int64()] * (len(COUNTS) + 1)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["_host", "_slot", *COUNTS])

        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                for name, slots, page in zip(*(part.column(x).to_pylist() for x in ("_host", "_slots", "html")), strict=True):
                    if name not in wrappers:
                        if len(wrappers) >= TEMPLATES_HELD:
                            yield out()
                            wrappers, sums = {}, {}
                        wrappers[name] = Wrapper(json.loads(slots))
                    counted(wrappers[name], page, sums.setdefault(name, {}))
        if sums:
            yield out()

    met = _with_host_rows(pages.select("_host", "html"), induced, "_slots").filter(F.col("_slots").isNotNull()).select("_host", "_slots", "html")
    numbers = met.mapInArrow(counts, "_host string, _slot long, " + ", ".join(f"{c} long" for c in COUNTS))
    per_slot = numbers.groupBy("_host", "_slot").agg(*[F.sum(c).alias(c) for c in COUNTS[:6]], F.min("low").alias("low"), F.max("high").alias("high"))
    per_host = per_slot.groupBy("_host").agg(F.collect_list(F.struct("_slot", *COUNTS)).alias("_counts"))  # a row per slot of a host

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for name, slots, rows in zip(*(batch.column(x).to_pylist() for x in ("_host", "_slots", "_counts")), strict=True):
                slots = json.loads(slots)
                drop, top, says = judged(slots, {r["_slot"]: [r[c] for c in COUNTS] for r in rows})
                for column, x in zip(out, (name, json.dumps([slots, drop, top]), [{"name": w, "template": t} for w, t in says]), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.struct([("name", pa.string()), ("template", pa.bool_())])))], ["_host", "_template", "_names"])

    return cut(induced.join(per_host, "_host").mapInArrow(judge, TEMPLATES))


def agreed_names(found: DataFrame) -> frozenset[str]:
    """The names, of the fixed list, that blocks were template under on nearly all hosts that have them."""
    rows = found.select("_host", F.explode("_names").alias("_n")).groupBy("_host", "_n.name").agg(F.avg(F.col("_n.template").cast("int")).alias("_share"))
    rows = rows.groupBy("name").agg(F.count("*").alias("hosts"), F.avg("_share").alias("share")).filter((F.col("hosts") >= NAMED_HOSTS) & (F.col("share") >= NAMED_SHARE))
    return frozenset(r["name"] for r in rows.collect())  # of the fixed list


def extract(pages: DataFrame) -> DataFrame:
    """SCHEMA for every row of pages (page_id, url, html; other columns, whatever their names, are ignored).

    A null html is an empty page with an empty text. A null url, or one without a host, belongs to a host of its own name "". A page of a
    host with fewer than AGREEING different pages is read without a template: by kinds of elements, names that the alignments of other
    hosts found to be template, and article elements. Pages of any length, width and depth are read whole, by the same steps. Repeated rows
    are rows of their own; an empty table gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"),
                        F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("_host"))
    found = templates(rows.select("_host", "html"))
    names = agreed_names(found)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                out = []
                for page, t in zip(part.column("html").to_pylist(), part.column("_template").to_pylist(), strict=True):
                    if t is not None and t not in known:
                        known = known if len(known) < TEMPLATES_HELD else {}
                        known[t] = Wrapper(*json.loads(t))
                    out.append(content(page, known[t] if t is not None else None, names))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url").cast(pa.string()), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return _with_host_rows(rows, found.select("_host", "_template"), "_template").select("page_id", "url", "html", "_template").mapInArrow(texts, SCHEMA)
