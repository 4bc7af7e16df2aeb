"""Main text of web pages by wrappers inferred for each host.

A page is a stream of tags and texts. The *wrapper* of a host is a regular expression without unions over
such streams: elements in order, a slot wherever there is text, optional elements, and repeated groups.

*Folding.* Children of one element are told apart by label and kind (with paragraphs, with other blocks, with text
alone). A label that returns is one repeated part, and what stands between its first and its last place
belongs to the same repeated group, so every label has one place among its siblings, however many they are.

*Alignment.* The wrapper takes in page after page. Children of matching elements are aligned on a longest common sequence
of labels; what only one side has becomes optional, and labels that cross become a repeated group. Slots
keep the texts that all their pages hold: these are fixed, the template; the rest varies. They also add up how much
text varies, links apart.

*Choice.* From the root the wrapper is followed to the element that holds more than half of the varying text,
as long as it is no part of a repetition: that is the article. An article element on the way ends it, else a main
one, else one named like content; else it ends at the last element, or above it at one with a heading of its own.
Texts in menus, headers, footers, sidebars, notices, adverts, forms and comments count for nothing and are never returned,
and neither is the template. Hosts with fewer than ``MIN_PAGES`` different pages, and pages on which the chosen
element has no text, go by names alone: the page's articles, else its main element, else an element named like content,
else the body.

All pages and all elements of a host take part. Each task folds its pages of a host into one wrapper before anything is shuffled;
elements are rows from there on, merged by host, place and salt, then by host and place. A host of up to ``TOGETHER`` elements and
fixed texts is followed in one task and its fixed texts go to its pages. Beyond, nothing of a host meets in one task: the text below its elements
is summed by pointer doubling, only the chain of its heavy elements is followed, and its pages look their texts up by joins. Elements
are numbered and held in flat lists, and nothing recurses, so a page may be nested or long at will.

Defined results: null html is empty; a page without main text has the empty text; a null
or odd url has the host ''; repeated rows repeat; page ids are carried as they are; an empty table stays
empty. A tag that is never closed ends with its parent. Other columns play no part.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.llm.text import slices, weighed
from matchspark.session import cut

#: Tasks that merge the wrappers of one host before the last one does.
SALTS = 64
#: A host's wrapper decides, and a text is fixed, from so many pages of different texts: fewer may agree by chance.
MIN_PAGES = 5
#: Elements that a task holds in wrappers before it sends them on, and most bytes of rules that go to every task.
HELD, BROADCAST_BYTES = 200_000, 24 << 20
#: Elements of one host's wrapper in a task before it is sent on: pages are aligned with all of them.
FULL = 5_000
#: Elements and fixed texts of a host that one task holds. Beyond, they stay rows of a table; the result is the same.
TOGETHER = 20_000

# Elements of HTML and the words that sites use for parts of a page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong"
    " sub sup time tt u var wbr object"
    " math annotation annotation-xml maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms"
    " mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = "script|style|noscript|template|iframe|svg|textarea|select|title|canvas|audio|video"
NO_TEXT = frozenset("head nav footer aside form button fieldset dialog menu".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
BARRIERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs byline comment"
    " comments consent cookie cookies copyright disclaimer discussion disqus footer form gdpr hidden login masthead menu"
    " menus modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promos"
    " recommended related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored"
    " sponsors subscribe subscription teaser toolbar topbar trending widget widgets".split()
)
#: Inside the main region only these words drop text, and not on headings or as the id of a section.
INNER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment comments consent"
    " cookie cookies disqus footer gdpr hidden menu menus nav navbar navigation newsletter pager pagination promo promos share sharing"
    " sidebar sidebars social sponsor sponsored sponsors".split()
)
BY_WRAPPER = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
PAGE_ONLY = frozenset("header heading".split())
CONTENT_WORDS = frozenset("article articlebody body content entry main post story text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<opaque>" + OPAQUE + r")\b[^>]*+>.*?(?:</(?P=opaque)\s*>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^<>]*+)>",
    re.S | re.I,
)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?<![\w-])hidden(?![\w-])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", name, label), ("close", name, ""), ("text", raw, "") in page order; scripts and the like are left out."""
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            yield "close", name, ""
            continue
        rest, label = m["rest"] or m["rest2"] or "", name
        if "=" in rest or "hidden" in rest:
            named = _NAMED.findall(rest)
            words = [w for k, v in named for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", v) if name != "section" or k.lower() != "id"]
            if name == "section":  # "#": words of an anchor, which names a part of the text as well
                words += ["#" + w for k, v in named for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", v) if k.lower() == "id"]
            if "idden" in rest or "display" in rest:
                words += ["hidden"] * bool(_HIDDEN.search(rest))
            label += "".join(f".{w}" for w in dict.fromkeys(w.lower() for w in words))
        yield "open", name, label
        if rest.endswith("/") and name not in VOID and name not in INLINE and "<" not in rest:
            yield "close", name, ""
    if at < len(page):
        yield "text", page[at:], ""


class Walk:
    """The stack of open block elements while a page is read."""

    def __init__(self):
        self.stack: list[str] = []
        self.open: dict[str, int] = defaultdict(int)

    def _pop(self) -> None:
        self.open[self.stack.pop()] -= 1

    def step(self, kind: str, name: str) -> tuple[int, bool, bool]:
        """What the token does: how many elements end, whether one begins, and whether it breaks a block of text."""
        if name in INLINE:
            return 0, False, False
        if name in VOID:
            return 0, False, name != "br"
        before = len(self.stack)
        if kind == "close":
            if self.open[name]:
                while self.stack[-1] != name:
                    self._pop()
                self._pop()
            return before - len(self.stack), False, True
        if self.stack and self.stack[-1] == "p":
            self._pop()
        closes, barriers = CLOSES.get(name, ()), BARRIERS.get(name, ())
        if any(self.open[x] for x in closes):
            at = len(self.stack) - 1
            while self.stack[at] not in barriers and self.stack[at] not in closes and at:
                at -= 1
            if self.stack[at] in closes:
                while len(self.stack) > at:
                    self._pop()
        ended = before - len(self.stack)
        self.stack.append(name)
        self.open[name] += 1
        return ended, True, True


class Page:
    """Elements numbered in page order, 0 the root: label, parent, children. A block of text is an element ``#`` (slot).

    ``blocks`` holds (slot, text, characters of it in links).
    """

    def __init__(self, page: str):
        self.label, self.parent, self.children = [""], [-1], [[]]
        self.blocks: list[tuple[int, str, int]] = []
        walk, here, links, linked = Walk(), 0, 0, 0
        current: list[str] = []

        def add(label: str) -> int:
            self.children[here].append(len(self.label))
            self.label.append(label)
            self.parent.append(here)
            self.children.append([])
            return len(self.label) - 1

        def close() -> None:
            text = " ".join(entities.unescape("".join(current)).split())
            if text:
                self.blocks.append((add("#"), text, min(linked, len(text))))

        for kind, name, label in tokens(page):
            if kind == "text":
                current.append(name)
                linked += len(name) if links else 0
            elif name == "br":
                current.append(" ")
            elif name == "a":
                links = links + 1 if kind == "open" else max(0, links - 1)
            else:
                ended, begins, breaks = walk.step(kind, name)
                if breaks and current:
                    close()
                    current, linked = [], 0
                for _ in range(ended):
                    here = self.parent[here]
                if begins:
                    here, links = add(label), 0
        if current:
            close()

    def keys(self) -> list[str]:
        """Label of each element; of an unnamed part of the page its kind as well."""
        out = []
        for label, children in zip(self.label, self.children):
            if label in PLAIN:
                below = {self.label[c].split(".", 1)[0] for c in children} - {"#"}
                label += "" if not below else "~p" if below & PROSE else "~"
            out.append(label)
        return out

    def places(self) -> list[int]:
        """A hash of the keys from the root down to each element."""
        out = [0]
        for key, parent in zip(self.keys()[1:], self.parent[1:]):
            out.append(place(out[parent], key))
        return out


def place(above: int, key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), above)


#: Elements whose name says nothing of their part.
PLAIN = frozenset("div section span table tbody tr td center".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6".split())
TITLES = PROSE - {"p"}
REGIONS = ("article", "main", "content", "body")


def _is_region(label: str, region: str) -> bool:
    name, *words = label.replace("#", "").split(".")
    if region in ("article", "main"):
        return name == region or region == "main" and "main" in words and name != "body"
    return region == "content" and name != "body" and not CONTENT_WORDS.isdisjoint(words) and SIDE_WORDS.isdisjoint(words)


def is_side(label: str, inside: bool) -> bool:
    """Whether an element holds no main text; ``inside`` the main region a header is the article's own."""
    name, *words = label.split(".")
    if name in ("html", "body"):
        return False
    if name in NO_TEXT or "hidden" in words:
        return True
    if inside:
        return name not in BY_WRAPPER and not INNER_WORDS.isdisjoint(words)
    words = [w.lstrip("#") for w in words]
    return name == "header" or not SIDE_WORDS.isdisjoint(words) or not PAGE_ONLY.isdisjoint(words)


def _is_page_header(label: str) -> bool:
    name, *words = label.split(".")
    return name == "header" or name not in ("html", "body") and name not in BY_WRAPPER and not PAGE_ONLY.isdisjoint(words)


def named_region(page: Page) -> set[int]:
    """The elements of the strongest named region whose text is main text, if that region has any text."""
    texts = {e for e, _, _ in page.blocks}
    for region in REGIONS:
        state = [region == "body"]  # of each element: in the region, or None on a side
        for label, parent in zip(page.label[1:], page.parent[1:]):
            inside = state[parent]
            if inside is not None:
                inside = inside or _is_region(label, region)
                if is_side(label, inside) or region == "body" and _is_page_header(label):
                    inside = None
            state.append(inside)
        live = {e for e in texts if state[e]}
        if live:
            return live
    return set()


def _lawful(page: Page, tops: Iterable[int]) -> set[int]:
    """Elements at or below ``tops`` that hold main text, sides inside them left out."""
    inside = [False] * len(page.label)
    for e in tops:
        inside[e] = True
    for e in range(1, len(page.label)):
        inside[e] = inside[e] or inside[page.parent[e]] and not is_side(page.label[e], True)
    return {e for e, x in enumerate(inside) if x}


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 11  # exact as a JSON number


def voting(page: Page) -> list[bool]:
    """Whether each element may be part of an article, as far as names tell."""
    state: list[bool | None] = [False]  # in a named region, or None on a side
    for label, parent in zip(page.label[1:], page.parent[1:]):
        inside = state[parent]
        if inside is not None:
            inside = inside or any(_is_region(label, r) for r in REGIONS[:3])
            if is_side(label, inside):
                inside = None
        state.append(inside)
    return [x is not None for x in state]


class Node:
    """An element of a wrapper; its children have greater numbers."""

    __slots__ = ("key", "parent", "children", "groups", "repeated", "optional", "pages", "mass", "fixed", "seen")

    def __init__(self, key: str, parent: int):
        self.key, self.parent = key, parent
        self.children: dict[str, int] = {}
        self.groups: list[list[str]] = []  # keys of the children in order; several in a group may come again
        self.repeated = self.optional = False
        self.pages, self.mass = 0, 0  # pages with the element; characters of its text outside links and sides
        self.fixed: dict[int, int] = {}  # texts that all its pages hold, with their lengths
        self.seen: list[int] = []  # the least hashes of the texts of pages with the element

    def copy(self, parent: int) -> Node:
        new = Node(self.key, parent)
        for name in ("groups", "repeated", "optional", "pages", "mass", "fixed", "seen"):
            setattr(new, name, getattr(self, name))
        return new


def folded(keys: list[str], groups: Iterable[list[str]] = ()) -> list[list[str]]:
    """Groups of keys in order: what stands between the places of a returning key, or of a group's keys, is one group with it."""
    first: dict[str, int] = {}
    reach: dict[str, int] = {}
    for i, k in enumerate(keys):
        first.setdefault(k, i)
        reach[k] = i
    for g in groups:
        start = min(g, key=first.__getitem__)
        reach[start] = max(reach[k] for k in g)
    out: list[list[str]] = []
    end = -1
    for k, i in first.items():
        if i > end:
            out.append([])
        out[-1].append(k)
        end = max(end, reach[k])
    return out


def aligned(a: list[list[str]], b: list[list[str]]) -> list[list[str]]:
    """Both sides' groups as one sequence: keys in a longest common order once, crossing ones as one group."""
    if a == b:
        return a
    left, right = [k for g in a for k in g], [k for g in b for k in g]
    spot = {k: i for i, k in enumerate(right)}
    # longest increasing run of the common keys' places on the right
    tails: list[int] = []
    ends: list[str] = []
    before: dict[str, str | None] = {}
    for k in left:
        if k in spot:
            at = bisect_left(tails, spot[k])
            before[k] = ends[at - 1] if at else None
            tails[at : at + 1], ends[at : at + 1] = [spot[k]], [k]
    common = set()
    k = ends[-1] if ends else None
    while k is not None:
        common.add(k)
        k = before[k]
    merged, j = [], 0
    for k in left:
        if k in common:
            merged += right[j : spot[k]]
            j = spot[k] + 1
        merged.append(k)
    merged += right[j:]
    return folded(merged, [g for g in (*a, *b) if len(g) > 1])


def _together(sequences: list[list[list[str]]]) -> list[list[str]]:
    """Several aligned as one, in pairs."""
    sequences = [s for i, s in enumerate(sequences) if not i or s != sequences[i - 1]]
    while len(sequences) > 1:
        odd = sequences[-1:] if len(sequences) % 2 else []
        sequences = [aligned(x, y) for x, y in zip(sequences[::2], sequences[1::2])] + odd
    return sequences[0] if sequences else []


def shape(page: Page) -> list[Node]:
    """The wrapper of a single page."""
    keys, live = page.keys(), voting(page)
    texts = {slot: (text, linked) for slot, text, linked in page.blocks}
    mark = hashed("\n".join(text for slot, text, _ in page.blocks if live[slot]))
    nodes, instances = [Node("", -1)], [[0]]
    for at, node in enumerate(nodes):  # grows
        node.pages, node.seen = 1, [mark]
        own, instances[at] = instances[at], []
        below: dict[str, list[int]] = defaultdict(list)
        holders: dict[str, int] = defaultdict(int)
        several, sequences = set(), []
        for e in own:
            if e in texts:
                text, linked = texts[e]
                node.fixed[hashed(text)] = len(text)
                node.mass += len(text) - linked if live[e] else 0
                continue
            sequence = [keys[c] for c in page.children[e]]
            times: dict[str, int] = defaultdict(int)
            for k, c in zip(sequence, page.children[e]):
                below[k].append(c)
                times[k] += 1
            for k, n in times.items():
                holders[k] += 1
                if n > 1:
                    several.add(k)
            if sequence:
                sequences.append(folded(sequence))
        node.groups = _together(sequences)
        for k in (k for g in node.groups for k in g):
            child = Node(k, at)
            child.repeated, child.optional = k in several, holders[k] < len(own)
            node.children[k] = len(nodes)
            nodes.append(child)
            instances.append(below[k])
    return nodes


def take(x: Node, y: Node) -> None:
    """Takes one element ``y`` into ``x``, the same place of another wrapper."""
    x.groups = aligned(x.groups, y.groups)
    x.repeated, x.optional = x.repeated or y.repeated, x.optional or y.optional
    x.pages, x.mass = x.pages + y.pages, x.mass + y.mass
    x.fixed = {h: n for h, n in x.fixed.items() if h in y.fixed}
    x.seen = sorted({*x.seen, *y.seen})[:MIN_PAGES]


def united(a: list[Node], b: list[Node]) -> list[Node]:
    """Takes the wrapper ``b`` into ``a``, every element of both."""
    pairs, fresh = [(0, 0)], []
    for i, j in pairs:  # grows
        x, y = a[i], b[j]
        take(x, y)
        for k, c in x.children.items():
            if k not in y.children:
                a[c].optional = True
        for k, c in y.children.items():
            if k in x.children:
                pairs.append((x.children[k], c))
            else:
                fresh.append((c, i, True))
    for c, parent, optional in fresh:  # grows
        new = b[c].copy(parent)
        new.optional = new.optional or optional
        a[parent].children[new.key] = len(a)
        fresh += [(x, len(a), False) for x in b[c].children.values()]
        a.append(new)
    return a


def merge(a: list[Node], b: list[Node]) -> list[Node]:
    """As :func:`united`, cut to ``MOST`` elements: a wrapper to look at. Inference and texts never use it."""
    a = united(a, b)
    return a if len(a) <= MOST else pruned(a)


#: Elements of a wrapper to look at. Beyond, those of the fewest pages go, and their text counts as their parent's.
MOST = 100_000


def pruned(nodes: list[Node]) -> list[Node]:
    least = sorted(n.pages for n in nodes)[-MOST // 2]
    out, number = [], {}
    for i, node in enumerate(nodes):
        if node.parent < 0 or node.parent in number and node.pages > least:
            number[i] = len(out)
            new = node.copy(number.get(node.parent, -1))
            out.append(new)
            if node.parent >= 0:
                out[new.parent].children[new.key] = number[i]
    for node in out:
        node.groups = [kept for g in node.groups if (kept := [k for k in g if k in node.children])]
    held = [number.get(i, -1) for i in range(len(nodes))]
    for i, node in enumerate(nodes):
        if held[i] < 0:
            held[i] = held[node.parent]
            out[held[i]].mass += node.mass
    return out


def as_regex(nodes: list[Node]) -> str:
    """The wrapper as a regular expression over tags; ``#`` is a text slot."""
    out, todo = [], [0]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            out.append(at)
            continue
        node, inner = nodes[at], []
        for g in node.groups:
            several = len(g) > 1
            inner += ["("] * several
            for k in g:
                c = nodes[node.children[k]]
                mark = ("*" if c.optional or several else "+") if c.repeated else "?" if c.optional or several else ""
                inner += ["(", node.children[k], f"){mark}"] if mark else [node.children[k]]
            inner += [")+"] * several
        tag = node.key.split("~")[0]
        if tag == "#":
            out.append("#")
        else:
            whole = [f"<{tag}>", *inner, f"</{tag.split('.')[0]}>"] if at else inner
            todo += reversed(whole)
    return "".join(out)


def chosen(nodes: list[Node]) -> int | None:
    """The wrapper's element that is the article; None if names have to tell."""
    if len(nodes[0].seen) < MIN_PAGES:
        return None
    total = [max(0, n.mass - n.pages * sum(n.fixed.values())) for n in nodes]
    own = list(total)
    for i in range(len(nodes) - 1, 0, -1):
        total[nodes[i].parent] += total[i]
    chain, at = [], 0
    while True:
        heavy = [c for c in nodes[at].children.values() if 2 * total[c] > total[0]]
        if not heavy:
            break
        at = heavy[0]
        titled = any(_tag(nodes[c].key) in TITLES and total[c] for c in nodes[at].children.values())
        chain.append((at, nodes[at].key, nodes[at].repeated, titled))
    return followed(chain)


def _tag(key: str) -> str:
    return key.split("~")[0].split(".")[0]


def followed(chain: Iterable[tuple[int, str, bool, bool]]) -> int | None:
    """The article of (element, key, repeated, with a heading of its own): elements that hold most of the text, from the root down."""
    path = []
    for i, key, repeated, titled in chain:
        if repeated or key == "#":
            break
        if _tag(key) not in ("html", "body"):
            path.append((i, key, titled))
    if not path:
        return None
    for region in REGIONS[:3]:
        for i, key, _ in path:
            if _is_region(key.split("~")[0], region):
                return i
    best = path[-1][0]
    for i, _, titled in path[-2::-1]:
        if not titled:
            break
        best = i
    return best


def rules(nodes: list[Node]) -> tuple[int | None, list[int]]:
    """(place of the article, codes of fixed texts): what is needed of a wrapper to read its pages."""
    places = [0]
    for n in nodes[1:]:
        places.append(place(places[n.parent], n.key))
    fixed = [code(places[i], h) for i, n in enumerate(nodes) if len(n.seen) >= MIN_PAGES for h in n.fixed]
    found = chosen(nodes)
    return None if found is None else places[found], fixed


def code(spot: int, text: int) -> int:
    """Of a text in a slot, as a signed number."""
    return (xxhash.xxh64_intdigest(text.to_bytes(8, "little"), spot)) - (1 << 63)


def extract(html: str, article: int | None = None, fixed: frozenset | set = frozenset()) -> str:
    """Texts of the article block by block, without the template's; a page of nothing but template keeps it."""
    page = Page(html)
    places = page.places() if article is not None or fixed else []
    live: set[int] = set()
    if article is not None:
        inside = _lawful(page, [e for e, p in enumerate(places) if p == article])
        live = {slot for slot, _, _ in page.blocks if slot in inside}
    live = live or named_region(page)
    blocks = [(slot, text) for slot, text, _ in page.blocks if slot in live]
    varying = [text for slot, text in blocks if code(places[slot], hashed(text)) not in fixed] if fixed else []
    return "\n".join(varying or [text for _, text in blocks])


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def packed(nodes: list[Node]) -> str:
    rows = [[n.parent, n.key, n.groups, n.repeated + 2 * n.optional, n.pages, n.mass, list(n.fixed.items()), n.seen] for n in nodes]
    return json.dumps(rows, separators=(",", ":"))


def unpacked(data: str) -> list[Node]:
    nodes = []
    for parent, key, groups, flags, pages, mass, fixed, seen in json.loads(data):
        node = Node(key, parent)
        node.groups, node.repeated, node.optional = groups, bool(flags & 1), bool(flags & 2)
        node.pages, node.mass, node.fixed, node.seen = pages, mass, dict(map(tuple, fixed)), seen
        if parent >= 0:
            nodes[parent].children[key] = len(nodes)
        nodes.append(node)
    return nodes


ELEMENTS = (
    "host string, place long, salt int, above long, depth int, key string, groups array<array<string>>, repeated boolean,"
    " optional boolean, pages long, mass long, texts array<long>, sizes array<long>, seen array<long>"
)
_ARROW = pa.schema(
    [("host", pa.string()), ("place", pa.int64()), ("salt", pa.int32()), ("above", pa.int64()), ("depth", pa.int32()), ("key", pa.string()),
     ("groups", pa.list_(pa.list_(pa.string()))), ("repeated", pa.bool_()), ("optional", pa.bool_()), ("pages", pa.int64()), ("mass", pa.int64()),
     ("texts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("seen", pa.list_(pa.int64()))]
)
#: Most rows of elements, and keys and texts in them, that are held as objects beside the wrapper.
BATCH = 20_000


def _element(node: Node) -> tuple:
    """Key and the rest of an element's row."""
    return (
        node.key, node.groups, node.repeated, node.optional, node.pages, node.mass, list(node.fixed), list(node.fixed.values()), node.seen,
    )


def _node(row: dict, parent: int = -1) -> Node:
    node = Node(row["key"], parent)
    node.groups, node.repeated, node.optional = row["groups"], row["repeated"], row["optional"]
    node.pages, node.mass, node.seen = row["pages"], row["mass"], row["seen"]
    node.fixed = dict(zip(row["texts"], row["sizes"]))
    return node


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of elements as Arrow batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 1 + len(row[6]) + len(row[11])
        if size >= BATCH:
            yield _batch(held)
            held, size = [], 0
    yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def elements(own: str, salt: int, nodes: list[Node]) -> Iterator[tuple]:
    """A host's wrapper as rows. Places are signed; the root has no place above."""
    places, depths = [0], [0]
    for i, node in enumerate(nodes):
        if i:
            places.append(place(places[node.parent], node.key))
            depths.append(depths[node.parent] + 1)
        above = places[node.parent] - (1 << 63) if i else None
        yield own, places[i] - (1 << 63), salt, above, depths[i], *_element(node)


def assembled(rows: Iterable[dict]) -> list[Node]:
    """A host's wrapper of its rows by depth. An element that is not on all pages of its parent is optional."""
    nodes, number = [], {}
    for row in rows:
        node = _node(row, -1 if row["above"] is None else number[row["above"]])
        number[row["place"]] = len(nodes)
        if node.parent >= 0:
            parent = nodes[node.parent]
            parent.children[node.key] = len(nodes)
            node.optional = node.optional or node.pages < parent.pages
        nodes.append(node)
    return nodes


def _wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements of a task's pages, one wrapper for each host as long as it fits."""
    salt = TaskContext.get().partitionId() % SALTS
    found: dict[str, list[Node]] = {}
    full: dict[str, int] = {}
    held = 0
    for batch in slices(batches):
        for own, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = shape(Page(html))
            before = len(found.get(own, ()))
            if own in found:
                found[own] = united(found[own], page)
            else:
                found[own], full[own] = page, max(FULL, 4 * len(page))
            held += len(found[own]) - before
            if len(found[own]) > full[own]:
                held -= len(found[own])
                yield from _batches(elements(own, salt, found.pop(own)))
            if held > HELD:
                yield from _batches(row for h, w in found.items() for row in elements(h, salt, w))
                found, held = {}, 0
    yield from _batches(row for h, w in found.items() for row in elements(h, salt, w))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by host, place and salt: one of each. A row that is alone passes as it is."""
    here, node = None, None
    for batch in slices(batches):
        keys = np.stack([batch.column(1), batch.column(2), batch.column(0).dictionary_encode().indices])
        first = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))
        alone = first & np.append(first[1:], False)
        alone[0] = False  # the batch before may end with the same
        yield batch.filter(pa.array(alone)).cast(_ARROW)
        done = []
        for r in batch.filter(pa.array(~alone)).to_pylist():
            at = r["host"], r["place"], r["salt"]
            if here and here[:3] == at:
                take(node, _node(r))
                continue
            if here:
                done.append((*here, *_element(node)))
            here, node = (*at, r["above"], r["depth"]), _node(r)
        yield from _batches(done)
    if here:
        yield _batch([(*here, *_element(node))])


def infer(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The elements of each host's wrapper, a row each, written once: see :func:`assembled` and :func:`as_regex`."""
    rows = pages.select(host(F.col(url)).alias("host"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    keys = ["host", "place", "salt"]
    by_salt = rows.mapInArrow(_wrappers, ELEMENTS).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merged, ELEMENTS)
    by_place = by_salt.withColumn("salt", F.lit(0)).repartition(*keys[:2]).sortWithinPartitions(*keys[:2]).mapInArrow(_merged, ELEMENTS)
    return cut(by_place.drop("salt"), "elements")


def _parted(found: DataFrame) -> DataFrame:
    """The elements and whether their host has more than a task should hold."""
    weight = F.sum(1 + F.size("texts"))
    return found.join(found.groupBy("host").agg((weight > TOGETHER).alias("wide")), "host")


def reading(found: DataFrame) -> DataFrame:
    """(host, article, fixed): the rules of each host's wrapper. ``fixed`` is null where the texts stay rows, see :func:`fixed_texts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in slices(batches) for r in batch.to_pylist())
        for own, group in groupby(rows, key=lambda r: r["host"]):
            article, fixed = rules(assembled(group))
            article = None if article is None else article - (1 << 63)
            columns = [pa.array([own]), pa.array([article], pa.int64()), pa.array([fixed], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "article", "fixed"])

    parted = _parted(found)
    narrow = parted.filter(~F.col("wide")).drop("wide").repartition("host").sortWithinPartitions("host", "depth")
    decided = narrow.mapInArrow(run, "host string, article long, fixed array<long>")
    wide = parted.filter("wide").drop("wide")
    if wide.isEmpty():
        return decided
    return decided.unionByName(articles(wide).withColumn("fixed", F.lit(None).cast("array<long>")))


def articles(found: DataFrame) -> DataFrame:
    """(host, article) as :func:`chosen` tells it, of hosts of any number of elements."""
    varying = F.col("mass") - F.col("pages") * F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    own = found.select(
        "host", "place", "above", "depth", "key", "repeated", F.size("seen").alias("seen"), F.greatest(F.lit(0), varying).alias("total")
    )
    own = cut(own, "varying")
    # the text below each element: twice as far down in each round
    sums = own.select("host", "place", F.col("above").alias("up"), "total")
    for _ in range((own.agg(F.max("depth")).first()[0] or 0).bit_length()):
        gained = sums.filter("up is not null").groupBy("host", F.col("up").alias("place")).agg(F.sum("total").alias("gained"))
        # an element without one so far above meets itself, so that these do not all meet
        further = sums.select("host", F.col("place").alias("by"), F.col("up").alias("next"))
        step = sums.withColumn("by", F.coalesce("up", "place")).join(further, ["host", "by"]).join(gained, ["host", "place"], "left")
        total = F.col("total") + F.coalesce("gained", F.lit(0))
        sums = cut(step.select("host", "place", F.col("next").alias("up"), total.alias("total")), "below", replaces=sums)
    whole = own.drop("total").join(sums.drop("up"), ["host", "place"])
    roots = whole.filter("depth = 0").select("host", "seen", F.col("total").alias("most"))
    heavy = whole.drop("seen").join(roots.filter(F.col("seen") >= MIN_PAGES), "host").filter(2 * F.col("total") > F.col("most"))
    titles = whole.filter(F.regexp_extract("key", "^[^~.]*", 0).isin(*TITLES) & (F.col("total") > 0))
    titles = titles.select("host", F.col("above").alias("place"), F.lit(True).alias("titled")).distinct()
    chains = heavy.filter("depth > 0").join(titles, ["host", "place"], "left").select("host", "depth", "place", "key", "repeated", "titled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in slices(batches) for r in batch.to_pylist())
        for own, group in groupby(rows, key=lambda r: r["host"]):
            article = followed((r["place"], r["key"], r["repeated"], bool(r["titled"])) for r in group)
            yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([article], pa.int64())], ["host", "article"])

    ended = chains.repartition("host").sortWithinPartitions("host", "depth").mapInArrow(run, "host string, article long")
    return roots.select("host").join(ended, "host", "left")


def fixed_texts(found: DataFrame) -> DataFrame:
    """(host, code) of each fixed text of the hosts whose texts stay rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spots, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            codes = [code(spot + (1 << 63), text) for spot, text in zip(spots, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64())], ["host", "code"])

    rows = _parted(found).filter(F.col("wide") & (F.size("seen") >= MIN_PAGES))
    return rows.select("host", "place", F.explode("texts").alias("text")).mapInArrow(run, "host string, code long").distinct()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, code) of each text of the pages."""
    for batch in slices(batches):
        for own, mark, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
            page = Page(html)
            places = page.places()
            codes = list({code(places[slot], hashed(text)) for slot, text, _ in page.blocks})
            columns = [pa.array([own] * len(codes), pa.string()), pa.array([mark] * len(codes), pa.string()), pa.array(codes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["host", "mark", "code"])


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text) of each page, read through the wrapper of its host."""
    elements = infer(pages, url, html)
    found = cut(reading(elements), "wrappers")
    wide = not found.filter("fixed is null").isEmpty()
    found = weighed(found, F.octet_length("host") + 32 + 8 * F.coalesce(F.size("fixed"), F.lit(0)), BROADCAST_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for page, article, fixed in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                texts.append(extract(page, None if article is None else article + (1 << 63), frozenset(fixed or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    rows = pages.select(
        F.col(id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"),
        host(F.col(url)).alias("host"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    joined = rows.join(found, "host", "left")
    columns = ["id", "url", "html", "article", "fixed"]
    if wide:
        looking = joined.filter("fixed is null").drop("fixed").withColumn("mark", F.sha2("html", 256))
        asked = looking.select("host", "mark", "html").mapInArrow(_asked, "host string, mark string, code long")
        answers = asked.join(fixed_texts(elements), ["host", "code"]).groupBy("host", "mark").agg(F.collect_set("code").alias("fixed"))
        joined = joined.filter("fixed is not null").select(*columns).unionByName(looking.join(answers, ["host", "mark"], "left").select(*columns))
    return joined.select(*columns).mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string")
