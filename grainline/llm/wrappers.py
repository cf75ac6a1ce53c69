"""HTML extraction (operator 5): wrappers inferred from pages of the same host, as union-free regular expressions.

A page is read as a stream of balanced token groups. Pages of one host are aligned one after the other with the wrapper
so far: groups with the same tag, class and id match, and are aligned inside; runs of like groups become a repeated
group; a group that only one side has becomes optional; text that differs becomes a text slot, text that never does
stays template text. The result is a regular expression without alternatives (``Group.regex``).

The wrapper then tells where the main text is: the article container (by its tag or role, else by its class or id, else
the group whose slots hold most text), without the groups that by tag, role, class or id are menus, headers, footers,
sidebars, notices, adverts, forms, comments and the like. A form that holds a named container or most of the text is layout;
a group that only a weak word marks (``WEAK_WORDS``) stays where it holds most of its container's text and varies from page
to page. Nothing else of a container that its key names is left out. Where no key names one, the texts that never vary on
the host's pages are left out too, headings excepted. A host's layouts can have different containers: each page is read by
the surest one it has.

A host's wrapper is aligned from all its different pages: every page is folded to a small tree where it is read, and
trees of the same host are merged by ``FAN`` at a time, in an order given by their hashes, until one is left; so a hot
host is no task of its own. Groups count their pages; a text can be template from two different pages on.
"""

from __future__ import annotations

import html
import json
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_below

FAN = 64  # trees of a host that are merged at a time
LONG_TEXT = 64  # a longer text is held as its digest
MAX_DEPTH = 200  # deeper groups are no containers and have no paths of their own; their keys are read like any other's

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>", re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")

# How HTML's elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": set()}

# What marks a group as no part of the article, by tag, role, or word of its class or id.
SKIP_TAGS = frozenset("head nav header footer aside form button dialog menu script style noscript iframe template object svg select textarea title".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar sidebars rail widget widgets related recommended share sharing social comment comments reply replies respond discussion disqus cookie "
    "cookies consent gdpr notice notices notification alert warning popup modal overlay newsletter subscribe subscription signup login register paywall "
    "footer foot masthead copyright legal disclaimer pagination pager toolbar skip hidden offscreen".split()
)
WEAK_WORDS = frozenset("legal disclaimer copyright notice notices alert warning".split())  # what articles are about, too
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_WORDS = ("article", "articlebody", "post", "entry", "story", "content", "main", "body", "text")


@dataclass
class Group:
    """A token group of a wrapper: a tag with what stands inside, or a text (key ``#``)."""

    key: str
    children: list[Group] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False
    text: str | None = None  # template text (``mark``); None once it has varied
    pages: int = 1  # different pages that have the group
    chars: int = 0

    def regex(self) -> str:
        """The group as a union-free regular expression; ``#`` is a text slot."""
        if self.key == "#":
            out = "#" if self.text is None else re.escape(self.text)
        else:
            out = f"<{self.key}>{''.join(c.regex() for c in self.children)}</>"
        if self.repeated:
            out = f"({out})+"
        return f"({out})?" if self.optional else out

    def pack(self) -> tuple:
        """The group as nested tuples."""
        return self.key, [c.pack() for c in self.children], self.optional, self.repeated, self.text, self.pages, self.chars

    @classmethod
    def unpack(cls, t: tuple) -> Group:
        return cls(t[0], [cls.unpack(c) for c in t[1]], *t[2:])


def squeeze(text: str) -> str:
    return " ".join(text.split())


def mark(text: str) -> str:
    """A text as wrappers hold it: long ones as their digest."""
    return text if len(text) <= LONG_TEXT else f"{len(text)}:{blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"


def read(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """Balanced events of a page: ("open", tag, attributes), ("close", tag, {}), ("text", decoded text, {}), ("break", ..)."""
    stack: list[str] = []
    at, end, low = 0, len(page), None

    def close(name: str, stop: set[str] | frozenset[str] = frozenset()) -> Iterator[tuple[str, str, dict[str, str]]]:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] == name:
                while len(stack) > i:
                    yield "close", stack.pop(), {}
                return
            if stack[i] in stop:
                return

    while at < end:
        m = TOKEN.search(page, at)
        upto = m.start() if m else end
        if upto > at:
            yield "text", html.unescape(page[at:upto]), {}
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            yield from close(name)
            continue
        if name in BLOCK and "p" in stack:
            yield from close("p", {"table", "td", "th", "li", "button", "article", "section", "div"})
        for other in sorted(CLOSES.get(name, ())):
            yield from close(other, SCOPE[name])
        attrs = {a[1].lower(): html.unescape((a[2] or "").strip("\"'")) for a in ATTRIBUTE.finditer(m[3])} if m[3] and not m[3].isspace() else {}
        if name in VOID:
            yield "break", name, attrs
        elif name in RAW:
            low = page.lower() if low is None else low
            stop = low.find(f"</{name}", at)
            stop = end if stop < 0 else stop
            gt = page.find(">", stop)
            at = end if gt < 0 else gt + 1
            yield "open", name, attrs
            yield "close", name, {}
        else:
            stack.append(name)
            yield "open", name, attrs
    while stack:
        yield "close", stack.pop(), {}


def key_of(name: str, attrs: dict[str, str]) -> str:
    """What groups must share to match: tag, role, classes, id (digits are left out) and whether they are hidden."""
    if not attrs:
        return name
    parts = [name]
    for a, sign in (("role", "@"), ("itemprop", "$"), ("class", "."), ("id", "#")):
        if attrs.get(a):
            parts += [sign + re.sub(r"\d+", "", x) for x in sorted(set(attrs[a].split()))]
    style = attrs.get("style", "").replace(" ", "").lower()
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        parts.append("!hidden")
    return " ".join(parts)


def skipped(key: str, tags: frozenset[str] = SKIP_TAGS, words: frozenset[str] = SKIP_WORDS) -> bool:
    """Whether a group is by its key no part of an article."""
    name, *marks = key.split(" ")
    if name in tags or "!hidden" in marks:
        return True
    for mark in marks:
        if mark[0] == "@" and mark[1:].lower() in SKIP_ROLES:
            return True
        if mark[0] in ".#" and name not in ("body", "html", "main") and not words.isdisjoint(_SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", mark[1:]).lower())):
            return True
    return False


def weak(key: str) -> bool:
    """Whether only a weak word tells that a group is no part of an article."""
    return skipped(key) and not skipped(key, words=SKIP_WORDS - WEAK_WORDS)


def tree(page: str) -> Group:
    """A page as nested groups, its texts squeezed and runs of like groups folded as they close."""
    root = Group("")
    stack = [root]
    for kind, value, attrs in read(page):
        if kind == "open":
            stack.append(Group(key_of(value, attrs)) if len(stack) < MAX_DEPTH else stack[-1])
        elif kind == "close":
            g = stack.pop()
            if g is not stack[-1]:
                fold(stack[-1].children, g)
        elif kind == "text" and (text := squeeze(value)):
            fold(stack[-1].children, Group("#", text=mark(text), chars=len(text)))
    return root


def fold(out: list[Group], g: Group) -> None:
    """Append a group to its neighbours: runs of like ones, of one group or of two in turn, become one repeated group each."""
    if out and out[-1].key == g.key:
        out[-1] = merge(out[-1], g, True)
        out[-1].repeated = True
    elif len(out) > 2 and out[-2].key == g.key and out[-3].key == out[-1].key:
        again = out.pop()
        out[-2], out[-1] = merge(out[-2], again, True), merge(out[-1], g, True)
        out[-2].repeated = out[-1].repeated = True
    else:
        out.append(g)


def merge(a: Group, b: Group, same_page: bool = False) -> Group:
    """One group that matches all that either does."""
    pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    return Group(a.key, align(a.children, b.children, same_page), a.optional or b.optional, a.repeated or b.repeated, a.text if a.text == b.text else None, pages, a.chars + b.chars)


def align(a: list[Group], b: list[Group], same_page: bool = False) -> list[Group]:
    """The longest common sequence of keys matches; what one side lacks is optional."""
    out, i, j = [], 0, 0
    for x, y in [*_common([g.key for g in a], [g.key for g in b]), (len(a), len(b))]:
        for g in (*a[i:x], *b[j:y]):
            g.optional = True
            out.append(g)
        if x < len(a):
            out.append(merge(a[x], b[y], same_page))
        i, j = x + 1, y + 1
    return out


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The places of a longest common sequence, in order. Only keys that both sides have between their like ends are compared."""
    low, n, m = 0, len(a), len(b)
    while low < min(n, m) and a[low] == b[low]:
        low += 1
    while min(n, m) > low and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    both = {*a[low:n]} & {*b[low:m]}
    x, y = ([i for i in range(low, end) if keys[i] in both] for keys, end in ((a, n), (b, m)))
    out = [(k, k) for k in range(low)] + [(x[i], y[j]) for i, j in _lcs([a[i] for i in x], [b[j] for j in y])]
    return out + [(n + k, m + k) for k in range(len(a) - n)]


def _lcs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The places of a longest common sequence, bit-parallel: a row of the table is a number with a zero bit where it steps up.

    Every ``step``-th row is held and those between are made again, so that long lists take little memory.
    """
    places: dict[str, int] = {}
    for j, key in enumerate(b):
        places[key] = places.get(key, 0) | 1 << j
    full, step = (1 << len(b)) - 1, isqrt(len(a)) + 1

    def rows(row: int, start: int, stop: int) -> list[int]:
        out = [row]
        for key in a[start:stop]:
            u = row & places.get(key, 0)
            row = (row + u | row - u) & full
            out.append(row)
        return out

    held, block, at = [full], [], len(a) + 1
    for start in range(0, len(a), step):
        held.append(rows(held[-1], start, start + step)[-1])
    out, i, j = [], len(a), len(b)
    while i and j:
        if i - 1 < at or not block:
            at = (i - 1) // step * step
            block = rows(held[at // step], at, at + step)
        if block[i - at] >> (j - 1) & 1:
            j -= 1
        elif not block[i - 1 - at] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def infer(pages: list[str]) -> tuple[Group, int]:
    """The wrapper of some pages of one host, and how many different pages it was aligned with."""
    wrapper = merged([tree(p) for p in dict.fromkeys(pages)])
    return wrapper, wrapper.pages if pages else 0


def merged(trees: list[Group]) -> Group:
    """The wrapper of trees of different pages, ``FAN`` at a time."""
    while len(trees) > 1:
        trees = [reduce(merge, trees[i : i + FAN]) for i in range(0, len(trees), FAN)]
    return trees[0] if trees else Group("")


def _is_main(key: str) -> int:
    """How surely a group is by its key the article container: 3, 2, 1 or 0."""
    name, *marks = key.split(" ")
    low = [m.lower() for m in marks]
    if name == "article" or "$articlebody" in low:
        return 3
    if name == "main" or "@main" in low or "@article" in low:
        return 2
    words = {w for m in low if m[0] in ".#" for w in _SPLIT.split(m[1:])}
    return int(name in ("div", "section", "td") and not words.isdisjoint(MAIN_WORDS))


def _slot_chars(g: Group, skips=lambda g: skipped(g.key)) -> int:
    if g.key == "#":
        return g.chars
    return 0 if skips(g) else sum(_slot_chars(c, skips) for c in g.children)


def _varies(g: Group) -> bool:
    return g.text is None if g.key == "#" else any(_varies(c) for c in g.children)


def _layout_forms(wrapper: Group) -> set[int]:
    """Forms (by ``id``) that are the page's layout: they hold a container that a tag or role names, or most of its text."""
    plain = SKIP_TAGS - {"form"}
    most = _slot_chars(wrapper, lambda g: skipped(g.key, plain))

    def named(g: Group) -> bool:
        return any(not skipped(c.key, plain) and (_is_main(c.key) > 1 or named(c)) for c in g.children if c.key != "#")

    out: set[int] = set()
    todo = [wrapper]
    while todo:
        for c in todo.pop().children:
            if c.key == "#" or skipped(c.key, plain):
                continue
            if c.key.split(" ")[0] == "form" and (2 * _slot_chars(c, lambda g: skipped(g.key, plain)) > most or named(c)):
                out.add(id(c))
            todo.append(c)
    return out


def rules(wrapper: Group, n_pages: int) -> dict:
    """What extraction needs of a wrapper: paths of its article containers, surest first, and template texts by path.

    With no container by key (``named`` is false), it is the innermost group that holds nine tenths of the varying text outside
    skipped groups. ``keep`` has the paths of weakly marked groups that are most of a container. ``rest`` has the texts that
    never vary outside of the containers, for pages that have none of these.
    """
    found: dict[int, list[str]] = {1: [], 2: [], 3: []}
    keep: set[str] = set()
    layout = _layout_forms(wrapper)
    skips = lambda g: skipped(g.key) and id(g) not in layout
    firmly = lambda g: skipped(g.key, words=SKIP_WORDS - WEAK_WORDS) and id(g) not in layout

    def most_of(g: Group, path: str, chars: int) -> None:
        """Groups inside a container that only a weak word marks, and that hold more than half of its text."""
        for c in g.children:
            if c.key != "#" and not firmly(c) and 2 * (here := _slot_chars(c, firmly)) > chars:
                p = f"{path}>{c.key}"
                if weak(c.key) and (n_pages < 2 or _varies(c)) and here:
                    keep.add(p)
                most_of(c, p, chars)

    def look(g: Group, path: str, strict: bool) -> None:
        for c in g.children:
            skip = id(c) not in layout and skipped(c.key if strict else c.key.split(" ")[0])
            if c.key != "#" and not skip:
                p = f"{path}>{c.key}"
                if (sure := _is_main(c.key)) and not skipped(c.key) and (chars := _slot_chars(c, firmly)):
                    found[sure].append(p)
                    most_of(c, p, chars)
                look(c, p, strict)

    look(wrapper, "", True)
    if not found[3] and not found[2]:  # a class of what stands around an article says little, its tag does
        look(wrapper, "", False)
    mains = [sorted(set(found[k])) for k in (3, 2, 1) if found[k]]
    named = bool(mains)
    if not named:
        g, path = wrapper, ""
        while inner := [c for c in g.children if c.key != "#" and not skips(c) and 10 * _slot_chars(c, skips) >= 9 * max(1, _slot_chars(g, skips))]:
            g, path = inner[0], f"{path}>{inner[0].key}"
            if g.key.split(" ")[0] not in BLOCK:
                break
        mains = [[path]]
    template: set[tuple[str, str]] = set()

    def constant(g: Group, path: str, level: set[str], held: list | None) -> None:
        """Template texts of the outermost containers: ``held`` has those of the open one, and how many texts vary there."""
        for c in g.children:
            if c.key == "#":
                if held is not None and c.text is not None and not c.optional and c.pages > 1 and g.key.split(" ")[0] not in HEADINGS:
                    held[0].append((path, c.text))
                elif held is not None and c.text is None:
                    held[1] += 1
            elif not skips(c) or f"{path}>{c.key}" in around:
                p = f"{path}>{c.key}"
                if p in beside:
                    continue
                if held is None and p in level:
                    close(c, p, level)
                else:
                    constant(c, p, level, held)

    def close(g: Group, path: str, level: set[str]) -> None:
        held = [[], 0]
        constant(g, path, level, held)
        if held[1]:
            template.update(held[0])

    beside: set[str] = set()
    for paths in mains if n_pages > 1 and not named else []:
        around = {p[:i] for p in paths for i in range(len(p)) if p[i] == ">"}
        if "" in paths:
            close(wrapper, "", set())
        else:
            constant(wrapper, "", set(paths), None)
    rest, around, beside = [[], 0], set(), {p for paths in mains for p in paths}
    if n_pages > 1:
        constant(wrapper, "", set(), rest)
    return {"main": mains, "named": named, "template": sorted(template), "keep": sorted(keep), "rest": sorted(set(rest[0]))}


def extract(page: str, rule: dict | None) -> str:
    """The main text of a page by its host's rules: block texts in order, joined by a line feed.

    It is read from the surest containers that the page has. For a page without any of its host's containers, or of a
    host without rules, they are taken from its own tree. A host's page with no container at all is read whole, without the
    skipped groups.
    """
    rule = rule or {"main": [], "template": [], "keep": [], "rest": []}
    if [""] not in rule["main"]:
        texts = _read(page, rule["main"], rule["template"], rule["keep"])
        if texts is None:
            own = rules(tree(page), 1)
            texts = (None if own["named"] else _read(page, own["main"], rule["rest"], own["keep"])) or _read(page, own["main"], [], own["keep"])
        return "\n".join(texts or [])
    return "\n".join(_extract(page, {""}, set())[0])


def _read(page: str, levels: list[list[str]], drop: list, keep: list[str]) -> list[str] | None:
    """The block texts of the surest containers that a page has, or None."""
    for mains in levels:
        texts, seen = _extract(page, set(mains), {(p, t) for p, t in drop}, set(keep))
        if seen:
            return texts
    return None


def _extract(page: str, mains: set[str], drop: set[tuple[str, str]], keep: set[str] = frozenset()) -> tuple[list[str], bool]:
    """The block texts inside the containers, and whether there was a container. Groups of the paths ``keep`` are not skipped."""
    out: list[str] = []
    held: list[str] = []
    path = [""]
    inside, off, seen = int("" in mains), 0, "" in mains  # open containers, open skipped groups
    state: list[tuple[bool, bool, int]] = []

    def flush() -> None:
        text = squeeze("".join(held))
        held.clear()
        if text:
            out.append(text)

    for kind, value, attrs in read(page):
        if kind == "open":
            key = key_of(value, attrs)
            own = len(path) < MAX_DEPTH
            path.append(f"{path[-1]}>{key}" if own else path[-1])
            main, skip = own and path[-1] in mains, skipped(key) and not (own and path[-1] in keep)
            edge = value in BLOCK or main or skip
            state.append((edge, main, off))
            if edge:
                flush()
            inside += main
            seen |= main
            off = 0 if main else off + skip  # the rules chose this container in spite of what stands around it
        elif kind == "close":
            edge, main, before = state.pop()
            path.pop()
            if edge:
                flush()
            inside -= main
            off = before
        elif inside and not off:
            if kind == "break":
                if value == "hr":
                    flush()
                elif value == "br":
                    held.append(" ")
            elif not drop or (path[-1], mark(squeeze(value))) not in drop:
                held.append(value)
    flush()
    return out, seen


def host_of(url: str = "url"):
    """The host of a page's url in lower case, without scheme, user and port; a null url has the empty host."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#]*)", 1))


def wrappers(scratch: Scratch, pages: DataFrame) -> DataFrame:
    """(host, rule): the extraction rules of every host, inferred from all its different pages."""

    def read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees = [pickle.dumps(tree(page.as_py()).pack()) for page in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("h"), b.column("h2"), pa.array(trees, pa.binary())], ["host", "h", "h2", "tree"])

    def merge_trees(key: tuple, t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("h").to_pylist(), t.column("h2").to_pylist(), t.column("tree").to_pylist(), strict=True))
        wrapper = merged([Group.unpack(pickle.loads(x)) for _, _, x in rows])
        return pa.table({"host": [key[0].as_py()], "b": pa.array([key[1].as_py() // FAN], pa.int64()), "h": pa.array([key[1].as_py()], pa.int64()), "h2": pa.array([0], pa.int64()), "tree": pa.array([pickle.dumps(wrapper.pack())], pa.binary())})

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Group.unpack(pickle.loads(x.as_py())) for x in b.column("tree")]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([json.dumps(rules(w, w.pages)) for w in found], pa.string())], ["host", "rule"])

    keyed = (
        pages.where(F.col("html").isNotNull())
        .select(host_of().alias("host"), "html", F.xxhash64("html").alias("h"), F.xxhash64(F.lit(1), "html").alias("h2"))
        .mapInArrow(read_pages, "host string, h long, h2 long, tree binary")
    )
    trees = scratch.keep(keyed.dropDuplicates(["host", "h", "h2"]), "trees")
    n = scratch.keep(trees.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    n_hosts, most = n.agg(F.count("*"), F.max("n")).first()
    groups = F.ceil(F.col("n") / FAN).cast("long")
    level = trees.join(broadcast_below(n, 300 * n_hosts), "host").select("host", F.pmod("h", groups).alias("b"), "h", "h2", "tree")
    last, left = level, -(-(most or 0) // FAN)  # buckets of the host with most pages
    while left > 0:
        last = scratch.keep(last.groupBy("host", "b").applyInArrow(merge_trees, "host string, b long, h long, h2 long, tree binary"), "merged")
        left = -(-left // FAN) if left > 1 else 0
    return last.mapInArrow(tell, "host string, rule string")


def extract_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars (code points).

    A null html is an empty page (empty text); a null url's page belongs to the empty host. A page that lacks its host's
    containers is read by those of its own tree, of any length. Repeated rows give the same result each; extra columns are
    ignored; no pages: no rows.
    """
    scratch = Scratch(spark, "html")
    rule = scratch.keep(wrappers(scratch, pages), "wrappers")
    n_bytes = rule.agg(F.coalesce(F.sum(F.octet_length("rule") + F.octet_length("host") + 32), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict | None] = {None: None}
        for b in batches:
            texts = []
            for page, r in zip(b.column("html"), b.column("rule"), strict=True):
                r = r.as_py()
                if r not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[r] = json.loads(r) if r is not None else None
                texts.append(extract(page.as_py() or "", known[r]))
            n = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(n, pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of().alias("host"))
    return rows.join(broadcast_below(rule, n_bytes), "host", "left").select("page_id", "url", "html", "rule").mapInArrow(run, "page_id long, url string, text string, n_chars long")
