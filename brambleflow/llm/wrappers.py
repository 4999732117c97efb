"""Main text of web pages by union-free wrappers, inferred host by host.

A page is a stream of tags and text slots.  Adjacent equal stretches of a stream
fold into repeated groups; the folded streams of a host are then aligned one
after another: what both have stays, what one lacks becomes optional, groups
align with groups and their insides are aligned in turn.  The result, a regular
expression without unions, is the host's wrapper.  Beside it stands what the
pages have in its slots: how much text, and whether it is the same on all pages.
By that the wrapper tells which element holds the main text: the one with most
text that differs from page to page, repeats and isn't links, and with little of
anything else; names like article are a hint.  A page's text is what stands in
that element (or the next best that the page has) without menus, headers,
footers, sidebars, notices, adverts, forms, scripts and comments.

Pages of one structure are one row before they are dealt, and a host's are
aligned in parts whose wrappers are aligned again, each part as a stream in
which a task holds one wrapper: a host with a third of all pages costs no task
more.

Defined cases: null or empty html, or html without text, gives the empty text;
a null url or one without a host makes all such pages one host; pages that
repeat a page_id are extracted one by one; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import html as references
import json
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Structures and wrappers that a task aligns for one host, and cells of the table by which two are aligned at once.
PART_STRUCTURES, PART_WRAPPERS, TABLE = 256, 64, 1 << 20
#: What template text, links and repeated text count, and what an element's name does (any of MAIN_WORDS: "").
TEMPLATE, LINK, REPEATED, HINTS = 0.1, 0.2, 1.5, {"article": 4, "main": 3, "": 2}
SLOT = "#"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
INLINE_BREAK = frozenset(["br"])
#: An opening tag ends open elements of these names.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
AROUND = frozenset("nav header footer aside form script style noscript template textarea title head iframe svg button select dialog menu".split())
#: Words of class, id or role that mark what isn't main text.
AROUND_WORDS = frozenset("ad ads advert advertisement adverts banner banners breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disclaimer disqus footer form header login menu menubar modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split())
#: Words that mark an element only as a whole name (long-form is text), and words of names that tell of a page's layout.
AMBIGUOUS, LAYOUT_WORDS = frozenset(["form", "search"]), frozenset("has have no non not with without".split())
#: Never around the main text; an article is by whole names only.
NEVER_AROUND = frozenset(["html", "body", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_WORDS = frozenset("article content entry main post story".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: A closing slash that isn't part of an unquoted value.
_SELF_CLOSED = re.compile(r"(?:^|[\s\"']|\s[^\s=]+)/\s*\Z")


def element_name(tag: str, attributes: str) -> str:
    """The tag with the names in its class, id and role, each the words in it joined by hyphens."""
    if "=" not in attributes:
        return tag
    names = {"-".join(_WORD.findall(x)) for m in _ATTRIBUTE.finditer(attributes) for x in (m[2] or m[3] or m[4] or "").lower().split()}
    return ".".join([tag, *sorted(names - {""})])


def _marks(name: str) -> set[str]:
    """Words of a class, id or role that say that it isn't main text."""
    if name in AROUND_WORDS:
        return {name}
    words = set(name.split("-"))
    return set() if words & LAYOUT_WORDS else words & (AROUND_WORDS - AMBIGUOUS)


@lru_cache(1 << 16)
def around(name: str) -> str:
    """Nothing, "header" for what is a header only, or "around"."""
    tag, *names = name.split(".")
    if tag in NEVER_AROUND:
        return ""
    marks = AROUND_WORDS.intersection(names) if tag == "article" else set().union(*map(_marks, names))
    marks |= AROUND & {tag}
    return "header" if marks == {"header"} else "around" if marks else ""


def is_around(path: Sequence[str]) -> bool:
    """Whether text in these open elements isn't main text; headings in an article's header are."""
    article = False
    for i, name in enumerate(path):
        kind = around(name)
        if kind and not (kind == "header" and article and any(n.split(".", 1)[0] in HEADINGS for n in path[i + 1 :])):
            return True
        article = article or name.split(".", 1)[0] == "article"
    return False


class Walk:
    """The open elements at each token of a page or wrapper."""

    def __init__(self) -> None:
        self.open: list[str] = []

    def start(self, name: str) -> None:
        tag = name.split(".", 1)[0]
        if tag in BLOCK:
            self._end(("p",), stop=("td", "th", "li", "div", "article", "section", "main", "body", "button"))
        if tag in ENDS:
            self._end(ENDS[tag], stop=("ul", "ol", "dl", "table", "select"))
        if tag not in VOID:
            self.open.append(name)

    def end(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].split(".", 1)[0] == tag:
                del self.open[i:]
                return

    def _end(self, tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            tag = self.open[i].split(".", 1)[0]
            if tag in tags:
                del self.open[i:]
                return
            if tag in stop:
                return


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, text): kind is "<", ">" or SLOT; raw elements are left out."""
    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        text = page[at : found.start() if found else size]
        if text and not text.isspace():
            yield SLOT, "", text
        elif text:
            yield SLOT, " ", text
        if not found:
            return
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            yield ">", tag, ""
        elif tag in RAW:
            if _SELF_CLOSED.search(found[3] or ""):
                continue
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else size
        else:
            yield "<", element_name(tag, found[3] or ""), ""


def stream(page: str) -> list[str]:
    return [SLOT if kind == SLOT else kind + name for kind, name, _ in tokens(page) if name != " "]


# The nodes of a wrapper are lists [what, optional]; what is a token or a list of nodes, a repeated group.


def _codes(nodes: list) -> np.ndarray:
    known: dict[str, int] = {}
    return np.array([known.setdefault(json.dumps(x), len(known)) for x in nodes], np.int64)


def _balanced(unit: list) -> bool:
    depth = 0
    for what, _ in unit:
        if isinstance(what, str) and what[0] in "<>" and what[1:].split(".", 1)[0] not in VOID:
            depth += 1 if what[0] == "<" else -1
            if depth < 0:
                return False
    return depth == 0


def folded(items: list) -> list:
    """Nodes of a stream, adjacent equal stretches folded into repeated groups.

    Stretches may have any length that lies between two places of a token in a row.
    """
    nodes = [[x, False] for x in items]
    while len(nodes) > 1:
        codes = _codes(nodes)
        order = np.argsort(codes, kind="stable")
        sizes = np.unique(np.diff(order)[codes[order][1:] == codes[order][:-1]])
        for size in sizes.tolist():
            same = np.concatenate([[False], codes[size:] == codes[:-size], [False]])
            starts, ends = (np.flatnonzero(x) for x in (same[1:] & ~same[:-1], same[:-1] & ~same[1:]))
            long = ends - starts >= size
            # A group stays one: alone it repeats nothing.
            found = [(a, b) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True) if size > 1 or isinstance(nodes[a][0], str)]
            if size == 1:
                alike = {a for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True) if isinstance(nodes[a][0], list)}
                drop = {i for a in alike for i in range(a + 1, int(ends[np.searchsorted(starts, a)]) + 1)}
                if drop:
                    nodes = [x for i, x in enumerate(nodes) if i not in drop]
                    break
            if not found:
                continue
            out, at = [], 0
            for a, b in found:
                turn = next((t for t in range(min(size, b - a - size + 1)) if _balanced(nodes[a + t : a + t + size])), 0)
                first = max(a + turn, at)
                times = (b + size - first) // size
                if times < 2:
                    continue
                out += nodes[at:first]
                out.append([nodes[first : first + size], False])
                at = first + times * size
            if at:
                nodes = out + nodes[at:]
                break
        else:
            return nodes
    return nodes


def _grouped_like(nodes: list, other: list) -> list:
    """Nodes with stretches that the other folds as a group folded too."""
    for what, _ in other:
        if isinstance(what, list) and all(isinstance(x[0], str) for x in what):
            inner = [x[0] for x in what]
            out, i = [], 0
            while i < len(nodes):
                if nodes[i][0] == inner[0] and [x[0] for x in nodes[i : i + len(inner)]] == inner:
                    if not (out and out[-1][0] == what):
                        out.append([what, any(x[1] for x in nodes[i : i + len(inner)])])
                    i += len(inner)
                else:
                    out.append(nodes[i])
                    i += 1
            nodes = out
    return nodes


def _head(what) -> str:
    while isinstance(what, list):
        what = what[0][0]
    return what


def _matches(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in linear space."""
    if not len(x) or not len(y):
        return []
    if len(x) * len(y) > TABLE and len(x) > 1:
        half = len(x) // 2
        left, right = _last_row(x[:half], y), _last_row(x[half:][::-1], y[::-1])[::-1]
        cut = int(np.argmax(left + right))
        return _matches(x[:half], y[:cut]) + [(i + half, j + cut) for i, j in _matches(x[half:], y[cut:])]
    best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x) - 1, -1, -1):
        best[i, :-1] = np.maximum.accumulate(np.maximum(best[i + 1, :-1], (best[i + 1, 1:] + 1) * (y == x[i]))[::-1])[::-1]
    i = j = 0
    out = []
    while i < len(x) and j < len(y):
        if x[i] == y[j] and best[i, j] == best[i + 1, j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def _last_row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences of x and each beginning of y."""
    row = np.zeros(len(y) + 1, np.int64)
    for code in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], (row[:-1] + 1) * (y == code)))
    return row


def aligned(a: list, b: list) -> list:
    """The nodes of two wrappers or folded streams as one: what one lacks is optional, groups are aligned in turn."""
    if a == b:
        return a
    a, b = _grouped_like(a, b), _grouped_like(b, a)
    known: dict[tuple, int] = {}
    x, y = (np.array([known.setdefault((isinstance(w, list), _head(w)), len(known)) for w, _ in nodes], np.int64) for nodes in (a, b))
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    out, i, j = a[:start], start, start
    ends = (len(a) - end, len(b) - end)
    for p, q in [(p + start, q + start) for p, q in _matches(x[start : ends[0]], y[start : ends[1]])] + [ends]:
        out += [[w, True] for w, _ in a[i:p]] + [[w, True] for w, _ in b[j:q]]
        if (p, q) != ends:
            v, w = a[p], b[q]
            out.append([v[0] if isinstance(v[0], str) else aligned(v[0], w[0]), v[1] or w[1]])
        i, j = p + 1, q + 1
    return out + a[len(a) - end :]


def expression(nodes: list) -> str:
    """The wrapper as a regular expression: groups with +, optional parts with ?."""
    return " ".join((what if isinstance(what, str) else f"( {expression(what)} )+") + ("?" if optional else "") for what, optional in nodes)


# What is known of a wrapper's slots: by their place, on how many pages, the smallest and largest hash of a page's text there, and all its characters.


@lru_cache(1 << 16)
def container(name: str) -> str:
    """The element as one that may hold the main text, or nothing."""
    tag, *names = name.split(".")
    if tag in ("article", "main"):
        return tag
    named = not MAIN_WORDS.isdisjoint(x for n in names for x in n.split("-"))
    return name if tag in ("section", "div", "td") or (named and tag not in NEVER_AROUND) else ""


def place(path: Sequence[str], link: bool = False) -> str:
    """A slot's place: whether it isn't main text by its elements' names, whether it is a link, and the containers around it."""
    names = dict.fromkeys(c for name in path if (c := container(name)))
    return " ".join(["around" if is_around(path) else "text", "link" if link or any(n == "a" or n.startswith("a.") for n in path) else "plain", *names])


def _slots(nodes: list, walk: Walk, repeated: int = 0) -> Iterator[tuple[tuple[str, ...], int]]:
    for what, _ in nodes:
        if isinstance(what, list):
            yield from _slots(what, walk, repeated + 1)
        elif what == SLOT:
            yield tuple(walk.open), repeated
        elif what[0] == "<":
            walk.start(what[1:])
        else:
            walk.end(what[1:])


def page_wrapper(page: str) -> dict:
    """The wrapper of one page: nodes, slots and the whole text's figures."""
    items, texts = [], {}
    walk = Walk()
    for kind, name, text in tokens(page):
        if kind == SLOT:
            if name != " ":
                items.append(SLOT)
                texts.setdefault(tuple(walk.open), []).append(text)
        else:
            items.append(kind + name)
            (walk.start if kind == "<" else walk.end)(name)
    slots: dict[str, list] = {}
    whole = 0
    for path, parts in texts.items():
        own = " ".join("".join(parts).split())
        h = zlib.crc32(own.encode(errors="replace"))
        whole = zlib.crc32(b"%d" % h, whole)
        said = slots.setdefault(place(path), [1, h, h, 0])
        said[1] = said[2] = zlib.crc32(b"%d" % h, said[1])
        said[3] += len(own)
    return {"nodes": folded(items), "slots": slots, "pages": [1, whole, whole]}


def merged(a: dict, b: dict) -> dict:
    """The wrapper of two."""
    slots = dict(a["slots"])
    for key, (n, low, high, size) in b["slots"].items():
        own = slots.get(key, [0, low, high, 0])
        slots[key] = [own[0] + n, min(own[1], low), max(own[2], high), own[3] + size]
    (n, low, high), (m, other_low, other_high) = a["pages"], b["pages"]
    return {"nodes": aligned(a["nodes"], b["nodes"]), "slots": slots, "pages": [n + m, min(low, other_low), max(high, other_high)]}


def containers(wrapper: dict) -> list[str]:
    """Names of the elements that hold the main text of a wrapper's pages, best first.

    Text counts by its length.  Text that is the same on all of several different
    pages belongs to the template, links are ways to other pages: both count
    little, repeated groups more.  An element is the better, the more text it
    holds and the less of something else; its name is a hint.
    """
    several = wrapper["pages"][0] > 1 and wrapper["pages"][1] != wrapper["pages"][2]
    repeated = {place(path) for path, times in _slots(wrapper["nodes"], Walk()) if times}
    text: dict[str, float] = {}
    other: dict[str, float] = {}
    depth: dict[str, int] = {}
    for key, (n, low, high, size) in wrapper["slots"].items():
        kind, link, *names = key.split(" ")
        mass = 0.0 if kind == "around" else size * (TEMPLATE if several and n > 1 and low == high else 1) * (LINK if link == "link" else 1)
        for at, name in enumerate(names):
            text[name] = text.get(name, 0) + mass * (REPEATED if key in repeated else 1)
            other[name] = other.get(name, 0) + size - min(size, mass)
            depth[name] = max(depth.get(name, 0), at)

    def score(name: str) -> float:
        hint = HINTS.get(name, 1 if MAIN_WORDS.isdisjoint(re.split("[.-]", name)) else HINTS[""])
        return hint * text[name] * text[name] / (text[name] + other[name])

    return sorted((n for n in text if text[n] > 0), key=lambda n: (-round(score(n), 6), -depth[n], n))


def main_text(page: str, best: list[str]) -> str:
    """The blocks of the first of the named elements that has text on the page, else of the body."""
    walk = Walk()
    blocks: list[tuple[tuple[str, ...], list[str]]] = []
    fresh = True
    for kind, name, text in tokens(page):
        if kind == SLOT:
            if is_around(walk.open):
                continue
            if fresh:
                blocks.append((tuple(walk.open), []))
                fresh = False
            blocks[-1][1].append(text)
        else:
            tag = name.split(".", 1)[0]
            (walk.start if kind == "<" else walk.end)(name)
            if tag in BLOCK:
                fresh = True
            elif tag in INLINE_BREAK and not fresh:
                blocks[-1][1].append(" ")
    said = [(path, " ".join(references.unescape("".join(parts)).split())) for path, parts in blocks]
    said = [(path, text) for path, text in said if text]
    inside = [{container(name) for name in path} for path, _ in said]
    for name in best:
        own = [text for (_, text), names in zip(said, inside, strict=True) if name in names]
        if own:
            return "\n".join(own)
    return "\n".join(text for _, text in said)


def _packed(wrapper: dict) -> str:
    return json.dumps(wrapper, separators=(",", ":"), sort_keys=True)


def _wrappers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's wrapper; a batch's pages of one host and structure as one."""
    for batch in batches:
        made: dict[tuple, dict] = {}
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            wrapper = page_wrapper(page or "")
            key = (host, json.dumps(wrapper["nodes"], separators=(",", ":")))
            made[key] = merged(made[key], wrapper) if key in made else wrapper
        nodes = [key[1] for key in made]
        yield pa.RecordBatch.from_arrays([pa.array([key[0] for key in made], pa.string()), pa.array(nodes, pa.string()), pa.array([_packed(w) for w in made.values()], pa.string())], names=["host", "nodes", "wrapper"])


def _align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by host and part: one wrapper for each."""
    key, wrapper = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"host": key[0], "part": key[1], "nodes": json.dumps(wrapper["nodes"], separators=(",", ":")), "wrapper": _packed(wrapper)}], schema=_WRAPPER)

    for batch in batches:
        for host, part, made in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "wrapper")), strict=True):
            if (host, part) != key:
                if key is not None:
                    yield row()
                key, wrapper = (host, part), json.loads(made)
            else:
                wrapper = merged(wrapper, json.loads(made))
    if key is not None:
        yield row()


_WRAPPER = pa.schema([("host", pa.string()), ("part", pa.int32()), ("nodes", pa.string()), ("wrapper", pa.string())])


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page or "", best or []) for page, best in zip(batch.column("html").to_pylist(), batch.column("best").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([containers(json.loads(x)) for x in batch.column("wrapper").to_pylist()], pa.list_(pa.string()))], names=["host", "best"])


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) of every host.

    Structures are dealt to parts of PART_STRUCTURES by their hash, so a host
    with most of them takes many tasks; rounds then join PART_WRAPPERS parts of
    a host into one.
    """
    columns = "host string, part int, nodes string, wrapper string"
    made = settle(_hosted(pages).select("host", "html").mapInArrow(_wrappers, "host string, nodes string, wrapper string"), "structures")
    parts = -(-made.count() // PART_STRUCTURES) or 1
    rows = made.withColumn("part", F.pmod(F.xxhash64("nodes"), F.lit(parts)).cast("int"))
    while True:
        rows = rows.repartition("host", "part").sortWithinPartitions("host", "part", "nodes", "wrapper").mapInArrow(_align, columns)
        if parts == 1:
            return rows.select("host", "wrapper")
        parts = -(-parts // PART_WRAPPERS)
        rows = rows.withColumn("part", F.pmod("part", F.lit(parts)).cast("int"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    best = settle(infer_wrappers(pages).mapInArrow(_best, "host string, best array<string>"), "containers")
    return _hosted(pages).join(best, "host", "left").select("page_id", "url", "html", "best").mapInArrow(_extract, "page_id long, url string, text string")
