"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is a stream of tags and texts, kept as a tree so that every part of an expression is closed where it was opened. Within a page, equal neighbouring
stretches become a repeated group. The streams of a host's different structures are then aligned one after another, element by element: texts that differ become slots,
texts that agree stay constant, what only one side has becomes an optional group, and a repeated group takes up further repetitions, for instance
    <article> <h1> # </h1> ( <p> # </p> )+ ( <ul> ( <li> # </li> )+ </ul> )? </article>
Contents with more than WIDE members become a repeated group of all their kinds, ( <h2>..? <p>..? )+, and what lies deeper than DEEP is a slot, so a wrapper
stays small however many structures a host has. Every page is in the language of its host's wrapper.

The wrapper says where the main text is: in its articles, else in its <main>, else in the innermost container with SHARE of the text in slots and repeated groups (of
all text, where nothing varies). To extract, a page's stream is matched with the wrapper along the way to these places; all text of the parts that match them is
the main text, constant or not, and the template's text leaves because it lies elsewhere. A page of which nothing matches is a host of its own. What is left out by
tag, role or name (see `markup`) is in no stream.

The result does not depend on how rows are dealt: tasks sum equal structures (their texts' lengths, and texts where they agree), structures meet by host and
a hash of their own, sorted, and are aligned in that order, SALTS lists for a host and then these lists' wrappers. So a host with a third of all pages is folded in
parallel, a task holds one wrapper and one structure at a time, and no text is shuffled. The hosts' places are broadcast if they have BROADCAST_BYTES at most; beyond,
they meet the pages in a shuffle.

Null html counts as empty and gives an empty text; null URLs form a host of their own. Repeated rows are extracted each. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_bytes, shuffle_parts, slices, stored
from lectern.llm.markup import MAIN, Page

SALTS, SHARE = 64, 0.6
#: Members of a content before it becomes a group of kinds, levels of a wrapper, and the longest stretch that is looked for as a repeated group.
WIDE, DEEP, LONGEST_GROUP = 64, 60, 8
#: Structures that a task sums before it hands them on, and the size of all places up to which they are broadcast.
FOLDED, BROADCAST_BYTES = 5_000, 32 << 20
#: Elements that may be the region of the main text.
CONTAINERS = frozenset("div section article main center table tbody tr td x-".split())
ARTICLE, MAIN_ELEMENT, CONTAINER = 1, 2, 3


class Text:
    """A slot, or a constant text by its hash; chars: the length of all texts that it stands for."""

    __slots__ = ("const", "chars")

    def __init__(self, const: int | None, chars: int):
        self.const, self.chars = const, chars


class Element:
    """An element with its content; ids: its places in a page, as pairs of pairs; place: why it holds main text."""

    __slots__ = ("label", "items", "ids", "place")

    def __init__(self, label: str, items: list, ids: int | tuple | None = None, place: int = 0):
        self.label, self.items, self.ids, self.place = label, items, ids, place

    def places(self) -> list[int]:
        out, todo = [], [self.ids]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            elif x is not None:
                out.append(x)
        return out


class Group:
    """A repeated (+) or optional (?) stretch."""

    __slots__ = ("mark", "items")

    def __init__(self, mark: str, items: list):
        self.mark, self.items = mark, items


def key(x) -> str:
    """What must agree for two members of a content to be aligned."""
    return "#" if isinstance(x, Text) else x.label if isinstance(x, Element) else f"{x.mark}({' '.join(map(key, x.items))})"


def tag(x) -> str:
    return x.label.split(".")[0].split("#")[0]


def opened(items: list) -> list[tuple]:
    """Members with optional groups opened, and whether each is optional."""
    return [p for x in items for p in ([(y, True) for y, _ in opened(x.items)] if isinstance(x, Group) and x.mark == "?" else [(x, False)])]


def kinds(x: Element) -> frozenset[str]:
    return frozenset(k for y, _ in opened(x.items) for k in ([key(z) for z, _ in opened(y.items)] if isinstance(y, Group) else [key(y)]))


def likeness(x, y) -> float:
    """How much two members of one key have in common: 0 to 1, by the kinds of their contents."""
    if not isinstance(x, Element) or (len(x.items) == len(y.items) == 1 and isinstance(x.items[0], Text) and isinstance(y.items[0], Text)):
        return 1.0
    a, b = kinds(x), kinds(y)
    return len(a & b) / len(a | b) if a or b else 1.0


def paired(a: list, b: list) -> list[tuple[int, int]]:
    """Places of members that are aligned, in order: as many as possible, and of those the most alike."""
    ka, kb = list(map(key, a)), list(map(key, b))
    if ka == kb:
        return [(i, i) for i in range(len(a))]
    if len(set(ka)) == len(ka) and len(set(kb)) == len(kb):  # nothing to choose but the order
        score = lambda i, j: 1.0 if ka[i] == kb[j] else 0.0
    else:
        score = lambda i, j: 1.0 + 0.5 * likeness(a[i], b[j]) if ka[i] == kb[j] else 0.0
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    own = [[score(i, j) for j in range(len(b))] for i in range(len(a))]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + own[i][j] if own[i][j] else 0.0)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if own[i][j] and best[i][j] == best[i + 1][j + 1] + own[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def _grouped(items: list[tuple], bodies: list[list[str]]) -> list[tuple]:
    """Opened members in which each stretch that is one of the bodies is a repeated group, too."""
    keys, out, i = [key(x) for x, _ in items], [], 0
    while i < len(items):
        for body in bodies:
            if keys[i : i + len(body)] == body and len({o for _, o in items[i : i + len(body)]}) == 1:
                out.append((Group("+", [x for x, _ in items[i : i + len(body)]]), items[i][1]))
                i += len(body)
                break
        else:
            out.append(items[i])
            i += 1
    return out


def _level(a: list, b: list) -> tuple[list[tuple], list[tuple]]:
    """Both contents opened, with the repeated groups of either as groups in both."""
    bodies = lambda items: sorted(([key(y) for y in x.items] for x, _ in items if isinstance(x, Group)), key=len, reverse=True)
    a, b = opened(a), opened(b)
    return _grouped(a, bodies(b)), _grouped(b, bodies(a))


def mixed(items: list) -> bool:
    """Whether a content is one repeated group of kinds."""
    return len(items) == 1 and isinstance(items[0], Group) and items[0].mark == "+" and all(isinstance(x, Group) for x in items[0].items)


def members(items: list) -> list:
    """All texts and elements of a content, groups opened."""
    return [y for x in items for y in (members(x.items) if isinstance(x, Group) else [x])]


def mix(*contents: list) -> list:
    """One repeated group of all kinds that the contents have; with more than WIDE kinds, names count without classes."""
    found: dict[str, object] = {}
    for x in (y for items in contents for y in members(items)):
        found[key(x)] = merged(found[key(x)], x) if key(x) in found else x
    if len(found) > WIDE:
        plain: dict[str, object] = {}
        for _, x in sorted(found.items()):
            if isinstance(x, Element):
                x = Element(tag(x), x.items, x.ids)
            plain[key(x)] = merged(plain[key(x)], x) if key(x) in plain else x
        found = plain
    return [Group("+", [Group("?", [found[k]]) for k in sorted(found)])]


def merged(x, y):
    """Two members of one key as one that stands for both."""
    if isinstance(x, Text):
        return Text(x.const if x.const == y.const else None, x.chars + y.chars)
    if isinstance(x, Element):
        return Element(x.label, align(x.items, y.items), (x.ids, y.ids) if x.ids is not None and y.ids is not None else None)
    return Group(x.mark, [merged(p, q) for p, q in zip(x.items, y.items)])


def align(a: list, b: list) -> list:
    """The content of everything that a and b stand for."""
    if len(a) == len(b) and all(key(x) == key(y) for x, y in zip(a, b)):
        return [merged(x, y) for x, y in zip(a, b)]
    if mixed(a) or mixed(b):
        return mix(a, b)
    a, b = _level(a, b)
    out: list = []
    i = j = 0
    for p, q in [*paired([x for x, _ in a], [x for x, _ in b]), (len(a), len(b))]:
        for x in [*a[i:p], *b[j:q]]:
            out.append(Group("?", [x[0]]))  # each by itself: parts of a stretch may be missing
        i, j = p + 1, q + 1
        if p < len(a):
            both = merged(a[p][0], b[q][0])
            out.append(Group("?", [both]) if a[p][1] or b[q][1] else both)
    return mix(out) if len(out) > WIDE else out


def folded(items: list) -> list:
    """A content with neighbouring stretches of one kind as repeated groups."""
    keys, out, i, n = list(map(key, items)), [], 0, len(items)
    like = lambda p, q: keys[p] == keys[q] and likeness(items[p], items[q]) >= 0.5
    while i < n:
        for size in range(1, min(LONGEST_GROUP, (n - i) // 2) + 1):
            stop = i + size
            while stop + size <= n and all(like(i + k, stop + k) for k in range(size)):
                stop += size
            if stop > i + size:
                body = items[i : i + size]
                for at in range(i + size, stop, size):
                    body = [merged(x, y) for x, y in zip(body, items[at : at + size])]
                out.append(Group("+", body))
                i = stop
                break
        else:
            out.append(items[i])
            i += 1
    return mix(out) if len(out) > WIDE else out


def structure(page: Page) -> Element:
    """The wrapper of a page alone, with places in the page."""
    n = len(page.label)
    depth, made, chars = [0] * n, [None] * n, [0] * n
    for i in range(1, n):
        depth[i] = depth[page.parent[i]] + 1
    for text, at in page.blocks:
        chars[at] += len(text)
    for i in range(n - 1, -1, -1):
        if page.gone[i]:
            chars[i] = 0
            continue
        if depth[i] > DEEP:
            chars[page.parent[i]] += chars[i]
            continue
        items = []
        for k in page.kids[i] if depth[i] < DEEP else ():
            if k < 0:
                text = page.blocks[-1 - k][0]
                items.append(Text(int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "replace")), "big", signed=True), len(text)))
            elif not page.gone[k]:
                items.append(made[k])
                chars[i] += chars[k]
                made[k] = None
        if depth[i] >= DEEP:
            items = [Text(None, chars[i])] if chars[i] else []
        made[i] = Element(page.label[i], folded(items), i)
    return made[0] if made[0] is not None else Element("", [])


def placed(root: Element) -> Element:
    """The wrapper with the places of the main text marked: its topmost articles, else its topmost <main>, and the container by text."""
    found = {name: [] for name in MAIN}

    def seek(x: Element, name: str):
        for y in members(x.items):
            if isinstance(y, Element):
                found[name].append(y) if tag(y) == name else seek(y, name)

    for name in MAIN:
        seek(root, name)

    sums: dict[int, tuple[int, int]] = {}

    def total(x, repeated: bool) -> tuple[int, int]:
        """Characters in slots and groups, and all."""
        if isinstance(x, Text):
            return (x.chars if x.const is None or repeated else 0), x.chars
        own = [total(y, repeated or (isinstance(x, Group) and x.mark == "+")) for y in x.items]
        sums[id(x)] = out = sum(o[0] for o in own), sum(o[1] for o in own)
        return out

    which = 0 if total(root, False)[0] else 1
    least, at = SHARE * sums[id(root)][which], root
    while True:
        inner = [x for x, _ in opened(at.items) if isinstance(x, Element) and tag(x) in CONTAINERS and sums[id(x)][which] >= least and any(isinstance(y, Element) for y in members(x.items))]
        if not inner or not least:
            break
        at = max(inner, key=lambda x: sums[id(x)][which])
    at.place = CONTAINER
    for kind, name in ((MAIN_ELEMENT, "main"), (ARTICLE, "article")):
        for x in found[name]:
            x.place = kind
    return root


def pruned(x: Element) -> Element | None:
    """What is needed to find the marked places: the way to them, and their neighbours with the kinds of their contents."""

    def marked(y) -> bool:
        return not isinstance(y, Text) and ((isinstance(y, Element) and y.place > 0) or any(map(marked, y.items)))

    def bare(y):
        if isinstance(y, Text):
            return Text(None, 0)
        if isinstance(y, Group):
            return Group(y.mark, list(map(bare, y.items)))
        return Element(y.label, [Element(k, []) for k in sorted(kinds(y))])

    def cut(y):
        if isinstance(y, Text) or not marked(y):
            return bare(y)
        return Group(y.mark, list(map(cut, y.items))) if isinstance(y, Group) else Element(y.label, list(map(cut, y.items)) if any(map(marked, y.items)) else bare(y).items, place=y.place)

    return cut(x)


def located(wrapper: Element, page: Element, found: dict[int, list[int]]) -> dict[int, list[int]]:
    """Places in the page that match the wrapper's marked ones, by mark."""
    if wrapper.place:
        found.setdefault(wrapper.place, []).extend(page.places())
    if mixed(wrapper.items) or mixed(page.items):
        of = {key(x): x for x in members(wrapper.items)}
        both = [(of.get(key(y)) or of.get(tag(y)), y) for y in members(page.items) if isinstance(y, Element)]
        both = [(x, y) for x, y in both if x is not None]
    else:
        a, b = _level(wrapper.items, page.items)
        a, b = [x for x, _ in a], [x for x, _ in b]
        both = [(a[i], b[j]) for i, j in paired(a, b)]
    while both:
        x, y = both.pop()
        if isinstance(x, Group):
            both += list(zip(x.items, y.items))
        elif isinstance(x, Element) and isinstance(y, Element):
            located(x, y, found)
    return found


def main_text(page: Page, own: Element, wrapper: Element | None) -> str:
    """The page's main text by its host's wrapper; where nothing with text matches, by its own."""
    for w in (wrapper, None):
        found = located(w or placed(own), own, {})
        for _, ids in sorted(found.items()):
            if text := page.text(set(ids)):
                return text
    return ""


# Transport: a shape is an element as [label, members], a text as 0 and a group as ["+" or "?", members]; texts travel beside it, in order.


def shape(x) -> list | int:
    return 0 if isinstance(x, Text) else [x.label if isinstance(x, Element) else x.mark, list(map(shape, x.items))]


def texts(x) -> list[Text]:
    return [x] if isinstance(x, Text) else [t for y in x.items for t in texts(y)]


def built(form, own: Iterator[tuple]):
    """The wrapper of a shape; own: const and chars of its texts."""
    if form == 0:
        return Text(*next(own))
    items = [built(x, own) for x in form[1]]
    return Group(form[0], items) if form[0] in ("+", "?") else Element(form[0], items)


def packed(x: Element) -> str:
    """A wrapper with its marks, without texts."""

    def go(y):
        return 0 if isinstance(y, Text) else [y.label, list(map(go, y.items)), y.place] if isinstance(y, Element) else [y.mark, list(map(go, y.items))]

    return json.dumps(go(x), separators=(",", ":"))


def unpacked(raw: str) -> Element:
    def go(y):
        return Text(None, 0) if y == 0 else Element(y[0], list(map(go, y[1])), place=y[2]) if len(y) > 2 else Group(y[0], list(map(go, y[1])))

    return go(json.loads(raw))


def shown(x) -> str:
    """A wrapper as an expression: # is a slot, =hash a constant text."""
    if isinstance(x, Text):
        return "#" if x.const is None else f"={x.const & (1 << 64) - 1:016x}"
    inner = " ".join(map(shown, x.items))
    if isinstance(x, Group):
        return f"( {inner} ){x.mark}"
    return f"<{x.label}> {inner} </{tag(x)}>" if x.label else inner


def host_of(url: str | None) -> str:
    found = re.match(r"[^:/?#]*://([^/?#]*)", url or "")
    return found[1].translate(_LOWER) if found else ""


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HOST_SQL = r"translate(regexp_extract(coalesce(url, ''), '^[^:/?#]*://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def sums(pages: DataFrame, url: str, content: str) -> DataFrame:
    """Per host and structure, by task: host, shape, n (pages), consts and chars of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}

        def out():
            rows = [(*k, *v) for k, v in held.items()]
            held.clear()
            kinds_ = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds_)], names=["host", "shape", "n", "consts", "chars"])

        for whole in batches:
            for batch in slices(whole, 1):
                for u, source in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                    root = structure(Page(source.decode("utf-8", "replace")))
                    own = texts(root)
                    add(held, (host_of(u), json.dumps(shape(root), separators=(",", ":"))), 1, [t.const for t in own], [t.chars for t in own])
                if len(held) > FOLDED:
                    yield out()
        if held:
            yield out()

    return pages.select(url, content).mapInArrow(run, "host string, shape string, n long, consts array<long>, chars array<long>")


def add(held: dict, at, n: int, consts: list, chars: list) -> None:
    if old := held.get(at):
        held[at] = [old[0] + n, [x if x == y else None for x, y in zip(old[1], consts)], [x + y for x, y in zip(old[2], chars)]]
    else:
        held[at] = [n, consts, chars]


def _folded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Structures of equal keys (in order) aligned: keys, shape, n, consts, chars of their wrapper. A task holds one wrapper and one structure at a time."""
    rows = rows.repartition(shuffle_parts(rows.sparkSession), *keys).sortWithinPartitions(*keys, "shape").select(*keys, "shape", "n", "consts", "chars")
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", shape string, n long, consts array<long>, chars array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, form, same, root = None, 0, None, {}, None

        def take():
            """The structure whose rows have all been summed joins the wrapper."""
            nonlocal root, n
            count, consts, chars = same.pop(form)
            x = built(json.loads(form), zip(consts, chars))
            root, n = (x if root is None else merged(root, x)), n + count

        def out():
            own = texts(root)
            cols = [pa.array([v], t) for v, t in zip(at, kinds_)]
            cols += [pa.array([json.dumps(shape(root), separators=(",", ":"))]), pa.array([n], pa.int64()), pa.array([[t.const for t in own]], pa.list_(pa.int64())), pa.array([[t.chars for t in own]], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, names=[*keys, "shape", "n", "consts", "chars"])

        for batch in batches:
            kinds_ = [batch.column(k).type for k in keys]
            columns = [batch.column(k).to_pylist() for k in keys]
            for i, f in enumerate(batch.column("shape")):
                here, f = tuple(c[i] for c in columns), f.as_py()
                if same and (here != at or f != form):
                    take()
                if here != at and at is not None:
                    yield out()
                    root, n = None, 0
                at, form = here, f
                add(same, f, *(batch.column(c)[i].as_py() for c in ("n", "consts", "chars")))
        if same:
            take()
        if root is not None:
            yield out()

    return rows.mapInArrow(run, schema)


def infer(pages: DataFrame, url: str = "url", content: str = "html") -> DataFrame:
    """One row per host: host, pages, wrapper (as an expression), places (the wrapper as far as extraction needs it)."""
    found = stored(sums(pages, url, content)).withColumn("salt", F.pmod(F.xxhash64("shape"), F.lit(SALTS)).cast("int"))
    lists = stored(_folded(found, ["host", "salt"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for form, consts, chars in zip(*(batch.column(c).to_pylist() for c in ("shape", "consts", "chars"))):
                root = placed(built(json.loads(form), zip(consts, chars)))
                rows.append((shown(root), packed(pruned(root))))
            cols = [pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 2
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("n"), *cols], names=["host", "pages", "wrapper", "places"])

    return _folded(lists.drop("salt"), ["host"]).mapInArrow(run, "host string, pages long, wrapper string, places string")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", content: str = "html") -> DataFrame:
    """Per row of pages: its id, url, text (empty if none) and n_chars."""
    hosts = stored(infer(pages, url, content)).select("host", "places")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(content).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long"

    def done(batch, wrappers):
        found = []
        for source, wrapper in zip(as_bytes(batch.column(2)), wrappers):
            page = Page(source.decode("utf-8", "replace"))
            found.append(main_text(page, structure(page), wrapper))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    size = hosts.agg(F.sum(F.octet_length("places") + F.octet_length("host") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        shared = rows.sparkSession.sparkContext.broadcast({r.host: r.places for r in hosts.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, Element] = {}
            for whole in batches:
                for batch in slices(whole, 2):
                    own = [host_of(u) for u in batch.column(1).to_pylist()]
                    for h in own:
                        if h not in known:
                            known[h] = unpacked(shared.value[h])
                    yield done(batch, [known[h] for h in own])

        return rows.mapInArrow(run, schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                yield done(batch, [unpacked(p) if p else None for p in batch.column(3).to_pylist()])

    return rows.withColumn("host", F.expr(HOST_SQL)).join(hosts, "host", "left").select("page_id", "url", "html", "places").mapInArrow(joined, schema)
