"""Wrappers accept the pages that they come from, and main texts don't depend on how many pages there are or where they lie."""

import json
import random

import pytest

from lectern.llm import wrappers as W
from lectern.llm.markup import Page


def ends(x, page, kids, starts):
    """Places among kids at which a match of x may end that began at one of starts, by trying all."""
    if isinstance(x, W.Text):
        return {i + 1 for i in starts if i < len(kids) and kids[i] < 0}
    if isinstance(x, W.Element):
        return {i + 1 for i in starts if i < len(kids) and kids[i] > 0 and x.label in (page.label[kids[i]], page.label[kids[i]].split(".")[0]) and accepts(x, page, kids[i])}
    out = new = through(x.items, page, kids, starts)
    if x.mark == "?":
        return starts | out
    while new:
        new = through(x.items, page, kids, new) - out
        out = out | new
    return out


def through(items, page, kids, starts):
    for x in items:
        starts = ends(x, page, kids, starts)
    return starts


def accepts(wrapper, page, node=0):
    kids = [k for k in page.kids[node] if k < 0 or not page.gone[k]]
    return len(kids) in through(wrapper.items, page, kids, {0})


def page_of(rng, depth=0):
    out = ""
    for _ in range(rng.randint(0, 5 if depth < 3 else 1)):
        kind = rng.choice(["p", "div", "ul", "h2", "div class=a", "section", "dl"])
        name = kind.split()[0]
        if name == "ul":
            out += "<ul>" + "".join(f"<li>{page_of(rng, depth + 1) if rng.random() < 0.3 else rng.choice('xyz')}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        elif name == "dl":
            out += "<dl>" + "<dt>a<dd>b" * rng.randint(1, 3) + "</dl>"
        else:
            out += f"<{kind}>{rng.choice('abc') if name in ('p', 'h2') else page_of(rng, depth + 1)}</{name}>"
    return out


@pytest.mark.parametrize("wide", [3, 6, 64])
def test_every_page_is_in_the_language_of_the_wrapper(wide, monkeypatch):
    monkeypatch.setattr(W, "WIDE", wide)
    rng = random.Random(wide)
    for _ in range(120):
        pages = [Page(page_of(rng)) for _ in range(rng.randint(1, 7))]
        made = [W.structure(p) for p in pages]
        half = len(made) // 2

        def fold(part):
            out = None
            for x in part:
                out = x if out is None else W.merged(out, x)
            return out

        whole = fold([x for x in (fold(made[:half]), fold(made[half:])) if x])  # also wrappers with wrappers
        assert all(accepts(whole, p) for p in pages), W.shown(whole)
        assert all(W.main_text(p, W.structure(p), W.unpacked(W.packed(W.pruned(W.placed(whole))))) for p in pages if p.blocks)


SITE = """<html><head><title>t</title></head><body><nav><a href='/'>x</a></nav><div class="top"><p>Site of the town</p></div><{box}><h1>Head {i}</h1>{list}<p>First of {i}, and a long line of text it is.</p><h2>Summary</h2>
<p>Second of {i}, as long as the first one was.</p></{end}><div class="legal"><p>Rights and duties of readers</p></div><footer>f</footer></body></html>"""


def site(n, box="article"):
    return [SITE.format(i=i, box=box, end=box.split()[0], list="<ul>" + "<li>a</li>" * (i % 3) + "</ul>" if i % 3 else "") for i in range(n)]


def extracted(spark, pages, parts):
    rows = [(i, "http://host.example/", p) for i, p in enumerate(pages)]
    return {r.page_id: r.text for r in W.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect()}


@pytest.mark.parametrize("box", ["article", "main", "div class='story'"])
def test_texts_are_the_same_for_any_number_of_pages_and_tasks(spark, box):
    pages = site(500, box)
    want = extracted(spark, pages, 3)
    for i in (0, 4, 499):
        assert want[i] == "\n".join([f"Head {i}", *["a"] * (i % 3), f"First of {i}, and a long line of text it is.", "Summary", f"Second of {i}, as long as the first one was."])
    for n in (1, 7, 8):
        for parts in (1, 2, 7):
            assert extracted(spark, pages[:n], parts) == {i: want[i] for i in range(n)}


def test_order_and_copies_of_pages_make_no_difference(spark):
    pages = site(9, "div class='story'")
    want = extracted(spark, pages, 2)
    turned = extracted(spark, pages[::-1] + pages[:1] * 30, 7)
    assert [turned[8 - i] for i in range(9)] == [want[i] for i in range(9)] and turned[20] == want[0]


def test_lines_that_pages_share_stay_in_the_region_and_leave_elsewhere(spark):
    got = extracted(spark, site(12, "div class='story'"), 3)
    assert all("Summary" in t and "Site of the town" not in t and "Rights" not in t for t in got.values())


def test_equal_folds_from_any_partitions(spark):
    rng = random.Random(4)
    rows = [(f"http://h{rng.randint(0, 2)}.example/", page_of(rng)) for _ in range(120)]
    rows += rows[:40]
    want = None
    for parts in (1, 2, 7):
        df = spark.createDataFrame(rows, "url string, html string").repartition(parts)
        got = sorted((r.host, r.pages, r.wrapper, r.places) for r in W.infer(df).collect())
        want = want or got
        assert got == want and sum(r[1] for r in got) == len(rows)


def test_shuffled_places_are_as_broadcast_ones(spark, monkeypatch):
    rows = [(i, f"http://Host{i % 3}.example/é?{i}" if i % 5 else None, p, "x") for i, p in enumerate(site(20))] + [(99, None, None, "x"), (99, "u", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    want = sorted(map(str, W.extract(df).collect()))
    monkeypatch.setattr(W, "BROADCAST_BYTES", -1)
    assert sorted(map(str, W.extract(df).collect())) == want and len(want) == 22


def test_shapes_are_packed_and_unpacked():
    page = Page(site(1)[0])
    root = W.structure(page)
    again = W.built(json.loads(json.dumps(W.shape(root))), iter([(t.const, t.chars) for t in W.texts(root)]))
    assert W.shown(again) == W.shown(root) and W.shown(W.unpacked(W.packed(root))).count("<") == W.shown(root).count("<")
