"""The operators against plain versions, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lectern.llm import bpe, common, decontaminate, exact_dedup, graph, hmm, licenses, quality, simhash, url_rules, warc, wrappers

WORDS = [a + b for a in ("an", "the", "or", "st", "é", "ü") for b in ("ing", "ed", "a", "ion", "!")]
SCHEMA = "doc_id long, text string, kept boolean, id string, __row long, size int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows_of(seed=0, n=60):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(0, 80)) for _ in range(n)]
    texts += [None, "", " \n", "one", "One", "one two", "x" * 5000, prose(rng, 30_000), "same text here now", "same text here now", "same text here now"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, texts[3]), (3, texts[3]), (500, texts[3])]
    near = texts[4].split() + prose(rng, 300).split()
    rows += [(600, " ".join(near)), (601, " ".join(near[:-1] + ["end"])), (602, " ".join(near + ["more"]))]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = rows_of()
    return rows, spark.createDataFrame([(i, t, True, "clash", 1, 2) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_runs_and_shingles_agree_with_split():
    text = (" Ab é\tx\x0by " * 50).encode()
    assert [w for run in common.word_runs(text, 37) for w in run] == text.lower().split()
    assert [s for run in common.shingles(b"a b c d", 3) for s in run] == [b"a b c", b"b c d"]
    assert list(common.shingles(b" A b ", 3)) == [[b"a b"]] and list(common.shingles(b" ", 3)) == []


def test_exact_dedup(docs, none):
    rows, df = docs
    got = exact_dedup.exact_groups(df, counters=4).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    want = Counter((i, max((j for j in groups[t or ""] if j is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert Counter((r.id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.id == r.keep_id for r in got if r.kept)
    left = exact_dedup.deduplicate(df)
    assert left.columns == df.columns and left.count() == len(groups)
    assert exact_dedup.exact_groups(none).count() == 0


def test_misra_gries_misses_no_frequent_item():
    rng = random.Random(1)
    items = ["a"] * 300 + ["b"] * 200 + [str(i) for i in range(500)]
    rng.shuffle(items)
    sketch = exact_dedup.MisraGries(9)
    for x in items:
        sketch.add(x)
    assert 200 <= sketch.counts["a"] <= 300 and 100 <= sketch.counts["b"] <= 200 and len(sketch.counts) <= 9


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_simhash_components(docs, none):
    rows, df = docs
    got = simhash.near_groups(df).collect()
    prints = [fingerprint(t) for _, t in rows]
    assert Counter((r.id, r.fp % 2**64) for r in got) == Counter((i, p) for (i, _), p in zip(rows, prints))
    own = sorted(set(prints))
    root = classes(own, [(a, b) for a in own for b in own if a < b and (a ^ b).bit_count() <= 3])
    first = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            first[root[p]] = min(first.get(root[p], i), i)
    assert all(r.component_id == first.get(root[r.fp % 2**64]) for r in got)
    assert sum(r.best for r in got) == len(set(root.values())) == simhash.deduplicate(df).count()
    assert simhash.near_groups(none).count() == 0


@pytest.mark.parametrize("full", [1 << 16, 0])
def test_linked_sets_in_a_posting(full, monkeypatch):
    monkeypatch.setattr(simhash, "FULL", full)
    rng = random.Random(3)
    base = rng.getrandbits(64) & ~0xFFFFFFFF
    own = {base | rng.getrandbits(12) << rng.choice([0, 10, 20]) for _ in range(120)}
    got = sorted(sorted(s.tolist()) for s in simhash.linked_sets(np.array(sorted(own), dtype=np.uint64)))
    root = classes(own, [(a, b) for a in own for b in own if a < b and (a ^ b).bit_count() <= 3])
    sets = defaultdict(list)
    for x in own:
        sets[root[x]].append(x)
    assert got == sorted(sorted(s) for s in sets.values() if len(s) > 1)


def test_blocks_leave_no_pair_out():
    from itertools import combinations

    assert len(simhash.BLOCKS) == 14
    assert all(any(not set(b) & set(d) for b in simhash.BLOCKS) for d in combinations(range(8), 3))


def test_components_of_paths_stars_and_cliques(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(300, i) for i in range(301, 340)] + [(a, b) for a in range(400, 408) for b in range(400, 408)] + [(7, 7)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = classes({x for e in edges for x in e}, edges)
    assert got == {x: r for x, r in root.items() if x != r}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers

    return bpe.make_codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_bpe_is_as_tiktoken(codec, docs, none):
    import public_tokenizers
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab \n\t\x85\xa0　'sédß1٣½漢字🙂\x1ćﬁIi'tLL") for _ in range(rng.randint(0, 50)))
        assert [i for part in codec.encode(text) for i in part] == other.encode_ordinary(text)
    rows, df = docs
    got = bpe.round_trip(df, codec).collect()
    want = Counter()
    for i, t in rows:
        ids = other.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    assert bpe.round_trip(none, codec).count() == 0
    back = bpe.decode(bpe.encode(df, codec), codec)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())


def test_bpe_of_long_texts_in_pieces(codec, monkeypatch):
    text = "word  two\n" * 300_000
    whole = codec.encode(text[:1000])
    assert bpe.digest(codec, text)[2] == hashlib.sha256(text.encode()).hexdigest()
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    assert [i for p in codec.encode(text[:1000]) for i in p] == [i for p in whole for i in p]


def test_perfect_hash():
    keys = [b"%d" % i for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot_key) == list(range(5000)) and all(h.find(k) == i for i, k in enumerate(keys))
    assert bpe.PerfectHash([b"one"]).find(b"one") == 0


def test_language_model(docs, none):
    rows, df = docs
    got = hmm.score(df, passes=2).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update((t or "").encode().lower().split() + [b""])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        w = (t or "").encode().lower().split() + [b""]
        want[i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)] += 1
    assert Counter((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert hmm.score(none, passes=1).count() == 0


def test_forward_and_expected_counts_sum_over_all_paths():
    from itertools import product

    rng = np.random.default_rng(0)
    mass = rng.random(hmm.CLASSES) + 0.01
    model = hmm.Model.begin(mass / mass.sum(), np.ones(hmm.CLASSES), [b"w%d" % i for i in range(hmm.OWN)])
    model.emit[:20] *= 1 + rng.random((20, hmm.STATES)) * 3
    seq = [np.array([3, 5, 0], dtype=np.int16), np.array([7], dtype=np.int16)]
    start, moves, counts = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((hmm.CLASSES, hmm.STATES))
    for s, log in zip(seq, hmm.forward(model, seq)):
        paths = list(product(range(hmm.STATES), repeat=len(s)))
        p = np.array([model.start[z[0]] * np.prod([model.step[a, b] for a, b in zip(z, z[1:])]) * np.prod([model.emit[o, a] for o, a in zip(s, z)]) for z in paths])
        assert math.isclose(log, math.log10(p.sum()), rel_tol=1e-9)
        for z, w in zip(paths, p / p.sum()):
            start[z[0]] += w
            for a, b in zip(z, z[1:]):
                moves[a, b] += w
            for o, a in zip(s, z):
                counts[o, a] += w
    for a, b in zip(hmm.expected(model, seq), (start, moves, counts)):
        np.testing.assert_allclose(a, b, rtol=2e-4, atol=1e-5)


def test_classes_and_words_add_up_to_one():
    assert hmm.bucket(b"a") == 1 + hmm.OWN + zlib.crc32(b"a|a") % hmm.BUCKETS


def test_bucket_of_is_bucket(spark):
    words = [b"a", b"ab", b"abc", "éü".encode(), b"longer"]
    got = spark.createDataFrame([(bytearray(w),) for w in words], "w binary").select("w", hmm.bucket_of(hmm.F.col("w")).alias("b")).collect()
    assert all(hmm.bucket(bytes(r.w)) == r.b for r in got)


RECORD = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9999:A-1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def test_warc_round_trip(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        x = "".join(rng.choice(["a", "é", RECORD, "WARC/1.0\r\n", "Content-Length: 7\r\n\r\n", "\r\n\r\n"]) for _ in range(rng.randint(0, 40)))
        if i % 20 == 0:
            x += "z" * 70_000 + RECORD * 500 + "y" * 50_000 + RECORD
        rows.append((None if i == 7 else i, f"http://a/\r\n{i}", None if i == 3 else "same" if i > 100 else x))
    rows.append(rows[10])
    df = spark.createDataFrame([(*r, True) for r in rows], "page_id long, url string, html string, header boolean").repartition(2)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        path = common.shared_dir(spark)
        warc.write(df, path)
        got = warc.payloads(warc.read(spark, path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    digest = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    assert Counter((r.row_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((i, len((x or "").encode()), digest(x or "")) for i, _, x in rows)
    groups = defaultdict(list)
    for i, _, x in rows:
        groups[digest(x or "")].append(i)
    for r in got:
        if r.record_type == "revisit":
            assert r.refers_to == min(j for j in groups[r.payload_digest] if j is not None)
        else:
            assert r.refers_to is None and hashlib.sha1(r.payload).digest() == base64.b32decode(r.payload_digest)
    assert sum(r.record_type == "revisit" for r in got) == sum(len(g) - 1 for g in groups.values())


def test_warc_of_nothing_and_least_size(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    path = common.shared_dir(spark)
    warc.write(none, path)
    assert warc.read(spark, path).count() == 0
    two = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], none.schema)
    path = common.shared_dir(spark)
    warc.write(two, path, least_bytes=5)
    got = {r.row_id: (r.record_type, r.refers_to) for r in warc.payloads(warc.read(spark, path)).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_url_rules(spark):
    rng = random.Random(4)
    hosts = ["net", "a.net", "b.a.net", "xnet", "net.org", "org", "A.Net", "", "a.net:80", "c.b.a.net", "org.", "é.org"]
    paths = ["", "/", "/en", "/en/x", "/en/xy?q#f", "/fr/", "?x", "#y", "/EN/"]
    urls = [rng.choice(["http://", "x://", ""]) + rng.choice(hosts) + rng.choice(paths) for _ in range(400)] + [None, "", "://", "a://b://c/d", "x" * 60_000, "y" * 60_000 + "://" + "a." * 30_000 + "net/" + "p" * 60_000, "h\nt://a.net/\n/en?"]
    rules = [("net", "/", "block"), ("a.net", "/en/", "allow"), ("b.a.net", "", "block"), ("a.net", "/en/xy", "block"), ("org", "/fr/", "allow"), ("org", "/fr/", "block"), ("A.net", "/EN/", "block")]
    got = url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, action string"), "page_id").collect()
    assert len(got) == len(urls)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in got:
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:end].translate(low), rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fit = [(len(h) + len(p), len(h), a, h.translate(low) + p) for h, p, a in rules if (host == h.translate(low) or host.endswith("." + h.translate(low))) and path.startswith(p)]
        best = max(fit, default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[3], best[2] if best else "allow"), u
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(empty, spark.createDataFrame(rules, "host string, path string, action string"), "page_id").count() == 0


def test_quality_model_learns_grades(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(900):
        grade = rng.choice([0, 1, 2, 2, 2])
        words = prose(rng, rng.randint(20, 120)).split()
        if grade == 0:
            words = [w + "$$$" for w in words]
        if grade == 1:
            words[rng.randrange(len(words))] = rng.choice(["vilex", "vilely", "vileous"])
        docs.append((i, " ".join(words)))
        if i < 600:
            labels.append((i, int(grade > 0), int(grade == 1)))
        else:
            labels.append((i, grade, None))
    table = spark.createDataFrame([x for x in labels if x[0] < 600] + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.id: r for r in quality.classify(spark.createDataFrame(docs + [(None, None)], "doc_id long, text string"), table).collect()}
    right = sum(got[i].kept == (g == 2) for i, g, _ in labels[600:])
    assert right >= 0.95 * 300 and len(got) == 901
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in got.values())


def test_quality_without_labels_keeps_all(docs, none, spark):
    _, df = docs
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.select_good(df, labels).count() == df.count()
    assert quality.classify(none, labels).count() == 0


def test_masks_fit_between_any_two_substitutions():
    from itertools import combinations

    for bad in combinations(range(decontaminate.WINDOW), decontaminate.WINDOW - decontaminate.AGREE):
        assert any(not {s + p for p in m} & set(bad) for m in decontaminate.MASKS for s in range(decontaminate.WINDOW - m[-1]))


def agree(doc, item):
    """Whether some diagonal has a window as the operator asks for, by trying all."""
    d, t = doc.encode().lower().split(), item.encode().lower().split()
    least, need = (13, 11) if len(t) >= 13 else (len(t), len(t))
    for diagonal in range(-len(t), len(d)):
        same = [d[diagonal + k] == t[k] if 0 <= diagonal + k < len(d) else None for k in range(len(t))]
        for s in range(len(t) - least + 1):
            w = same[s : s + least]
            if t and None not in w and sum(w) >= need:
                return True
    return False


def test_decontamination(spark, none):
    rng = random.Random(6)
    items = [(i, prose(rng, n)) for i, n in enumerate([30, 13, 14, 5, 1, 40])] + [(6, None), (7, ""), (8, items_text := prose(rng, 20)), (9, items_text)]
    rows = []
    for i in range(80):
        words = prose(rng, rng.randint(0, 60)).split()
        part = (items[rng.randrange(6)][1]).split()
        for _ in range(rng.randint(0, 4)):
            part[rng.randrange(len(part))] = "changed"
        at = rng.randint(0, len(words))
        rows.append((i, " ".join(words[:at] + part + words[at:])))
    rows += [(90, None), (91, ""), (92, items_text), (92, items_text), (None, items_text.upper())]
    got = decontaminate.overlaps(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"))
    want = Counter((i, j) for i, t in rows for j, x in items if agree(t or "", x or ""))
    assert Counter((r.id, r.item_id) for r in got.collect()) == want and want
    assert decontaminate.overlaps(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.overlaps(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_license_notices(spark, none):
    rng = random.Random(8)
    short = {"MIT": "Released under the MIT License.", "CC-BY-NC": "Licensed under CC BY-NC 4.0.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL": "This work is licensed under the GNU General Public License, version 3.", "all-rights-reserved": "All rights reserved."}
    rows, want = [], Counter()
    for i in range(60):
        lines = [prose(rng, rng.randint(0, 90)) for _ in range(3)]
        for name in rng.sample(sorted(short), rng.randint(0, 2)):
            lines.insert(rng.randint(0, len(lines)), short[name])
            want[i, name] += 1
        rows.append((i, "\n".join(lines)))
    rows += [(70, None), (71, ""), (72, "All rights are reserved, and this license is void"), (73, licenses.TEMPLATES["MIT"][2].replace("copy,", "clone,"))]
    got = licenses.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")).collect()
    assert Counter((r.id, r.license) for r in got if r.id < 60) == want
    mine = [r for r in got if r.id == 73]
    assert [(r.license, r.differing) for r in mine] == [("MIT", "copy>clone")]
    assert {r.version for r in got if r.license == "CC-BY-NC"} == {"4.0"}
    assert licenses.scan(none).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul>{nav}</ul></nav><div class="ad">buy {n}</div>
<article><h1>Head {n} &amp; more</h1><div class="notice">We use cookies</div><p>{a}<br><p><b>{b}</b>&nbsp;end</p><aside>no</aside><form><p>mail</p></form>{list}<section id="comments"><p>me too</p></section></article><article class="comment"><p>first!</p></article><footer>f</footer></body></html>"""


def test_main_text(spark):
    rows, want = [], {}
    for i in range(30):
        a, b, items = f"first {i}\n  line", f"second {i}", [f"item {k}" for k in range(i % 3)]
        page = PAGE.format(nav="<li><a href='/x'>x</a>" * (i % 4), n=i, a=a, b=b, list="<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>" if items else "")
        rows.append((i, f"http://host{i % 2}.example/{i}", page))
        want[i] = "\n".join([f"Head {i} & more", f"first {i} line", f"second {i} end", *items])
    rows += [(100, None, None), (101, "http://one.example/", ""), (102, "http://two.example/", "<div><p>Only <i>text</i></p><div class='sidebar'>s</div>"), (103, "x", "a < b & c <unclosed 'q")]
    want |= {100: "", 101: "", 102: "Only text", 103: None}
    got = wrappers.extract(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        if want[r.page_id] is not None:
            assert r.text == want[r.page_id]
        assert r.n_chars == len(r.text) and r.url == dict((x[0], x[1]) for x in rows)[r.page_id]
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_have_slots_groups_and_options(spark):
    rows = [(f"http://h.example/{i}", f"<article><h1>t{i}</h1>" + "<p>x</p>" * (i % 3 + 1) + ("<table><tr><td>q</table>" if i % 2 else "") + "<div>by us</div></article>") for i in range(12)]
    got = wrappers.infer(spark.createDataFrame(rows, "url string, html string")).collect()
    assert len(got) == 1 and got[0].pages == 12
    assert "<h1> # </h1>" in got[0].wrapper and "( <p> =" in got[0].wrapper and "</p> )+" in got[0].wrapper and ")?" in got[0].wrapper and "<div> =" in got[0].wrapper
