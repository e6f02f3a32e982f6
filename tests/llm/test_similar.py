"""Near copies against all pairs by brute force."""

import random
import time
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from lectern.llm import common, similar
from lectern.llm.common import stored
from lectern.llm.simhash import majorities
from tests.llm.test_operators import classes


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    line = " ".join(word() for _ in range(12))
    out = [None, "", " \n", "one", "One", "one two"] + [" ".join(word() for _ in range(rng.randint(1, 90))) + " " + line for _ in range(40)]
    for size in (2, 4, 30):
        base = [word() for _ in range(200)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(1, 6)):
                own[rng.randrange(200)] = word()
            out.append(" ".join(own))
    chain = [word() for _ in range(100)]  # each near the next, the ends not
    return out + [" ".join([*chain[4 * i :], *(word() for _ in range(4 * i))]) for i in range(8)]


@pytest.mark.parametrize("short", [8, 1])
def test_near_copies_are_those_of_all_pairs(spark, short):
    own = dict(enumerate(texts()))
    sets = {i: shingle_set(t) for i, t in own.items()}
    linked = [(a, b) for a in own for b in own if a < b and alike(sets[a], sets[b])]
    assert len(linked) > 40
    root = classes(set(own), linked)
    df = spark.createDataFrame(list(own.items()), "doc_id long, text string").repartition(3)
    got = similar.near_groups(df, short=short).collect()
    assert {r.id: r.component_id for r in got} == root
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert {r.doc_id for r in stage(spark, stored(df), None).collect()} == set(root.values())


def test_no_rows(spark):
    assert similar.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_propose_pairs_first(spark, monkeypatch):
    """Pairs that the index over byte positions links are verified on whole sets before any other; those beyond it are found all the same."""
    seen, verified = [], similar._verified

    def spy(pairs, nodes, docs):
        seen.append({frozenset(r) for r in pairs.collect()})
        return verified(pairs, nodes, docs)

    monkeypatch.setattr(similar, "_verified", spy)
    own = dict(enumerate(texts()))
    rows = similar.near_groups(spark.createDataFrame(list(own.items()), "doc_id long, text string")).collect()
    sets = {r.fp: similar.hashes((own[r.id] or "").encode()) for r in rows}
    prints = {fp: int(majorities([x], [len(x)])[0]) for fp, x in sets.items()}
    assert prints == {fp: sum((2 * sum(int(h) >> b & 1 for h in x) > len(x)) << b for b in range(64)) for fp, x in sets.items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    root = classes(set(prints), near)
    proposed = classes(set(prints), [tuple(x) for x in seen[0]])
    assert root == proposed and 0 < len(seen[0]) < len(near) + 1
    linked = classes(set(prints), [tuple(x) for x in seen[0] if alike(*(set(sets[fp].tolist()) for fp in x))])
    assert all(linked[a] != linked[b] for a, b in map(tuple, set().union(*seen[1:])))


def test_pairs_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch):
    """Copies whose pairs are near the least similarity, on both sides of it."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    made, lists = [], similar._lists

    def spy(rows, columns, work):
        out = stored(lists(rows, columns, work))
        made.append(out.count() if columns == "a long, b long" else 0)
        return out

    def group(size):
        out = []
        for i in range(size):
            words = list(base)
            for at in rng.sample(range(100, 150), 4):
                words[at] = f"x{i}-{at}"
            out.append((i, " ".join(words)))
        return out

    monkeypatch.setattr(similar, "_lists", spy)
    counts = []
    for size in (60, 240):
        made.clear()
        rows = group(size)
        sets = {i: shingle_set(t) for i, t in rows}
        want = classes(set(sets), [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
        got = {r.id: r.component_id for r in similar.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == want
        counts.append(sum(made))
    assert counts[1] <= 8 * max(counts[0], 60)


def test_sketches_rule_out_what_is_a_little_less_similar():
    rng = random.Random(12)
    draw = lambda n: {rng.getrandbits(64) for _ in range(n)}
    for n in (30, 144, 600):
        both = draw(n)
        for part, may in ((0.09, True), (0.16, False)):  # similarity 0.83 and 0.72
            sets = [np.array(sorted(both | draw(int(part * n / (1 - part)))), dtype=np.uint64) for _ in range(2)]
            sketches = similar.Sketches([similar.sketch(x) for x in sets], np.array([len(x) for x in sets]))
            assert (sketches.room(0, np.array([1]))[0] >= 0) == may == similar.alike(*sets)


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def test_what_is_used_up_leaves_the_disks(spark, monkeypatch):
    """Of near_groups only its result stays in the shared folder, sets go once their pairs are checked, and shuffle files go with their query."""
    folder, setting = Path(spark.conf.get("spark.checkpoint.dir")), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    df = stored(spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string"))
    grown, verified = [], similar._verified

    def spy(*args):
        tables = set(folder.iterdir())
        out = verified(*args)
        grown.append(len(set(folder.iterdir()) - tables))
        return out

    monkeypatch.setattr(similar, "_verified", spy)
    tables, files, was = set(folder.iterdir()), shuffle_files(spark), spark.conf.get(setting)
    got = similar.near_groups(df)
    end = time.time() + 20
    while (left := shuffle_files(spark) - files) and time.time() < end:  # they go without waiting
        time.sleep(0.2)
    assert not left and spark.conf.get(setting) == was
    assert len(set(folder.iterdir()) - tables) == 1 and len(grown) > 1 and set(grown) == {1}
    assert got.count() == df.count() == len(got.collect())


def test_few_and_many_rows_give_the_same(spark, monkeypatch):
    df = stored(spark.createDataFrame([*enumerate(texts()), (0, None), (7, "one two")], "doc_id long, text string"))
    found = lambda: (sorted(map(tuple, similar.near_groups(df).collect())), sorted(r.doc_id for r in similar.deduplicate(df).collect()))
    broadcast = found()
    monkeypatch.setattr(common, "FEW", 0)
    assert found() == broadcast


def test_sketches_rule_pairs_of_short_lists_out_before_sets_are_made(spark, monkeypatch):
    """Texts that have half of their words in common meet in lists, but no sets are made of them."""
    rng = random.Random(13)
    draw = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    rows = []
    for i in range(0, 60, 3):
        half, other = draw(100), draw(100)
        rows += [(i, " ".join(half + other)), (i + 1, " ".join(half + draw(100))), (i + 2, " ".join(half + other + draw(3)))]
    seen, verified = set(), similar._verified

    def spy(pairs, nodes, docs):
        seen.update(frozenset(r) for r in pairs.collect())
        return verified(pairs, nodes, docs)

    monkeypatch.setattr(similar, "_verified", spy)
    got = {r.id: r for r in similar.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.component_id for i, r in got.items()} == {i: i - 2 if i % 3 == 2 else i for i, _ in rows}
    assert seen == {frozenset((got[i].fp, got[i + 2].fp)) for i in range(0, 60, 3)}
