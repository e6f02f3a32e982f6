"""Exact notices in long texts with many anchor words."""

import random

import pytest

from lectern.llm import licenses


@pytest.mark.parametrize("name,form,n", [("all-rights-reserved", 0, 1000), ("MIT", 0, 1000), ("MIT", 2, 2000)])
def test_notice_in_a_long_block(name, form, n):
    own, rng = licenses.Templates(), random.Random(1)
    notice = licenses.split(licenses.TEMPLATES[name][form])
    for _ in range(5):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)).encode() for _ in range(n)]
        words[::45] = [rng.choice([b"version", b"software", b"license"]) for _ in words[::45]]
        at = rng.randrange(n)
        found = own.find([*words[:at], *notice, *words[at:]])
        assert [(f[0], f[1], own.names[f[2]], f[4]) for f in found] == [(at, len(notice), name, [])]


def test_many_notices_in_one_block():
    own = licenses.Templates()
    words = licenses.split("All rights reserved. and then ") * 1500
    assert [f[0] for f in own.find(words)] == list(range(0, len(words), 5))


def test_compression_ranks_before_words_are_aligned():
    """A long notice with a word changed, in which a short one is whole: the one that shortens the text most is tried first."""
    own = licenses.Templates()
    notice = licenses.split(licenses.TEMPLATES["Apache-2.0"][1])
    changed = [b"acquire" if w == b"obtain" else w for w in notice]
    around = licenses.split("some words before it and then")
    ((first, n, i, _, differing),) = own.find([*around, *changed, *around])
    assert (first, n, own.words[i] == notice, differing) == (len(around), len(notice), True, [b"obtain>acquire"])
    assert [own.names[k] for _, k in own.ranked(changed, [0, i])] == ["Apache-2.0"] * 2 and own.ranked(changed, [0, i])[0][1] == i != 0


def test_each_template_is_found_as_itself():
    own, rng = licenses.Templates(), random.Random(3)
    for i, words in enumerate(own.words):
        for n in (0, 40, 400):
            around = ["".join(rng.choice("abcdefgh") for _ in range(5)).encode() for _ in range(n)]
            found = own.find([*around, *words, *around])
            assert [(f[0], f[1], f[2], f[4]) for f in found] == [(n, len(words), i, [])]


def test_no_rank_rules_a_template_out(monkeypatch):
    """In any order of ranks a notice is found wherever a template is confirmed."""
    notice = licenses.split("Released under the BSD License.")
    for turn in (1, -1):
        monkeypatch.setattr(licenses.Templates, "ranked", lambda self, words, among, turn=turn: [(-1.0, i) for i in among[::turn]])
        assert [f[:2] for f in licenses.Templates().find([b"x", *notice, b"y"])] == [(1, len(notice))]
