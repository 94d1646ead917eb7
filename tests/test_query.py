from __future__ import annotations

import re

import pytest

from scriptorium.operators.filters import check_limit, subtree_prefix
from scriptorium.operators.query import (
    ButNot,
    Everything,
    Tagged,
    all_of,
    any_of,
    but_not,
    describe,
    phrase,
    prefix,
    separate,
    tag,
    terms,
    word,
)

def test_description_rebuilds_the_query():
    import random

    from test_search import random_tree

    rng = random.Random(11)
    names = {f.__name__: f for f in (word, phrase, prefix, tag, all_of, any_of, but_not)}
    for _ in range(200):
        tree = all_of(random_tree(rng, 3), but_not(tag("x-1"), tag("it's")))
        text = re.sub(r", in (\w+)\)", r", '\1')", describe(tree))
        assert eval(text, names) == tree


def test_operators_build_the_same_trees():
    assert word("p") & "q" | "r" == any_of(all_of("p", "q"), "r")
    assert word("p") - "q" == but_not("p", "q") and terms(["p", "q"], "OR") == any_of("p", "q")


def test_tokens_of_a_compound_word():
    assert word("crash-Réport").tokens == ("crash", "report")


def test_separate_tags_from_keywords():
    assert separate(tag("x")) == (None, Tagged("x"))
    assert separate(all_of(tag("x"), "a")) == (word("a"), Tagged("x"))
    assert separate(but_not("a", tag("x"))) == (word("a"), ButNot(Everything(), Tagged("x")))
    assert separate(but_not(tag("y"), tag("x"))) == (None, ButNot(Tagged("y"), Tagged("x")))
    text, tags = separate(but_not(all_of("a", tag("x")), "b"))
    assert (text, tags) == (ButNot(word("a"), word("b")), Tagged("x"))


@pytest.mark.parametrize(
    "tree",
    [
        any_of(tag("x"), "a"),
        any_of("a", all_of("b", tag("x"))),
        but_not("a", all_of("b", tag("x"))),
        but_not(tag("x"), "a"),
    ],
)
def test_rejected_mixes(tree):
    with pytest.raises(ValueError):
        separate(tree)


def test_argument_checks():
    for build in (
        lambda: phrase("a b", "tag"),
        lambda: prefix("a", "tag"),
        lambda: word("a", "author"),
        lambda: all_of(),
        lambda: terms(["a"], "XOR"),
        lambda: check_limit(0),
        lambda: check_limit(10_001),
    ):
        with pytest.raises(ValueError):
            build()
    assert word("x", "TAG") == tag("x")


@pytest.mark.parametrize("bad", ["", " ", ".", "..", "/abs", "a/../b", "a//b", "./a", "a\0b", "\\abs", "/", None])
def test_rejected_subtrees(bad):
    with pytest.raises(ValueError):
        subtree_prefix(bad)


@pytest.mark.parametrize("given,expected", [("Soups", "soups"), ("Kitchen/", "kitchen"), ("G\\H//", "g/h"), ("50%_x", "50%_x")])
def test_subtree_forms(given, expected):
    assert subtree_prefix(given) == expected
