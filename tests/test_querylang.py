import random

import pytest

from voxloom.functions.porter import stem
from voxloom.plans.querylang import Filters, Phrase, State, effective_years, parse, range_label, read_state, set_episode, set_range, without_filters, write_state


def groups(q):
    return [[p.text + "*" * p.prefix for p in g] for g in parse(q).groups]


@pytest.mark.parametrize(
    "q, want, negative",
    [
        ("red fox", [["red"], ["fox"]], []), ('"red  fox" -"old dog" run*', [["red fox"], ["run*"]], ["old dog"]), ("a OR b c", [["a", "b"], ["c"]], []),
        ("a OR -b c", [["a"], ["c"]], ["b"]), ("OR a OR", [["a"]], []), ("a year:2014 OR b", [["a"], ["b"]], []), ('x"y z"w', [["x"], ["y z"], ["w"]], []),
        ('say "nothing', [["say"], ["nothing"]], []), ("-- * ?? 🙂", [], []), ("or Or", [["or"], ["Or"]], []), ("--x y**", [["y*"]], ["x"]), ("", [], []), (None, [], []),
    ],
)
def test_groups(q, want, negative):
    assert groups(q) == want
    assert [p.text for p in parse(q).negative] == negative


def test_filters():
    assert parse("year:2020–2015 x").filters == Filters(after=2014, before=2021)
    assert parse("year:2015-2015 ep:12 EP:13").filters == Filters(year=2015, ep=13)
    assert parse("include:ads").include_ads and parse("year:15 x").filters == Filters() and len(parse("year:15 x").groups) == 2
    assert effective_years(parse("after:2014 x"), 2024) == (2015, 2024) and effective_years(parse("x"), 2024) is None
    assert without_filters('x year:2014 "a b" ep:3') == 'x "a b"'


def test_rewriting():
    assert without_filters("a OR year:2015 b ep:3", ("year", "before", "after")) == "a b ep:3"
    assert set_range("glue year:2010 before:2012", 2015, 2014) == "glue year:2014-2015" and set_episode("glue ep:3", 5) == "glue ep:5"
    assert set_range("x" * 195, 2014, 2014).startswith("year:2014 ") and range_label((2014, 2014)) == "2014" and range_label(None) == "Any year" and range_label((2014, 2016)) == "2014–2016"
    assert effective_years(parse("after:2020 before:2019"), 2024) == (2021, 2018)
    assert read_state("?q=hide+glue+🙂&mode=smart&sort=NEWEST&page=99") == State("hide glue", "related", "newest", 5)
    assert write_state(State("hide glue", "exact", "relevance", 2)) == "?q=hide+glue&page=2" and write_state(State()) == ""


def test_terms_and_meaning():
    q = parse("the “red fox” don’t of*")
    assert q.semantic == "the red fox don't of" and q.terms == (Phrase("red"), Phrase("fox"), Phrase("of", True))


def test_anything_parses():
    r = random.Random(1)
    for _ in range(2000):
        q = parse("".join(r.choices('ab "-*:OR 1year\t“’\x00\ud800', k=r.randint(0, 260))))
        assert all(p.text for g in q.groups for p in g)


@pytest.mark.parametrize("word, want", [("glue", "glue"), ("glued", "glu"), ("running", "run"), ("ponies", "poni"), ("relational", "relat"), ("hopefulness", "hope"), ("sky", "sky"), ("at", "at"), ("école", "école")])
def test_stem(word, want):
    assert stem(word) == want
