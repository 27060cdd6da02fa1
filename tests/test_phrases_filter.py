"""The join of phrases sends only pieces that may be listed."""

import pytest

from umbra.operators import phrases

NODES = [(1, "the red fox saw a Red Fox; the red  fox"), (2, None), (3, ""), (4, "nothing here " * 500), (5, "l'été à Nice, red fox")]
LIST = ["red fox", "été", "Nice", "the red fox", None, " ", "a,b"]


@pytest.mark.parametrize("most", [28, 1])  # 1: a list too long for the filter
def test_joined_finds_what_the_automaton_does(spark, monkeypatch, most):
    monkeypatch.setattr(phrases.Listed, "MOST_BITS", most)
    nodes = spark.createDataFrame(NODES, "id int, text string")
    names = spark.createDataFrame([(p,) for p in LIST], "text string")
    for fold in (False, True):
        automaton = phrases.Automaton([p for p in LIST if p], fold)
        want = {(i, a, b, t[a:b]) for i, t in NODES if t for a, b in phrases.longest(automaton.matches([t])[0])}
        assert want
        assert {tuple(r) for r in phrases.joined(nodes, names, "id", fold=fold).collect()} == want


def test_only_listed_pieces_pass(spark):
    marks = [int(phrases.marks_of(phrases.token_numbers(phrases.tokens(p, False)), 3)[0]) >> 1 for p in ("red fox", "blue sky")]
    known = phrases.Listed.of(spark.createDataFrame([(m,) for m in marks], "mark long"))
    h = phrases.token_numbers(phrases.tokens("x " * 2000 + "red fox " + "blue sky", False))
    assert set(known.holds(phrases.marks_of(h, 3) >> phrases.U(1)).nonzero()[0].tolist()) == {4000, 4004}
