"""Phrase lists against brute force: whole words, the longest match, lists of a million, and the join."""

import random
import re
import time

import pytest

from umbra.errors import ValidationError
from umbra.operators import detect, phrases


def brute(names, text, fold=False, all_matches=False):
    """Every place where a phrase's tokens stand, looked for one by one."""
    norm = (lambda t: t.casefold()) if fold else (lambda t: t)
    found = [m.span() for m in phrases.TOKEN.finditer(text)]
    plain = [norm(text[a:b]) for a, b in found]
    lists = {tuple(phrases.tokens(p, fold)) for p in names if p and p.strip()}
    hits = sorted({(found[i][0], found[i + len(p) - 1][1]) for p in lists for i in range(len(plain) - len(p) + 1) if tuple(plain[i : i + len(p)]) == p}, key=lambda s: (s[0], -s[1]))
    if all_matches:
        return hits
    out = []
    for a, b in hits:
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


@pytest.mark.parametrize("fold", [False, True])
def test_random_lists_against_brute_force(fold):
    rng = random.Random(7)
    alphabet = ["a", "b", "ab", "A", "É", "é", "-", "'", " ", "  ", "1", "_", "ß", "😀", "."]
    for _ in range(150):
        names = ["".join(rng.choices(alphabet, k=rng.randrange(7))) for _ in range(rng.randrange(25))]
        texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(5)] + [""]
        own = phrases.Automaton(names, fold)
        got = own.matches(texts)
        assert [sorted(set(g), key=lambda s: (s[0], -s[1])) for g in got] == [brute(names, t, fold, True) for t in texts]
        assert [phrases.longest(g) for g in got] == [brute(names, t, fold) for t in texts]


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(phrases, "PIECE", 3)
    rng = random.Random(3)
    names = [" ".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(15)]
    text = " ".join(rng.choices("abcd", k=2000))
    assert phrases.longest(phrases.Automaton(names).matches([text])[0]) == brute(names, text)


def test_whole_words_and_the_longest():
    own = phrases.phrases("CITY", ["York", "New York", "New York City", "O'Neil", "C++"])
    text = "Yorkshire, New York Citys, New York City; York_ O'Neils O'Neil C++"
    assert [text[a:b] for a, b, *_ in own.model.find_all([text])[0]] == ["New York", "New York City", "O'Neil", "C++"]
    every = phrases.phrases("CITY", ["York", "New York"], all_matches=True)
    assert every.model.find_all(["New York"])[0] == [(0, 8, "CITY", 0.7), (4, 8, "CITY", 0.7)]


def test_a_million_phrases():
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    pool = [word() for _ in range(60_000)]
    names = {" ".join(rng.choices(pool, k=rng.randrange(1, 4))) for _ in range(1_000_000)}
    began = time.perf_counter()
    own = phrases.Automaton(names)
    built = time.perf_counter() - began
    text = " ".join(rng.choices(pool, k=3000)) + " " + " ".join(rng.sample(sorted(names), 500))
    found = phrases.longest(own.matches([text])[0])
    lists = set(names)
    words, starts = text.split(" "), [m.start() for m in re.finditer(r"\S+", text)]
    want, reach = [], 0
    for i, a in enumerate(starts):
        n = next((n for n in (3, 2, 1) if " ".join(words[i : i + n]) in lists and i + n <= len(words)), 0)
        if n and a >= reach:
            reach = starts[i + n - 1] + len(words[i + n - 1])
            want.append((a, reach))
    assert found == want and len(found) > 500
    assert built < 60 and own.nbytes < 64 << 20


def test_by_automaton_and_by_join(spark):
    nodes = spark.createDataFrame([(1, "x", "Ann Lee met Ann in Old Town"), (1, "y", "ann lee"), (2, "x", None), (3, "x", ""), (None, "x", "Ann Lee"), (4, "z", "Ann Lee Old Town " * 3000)], "doc_id long, node_id string, text string")
    names = spark.createDataFrame([("Ann",), ("Ann Lee",), ("Old Town",), (None,), (" ",), ("Ann Lee",)], "text string")
    for fold in (False, True):
        by_list = detect.entities(detect.detect(nodes, [phrases.of_table("X", names, fold=fold)]), "doc_id", "node_id").select("doc_id", "node_id", "start", "end", "text")
        by_join = phrases.joined(nodes, names, "doc_id", "node_id", fold=fold)
        a, b = (sorted(map(repr, df.collect())) for df in (by_list, by_join))
        assert a == b and len(a) == 6000 + 4 + fold
    assert phrases.joined(nodes, names.limit(0), "doc_id", "node_id").count() == 0
    with pytest.raises(ValidationError):
        phrases.of_table("X", names, most_bytes=10)
