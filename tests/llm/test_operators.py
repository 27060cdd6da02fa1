"""Each operator on small tables against brute force, with nulls, empty and repeated rows and clashing columns."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from umbra.llm import jaccard_join, lm_scoring, media, mixing, packing, pii, topk, toxicity, url_filters
from umbra.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, size int, _h int"
LONG = " ".join(f"w{i} common words here" for i in range(3000))
ROWS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "a"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "b"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "b"), (3, None, None), (4, "", "a"), (5, LONG, "a"), (6, LONG + " end", "b"), (7, "mail x.y@z.org or +1 (555) 555-1234 at 10.0.0.1", "c"), (None, "one two", "c"), (8, " \t\n ", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", s, 1, 2) for i, t, s in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_packing(spark, docs, none):
    rows = packing.pack(docs, tokenizer_path()).collect()
    by_bin = collections.defaultdict(list)
    for r in rows:
        by_bin[r.sequence_id].append(r)
    for pieces in by_bin.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        assert sum(r.length for r in pieces) <= 2048
    assert sum(r.piece == 0 for r in rows) == len(ROWS)
    assert packing.pack(none, tokenizer_path()).count() == 0
    bins, _ = packing.best_fit(np.array([5, 5, 4, 3, 3]), 10, 2, 50)
    assert bins[0] == bins[1]


def test_words_of_letters_by_the_model():
    from tokenizers import Tokenizer

    whole, ids = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path())
    assert packing.letter_model(whole) is not None
    for text in ["Élan's l'été DON'T it's O'Neil", "ﬁn İstanbul Σίσυφος", "Straße!! ÇA$$$ ÿ×÷ªº", "12ab ab12 a.b don't.", "e\u0301 a\tb\r\nc", "日本語 👍🏽 <|endoftext|>", "", "\n"]:
        assert ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_lm_scoring(spark, docs, none):
    got = lm_scoring.score(docs, block_bytes=2000).collect()
    token = lambda t: re.findall("[^\x20\x09-\x0d]+", (t or "").lower()) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, t, _ in ROWS if not held(i) for w in token(t))
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter((i, len(token(t)), sum(w in counts for w in token(t)), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in token(t)), 5)) for i, t, _ in ROWS)
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert all(r.train_tokens == n and r.held_out == held(r.doc_id) and r.score < 0 for r in got)
    assert lm_scoring.score(none).count() == 0


def test_mixing(spark, docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5
        assert all(sum(d.words for d in r.draws) == r.taken for r in own)
    assert sorted(map(str, mixing.mix(docs.repartition(3)).collect())) == sorted(map(str, rows))
    assert mixing.mix(none).count() == 0


def test_jaccard_join(spark, none):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(rng.choice(words, rng.integers(0, 40)))) for i in range(150)]
    for i in range(150, 400):
        t = texts[int(rng.integers(0, 150))][1].split()
        for _ in range(int(rng.integers(0, 3))):
            if t:
                t[int(rng.integers(0, len(t)))] = str(rng.choice(words))
        texts.append((i, " ".join(t)))
    texts += [(400, None), (None, "a b c"), (401, "a b c"), (402, "A b C"), (402, "A b C")]
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = [i for i in sets if i is not None]
    label = {i: i for i in ids}
    for _ in range(40):
        for i in ids:
            for j in ids:
                if i < j and sets[i] and sets[j] and label[i] != label[j]:
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                        low, high = sorted((label[i], label[j]))
                        label = {k: low if v == high else v for k, v in label.items()}
        break
    got = jaccard_join.join(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    assert all(r.component_id == label.get(r.doc_id) and r.n_shingles == len(sets[r.doc_id]) for r in got)
    assert jaccard_join.join(none).count() == 0


def test_pii_base_and_added(spark, docs, none):
    found = {r.doc_id: r for r in pii.digest(pii.find(docs)).collect()}
    assert found[7].spans.split(",")[0].startswith("email:5:14") and (found[7].n_email, found[7].n_ip, found[7].n_phone) == (1, 1, 1)
    seeds = [(i, f"my desk number is +1 555 010 {1000 + i} thanks", "s") for i in range(5)]
    rows = [*seeds, (9, "my mail is a@b.co thanks", "s")]
    mails = [(20 + i, f"write user{i}@site{i}.org today", "s") for i in range(5)] + [(30, "write user77@intranet today", "s")]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(spark.createDataFrame([(i, t, "en", s, 1, 2) for i, t, s in rows + mails * 2], DOCS), min_confidence=0.8)).collect()}
    assert got[20] == "email:6:21"
    assert pii.find(none).count() == 0


def test_pii_adds_unseen_identifiers_in_the_context_of_seeds(spark):
    seeds = [f"write user{i}@site{i}.org today" for i in range(9)] + [f"my desk number is +1 ({200 + i}) 555-{1000 + 37 * i} thanks" for i in range(30)]
    planted = {"write user77@intranet today": ["email:6:21"], "my desk number is 555-7713 thanks": ["phone:18:26"], "my desk number is 5557713 thanks": ["phone:18:25"], "my desk number is (017) 555 77 13 thanks": ["phone:18:33"]}
    clean = ["write 5 today", "room 555-7713 is free", "my desk number is A5 thanks", "", None]
    texts = [*seeds, *planted, *clean]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert {t: got[texts.index(t)].split(",") for t in planted} == planted
    assert all(got[texts.index(t)] == "" for t in clean)
    assert all(got[i].count(":") == 2 for i in range(len(seeds)))


def test_media_round_trip(spark, docs, none):
    rows = media.media_columns(docs).collect()
    assert len(rows) == len(ROWS)
    texts = {i: t for i, t, _ in ROWS}
    for r in rows:
        payload, n = media.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (n, len(payload), zlib.crc32(payload[-64:]))
    assert b"".join(media.chunks_of(media.media_of(payload))) == media.media_of(payload)
    assert media.media_columns(none).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(301, None), (None, [0.0] * 8), (302, [float("nan")] * 8), (303, rows_value := [1.0] * 8), (304, rows_value)]
    got = collections.defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=32).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ok = [(i, np.floor(256 * np.array(v))) for i, v in rows if i is not None and v is not None and not any(map(math.isnan, v))]
    for q, v in ok:
        if q % 50 == 0:
            best = sorted(((-int(v @ x), i) for i, x in ok if i != q))[:5]
            assert got.pop(q) == [(i, -s) for s, i in best]
    assert not got


def test_url_filters(spark):
    urls = ["http://a.com/x", "https://b.example.com/en/1", "http://www.example.com/en/2", "http://x.net/es/", "http://x.net/de/1", "http://q.org/a?b", None, "none", "HTTP://UP.NET/fr/?x#y"] * 3
    rows = {r.url: r for r in url_filters.filter_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")).collect()}
    assert [(rows[u].rule, rows[u].verdict) for u in urls[:4]] == [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block")]
    assert (rows["none"].host, rows["none"].path, rows[None].host) == ("", "", "") and rows["HTTP://UP.NET/fr/?x#y"].rule == "net/fr/"
    assert all(r.verdict in ("allow", "block") for r in rows.values())
    assert url_filters.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_toxicity_learns_words(spark, none):
    rng = np.random.default_rng(5)
    clean = [f"{a}{b}" for a in ("ther", "ondo", "lari", "meso", "kati") for b in ("ng", "tion", "ble", "st", "ous")]
    text = lambda bad: " ".join([*rng.choice(clean, 30), *(["grumblefoul"] if bad else [])])
    rows = [(i, text(i % 4 == 0), "en", "s", 1, 2) for i in range(400)] + [(None, None, "en", "s", 1, 2)]
    table = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.classify(table, labels).collect()
    assert len(got) == len(rows) and all((r.predicted == 1) == (r.doc_id is not None and r.doc_id % 4 == 0) for r in got)
    assert toxicity.classify(none, labels).count() == 0


def test_toxicity_learns_passages_of_ordinary_words_and_rare_words(spark):
    rng = np.random.default_rng(6)
    clean = [f"{a}{b}" for a in ("ther", "ondo", "lari", "meso", "kati", "velu") for b in ("ng", "tion", "ble", "st", "ous")]
    phrase = ["therng", "ondotion", "larible"]
    rare = [f"{a}{b}{c}" for a in "bdgkp" for b in ("unk", "arg", "esh", "olv") for c in ("ix", "uf", "ey")]  # each in 2 % of the toxic documents or less
    split = lambda w: [x for i, x in enumerate(w) if w[i - 1 : i + 1] not in (phrase[:2], phrase[1:])]
    for least_recall, bad in ((0.95, lambda i: phrase), (0.8, lambda i: [rare[i // 4 % len(rare)]])):
        text = lambda i: " ".join([*split([str(w) for w in rng.choice(clean, 20)]), *(bad(i) if i % 4 == 0 else ["mesost", *rng.permutation(phrase)[:1]]), "katious"])  # noqa: E731, B023
        rows = [(i, text(i)) for i in range(1600)]
        labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1600)], "doc_id long, toxic int")
        got = toxicity.classify(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
        held = [r for r in got if r.held_out]
        assert sum(r.predicted for r in held if r.doc_id % 4 == 0) >= least_recall * sum(r.doc_id % 4 == 0 for r in held)
        assert sum(r.predicted for r in held if r.doc_id % 4) <= 0.03 * len(held)
