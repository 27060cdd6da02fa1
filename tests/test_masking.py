"""Strategies, detection, policies, masking and its inverse on small rows."""

import base64
import hashlib
import json
import re
import time

import pytest
from pyspark.sql import functions as F

from umbra import cli, errors
from umbra.engine import Engine, batch_summary, mask_pii
from umbra.functions import strategies as S
from umbra.operators import cloakmap, detect, mask, models, policy, resolve, validate
from umbra.sources import documents as D
from umbra.streaming.masking import counts_by_window, mask_stream


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).head()["x"]



def by(spark, strategy, text, kind="OTHER"):
    return one(spark, S.native(strategy, F.col("k"), F.col("t")), t=text, k=kind)


def test_redact_and_templates(spark):
    assert by(spark, S.Strategy("redact"), "añ😀 d") == "*****" and by(spark, S.Strategy("redact", {"preserve_length": False, "redact_char": "#"}), "ab") == "########"
    assert by(spark, S.Strategy("template", {"template": "{entity_type}/{length}/{original_format}"}), "a1 -", "K") == "K/4/LDSP"
    assert len(by(spark, S.Strategy("template", {"template": "id {}"}), "a")) == 11
    auto = S.AUTO_TEMPLATE
    cases = [
        ("PHONE_NUMBER", "2125550143", "XXX-XXX-XXXX"), ("PHONE_NUMBER", "212-555-0143", "XXX-XXX-XXXX"), ("PHONE_NUMBER", "(212) 555-0143", "(XXX) XXX-XXXX"), ("PHONE_NUMBER", "+49 30 1234", "+X XXXXXXXX"), ("PHONE_NUMBER", "30 12-34", "XXXXXX -"),
        ("US_SSN", "212-55-0143", "XXX-XX-XXXX"), ("US_SSN", "212550143", "XXXXXXXXX"), ("US_SSN", "212 55 0143", "XXX XX XXXX"),
        ("CREDIT_CARD", "4" * 16, "XXXX-XXXX-XXXX-XXXX"), ("CREDIT_CARD", "4444 4444 4444 4444", "XXXX XXXX XXXX XXXX"), ("CREDIT_CARD", "3782 822463 10005", "XXXX XXXXXX XXXXX"),
        ("EMAIL_ADDRESS", "bo.b@mx.site.org", "xxxx@xx.xxxx.xxx"), ("EMAIL_ADDRESS", "bo.b", "[EMAIL]"), ("OTHER", "Ab1-é", "XX#-X"), ("OTHER", "", "[REDACTED]"),
    ]
    assert [by(spark, auto, t, k) for k, t, _ in cases] == [x for *_, x in cases]
    keep = lambda t: S.Strategy("template", {"template": t, "preserve_format": True})
    assert [by(spark, keep(t), "ab1") for t in ("[X]", "<{format}>", "plain")] == ["[X:3]", "<XX#>", "plain"]


def salted(text, kind, salt="", own=None):
    return text + "|".join([salt, *([own] if own is not None else []), f"len:{len(text)}", f"type:{kind}"])


def test_hashes(spark):
    h = lambda **p: by(spark, S.Strategy("hash", p), "a-b c", "K")
    raw = salted("a-b c", "K").encode()
    for name in S.ALGORITHMS:
        whole = hashlib.new(name, raw).digest()
        assert h(algorithm=name) == whole.hex()
        assert h(algorithm=name, format_output="base64") == base64.b64encode(whole).decode()
        assert h(algorithm=name, format_output="base32") == base64.b32encode(whole).decode()
    assert h(salt="s", per_entity_salt={"K": "k", "default": "d"}) == hashlib.sha256(salted("a-b c", "K", "s", "k").encode()).hexdigest()
    assert h(per_entity_salt={"L": "l", "default": "d"}) == hashlib.sha256(salted("a-b c", "K", "", "d").encode()).hexdigest()
    digest = hashlib.sha256(raw).hexdigest()
    assert h(truncate=8, consistent_length=False, prefix="p_") == "p_" + digest[:8] and h(truncate=64) == digest
    at = int(hashlib.sha256(b"a-b csha256").hexdigest()[:7], 16) % 56
    assert h(truncate=8) == digest[at : at + 8]
    out = list(digest)
    for i, c in enumerate("a-b c"):
        if c in S.DELIMITERS:
            out[int(i / 5 * 64)] = c
    assert h(preserve_format_structure=True) == "".join(out)
    assert one(spark, S.operator_form(S.Strategy("hash", {"salt": "s", "prefix": "p", "truncate": 9}), F.lit("K"), F.col("t")), t="ab") == ("p" + hashlib.sha256(b"abs").hexdigest())[:9]


def test_partial(spark):
    p = lambda t, **q: by(spark, S.Strategy("partial", q), t)
    assert [p("12-34 567"), p("12-34 567", position="start", visible_chars=3), p("12-34 567", position="middle", visible_chars=3, mask_char="#")] == ["**-*4 567", "12-3* ***", "12-## ##7"]
    assert [p("12-3"), p("1234"), p("", visible_chars=0), p("ab", visible_chars=0), p("-- ")] == ["12-3", "1234", "", "**", "-- "]
    assert p("12-34", preserve_delimiters=False, visible_chars=3) == "**-34" and p("12-34", min_length=6) == "*****"
    plain = lambda t, **q: p(t, format_aware=False, **q)
    assert [plain("123456"), plain("12-34"), plain("1234"), plain("123", visible_chars=9), plain("12"), plain("1")] == ["**3456", "*2-34", "1**4", "1*3", "**", "*"]
    assert [plain("123456", position="middle", visible_chars=3), plain("123456", position="start"), plain("123456", visible_chars=0)] == ["12***6", "1234**", "******"]
    shown = p("abcdefgh", position="random", visible_chars=3)
    assert shown == p("abcdefgh", position="random", visible_chars=3) and shown.count("*") == 5
    assert one(spark, S.operator_form(S.Strategy("partial"), F.lit("K"), F.col("t")), t="abc") == "abc"


def test_strategies_are_checked():
    for kind, parameters in [("hash", {"algorithm": "crc"}), ("hash", {"format_output": "hexa"}), ("hash", {"truncate": 0}), ("template", {}), ("partial", {"visible_chars": -1}), ("partial", {"position": "left"}), ("partial", {"mask_char": "ab"}), ("redact", {"redact_char": ""}), ("redact", {"preserve_length": 1}), ("custom", {}), ("surrogate", {"seed": 1}), ("other", {})]:
        with pytest.raises(ValueError):
            S.Strategy(kind, parameters)
    assert S.REDACT.with_parameters(redact_char="#").get("redact_char") == "#" and S.REDACT.parameters == {}


def test_surrogates():
    fake = lambda k, t, **q: S.surrogate_of(k, t, "s", **q)
    assert fake("CARD", "4111-11 aB") == fake("CARD", "4111-11 aB") != S.surrogate_of("CARD", "4111-11 aB", "t")
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", fake("X", "2025-01-01")) and re.fullmatch(r"[A-Z][a-z]\d -", fake("X", "Qr7 -"))
    assert re.fullmatch(r"2(0|10)\d* ?-?.*", fake("PHONE_NUMBER", "415-555-0143")) and re.fullmatch(r"\(2\d\d\) \d{3}-\d{4}", fake("PHONE_NUMBER", "(415) 555-0143"))
    assert fake("PHONE_NUMBER", "+44 20 7946 0958").startswith("+1 2") and re.fullmatch(r"\d{3}\.\d{3}\.\d{4}", fake("PHONE_NUMBER", "415.555.0143"))
    assert re.fullmatch(r"[1-8]\d\d-\d\d-\d{4}", fake("US_SSN", "123-45-6789")) and re.fullmatch(r"\d{9}", fake("US_SSN", "123456789"))
    user, domain = fake("EMAIL_ADDRESS", "jo.7@mail.site.org").split("@")
    assert re.fullmatch(r"[a-z]{2}\.\d", user) and domain.split(".")[0] in S.SAFE_DOMAINS and domain.split(".")[-1] in S.SAFE_TOPS
    assert re.fullmatch(r"(\d{4}-){3}\d{4}", fake("CREDIT_CARD", "1111-2222-3333-4444")) and fake("CREDIT_CARD", "1" * 16)[:4] in S.CARD_PREFIXES
    first, middle, last = fake("PERSON", "Ana B Cruz").split()
    assert first in S.FIRST_NAMES and len(middle) == 1 and last in S.LAST_NAMES
    assert re.fullmatch(r"[A-Z]{2}-[a-z]\d[A-Za-z0-9]!", fake("X", "anything", pattern="XX-x9?!"))
    taken = {}
    made = [S.distinct_surrogate("X", str(i % 10), "s", taken) for i in range(20)]
    assert len(set(made)) == 10 and made[:10] == made[10:]


def test_fallbacks_and_order(spark):
    assert [s.kind for s in S.fallback_chain(S.Strategy("surrogate"), "K")] == ["hash", "template", "redact", "redact"]
    assert [s.kind for s in S.fallback_chain(S.PARTIAL, "K")] == ["redact", "template"]
    assert one(spark, S.with_fallback(F.lit(None).cast("string"), S.HASH, "K", F.lit("K"), F.col("t")), t="ab") == "[K]"
    some = [S.REDACT, S.HASH, S.PARTIAL, S.AUTO_TEMPLATE, S.Strategy("surrogate")]
    assert [s.kind for s in S.prioritised("EMAIL_ADDRESS", 0.95, some)][:2] == ["surrogate", "hash"] and S.prioritised("US_SSN", 0.95, some)[0].kind == "redact"
    out = one(spark, S.custom(lambda original_text, entity_type, confidence: 1 / 0)(F.col("k"), F.col("t"), F.col("c")), t="abc", k="X", c=0.5)
    assert out == "***"


TEXTS = [(1, "#/0", "\U0001f600 mail a.b@c.org, call 555-123-4567 or 10.0.0.1 é"), (2, "#/0", "none here"), (3, "#/0", None), (4, "#/0", ""), (5, "#/0", "a@b.co" * 2 + " 4111111111111111 4111111111111112 999.1.1.1")]


def test_spans_are_code_points_and_mask_is_inverted(spark):
    nodes = spark.createDataFrame(TEXTS, "doc_id long, node_id string, text string")
    for preset in [*policy.PRESETS.values(), policy.Policy(S.Strategy("surrogate")), policy.Policy(S.Strategy("custom", {"callback": lambda original_text, entity_type, confidence: original_text[::-1]}))]:
        done, anchors = Engine().with_policy(preset).mask(nodes)
        for r in done.select("text", "spans").collect():
            assert all(r.text[s.start : s.end] == s.text for s in r.spans)
        back = Engine().unmask(done.select("doc_id", "node_id", "text", "masked_text"), anchors)
        assert all(r.restored_text == r.text for r in back.collect())
        assert cloakmap.verified(anchors).filter("not ok").count() == 0
        assert cloakmap.faults(anchors).count() == 0 and cloakmap.overlaps(anchors).count() == 0
    types = {(r.doc_id, r.entity_type) for r in detect.entities(detect.detect(nodes), "doc_id").collect()}
    assert types == {(1, "EMAIL_ADDRESS"), (1, "PHONE_NUMBER"), (1, "IP_ADDRESS"), (5, "EMAIL_ADDRESS"), (5, "CREDIT_CARD")}


def test_anchors_are_found_after_an_edit(spark):
    nodes = spark.createDataFrame(TEXTS[:1], "doc_id long, node_id string, text string")
    done, anchors = Engine().mask(nodes)
    edited = done.withColumn("masked_text", F.concat(F.lit("new "), "masked_text"))
    rows = mask.resolve_anchors(edited, anchors).collect()
    assert rows and all(r.delta == 4 and r.found_confidence == pytest.approx(0.96) for r in rows)
    gone = mask.resolve_anchors(done.withColumn("masked_text", F.lit("")), anchors).collect()
    assert {r.reason for r in gone} == {"value not found"}


def test_overlaps(spark):
    spans = [("A", 0, 5, 0.9, "x"), ("B", 0, 9, 0.9, "x"), ("C", 8, 12, 0.95, "x"), ("D", 20, 21, 0.1, "x")]
    rows = spark.createDataFrame([(spans,)], f"spans array<{detect.SPAN}>")
    names = lambda f: [s.entity_type for s in rows.select(f(F.col("spans")).alias("s")).head().s]
    assert names(resolve.greedy) == ["B", "D"]
    assert names(resolve.score_first) == ["A", "C", "D"]
    assert names(resolve.longest_first) == ["B", "D"]


def test_policy_order_and_files(spark, tmp_path):
    p = policy.Policy(thresholds={"X": 0.8}, allow=frozenset({"ok"}), deny=frozenset({"no"}), min_length=2, contexts={"table": policy.Rule(enabled=False)})
    rows = spark.createDataFrame([(("X", 0, 1, c, t), ctx) for c, t, ctx in [(0.1, "no", "table"), (0.9, "ok", "paragraph"), (0.9, "a", "paragraph"), (0.7, "abc", "paragraph"), (0.9, "abc", "table"), (0.9, "abc", "paragraph")]], "s struct<entity_type:string,start:int,end:int,confidence:double,text:string>, c string")
    assert [r.m for r in rows.select(p.masks(F.col("s"), F.col("c")).alias("m")).collect()] == [True, False, False, False, False, True]
    (tmp_path / "base.yaml").write_text("thresholds: {X: 0.4, Y: 0.6}\nallow_list: [a]\n")
    (tmp_path / "own.yaml").write_text("extends: base.yaml\nthresholds: {X: 0.9}\nallow_list: [b]\ndefault_strategy: {kind: hash}\n")
    got = policy.load(str(tmp_path / "own.yaml"))
    assert got.thresholds == {"X": 0.9, "Y": 0.6} and got.allow == {"a", "b"} and got.default.kind == "hash" and policy.problems(str(tmp_path / "own.yaml")) == []
    assert policy.Policy.from_dict(got.to_dict()).to_json() == got.to_json()
    (tmp_path / "strict.yaml").write_text("extends: own.yaml\nlocale: de\nthresholds: {Z: 0.1}\nallow_list: [c]\npolicy_composition: {merge_strategy: strict}\n")
    strict = policy.load(str(tmp_path / "strict.yaml"))
    assert strict.thresholds == {"Z": 0.1} and strict.allow == {"c"} and strict.locale == "en" and strict.default.kind == "hash"
    (tmp_path / "bad.yaml").write_text("thresholds: {X: 3}\n")
    assert policy.problems(str(tmp_path / "bad.yaml")) and policy.problems(str(tmp_path / "none.yaml"))
    (tmp_path / "loop.yaml").write_text("extends: loop.yaml\n")
    with pytest.raises(ValueError):
        policy.load(str(tmp_path / "loop.yaml"))


def test_document_nodes(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"texts": [{"self_ref": "#/texts/0", "label": "title", "text": "Hi"}, {"self_ref": "#/texts/1", "label": "text", "text": " "}], "tables": [{"self_ref": "#/tables/0", "data": {"num_rows": 1, "num_cols": 2, "table_cells": [{"text": "a"}, {"text": "b"}]}}], "key_value_items": [{"self_ref": "#/kv/0", "key": {"text": "k"}, "value": {"text": "v"}}]}')
    rows = D.nodes(D.read_json(spark, str(tmp_path / "d.json"))).orderBy("ordinal").collect()
    assert [(r.node_id, r.text, r.start_offset) for r in rows] == [("#/texts/0", "Hi", 0), ("#/tables/0/cell_0_0", "a", 4), ("#/tables/0/cell_0_1", "b", 7), ("#/kv/0/key", "k", 10), ("#/kv/0/value", "v", 13)]


def test_policies_keep_all_they_say():
    rule = policy.Rule(None, S.PARTIAL, 0.4, {"X": S.HASH}, {"Y": 0.9})
    p = policy.Policy(S.HASH, {"X": S.REDACT}, {"X": 0.7}, frozenset({"a"}), frozenset({"b"}), {"table": rule, "list": policy.Rule(enabled=False)}, 3, 0.2, "de-AT", "seed", privacy_level="high")
    assert policy.Policy.from_dict(p.to_dict()) == p
    assert p.strategy("X", "table").kind == "hash" and p.strategy("Z", "table").kind == "partial" and p.strategy("X").kind == "redact" and p.strategy("Z", "list") == S.REDACT_FIXED
    for bad in ({"thresholds": {"X": 2}}, {"locale": "english"}, {"min_length": -1}, {"privacy_level": "some"}, {"contexts": {"hall": policy.Rule()}}, {"callbacks": {"X": lambda text: text}}):
        with pytest.raises(ValueError):
            policy.Policy(**bad)
    with pytest.raises(ValueError):
        policy.preset("none")
    with pytest.raises(ValueError):
        policy.Policy.from_dict({"context_rules": {"table": {"on": True}}})


def test_surrogates_of_a_row_differ_and_repeat(spark):
    text = " ".join(f"u{i % 12}@site.org" for i in range(24))
    nodes = spark.createDataFrame([(1, "#/0", text)], "doc_id long, node_id string, text string")
    row = Engine(policy.Policy(S.Strategy("surrogate"), seed="x")).mask(nodes)[0].head()
    fakes = {}
    for s in row.spans:
        fakes.setdefault(s.text, set()).add(s.replacement)
    assert len(fakes) == 12 and all(len(f) == 1 for f in fakes.values()) and len(set.union(*fakes.values())) == 12


def test_forms_of_cards_and_phones(spark):
    found = ["4111-1111-1111-1111", "4111 1111 1111 1111", "378282246310005", "3782 822463 10005", "4222222222222", "+44 20 7946 0958", "555.123.4567", "5551234567", "(555) 123-4567", "+1 555-123-4567", "555 123 4567"]
    not_found = ["41111111111111110000000", "1.2.3", "12-34-56", "555.12.4567"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(found + not_found)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in detect.entities(detect.detect(rows, [r for r in detect.RECOGNIZERS if r.entity_type in ("CREDIT_CARD", "PHONE_NUMBER")]), "doc_id").collect()}
    assert got == dict(enumerate(found))


def test_detection_of_long_runs_is_linear(spark):
    long = ["a" * 300_000, "a@" * 150_000, "a@b" + ".c" * 100_000, "1" * 300_000, "1-" * 150_000, "(" * 300_000, "a.b_c%" * 50_000 + "@"]
    rows = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    began = time.time()
    assert detect.detect(rows).selectExpr("sum(size(spans)) as n").head().n is not None
    assert time.time() - began < 60


def test_marks_in_a_text_do_no_harm(spark):
    rows = spark.createDataFrame([("\uffffa@b.co\uffff x \uffff",)], "text string")
    assert [(s.start, s.end, s.text) for s in detect.detect(rows).head().spans] == [(1, 7, "a@b.co")]


def test_analyzers(spark):
    names = detect.phrases("PERSON", ["Ann Lee", "Ann"])
    own = detect.Analyzer(threshold=0.6).add(names).add(detect.FunctionRecognizer("LOCATION", lambda text: 1 / 0)).enable("US_PASSPORT").disable("URL")
    rows = spark.createDataFrame([(1, "Ann Lee and Ann at a@b.co http://x.y A12345678"), (2, None), (3, "x")], "doc_id long, text string")
    got = {(r.entity_type, r.text) for r in detect.entities(own.detect(rows), "doc_id").collect()}
    assert got == {("PERSON", "Ann Lee"), ("PERSON", "Ann"), ("EMAIL_ADDRESS", "a@b.co"), ("US_PASSPORT", "A12345678")}
    assert {s.entity_type for s in own.detect(rows, types=("EMAIL_ADDRESS",), threshold=0.1).head().spans} == {"EMAIL_ADDRESS"}
    assert own.diagnostics(spark)["works"] and "URL" not in own.supported()
    with pytest.raises(ValueError):
        own.detect(rows, language="fi")
    assert detect.analyzer("high_precision").threshold == 0.85 and detect.from_policy(policy.MIXED_STRATEGY_POLICY).threshold == 0.7
    done = detect.analyze_segments(rows, own)
    assert [r.error for r in done.collect()] == [None] * 3
    assert validate.stop_on_failures(done) == 0
    with pytest.raises(errors.TooManyFailures):
        validate.stop_on_failures(done.withColumn("error", F.lit("bad")))
    spans = detect.entities(detect.Analyzer(recognizers=(detect.TITLED_PERSON,)).detect(spark.createDataFrame([("Dr. Ada Byron met Mr Poe",)], "text string"))).collect()
    assert [s.text for s in spans] == ["Dr. Ada Byron", "Mr Poe"]


def test_conflicts_may_be_refused(spark):
    rows = spark.createDataFrame([([("A", 0, 5, 0.9, "x"), ("B", 5, 9, 0.9, "x")],), ([("A", 0, 5, 0.9, "x"), ("B", 4, 9, 0.9, "x")],)], f"spans array<{detect.SPAN}>")
    assert [r.c for r in rows.select(resolve.conflicting(F.col("spans")).alias("c")).collect()] == [False, True]
    with pytest.raises(Exception, match="overlap"):
        resolve.rejecting(rows).collect()
    flat = spark.createDataFrame([(1, "A", 0, 9, 0.96, "x"), (1, "B", 3, 20, 0.5, "y"), (1, "A", 22, 25, 0.4, "z")], "doc_id long, entity_type string, start int, end int, confidence double, text string")
    for how in (*resolve.RESOLVERS, "highest_confidence", "merge_adjacent"):
        out, counts = resolve.normalised(flat, "doc_id", how=how)
        c = counts.head()
        assert (c.entities, c.groups, c.conflicts, c.kept) == (3, 1, 1, out.count())
    lost = resolve.normalisation_faults(flat, flat.filter("start = 3"), "doc_id").collect()
    assert [(r.start, r.fault) for r in lost] == [(0, "lost")]


def test_restoring_after_edits(spark):
    nodes = spark.createDataFrame([(1, "#/0", "from a@b.co to c@d.org, " + "x" * 300 + " 10.0.0.1"), (2, "#/0", "only 10.0.0.2")], "doc_id long, node_id string, text string")
    done, anchors = Engine().mask(nodes)
    edited = done.withColumn("masked_text", F.when(F.col("doc_id") == 1, F.concat(F.lit("PS. "), F.regexp_replace("masked_text", " to ", " or "))).otherwise(F.lit("gone")))
    restored, found = mask.restore(edited, anchors)
    texts = {r.doc_id: r.restored_text for r in restored.collect()}
    assert texts[1] == "PS. from a@b.co or c@d.org, " + "x" * 300 + " 10.0.0.1" and texts[2] == "gone"
    r = mask.restoration_statistics(found).head()
    assert (r.anchors, r.restored, r.verified, r.no_value) == (4, 3, 3, 1)
    assert {x.doc_id: (x.valid, x.failed) for x in mask.integrity(found, "doc_id").collect()} == {1: (True, 0), 2: (False, 1)}
    vault = anchors.select("replacement_id", F.lit("V").alias("original"))
    blind = anchors.withColumn("original_text", F.lit(None).cast("string"))
    assert mask.unmask(done, blind, vault).filter("doc_id = 2").head().restored_text == "only V"
    assert mask.unmask(done, blind).filter("doc_id = 2").head().restored_text == "only [IP_ADDRESS]"
    assert mask.unmask(done, anchors.limit(0)).filter("restored_text != masked_text").count() == 0


def test_runs_of_asterisks_are_found_whole(spark):
    anchors = spark.createDataFrame([(1, "n", 0, 3, "***", "X")], "doc_id long, node_id string, start int, end int, masked_value string, entity_type string")
    texts = spark.createDataFrame([(1, "n", "a ***** b *** c")], "doc_id long, node_id string, masked_text string")
    assert mask.resolve_anchors(texts, anchors).head().found == 10


def test_many_spans_are_spliced_in_linear_time(spark):
    text = ("x" * 89 + " a@b.co ") * 1000
    done, anchors = Engine().mask(spark.createDataFrame([(1, "n", text)], "doc_id long, node_id string, text string"))
    began = time.time()
    row = done.head()
    assert len(row.spans) == 1000 and row.masked_text == text.replace("a@b.co", "[EMAIL]") and time.time() - began < 20
    assert mask.unmask_rows(done).head().restored_text == text


def test_clamping(spark):
    rows = spark.createDataFrame([("one\n\ntwo\n\n  \n\nlast", [("A", 0, 9, 1.0, ""), ("B", 4, 6, 1.0, ""), ("C", 5, 30, 1.0, ""), ("D", 10, 12, 1.0, "")], [(0, 3), (5, 8), (10, 12), (14, 18)])], f"text string, spans array<{detect.SPAN}>, segments array<struct<start:int,end:int>>")
    got = rows.select(mask.clamped(F.col("spans"), F.col("text"), F.col("segments")).alias("s")).head().s
    assert [(s.entity_type, s.start, s.end, s.text) for s in got] == [("A", 0, 3, "one"), ("C", 5, 8, "two")]
    kept = rows.select(detect.inside(F.col("spans"), F.col("text"), strict=True).alias("s")).head().s
    assert [s.entity_type for s in kept] == ["A", "B", "D"]


DOCUMENT = '{"schema_name": "D", "version": "1", "name": "n", "texts": [{"self_ref": "#/texts/0", "label": "title", "text": "Mail a@b.co", "orig": "Mail a@b.co"}, {"label": "text", "text": "loose <x>"}], "tables": [{"self_ref": "#/tables/0", "data": {"num_rows": 1, "num_cols": 2, "table_cells": [{"text": "c@d.org"}, {"text": "b"}], "grid": [[{"text": "c@d.org"}, {"text": "b"}]]}}], "key_value_items": [{"self_ref": "#/kv/0", "key": {"text": "ip"}, "value": {"text": "10.0.0.1"}}]}'


def test_documents_there_and_back(spark, tmp_path):
    (tmp_path / "d.json").write_text(DOCUMENT)
    (tmp_path / "bad.json").write_text("{")
    docs = D.read_json(spark, str(tmp_path))
    said = {r.doc_id.rsplit("/", 1)[1]: (r.error, r.warnings) for r in D.structure(docs).collect()}
    assert said == {"d.json": (None, ["texts without a reference"]), "bad.json": ("not JSON", ["no name", "no text"])}
    row = D.processing_statistics(docs).head()
    assert (row.files, row.documents, row.errors, row.texts, row.tables) == (2, 1, 1, 2, 1)
    good = docs.filter("_corrupt_record is null")
    nodes = D.nodes(good)
    assert {r.node_id for r in nodes.collect() if r.text == "loose <x>"}.pop().startswith("#Text_")
    done, maps = Engine().mask_documents(good)
    d = done.head()
    assert d.texts[0].text == d.texts[0].orig == "Mail [EMAIL]" and d.texts[1].text == "loose <x>"
    assert d.tables[0].data.grid[0][0].text == d.tables[0].data.table_cells[0].text == "[EMAIL]" and d.key_value_items[0].value.text == "[IP]"
    back, found = Engine().unmask_documents(done, maps)
    assert found.filter("found is null").count() == 0
    assert [r.text for r in D.nodes(back).orderBy("ordinal").collect()] == [r.text for r in nodes.orderBy("ordinal").collect()]
    texts = {f: D.render(done, f).head().text for f in D.FORMATS}
    assert json.loads(texts["json"])["texts"][0]["text"] == "Mail [EMAIL]" and texts["markdown"].startswith("# Mail [EMAIL]\n\nloose")
    assert "<h1>Mail [EMAIL]</h1>" in texts["html"] and "loose &lt;x&gt;" in texts["xml"] and texts["text"].count("\n\n") == 5
    assert D.convert(spark, str(tmp_path / "d.json"), "text", str(tmp_path / "out")) == 1
    with pytest.raises(ValueError):
        D.render(done, "odt")
    assert D.metadata(good).filter("node_id = '#/texts/0'").head().metadata == {"item_type": "title"}
    assert D.node_text(nodes, "#/tables/0").head().text == "c@d.org b"


def test_maps(spark, tmp_path):
    nodes = spark.createDataFrame([("1", "#/0", "a@b.co 10.0.0.1"), ("2", "#/0", "none")], "doc_id string, node_id string, text string")
    done, anchors = Engine().mask(nodes)
    maps = cloakmap.build(anchors, nodes, policy.DEFAULT, "1.0", "2026-01-01T00:00:00Z")
    cloakmap.save(maps, str(tmp_path / "maps"))
    back = cloakmap.load(spark, str(tmp_path / "maps"))
    assert back.count() == 2 and {r.doc_id: len(r.anchors) for r in back.collect()} == {"1": 2, "2": 0}
    two = cloakmap.migrated(back)
    assert {(r.doc_id, r.version, r.operator_metadata is not None) for r in two.collect()} == {("1", "2.0", True), ("2", "2.0", False)}
    assert {r.doc_id: r.same for r in cloakmap.hash_verified(back, nodes).collect()} == {"1": True, "2": True}
    assert {r.doc_id: (r.errors, r.warnings) for r in cloakmap.validated(back).collect()} == {"1": ([], []), "2": ([], ["nothing was masked"])}
    assert len(cloakmap.id_to_mask(back).filter("doc_id = '1'").head().masks) == 2
    assert cloakmap.touching(cloakmap.anchors_of(back), "#/0", 0, 3).count() == 1
    merged, wrong = cloakmap.merge(back.unionByName(back))
    assert merged.count() == 2 and wrong.count() == 0
    shifted = back.withColumn("anchors", F.transform("anchors", lambda a: a.withField("start", a["start"] + 1)))
    assert cloakmap.merge(back.unionByName(shifted))[1].head().errors == ["ids repeat", "anchors overlap"]
    bad = ["", "{", '{"version": "9", "doc_id": "d", "doc_hash": "h", "anchors": []}', '{"version": "1.0"}', '{"version": "1.0", "doc_id": "d", "doc_hash": "h", "anchors": [], "encrypted_content": "x"}']
    rows = cloakmap.loaded(spark.createDataFrame([(b,) for b in bad], "value string"), strict=False).collect()
    assert [r.error for r in rows] == ["empty", "not JSON of a map", "unknown version 9", "missing: doc_id, doc_hash, anchors", "encrypted maps are not supported"]
    with pytest.raises(Exception, match="no map"):
        cloakmap.loaded(spark.createDataFrame([(bad[2],)], "value string")).collect()
    (tmp_path / "one.json").write_text(bad[2])
    report = cloakmap.file_report(spark, str(tmp_path / "one.json")).head()
    assert (report.valid, report.version, report.anchors) == (False, "9", 0)


def test_command_line(spark, tmp_path, capsys):
    source = tmp_path / "d.json"
    source.write_text(DOCUMENT)
    assert cli.main(["mask", str(source)]) == 0
    masked = json.loads((tmp_path / "d.masked.json").read_text())
    assert masked["texts"][0]["text"] == "Mail [EMAIL]"
    assert cli.main(["unmask", str(tmp_path / "d.masked.json"), str(tmp_path / "d.cloakmap.json"), "-o", str(tmp_path / "r.json")]) == 0
    assert json.loads((tmp_path / "r.json").read_text())["tables"][0]["data"]["grid"][0][0]["text"] == "c@d.org"
    assert cli.main(["mask", str(tmp_path / "none.json")]) == 2 and cli.main(["version"]) == 0
    assert "umbra:" in capsys.readouterr().err


def test_stream(spark, tmp_path):
    schema = "doc_id long, node_id string, text string, ts timestamp"
    rows = spark.createDataFrame([(i, "#/0", f"u{i}@site.org") for i in range(10)], "doc_id long, node_id string, text string").withColumn("ts", F.timestamp_seconds(F.col("doc_id") * 300))
    rows.write.parquet(str(tmp_path / "in"))
    to = {n: str(tmp_path / n) for n in ("nodes", "anchors", "check")}
    mask_stream(spark, str(tmp_path / "in"), schema, to["nodes"], to["anchors"], to["check"]).awaitTermination()
    assert {r.masked_text for r in spark.read.parquet(to["nodes"]).collect()} == {"[EMAIL]"} and spark.read.parquet(to["anchors"]).count() == 10
    stream = detect.detect(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    counts_by_window(stream).writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("seen").collect()) == [2] * 5


def test_facade_and_models(spark):
    df = spark.createDataFrame([(1, "a@b.co", 5)], "doc_id long, text string, spans int")
    assert df.select("doc_id", "text").transform(mask_pii()).head().text == "[EMAIL]"
    cloaked = Engine().with_policy("hash").with_types("EMAIL_ADDRESS").with_threshold(0.9).with_resolution("longest").cloak(spark.createDataFrame([(1, "n", "a@b.co 10.0.0.1")], "doc_id long, node_id string, text string"))
    assert cloaked.unmasked().head().restored_text == "a@b.co 10.0.0.1" and cloaked.statistics().head().n == 1
    assert models.model("de-AT", "large") == "de_core_news_lg" and models.recommended(60).name == "medium" and models.recommended(1).name == models.recommended(fast=True).name == "small"
    with pytest.raises(ValueError):
        Engine().with_resolution("best")
    with pytest.raises(ValueError):
        validate.columns(df, doc_id="string")
    assert validate.policy_faults({"thresholds": {"X": 3}, "allow_list": "a"}) == ["allow_list is no list", "the threshold of X is outside 0 to 1"]


def test_other_files_and_settings(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one a@b.co\r\n\r\ntwo")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    docs = D.read_with(spark, str(tmp_path), D.plain_text, "*.txt")
    assert {r.doc_id.rsplit("/", 1)[1]: (r._corrupt_record or "")[:18] for r in docs.collect()} == {"a.txt": "", "b.txt": "UnicodeDecodeError"}
    assert [r.text for r in D.nodes(docs).orderBy("ordinal").collect()] == ["one a@b.co", "two"]
    (tmp_path / "a.yaml").write_text("language: de\nconfidence_threshold: 0.8\nenabled: [EMAIL_ADDRESS, TICKET, MEDICAL_LICENSE]\nrecognizers: [{name: TICKET, pattern: 'T-[0-9]+', score: 0.9}]\n")
    own = detect.load_config(str(tmp_path / "a.yaml"), {"UMBRA_CONFIDENCE": "0.85"})
    assert own.threshold == 0.85 and own.language == "de" and own.supported() == ["EMAIL_ADDRESS", "MEDICAL_LICENSE", "TICKET"]
    rows = spark.createDataFrame([(1, "n", "T-12 a@b.co 10.0.0.1"), (2, "n", "x")], "doc_id long, node_id string, text string")
    done, anchors = Engine(analyzer=own).mask(rows)
    said = batch_summary(done, anchors).head()
    assert (said.documents, said.nodes, said.masked_nodes, said.masks, said.types) == (2, 2, 1, 2, ["EMAIL_ADDRESS", "TICKET"])
