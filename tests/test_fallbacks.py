"""What stands in where a strategy fails on some rows."""

from pyspark.sql import functions as F

from umbra.functions import strategies as S
from umbra.operators import detect, mask, policy


def failing(original_text: str, entity_type: str, confidence: float):
    if "b" in original_text:
        raise ValueError
    return "" if "c" in original_text else f"<{original_text[0]}>"


def test_custom_with_and_without_fallbacks(spark):
    nodes = spark.createDataFrame([(1, "#/0", "a@x.org b@x.org c@x.org"), (2, "#/0", None)], "doc_id long, node_id string, text string")
    own = policy.Policy(S.Strategy("custom", {"callback": failing}))
    text = lambda p: mask.mask(nodes, p, [detect.EMAIL]).filter("doc_id = 1").head().masked_text
    assert text(own) == "<a> ******* *******"
    assert text(policy.replace(own, fallbacks=True)) == "<a> [EMAIL_ADDRESS] [EMAIL_ADDRESS]"


def test_what_stands_in(spark):
    row = spark.createDataFrame([("K", "ab1"), ("K", "")], "k string, t string")
    stands = lambda s: [r.x for r in row.select(S.fallback(s, F.col("k"), F.col("t")).alias("x")).collect()]
    assert stands(S.PARTIAL) == ["***", "[K]"] and stands(S.Strategy("custom", {"callback": failing})) == ["[K]", "[K]"]
    assert [len(x) for x in stands(S.Strategy("surrogate"))] == [8, 8]
    assert [s.kind for s in S.fallback_chain(S.Strategy("surrogate"), "K")] == ["hash", "template", "redact", "redact"]
