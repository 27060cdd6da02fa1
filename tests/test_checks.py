"""Checksums of account numbers and addresses: planted true ones, and every single wrong character."""

import random

import pytest
from pyspark.sql import functions as F

from umbra.functions import checks
from umbra.operators import detect

IBANS = ["GB82WEST12345698765432", "DE89370400440532013000", "FR1420041010050500013M02606", "NO9386011117947"]
ADDRESSES = ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "1111111111111111111114oLvT2", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", "bc1p5cyxnuxmeuwuvkwfem96lqzszd02n6xdcjrs20cac6yqjjwudpxqkedrcr"]


@pytest.mark.parametrize(("check", "true", "alphabet"), [(checks.iban, IBANS, "0123456789"), (checks.crypto, ADDRESSES[:3], checks.BASE58), (checks.crypto, ADDRESSES[3:], checks.BECH32)])
def test_true_ones_and_single_errors(spark, check, true, alphabet):
    rng = random.Random(2)
    wrong = set()
    for t in true:
        for i in range(4, len(t)):
            if t[i] in alphabet:
                wrong.add(t[:i] + rng.choice([c for c in alphabet if c != t[i]]) + t[i + 1 :])
    rows = spark.createDataFrame([(t,) for t in [*true, *sorted(wrong)]], "t string").select("t", check(F.col("t")).alias("ok")).collect()
    assert {r.t for r in rows if r.ok} == set(true)


def test_lengths_and_other_characters(spark):
    rows = spark.createDataFrame([("GB82",), ("",), ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfN0",), ("bc1b",), ("z" * 60,)], "t string")
    assert not any(any(r) for r in rows.select(checks.iban(F.col("t")), checks.crypto(F.col("t"))).collect())


def test_recognizers(spark):
    text = f"to {IBANS[1]} or DE89370400440532013001, {ADDRESSES[0]} {ADDRESSES[3]} {ADDRESSES[5]} {ADDRESSES[0][:-1]}b"
    own = detect.Analyzer().enable("CRYPTO")
    spans = own.detect(spark.createDataFrame([(text,)], "text string")).head().spans
    assert [s.text for s in spans if s.entity_type == "IBAN_CODE"] == [IBANS[1]]
    assert [s.text for s in spans if s.entity_type == "CRYPTO"] == [ADDRESSES[0], ADDRESSES[3], ADDRESSES[5]]
