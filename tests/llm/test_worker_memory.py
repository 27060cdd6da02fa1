"""What a task leaves in its Python worker, and Python functions that need no second worker."""

import numpy as np
import pyarrow as pa

from umbra.llm import common, jaccard_join, packing
from umbra.llm.common import Cache, Places, slices
from umbra.llm.queries import tokenizer_path


def test_a_task_leaves_only_kept_words_in_its_worker():
    Cache.empty()
    kept = Cache(str.upper, keep=True)
    plain = Cache(str.lower)
    assert [kept["a"], plain["B"]] == ["A", "b"]
    for batch in slices([pa.RecordBatch.from_arrays([pa.array(["C", "D"])], ["text"])], 1):
        assert plain[batch.column(0)[0].as_py()] in "cd"
    assert (dict(plain), plain.older, dict(kept), Cache.filled) == ({}, {}, {"a": "A"}, [kept])
    assert plain["B"] == "b"  # it still works
    Cache.empty()
    assert not kept and not Cache.filled


def test_the_encoder_of_the_pipeline_keeps_no_words():
    text = "therlyon & whedon, Straße 12"
    want = packing.encoder(tokenizer_path())(text).tolist()
    ids = packing.encoder(tokenizer_path(), 40_000, False)
    for _ in range(2):
        for _ in slices([pa.RecordBatch.from_arrays([pa.array([text])], ["text"])]):
            assert ids(text).tolist() == want and Cache.filled
        assert not Cache.filled


def test_hashes_are_asked_for_inside_a_function(spark):
    rng = np.random.default_rng(1)
    hashes = rng.integers(-(1 << 63), (1 << 63) - 1, 20_000)
    ids = spark.createDataFrame([(int(h),) for h in hashes[:2000]], "sig long")
    for most in (Places.MOST_BITS, 1):
        try:
            Places.MOST_BITS, before = most, Places.MOST_BITS
            may_be = Places(ids, "sig", hashed=True).among()
        finally:
            Places.MOST_BITS = before
        found = may_be(hashes.view(np.uint64))
        assert found[:2000].all() and (found[2000:].mean() < 0.1 or most == 1)


def test_rest_links_has_one_python_function_a_stage(spark, monkeypatch):
    seen = []

    def record(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return common.written(df)

    monkeypatch.setattr(jaccard_join, "written", record)
    base = spark.createDataFrame([], "kind int, doc_id long, size long, cls long, blob binary, set binary, key long")
    shared = spark.sparkContext.broadcast((np.zeros(1 << 16, np.uint8), frozenset()))
    jaccard_join.rest_links(base, spark.createDataFrame([], "node long, label long"), spark.createDataFrame([(1,)], "sig long"), (4, 5), shared)
    rows = [p for p in seen if "MapInArrow" in p]
    assert rows and not any("ArrowEvalPython" in p for p in rows)
