"""What one shard of many has learned does not fade with the number of shards."""

import numpy as np
import pyarrow as pa

from umbra.operators import tagger


def test_a_weight_is_the_mean_of_the_shards_that_changed_it(spark, monkeypatch):
    def shard(shared):
        def run(key, table):
            own = "rare" in table.column("text").to_pylist()
            rows = [-1, 7] if own else [-1]
            value = [[1, 0, 0], [4, -4, 0]][: len(rows)]
            return pa.table({"row": pa.array(rows, pa.int64()), "change": pa.array(value, pa.list_(pa.int64())), "mean": pa.array([[x * tagger.UNIT for x in v] for v in value], pa.list_(pa.int64()))})

        return run

    monkeypatch.setattr(tagger, "_shard", shard)
    monkeypatch.setattr(tagger, "SHARD", 5)
    spans = "array<struct<start:int,end:int,entity_type:string>>"
    texts = spark.createDataFrame([(t, []) for t in ["rare", *(f"text {i}" for i in range(40))]], f"text string, spans {spans}")
    model, _ = tagger.fit(texts, types=("PERSON",), epochs=1, bits=6)
    assert np.array_equal(model.weights[7], [4, -4, 0])
