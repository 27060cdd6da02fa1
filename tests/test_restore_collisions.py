"""Equal masks a few characters apart, restored after a small edit before them."""

from pyspark.sql import functions as F

from umbra.operators import mask

TEXTS = ["1.2.3.4 5.6.7.8", "1.2.3.4 5.6.7.8 9.8.7.6 and 4.3.2.1,4.4.4.4", "a@example.org b@example.org", "one 1.2.3.4 only"]


def _restored(spark, edit):
    docs = spark.createDataFrame([(i, "#", t) for i, t in enumerate(TEXTS)], "doc_id int, node_id string, text string")
    done = mask.mask(docs)
    edited = done.select("doc_id", "node_id", edit(F.col("masked_text")).alias("masked_text"))
    rows, found = mask.restore(edited, mask.anchors(done))
    assert "places" not in found.columns
    return [r.restored_text for r in rows.orderBy("doc_id").collect()]


def test_masks_keep_their_order_after_a_word_before_them(spark):
    assert _restored(spark, lambda t: F.concat(F.lit("new "), t)) == ["new " + t for t in TEXTS]


def test_places_in_order():
    place = mask.in_order_places
    assert place([(0, 4, [4, 9]), (5, 4, [4, 9])]) == [4, 9]  # moved by 4: the nearest of both is 4
    assert place([(5, 4, [0, 5]), (10, 4, [5, 0])]) == [0, 5]  # moved back
    assert place([(50, 4, [70]), (70, 4, [70, 90]), (90, 4, [70, 90, 105])]) == [None, 70, 90]  # the first was cut out
    assert place([(0, 4, []), (5, 4, [5])]) == [None, 5]
    assert place([]) == []
