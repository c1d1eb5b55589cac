"""The sample of labelled texts when doc_ids repeat."""

from granary.llm import byte_cnn


def test_a_repeated_id_leaves_the_other_ids_in_the_sample(spark):
    ids = [k for k in spark.range(60).where(~byte_cnn.held_out("id")).toPandas()["id"].tolist()][:20]
    docs = spark.createDataFrame([(ids[0], f"text {k:03}") for k in range(200)] + [(k, f"of {k}") for k in ids[1:]], "doc_id long, text string")
    labels = spark.createDataFrame([(k, i % 2) for i, k in enumerate(ids)], "doc_id long, quality int")
    found = byte_cnn.labelled_sample(docs, labels, "quality", per_class=10)
    assert found == [("text 000", 0)] + [(f"of {k}", i % 2) for i, k in enumerate(ids) if i]
