"""The sample that the lexicon is learned from, with an id of many rows."""

from wardwise.llm import toxicity

DOCS, LABELS = "doc_id long, text string", "doc_id long, toxic int"


def test_an_id_of_many_texts_counts_once(spark):
    rows = [(i, f"you grumple {i} thing" if i < 40 else f"plain words {i} here") for i in range(240)]
    hot = [(240, f"a grumple text {k}") for k in range(400)] + [(240, None)] * 5
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(241)], LABELS)
    docs = spark.createDataFrame(rows + hot, DOCS).repartition(5)
    sample = toxicity.training_rows(docs, labels).collect()
    assert len(sample) == 241 and len({(r["__id"], r["__y"]) for r in sample}) == 241
    one = toxicity.train(spark.createDataFrame([*rows, (240, None)], DOCS), labels)
    assert one.terms and toxicity.train(docs, labels).to_json() == one.to_json()
    assert one.score("you grumple") >= 0.5
