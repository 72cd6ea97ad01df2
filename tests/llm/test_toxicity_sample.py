"""One over-long text does not empty the labelled sample."""

from perfweave.llm import toxicity


def test_over_long_text_displaces_nothing(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_CHARS", 1000)
    ids = spark.range(200).filter(toxicity.fold(toxicity.F.col("id")) > 1).withColumn("rank", toxicity.F.xxhash64("id", toxicity.F.lit("sample")))
    used = [r.id for r in ids.orderBy("rank").limit(20).collect()]
    texts = [(i, "word " * (400 if n == 0 else 5)) for n, i in enumerate(used)]
    docs, labels = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(i, 1) for i in used], "id long, toxic int")
    assert [len(r.text) for r in toxicity._labelled(docs, labels, 50).collect()] == [25] * 19
