"""op8's query on rows whose ids are null or stand for several texts."""

from perfweave.llm import decontamination


def test_rows_keep_their_own_items(spark, tmp_path):
    item, other = (" ".join(f"{x}{i}" for i in range(20)) for x in "ab")
    rows = [(None, item), (None, "nothing of it here at all"), (1, item), (1, other), (1, "clean text of the same id"), (2, None), (1, item)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, item), (8, other)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [(r.doc_id, r.item_ids, r.kept) for r in decontamination.op8_decontamination(spark, str(tmp_path)).collect()]
    want = [(None, [7], False), (None, [], True), (1, [7], False), (1, [8], False), (1, [], True), (2, [], True), (1, [7], False)]
    assert sorted(map(str, got)) == sorted(map(str, want))
