"""Keys and acronyms of whole values."""

from loomnet.plans import registry


def test_whole_keys_and_names(spark, tmp_path):
    tail = "x" * 100
    spark.createDataFrame([(1, f"{tail} Ä\tB"), (2, f"{tail} c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.key for r in registry.QUERIES["folded_text"](spark, str(tmp_path)).collect()}
    assert got == {1: f"{tail} a b", 2: f"{tail} c"}
    spark.createDataFrame([(1, "international federation of green gardens"), (2, "one")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert [tuple(r) for r in registry.QUERIES["acronyms"](spark, str(tmp_path)).collect()] == [(1, "IFGG")]
