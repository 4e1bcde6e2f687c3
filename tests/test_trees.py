"""Text trees: ids of any length, and listings that the driver doesn't hold."""

from loomnet.plans import registry
from loomnet.sources import readers as R
from loomnet.sources import writers as W


def test_long_ids_are_named_as_in_sql_and_lose_no_file(spark, tmp_path):
    import hashlib

    ids = [2, 7, 123456, 1234560, 1234564]  # the last two have the same year, organisation and first six digits
    spark.createDataFrame([(k, f"text {k}", "src1") for k in ids], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.year, r.org, r.filename, r.h) for r in registry.QUERIES["io_text_tree"](spark, str(tmp_path)).collect())
    assert got == sorted((str(k % 4 + 2016), "src1", str(k).zfill(6)[:6] + ".txt", hashlib.md5(f"text {k}".encode()).hexdigest()) for k in ids)
    assert {(r.state, r.n) for r in registry.QUERIES["io_tree_diff"](spark, str(tmp_path)).collect()} == {("same", 4), ("missing", 1)}


def test_tasks_list_and_read_the_files_of_a_tree(spark, tmp_path):
    docs = [("2020", f"Org {k % 3}=%", f"{k}.txt", "é" * (k % 7)) for k in range(1100)]  # more than two lots, some texts empty
    W.text_tree(spark.createDataFrame(docs, "year string, org string, filename string, text string"), f"{tmp_path}/t")
    d = R.text_tree(spark, f"file://{tmp_path}/t")
    assert d.inputFiles() == [] and sorted((r.year, r.org, r.filename, r.text) for r in d.collect()) == sorted(docs)
    W.text_tree(spark.createDataFrame([], "year string, org string, filename string, text string"), f"{tmp_path}/none")
    assert R.text_tree(spark, f"{tmp_path}/none").isEmpty()
