"""The index of all documents."""

from loomnet.plans import registry


def test_every_document_is_indexed(spark, sf):
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in registry.QUERIES["index_docs_whole"](spark, sf).collect()} == ids
