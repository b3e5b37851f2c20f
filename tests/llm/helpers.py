"""Fixtures shared by the tests of the training-data operators."""

DOC_TYPE = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=""):
    """A documents table from (doc_id, text) pairs; spread over several partitions."""
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, DOC_TYPE).repartition(3)


def table_rows(spark, sf, name="documents"):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()
