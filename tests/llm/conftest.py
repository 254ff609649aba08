import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """documents table from (doc_id, text[, lang]) tuples, with a clashing extra column."""
    def make(rows, extra=("key", "id", "pos", "score", "findings")):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        from pyspark.sql import functions as F
        for c in extra:
            df = df.withColumn(c, F.lit(f"own {c}"))
        return df
    return make


@pytest.fixture
def sf(spark, tmp_path):
    """Writes tables below a fresh folder and returns its path."""
    def put(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return put
