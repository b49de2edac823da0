import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=False):
        """Documents from (id, text); ``extra`` adds columns whose names the operators use themselves."""
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        if extra:
            from pyspark.sql import functions as F

            names = ["n", "id", "t", "d", "fa", "label", "base", "_text", "score", "n_tokens", "words", "node", "matches"]
            df = df.withColumns({c: F.lit(f"own {c}") for c in names})
        return df

    return make
