import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text[, source]) tuples; extra columns clash with names the operators use."""

    def make(rows, clashing=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        if clashing:
            names = ["size", "key", "fp", "kept", "score", "found", "live", "seed", "pair", "bucket", "n_words", "anchor", "label", "times", "pos", "fence", "_w", "_h", "__words", "__q_kept", "__q_n_words", "__found", "__key", "__k", "__own", "__size", "__cut", "__copy"]
            from pyspark.sql import functions as F

            df = df.withColumns({n: F.lit("x") for n in names})
        return df

    return make
