import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    """The documents of the smallest tables, and the awkward rows that every operator must take."""
    own = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [
        (9001, None, None, None, None),
        (9002, "", "en", "src0", 0),
        (9003, "word " * 30000, "en", "src0", 150000),
        (9004, "a<|endoftext|>b 0 10 H̱ İx \x0b   q", "en", None, 10),
        (9004, "a<|endoftext|>b 0 10 H̱ İx \x0b   q", "en", None, 10),
        (9005, "x" * 5000, "de", "src0", 5000),
        (9006, "\n\n \t\n", None, "src0", 5),
        (9007, "one two", "en", "src0", 7),
    ]
    return own.unionByName(spark.createDataFrame(rows, own.schema))


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns named like those that operators use inside."""
    from pyspark.sql import functions as F

    names = ("id", "n", "a", "b", "node", "component", "fp", "shard", "score", "line", "key", "fingerprint", "component_id", "start", "n_tokens", "text_sha256", "n_hit", "words", "toxic", "held_out")
    return docs.select("*", *(F.lit("clash").alias(x) for x in names))
