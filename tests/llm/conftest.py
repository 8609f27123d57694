import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows with nulls, empty and long texts, repeats, and columns named like the operators' own."""
    long = " ".join(f"word{k % 977}" for k in range(30_000))
    plain = "The quick brown fox jumps over the lazy dog. " * 14
    rows = [
        (1, plain), (1, plain), (2, plain), (3, None), (4, ""), (5, " \n\t "), (None, plain + "more"), (None, None), (6, long), (7, "x"), (8, "a" * 50_000), (3, None),
    ]
    spare = ["fp", "score", "k", "id", "row", "text_key", "runs", "tokens", "component_id", "size", "_text", "spans", "shard", "m", "n_words", "host", "value"]
    return spark.createDataFrame([(i, t, *["?"] * len(spare)) for i, t in rows], "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in spare))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
