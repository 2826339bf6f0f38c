import pytest

#: Column names that the operators use themselves, beside those of documents.
CLASHING = "lang string, source string, n_chars long, block string, band string, shard string, u string, bits string, words string"


@pytest.fixture
def documents(spark):
    """Documents of (doc_id, text) or (doc_id, text, lang) rows, with further columns of clashing names."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", 1, "a", "b", "c", "d", "e", "f") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, " + CLASHING)

    return make


#: Nulls, blanks, one character, repeated rows, equal texts, odd white space and a very long text.
ODD = [
    (None, "a text without an id " * 20),
    (0, None),
    (1, ""),
    (2, " \n\t "),
    (3, "x"),
    (4, "one two"),
    (5, "the same row twice, with some more words in it so that it counts"),
    (5, "the same row twice, with some more words in it so that it counts"),
    (6, "A b　c\u0085d \x0b\x0c\re"),
    (7, "w" * 200_000),
    (8, " ".join(f"word{k * k % 977}" for k in range(30_000))),
    (9, " " * 50_000 + "end"),
    (10, "é" * 5_000 + " 字 𝒳 ́"),
]


@pytest.fixture
def odd(documents):
    return documents(ODD)


@pytest.fixture
def odd_rows():
    return ODD


def table_texts(name="documents", folder="/root/testdata/sf0.001"):
    import pyarrow.parquet as pq

    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()
