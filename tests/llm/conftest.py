import pytest

#: Rows that every operator on documents must stand: nulls in each column, empty and blank texts, ties and repeated rows,
#: very long texts, other scripts, special tokens, and extra columns with clashing names.
LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(40_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, component_id string, _x string"
ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 1, 7, "c", "x"),
    (2, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 1, 7, "c", "x"),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", "b", 0, 1, "c", "x"),
    (5, " \t\n ", "fr", "b", 4, 1, "c", "x"),
    (6, LONG, "en", None, 5, 1, "c", "x"),
    (6, "same id, other text", "en", "b", 5, 1, "c", "x"),
    (6, "same id, other text", "en", "b", 5, 1, "c", "x"),
    (None, "a row without an id", "en", "a", 5, 1, "c", "x"),
    (9, "Ein ganz anderer Satz über Straßen, Flüsse und das schöne Wetter heute.", "de", "d", 5, 1, "c", "x"),
    (10, "日本語のテキスト 123 ½ é é 😀 don't <|endoftext|> x  y\t z\r\n", None, "c", 5, 1, "c", "x"),
    (11, "12345 !!! ###", "en", "c", 5, 1, "c", "x"),
    (12, "the quick brown fox jumps over the LAZY dog again and again.", "en", "a", 1, 7, "c", "x"),
    (13, "a" * 5000, "en", "a", 1, 7, "c", "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
