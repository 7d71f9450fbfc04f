import public_tokenizers
import pytest

PII = "mail a.b+c@x-y.example.org or ip 10.0.0.255, card 4111 1111 1111 1111, call +1 (555) 123-4567 now"
PASSAGE = "The quick brown fox jumps over the lazy dog again. It then runs through seven green fields. Nobody had seen such a thing before in town. Everyone talked about it for many days after."


@pytest.fixture(scope="session")
def tokenizer():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def rows():
    """Awkward documents: nulls, empty and blank texts, repeated rows, equal texts, a very long text, odd characters."""
    long = " ".join(f"w{k * k % 9973} of the" for k in range(30_000)) + "."
    return [
        (1, "Hello, World! It's fine.", "en"),
        (1, "Hello, World! It's fine.", "en"),
        (2, "Hello, World! It's fine.", None),
        (3, None, "en"),
        (None, "No id here, only words and more words.", "en"),
        (4, "", "en"),
        (5, " \t\n\x0b ", "en"),
        (6, long, "en"),
        (7, "Ünïcödé Σίσυφος ½ ²  　 中文 \U0001f600 <|endoftext|> don't", "de"),
        (8, PII, "en"),
        (9, PASSAGE, "en"),
        (10, "Some other opening words stand here. " + PASSAGE + " And a tail.", "en"),
        (11, "a a a a a a a a a a a a a a a a a a a a a a a a a", "en"),
        (12, "1" * 3000 + "." + "2" * 3000, "en"),
    ]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, lang, 1, "x", 0.5) for i, t, lang in rows], "doc_id long, text string, lang string, id int, fp string, score double").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, id int, fp string, score double")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (9, None, None), (10, 1, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
