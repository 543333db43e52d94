import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string"


def prose(seed: int, n: int, vocabulary: str = "the of stone river light and under winter garden amber") -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(vocabulary.split()) + r.choice(["", "", "s", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names of extra columns."""
    long = prose(7, 6000)
    rows = [(i, prose(i, 5 + i * 3), ("en", "fr", None)[i % 3], ("a", "b", None, "é")[i % 4]) for i in range(40)]
    rows += [(100, None, None, None), (101, "", "en", "a"), (102, "  \t\n", "fr", "b"), (103, long, "en", "a"), (104, long + " End", "en", "a")]
    rows += [(105, "Same TEXT here", "en", "a"), (106, "same text HERE", "en", "b"), (105, "Same TEXT here", "en", "a"), (None, "same text here", "fr", None)]
    rows += [(107, "1234 !!", "en", "a"), (108, "ÄB Àb", "fr", "z"), (109, "äb àb", "fr", "z"), (110, "one two", None, "a")]
    rows += [(200 + i, "a hot text of many copies", "en", "a") for i in range(150)]
    return spark.createDataFrame([(i, t, k, s, len(t or ""), "x", "y") for i, t, k, s in rows], DOCS).repartition(5, "n_chars").persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t
