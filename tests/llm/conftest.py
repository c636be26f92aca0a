import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, copies string, nid long, spans string"


def long_text(words: int, salt: str = "w") -> str:
    return " ".join(f"{salt}{i}" for i in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows; columns whose names clash with the operators' own."""
    base = long_text(60, "base")
    near = base.replace("base30", "other")
    shared = "First shared line of words.\nSecond shared line here.\nThird shared line ends.\n"
    passage = "This sentence is the first one of a passage that many share today. The second sentence of it goes on for a while with more words. And the third one ends the passage at last with words."
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", None), (4, None, "en", "b"), (5, "", None, "b"), (6, "one two", "de", "b"),
        (7, "ONE two", "de", "c"), (8, long_text(30_000, "x"), "de", "c"), (None, "no id at all", "en", "c"), (9, shared + "own tail a", "en", "a"), (10, "own head\n" + shared + "tail b", "en", "a"),
        (11, "Mine. " + passage + " Tail.", "fr", "a"), (12, "Other start. " + passage + " Different end here.", "fr", "a"), (13, " \n\t ", "fr", None), (14, "12 34 !! ##", "es", "d"), (15, "Released under the MIT License.", "en", "d"),
        (16, "été \U0001f600 <|endoftext|> x y", "fr", "d"),
    ]
    return [(i, t, lang, src, None, 7, "x", 5, "y") for i, t, lang, src in texts]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
