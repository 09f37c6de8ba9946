import pytest

#: (doc_id, text, lang, source, n_chars and columns whose names the operators use themselves)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, body string, row int, tokens string, fp int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and white texts, a very long one, repeated rows, ties, clashing names."""
    prose = "The of and to in thering ander outh resh. Wherin theth and the of to reas.\nOnther line of the text, and more of it here.\n"
    german = "Der die und das nicht mit einer schlich ung keiten verstellt über den großen Fluß.\n"
    rows = [
        (1, prose * 3, "en", "a", 1), (2, prose * 3, "en", "a", 1), (2, prose * 3, "en", "a", 1), (3, german * 4, "de", None, None),
        (4, None, "en", "b", None), (5, "", None, None, 0), (6, " \n\t ", "de", "b", 3), (7, "!!! 123 ???", "en", "b", 11), (8, "One", "en", "c", 3),
        (9, ("word" * 3000) + " " + prose * 400, "en", "c", 7), (10, prose * 2 + "tail that is new and only here in this one.", "en", "a", 5),
        (11, german * 4 + "ende", "de", "b", 9), (None, german * 3, "de", "a", 2), (None, None, None, None, None), (12, "é" * 60 + "漢字" * 40 + "\u0000x", None, "d", 4),
    ]
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
