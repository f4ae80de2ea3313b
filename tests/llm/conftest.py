import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _hit string, kept string, n_lines long, id long, value string, word string, row long, start long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    prose = " ".join(f"word{k} of{k % 7} the" for k in range(60))
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [None, "", " \n\t", "A", "a\nb", prose, prose, prose + " x", "y " + passage + " z", passage, passage + " " + prose, "x" * 20_000, "la la " * 500, "Ünï ©   ß", "=\n=\n" * 3]
    rows = [(k, t, "en", f"s{k % 2}", 1, "h", "k", 1, 5, "v", "w", 7, 3) for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, prose, None, None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
