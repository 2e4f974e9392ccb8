import pytest


@pytest.fixture(scope="session")
def tok():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture
def hard(spark):
    """Documents with nulls, empty and odd texts, repeated rows, a repeated and a null id, and an extra column."""
    words = " ".join(f"w{k}" for k in range(60))
    rows = [
        (0, None), (1, ""), (2, "   \n\t "), (3, words), (4, words), (4, words), (5, "x " + words + " y"), (6, words.upper()), (None, "alone here"),
        (7, "é ü ñ  double  spaces\n\nlines"), (8, "a" * 700), (9, "ab " * 400), (10, words + " " + words), (11, "one"), (12, "<|endoftext|> 日本語 a"), (13, "long " + " ".join(str(k * k) for k in range(30000))),
    ]
    return spark.createDataFrame([(d, t, "en" if d != 7 else None, "src" if d != 3 else None, 5, 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, uid0 int")
