import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, h string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) with odd extra columns; lang and source go round."""

    def make(rows):
        full = [(i, t, ("en", "de", None)[k % 3], ("a", "b", None)[k % 3], len(t or ""), 0.5, "x") for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA)

    return make


LONG = " ".join(f"word{i % 977} und{i % 13}," for i in range(60_000))
ODD = [
    (1, "Plain words, twice: plain words."),
    (2, ""),
    (3, None),
    (4, "   \n\t "),
    (5, "á Éa  İstanbul ΑΣ foo's don't <|endoftext|> x<|endoftext|>y it's. a.b,c!! 12ab ﬁ \x1c z ̈a ǅ 日本語 🙂"),
    (6, LONG),
    (7, "Plain words, twice: plain words."),
    (7, "Plain words, twice: plain words."),
    (None, "no id here"),
    (None, None),
]
