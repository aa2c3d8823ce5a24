import pytest

WORDS = "stone river cloud ember lantern meadow orchard quill saddle timber violet willow anchor basil cedar dune".split()

#: Null and empty texts, white space alone, odd characters, special strings, a long word, a very long text, ties.
TEXTS = [
    None, "", " \t\n ", "one", "Hello World's end, it's 42 o'clock!", "naïve café dunkel zeile\x1cpfeil", "é ́x ﬁ İstanbul ΣΑΣ",
    "<|endoftext|> a<|startoftext|>b", "x" * 3000, "日本語のテキスト 😀😀 end", "a  b\n\n\nc   ", "tab\tsep\x0bvt\x0cff\rcr", "same text here", "same text here", "same  text\nhere",
    "\n".join(" ".join(WORDS[(i * 7 + j * j) % 16] for j in range(12)) for i in range(2000)),
    " ".join(["again and again we say the same eight words"] * 5),
]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, part int, row string, key string, id string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with the texts above, null ids and sources among them, and columns whose names clash with inner ones."""
    rows = [(i * 3, t, "en", None if i % 5 == 4 else f"s{i % 3}", len(t or ""), "x", 1, "r", "k", "i") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, "no id here", "en", "s1", 10, "x", 1, "r", "k", "i")], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
