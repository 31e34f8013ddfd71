import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_texts():
    """Texts with everything that operators must stand: nulls, empties, ties, copies, long ones, odd characters."""
    long = " ".join(f"word{i % 977} and {i}" for i in range(30_000))
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    return [
        (1, None),
        (2, ""),
        (3, "   \n\t "),
        (4, base),
        (5, base),
        (6, base.upper()),
        (7, base.replace("twenty", "more")),
        (8, "a b c"),
        (9, "A  b\tc"),
        (10, "x" * 50_000),
        (11, long),
        (12, "naïve çafé – 日本語 🎉 it's 1234 'll \x85 \xa0 \x1c end"),
        (13, "mail me: a.b@c-d.example.com or +1 (017) 555-7713, 10.0.0.256 1.2.3.4 4111 1111 1111 1111"),
        (None, "a text without an id, of eight words"),
        (14, "line\nline\nline\nother\n"),
        (14, "line\nline\nline\nother\n"),
        (15, "<|endoftext|> &amp; İstanbul ﬁne"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    """The odd texts as documents, with columns whose names operators might use themselves."""
    rows = [(i, t, "en", k) for k, (i, t) in enumerate(odd_texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int").selectExpr(
        "*", "1 as n", "'x' as score", "2 as block", "3 as id", "4 as bucket", "5 as cls", "6 as Failed_Bits", "7 as spans", "8 as part"
    ).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
