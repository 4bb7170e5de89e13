import pytest

from ledgerlink.llm.common import table  # noqa: F401  without the package these tests don't apply

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """The folder that a cluster would name in spark.checkpoint.dir."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def save(spark, tmp_path):
    """Write rows as tables of a folder; returns the folder."""

    def make(schemas=None, **tables):
        for name, rows in tables.items():
            ddl = (schemas or {}).get(name, SCHEMA)
            spark.createDataFrame(rows, ddl).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


@pytest.fixture(scope="session")
def samples(spark):
    """Rows of the smallest test tables by name, as dictionaries."""
    root = "/root/testdata/sf0.001"
    return lambda name: [r.asDict() for r in spark.read.parquet(f"{root}/{name}.parquet").collect()]


def odd_texts():
    """Empty, blank, repeated, very long and unusual texts."""
    long = "many words and more words " * 4000
    return [
        None, "", " \n\t ", "a", "a", "x" * 30_000, long, long, "İstanbul ΣΟΦΟΣ   ﬁne é́", "don't we'll I'M",
        "日本語 текст 123\x00 4", "a\x0bb\x1cc d", "퟿\U0001f600" * 300, " " * 999, "1 2 3 4 5 6", "<|endoftext|> x",
    ]


def odd_rows():
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None) for i, t in enumerate(odd_texts())]
    return [*rows, (5, "x" * 30_000, "en", "s", 1), (None, "no id", None, None, None), (None, None, None, None, None)]
