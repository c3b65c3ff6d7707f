import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the old river runs past nine quiet mills and turns east where a stone bridge still stands in the rain"


def doc_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, odd white space and code points."""
    words = PROSE.split()
    long_text = " ".join(f"{words[i % 19]}{(i * i) % 977}" for i in range(30_000))
    rows = [
        (1, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (3, "", "en", "a", 0), (4, None, None, None, None), (None, PROSE + " again", "en", "b", 2),
        (None, None, None, "b", None), (5, " \t\n\x0b\x0c\r ", "en", "b", 3), (6, long_text, "en", "c", 4), (7, "é ñ ö 中文 字 \U0001f600", "fr", None, 5),
        (8, "one\ntwo\none\n\none \n  \n" + PROSE, "en", "c", 6), (8, "one\ntwo\none\n\none \n  \n" + PROSE, "en", "c", 6),
        (9, "one two", "en", "c", 7), (-3, PROSE.upper(), "en", "a", 8), (10, PROSE + "\n" + PROSE, "en", "d", 9),
    ]
    return rows + [(100 + i, f"{PROSE} {i} " + " ".join(words[i % 7:]) + f"\nfooter line of the site\n{i * 7919}", "en", "d", i) for i in range(40)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(doc_rows(), SCHEMA)


@pytest.fixture
def clashing(docs):
    """The same rows with further columns named like those that operators add or use inside."""
    from pyspark.sql import functions as F
    names = "size shard slot start length spans kind host line words component_id fingerprint source_size target taken sequence_id offset rank _n _sub h text_hash position".split()
    return docs.select("*", *[F.lit(f"x{n}").alias(n) for n in names])


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def folder(tmp_path):
    """Writes DataFrames as the tables of a folder for the registered queries."""
    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write
