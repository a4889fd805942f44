import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text, source) or (doc_id, text), with one empty partition or more."""

    def of(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return of


@pytest.fixture(scope="session")
def texts(spark, sf):
    """All (doc_id, text) of the small documents table, as a list."""
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd():
    """Texts that break naive code: null, empty, spaces, unusual characters, one very long."""
    return [None, "", " ", "\n\t \x1c\x85", "a", "É é ​ 日本語 🙂🙂", "x" * 70_000, "word " * 30_000, "  lead", "trail  ", "don't I'll WE'RE 12345 !!!\r\n\r\n  end", "▁ ▁▁x ▁", "\x00\x01null", "<|endoftext|> <s> </s>", "a b　c"]
