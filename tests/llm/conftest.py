import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Build a documents table from (doc_id, text) or (doc_id, text, lang, source) tuples."""
    from runlore.llm.common import prepare

    prepare(spark)

    def build(rows):
        full = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return build
