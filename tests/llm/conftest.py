import pytest


@pytest.fixture(scope="session")
def corpus_dir(spark, tmp_path_factory):
    """Writes rows as a table `documents` (and others) and returns the folder."""

    def write(**tables):
        folder = tmp_path_factory.mktemp("corpus")
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) or longer as a table with the columns of documents."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make
