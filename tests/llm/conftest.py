import pandas as pd
import pytest


@pytest.fixture
def frame(spark):
    """A DataFrame from rows and a schema, empty ones included."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture
def docs(spark):
    """Documents as the operators meet them at worst: nulls, blanks, repeated rows and ids, clashing column names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, piece int, length long"
    long_text = " ".join(f"w{i % 977}.{'x' * (i % 7)}" for i in range(30_000)) + "\nend"
    base = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "One"), (4, "One"), (4, "another text of the same id"), (5, "One"),
        (None, "a row without an id"), (None, None), (6, long_text), (7, "Ünï çödé\u00a0✓ \U0001f600 <|endoftext|> x"),
    ]
    return spark.createDataFrame(
        [(i, t, "en", None if i == 2 else "s", len(t or ""), 0.1, 9, 9) for i, t in base], schema
    )


def as_pandas(df) -> pd.DataFrame:
    return df.toPandas()
