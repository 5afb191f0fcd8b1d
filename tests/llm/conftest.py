import pytest
import sys; from pathlib import Path; sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

SF = "/root/testdata/sf0.001"

#: Rows that every operator on documents has to bear: nulls in any column, empty, blank and long texts, ties, repeated rows.
HARD = [
    (1, "The cat and the dog of the house sat.\nA second line that has seven words here.", "en", "a"),
    (2, "The cat and the dog of the house sat.\nA second line that has seven words here.", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, "b"),
    (5, " \t\n", "de", None),
    (6, "été où ça 世界 😀 naïve", None, None),
    (None, "a row without an id has words too", "en", "a"),
    (8, "x", "fr", "c"),
    (9, "der hund und die katze " * 3000, "de", "a"),
    (9, "der hund und die katze " * 3000, "de", "a"),
    (10, "w" * 50_000, "de", "a"),
    (11, "12345 !!! <|endoftext|> %%%", "en", "c"),
]


@pytest.fixture(scope="session")
def hard(spark):
    """The hard rows with columns whose names the operators use themselves."""
    rows = [(*r, None if r[1] is None else len(r[1]), i, i, i, i, i) for i, r in enumerate(HARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, fp int, mix int, key int, line int")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (9, 0, 0), (10, 0, None), (11, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
