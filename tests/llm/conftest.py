import pytest
from awkward_cases import AWKWARD


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [(*r, None if r[1] is None else len(r[1]), k, "z") for k, r in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long, row_key string")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")
