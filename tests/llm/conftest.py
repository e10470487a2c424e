from __future__ import annotations

import pytest

from clickloom.llm.arrow import ship
from clickloom.sources.staging import Staging


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def staging(spark):
    with Staging(spark) as tables:
        yield tables


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A frame of documents from texts: ids count from 0 unless given."""

    def make(*texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, DOCUMENTS)

    return make
