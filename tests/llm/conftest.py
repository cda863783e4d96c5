import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

LONG = "alpha beta gamma delta epsilon " * 20_000

#: Nulls in every column, empty and wordless texts, repeated rows and ids, ties, a very long text.
ODD_DOCS = [
    (1, "one two three four five six seven eight", "en", "a", 39),
    (1, "one two three four five six seven eight", "en", "a", 39),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \n\t ", "fr", "b", 4),
    (None, "a text without id, five words", "en", "a", 29),
    (None, None, None, None, None),
    (5, LONG, "en", "c", len(LONG)),
    (6, "ünï çödé – “quoted”   日本語 text", "de", "", 30),
    (6, "another text under the same id", "de", "", 30),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd_docs(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD_DOCS, DOCS)
    # names that operators use inside
    own = "id n key size part block row rank lap first last s1 component toxicity toxic kept label at host salt member fold"
    return docs.select("*", *(F.lit(i).alias(name) for i, name in enumerate(own.split())))


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def tokenizer():
    from shelfline.llm.queries import tokenizer_path

    return tokenizer_path()
