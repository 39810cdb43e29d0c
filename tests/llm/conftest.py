import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
for p in (ROOT, os.path.join(ROOT, "tests")):
    if p not in sys.path:
        sys.path.insert(0, p)

SF001 = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, th long, key string"

LONG = "Rivers rise when snow melts in the hills and the valley towns watch the bridges all night long. "
ROWS = [
    (1, "One line that several documents share with each other today.\nFirst own line here, quite short.", "en", "a", 3, 9, 9, "k"),
    (2, "One line that several documents share with each other today.\nAnother line of its own, longer than that.", "en", "a", 3, 9, 9, "k"),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", "a", 0, 9, 9, "k"),
    (5, " \n\t \n", "en", None, 0, 9, 9, "k"),
    (6, LONG * 400, "en", "b", 3, 9, 9, "k"),                      # long, over a chunk of words on one line
    (7, LONG * 400, "en", "b", 3, 9, 9, "k"),                      # an exact copy
    (8, "ÉCOLE über <|endoftext|> x y  z. don't stop!!", "xx", "b", 3, 9, 9, "k"),
    (9, "One line that several documents share with each other todax.\nThird own line.", "en", "a", 3, 9, 9, "k"),
    (9, "One line that several documents share with each other todax.\nThird own line.", "en", "a", 3, 9, 9, "k"),  # repeated row
    (None, "a text whose number is missing", "en", "a", 3, 9, 9, "k"),
]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
    from turnwise.session import get_spark
    return get_spark("local[4]", app="turnwise-llm-tests", shuffle_partitions=4)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, copies, repeated rows and clashing column names."""
    from turnwise.llm.common import reachable
    reachable(spark)
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    from turnwise.llm.common import documents
    return documents(spark, SF001)


@pytest.fixture(scope="session")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]
