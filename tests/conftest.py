import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from turnwise.session import get_spark
    s = get_spark("local[*]", app="turnwise-tests", shuffle_partitions=8)
    yield s


@pytest.fixture()
def small_blocks(spark):
    """Blocks of 3 turns, so every scan crosses block borders."""
    spark.conf.set("turnwise.scan.blockRows", "3")
    yield 3
    spark.conf.unset("turnwise.scan.blockRows")
