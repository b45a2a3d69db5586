import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    import rows

    return rows.write(spark, tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    import rows

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    return rows.write(spark, tmp_path_factory.mktemp("empty"), [], labels=labels, pages=pages)
