import pytest
from cases import SF

from panelspark.llm.common import bounded_batches


@pytest.fixture(autouse=True)
def small_batches(spark):
    bounded_batches(spark, 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture
def docs(spark):
    def make(rows, columns="doc_id long, text string"):
        return spark.createDataFrame(rows, columns)

    return make


@pytest.fixture
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
