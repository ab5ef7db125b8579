import pytest


@pytest.fixture(autouse=True)
def _prepared(spark):
    from flowlens.llm.common import prepare

    prepare(spark)
