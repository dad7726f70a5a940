import os

import pytest

from fernglass.llm import q_percentiles, q_splitting
from tests.compare import DATA, differences


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_queries_agree_with_sql(spark):
    assert differences(spark, [q_percentiles, q_splitting]) == []
