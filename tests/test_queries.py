import importlib
import os

import pytest

from fernglass import plans

from .compare import DATA, differences


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("module", plans.MODULES)
def test_queries_agree_with_sql(spark, module):
    assert differences(spark, [importlib.import_module(f"fernglass.plans.{module}")]) == []


def test_entry_lists_every_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert len(names) > 60 and set(entry.oracle_sql()) <= set(names)


def test_core_queries_stay_when_the_training_data_operators_cannot_be_imported(monkeypatch):
    import __spark_entry__ as entry

    found = importlib.import_module

    def broken(name, *rest):
        if name.startswith("fernglass.llm"):
            raise ImportError("no such tokenizer")
        return found(name, *rest)

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.warns(UserWarning, match="left out"):
        names = entry.queries()
    assert "fused_search" in names and "p9_found" not in names


def test_written_tables_go_to_the_folder_the_session_names(spark):
    from fernglass.session import SHARED, materialize, shared_dir

    path = shared_dir(spark)
    assert path.startswith(spark.conf.get(SHARED)) and path.endswith(spark.sparkContext.applicationId)
    assert materialize(spark.range(3)).inputFiles()[0].startswith(path.removeprefix("file://") if "://" not in path else path.replace("file://", "file:///").replace("////", "///"))
