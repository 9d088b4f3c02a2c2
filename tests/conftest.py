from __future__ import annotations

import pytest

from emberlog.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # Small inputs: compiling each plan would take most of the time.
    made = session("local[4]", 2, **{"spark.driver.memory": "4g", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield made
    made.stop()


@pytest.fixture
def lines(spark):
    """Numbered lines of a file from a text."""

    def make(text: str, name: str = "a.log"):
        return spark.createDataFrame([(name, i, x) for i, x in enumerate(text.split("\n"), 1)], "file_name string, line_no int, line string")

    return make
