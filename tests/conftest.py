import os
import sys

import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for folder in (ROOT, os.path.join(ROOT, "tests")):
    if folder not in sys.path:
        sys.path.insert(0, folder)

from cardmill.plans import registry  # noqa: E402
from cardmill.session import build_session  # noqa: E402
from cardmill.sources.corpus import documents_as_entries  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def snippets(spark):
    """The documents as short entries: 80 characters of title, 200 of content."""
    whole = documents_as_entries(registry.documents(spark, SF))
    table = whole.withColumns({"title": F.substring("title", 1, 80), "content": F.substring("content", 1, 200)}).cache()
    table.count()
    return table


@pytest.fixture(scope="session")
def stored_table(spark, snippets, tmp_path_factory):
    """The short entries written as the date-partitioned table."""
    from cardmill.sources.entries import append_entries

    path = str(tmp_path_factory.mktemp("table") / "entries")
    append_entries(snippets, path)
    return path


@pytest.fixture(scope="session")
def make_entries(spark):
    """Entries from dicts; what is not given gets a plain value."""
    import datetime as dt

    from cardmill.schema import ENTRY_SCHEMA

    def build(rows):
        full = []
        for i, row in enumerate(rows):
            base = {
                "id": f"{i:024x}",
                "title": "t",
                "content": "c",
                "source": "s",
                "link": "l",
                "date_scraped": "2024-01-01",
                "created_at": dt.datetime(2024, 1, 1),
            }
            full.append(tuple({**base, **row}[name] for name in ENTRY_SCHEMA.names))
        return spark.createDataFrame(full, ENTRY_SCHEMA)

    return build


@pytest.fixture(scope="session")
def plan_of():
    def text(df) -> str:
        return df._jdf.queryExecution().executedPlan().toString()

    return text
