from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerframe.session import build_session  # noqa: E402
from ledgerframe.sources.loaders import Tables  # noqa: E402
from ledgerframe.sources.schemas import ERP_SCHEMAS  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app_name="ledgerframe-tests", shuffle_partitions=4,
                      extra={"spark.sql.maxMetadataStringLength": "4000"})
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerframe-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture
def erp(spark):
    """Build a table mapping from hand-made rows; tables not given are empty."""

    def make(**rows):
        def build(name):
            return spark.createDataFrame(rows.get(name, []), ERP_SCHEMAS[name])

        return Tables(list(ERP_SCHEMAS), build)

    return make
