import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortloom import schema  # noqa: E402
from cohortloom.config import TrialConfig  # noqa: E402
from cohortloom.plans.trial import Trial  # noqa: E402
from cohortloom.sources.snapshot import Snapshot, document_defaults  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
               # a few rows gain nothing from re-planning between stages
               .config("spark.sql.adaptive.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def config():
    return TrialConfig.default()


def frame(spark, declared, rows):
    """Rows given as dicts; missing cells are null."""
    return spark.createDataFrame(
        [tuple(r.get(f.name) for f in declared.fields) for r in rows], declared)


@pytest.fixture(scope="session")
def mini(spark):
    """A snapshot from a few hand-written rows."""
    def build(ae, ex=(), sc=(), documents=(), dm=()):
        ae = [{"USUBJID": "S1", "AETERM": "rash", "AEDECOD": "Rash", "AEDICTVER": "D-21.0",
               "AESER": "N", "AEGRADE": "2", "AESTDTC": "2022-01-06", **r} for r in ae]
        ex = ex or [{"STUDYID": "STUDY-A", "USUBJID": "S1", "EXSEQ": "1", "EXDOSE": "10",
                     "EXSTDTC": "2022-01-01", "EXENDTC": "2022-01-28"}]
        return Snapshot(
            dm=frame(spark, schema.DM, dm or [{"STUDYID": "STUDY-A", "USUBJID": "S1"}]),
            ae=frame(spark, schema.AE, ae), ex=frame(spark, schema.EX, ex),
            sc=frame(spark, schema.SC, sc), co=frame(spark, schema.CO, []),
            documents=document_defaults(frame(spark, schema.DOCUMENTS, documents)))
    return build


@pytest.fixture(scope="session")
def whole_trial(spark):
    from cohortloom.plans.queries import trial
    return trial(spark, SF)


@pytest.fixture(scope="session")
def read(mini):
    """Records of a few rows, prose included, by source record id."""
    def go(ae, **tables):
        rows = Trial(mini(ae, **tables)).records.collect()
        return {r["source_record_id"]: r.asDict(recursive=True) for r in rows}
    return go
