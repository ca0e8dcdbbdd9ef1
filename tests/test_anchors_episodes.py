"""Order-dependent operators against brute force on small data with a dominant subject."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cohortloom import schema
from cohortloom.config import ConfigError
from cohortloom.operators import anchors, episodes, ranges
from conftest import frame

BASE = dt.date(2022, 1, 1)


@pytest.fixture(scope="module")
def exposures():
    rng = random.Random(5)
    rows = []
    for i in range(300):
        subject = "S0" if i % 3 == 0 else f"S{rng.randint(1, 9)}"
        start = BASE + dt.timedelta(days=rng.randint(0, 60))
        length = rng.choice([None, -2, 0, 5, 20])
        rows.append((subject, str(i + 1), rng.choice([None, "10", "20.5", "50", "x"]), start,
                     None if length is None else start + dt.timedelta(days=length)))
    return rows


@pytest.fixture(scope="module")
def ex(spark, exposures):
    return frame(spark, schema.EX, [
        {"USUBJID": s, "EXSEQ": q, "EXDOSE": d, "EXSTDTC": b.isoformat(),
         "EXENDTC": e.isoformat() if e else "NA"} for s, q, d, b, e in exposures])


def dose(cell):
    return float(cell) if cell not in (None, "x") else None


def test_dose_before_onset(spark, ex, exposures):
    rng = random.Random(6)
    asked = [(f"S{rng.randint(0, 10)}", BASE + dt.timedelta(days=rng.randint(-5, 80)))
             for _ in range(80)]
    got = {(r["subject_id"], r["onset"]): (r["dose_days"], r["n_exposures"])
           for r in anchors.dose_before(spark.createDataFrame(
               asked, "subject_id string, onset date"), ex).collect()}
    for subject, onset in asked:
        parts = [dose(d) * (min(e or onset, onset) - b).days for s, _q, d, b, e in exposures
                 if s == subject and b < onset and dose(d) is not None
                 and (min(e or onset, onset) - b).days > 0]
        if parts:
            total, n = got[(subject, onset)]
            assert total == pytest.approx(sum(parts)) and n == len(parts)
        else:
            assert (subject, onset) not in got


@pytest.mark.parametrize("rule", ["dose_increase", "dose_decrease"])
def test_dose_changes(ex, exposures, rule):
    want = set()
    for subject in {r[0] for r in exposures}:
        seen = None
        for _s, q, d, b, _e in sorted((r for r in exposures if r[0] == subject),
                                      key=lambda r: (r[3], float(r[1]))):
            value = dose(d)
            if value is None:
                continue
            if seen is not None and (value > seen if rule == "dose_increase" else value < seen):
                want.add((subject, b, float(q)))
            seen = value if seen is None or rule == "dose_decrease" else max(seen, value)
    got = {(r["subject_id"], r["day"], r["seq"]) for r in anchors.dose_changes(ex, rule).collect()}
    assert got == want


@pytest.mark.parametrize("rule", ["dose_increase", "dose_decrease"])
def test_doses_of_one_crowded_day_spread_over_ranges(spark, rule):
    """One subject, one day, 4,000 sparse numbers: the sorted positions lie in several ranges."""
    rng = random.Random(9)
    doses = [rng.randint(1, 400) + i // 40 for i in range(4_000)]
    ex = spark.createDataFrame([("S1", "2022-01-05", str(7_919 * i), str(d), "mg") for i, d in enumerate(doses)],
                               "USUBJID string, EXSTDTC string, EXSEQ string, EXDOSE string, EXDOSU string")
    want, top = set(), doses[0]
    for i, d in enumerate(doses[1:], 1):
        if d > top if rule == "dose_increase" else d < doses[i - 1]:
            want.add(float(7_919 * i))
        top = max(top, d)
    assert {r["seq"] for r in anchors.dose_changes(ex, rule).collect()} == want
    placed = ranges.sorted_rows(anchors.dated_exposures(ex), ["subject_id", "day", "seq"], "spread")
    assert placed.groupBy("part").count().count() >= 3


def test_anchor_resolution(spark, ex, config):
    escalations = anchors.dose_changes(ex, "dose_increase").collect()
    who = escalations[0]["subject_id"]
    asked = spark.createDataFrame([(who, BASE + dt.timedelta(days=d)) for d in (0, 20, 90)]
                                  + [(who, None), ("S99", BASE)], "subject_id string, onset date")
    got = {(r["subject_id"], r["onset"]): r["anchor_date"] for r in anchors.resolve(
        asked, ex, config, "dose_escalation", "most_recent_before_onset").collect()}
    days = sorted(r["day"] for r in escalations if r["subject_id"] == who)
    for (subject, onset), anchor in got.items():
        if subject == "S99":
            assert anchor is None
        elif onset is None:
            assert anchor == days[0]
        else:
            assert anchor == max((d for d in days if d <= onset), default=None)
    with pytest.raises(ConfigError):
        anchors.occurrences(ex, config, "moon_phase")


def _groups(rows, tolerance):
    """Brute force: {record: (ordinal in group)} over sorted groups."""
    out = {}
    for key in {r[1] for r in rows}:
        group = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] or dt.date.max, r[0]))
        ordinal, previous = 0, None
        for rid, _k, onset, end in group:
            closes = previous and (previous[3] or previous[2])
            if not (previous and closes and onset and (onset - closes).days <= tolerance):
                ordinal += 1
            out[rid] = ordinal
            previous = (rid, key, onset, end)
    return out


def test_episode_grouping(spark):
    """Ids share twenty leading characters and one subject holds a third of the rows."""
    rng = random.Random(9)
    rows = []
    for i in range(400):
        onset = None if rng.random() < 0.1 else BASE + dt.timedelta(days=rng.randint(0, 120))
        end = onset + dt.timedelta(days=rng.randint(-6, 4)) if onset and rng.random() < 0.7 else None
        subject = "STUDY-A-SH-000000000" + ("0" if i % 3 == 0 else f"{rng.randint(1, 40)}")
        rows.append((f"A:STUDY-A-RECORD-0000000{rng.randint(0, 99)}-{i}", ("A", subject, rng.choice(["RASH", None])),
                     onset, end))
    df = spark.createDataFrame(
        [(rid, rid[2:], *key, (onset,), (end,)) for rid, key, onset, end in rows],
        "record_id string, source_record_id string, study_id string, subject_id string, "
        "concept_id string, onset struct<value:date>, `end` struct<value:date>")
    placed = episodes.members(df)
    got = {r["record_id"]: r["ordinal"] for r in placed.collect()}
    assert got == _groups(rows, 3)
    table = episodes.number(episodes.episodes(placed)).collect()
    order = sorted(table, key=lambda r: (r["study_id"], r["subject_id"], r["concept"], r["ordinal"]))
    assert [r["episode_number"] for r in order] == list(range(1, len(order) + 1))
    assert sum(r["n_records"] for r in table) == len(rows)
    assert order[0]["episode_id"].endswith("::01")


def test_onset_decides_first_exposure(ex, exposures):
    got = {r["subject_id"]: r["anchor_date"] for r in anchors.first_exposure(ex).collect()}
    assert got == {s: min(r[3] for r in exposures if r[0] == s) for s in {r[0] for r in exposures}}
    assert anchors.first_exposure(ex).filter(F.col("anchor_record").isNull()).count() == 0


def test_ranges_split_one_day_of_one_subject(spark):
    """All records of one subject, concept and day, ids alike: no range holds much more than its share."""
    from cohortloom.operators.ranges import sorted_rows
    df = spark.createDataFrame([("A", "STUDY-A-SH-0000000001", "RASH", BASE, f"STUDY-A-RECORD-{i:09d}")
                                for i in range(4000)],
                               "study_id string, subject_id string, concept string, onset_day date, record_id string")
    laid = sorted_rows(df.repartition(4), [*episodes.GROUP, "onset_day", "record_id"], "t")
    sizes = [r["count"] for r in laid.groupBy("part").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 2 * 4000 / len(sizes)
    order = [r["record_id"] for r in laid.orderBy("part", "place").collect()]
    assert order == sorted(order)


def test_doses_of_any_size(spark):
    rows = [("S", "2022-01-01", "2022-01-03", "2e12"), ("S", "2022-01-01", "2022-01-02", "0.0000001"),
            ("T", "2022-01-01", "2022-01-02", "4e-7"), ("T", "2022-01-01", "2022-01-02", "not a dose")]
    ex = spark.createDataFrame(rows, "USUBJID string, EXSTDTC string, EXENDTC string, EXDOSE string")
    asked = spark.createDataFrame([("S", BASE + dt.timedelta(days=30)), ("T", BASE + dt.timedelta(days=30))],
                                  "subject_id string, onset date")
    ex = ex.withColumn("EXSTDTC", F.lit(str(BASE))).withColumn(
        "EXENDTC", F.when(F.col("EXDOSE") == "2e12", str(BASE + dt.timedelta(days=2)))
        .otherwise(str(BASE + dt.timedelta(days=1))))
    got = {r["subject_id"]: r["dose_days"] for r in anchors.dose_before(asked, ex).collect()}
    assert got == {"S": 4e12 + 1e-7, "T": 4e-7}
    huge = ex.withColumn("EXDOSE", F.lit("9e30"))
    with pytest.raises(Exception, match="out of range"):
        anchors.dose_before(asked, huge).collect()
