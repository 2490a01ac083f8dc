"""The daily energy job: which days are due, a second run, rows of other kinds, days that could not be asked."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from hearthlake.operators import daily

T0 = datetime(2026, 8, 2, 15)  # midnight of 3 August in Seoul
ROWS = "organization_id long, day date, space_id long, source_kind string, kwh double, krw double, tco2 double, includes_estimate boolean"


def tables(spark):
    sources = spark.createDataFrame(
        [(1, 10, 0, 7, 1, "Asia/Seoul", 100, "power", "METERED", None, None, None), (1, 11, 1, 7, 1, "Asia/Seoul", 101, "energy", "METERED", None, None, None), (1, 12, 2, 8, 1, "Asia/Seoul", 102, "x", "ESTIMATED", None, 1200.0, 5.0),
         (1, 13, 3, 9, 1, "Asia/Seoul", 103, "power", "METERED", None, None, None)],
        "organization_id long, source_id long, ordinal int, space_id long, site_id long, timezone string, device_id long, metric_key string, kind string, cumulative boolean, rated_w double, standby_w double",
    )
    power = [(100, "power", T0 + timedelta(minutes=10 * k), 1000.0, 0) for k in range(-6, 150)] + [(100, "power", T0 + timedelta(hours=3, minutes=5), 9e9, 1)]
    counter = [(101, "energy", T0 + timedelta(hours=h), v, 0) for h, v in ((-2, 0.0), (2, 4.0), (12, 14.0), (20, 1.0), (30, 11.0))]
    readings = spark.createDataFrame(power + counter, "device_id long, metric_key string, time timestamp, value double, quality int")
    running = spark.createDataFrame([(1, date(2026, 8, 3), 102, 8 * 3600)], "organization_id long, day date, device_id long, on_seconds long")
    tariffs = spark.createDataFrame([(1, 1, None, date(2026, 1, 1), "FLAT", 100.0)], "tariff_id int, organization_id long, site_id long, valid_from date, mode string, flat_rate double")
    bands = spark.createDataFrame([], "tariff_id int, ordinal int, months array<int>, day_type string, from_time string, to_time string, rate double")
    holidays = spark.createDataFrame([], "organization_id long, site_id long, day date")
    factors = spark.createDataFrame([(1, date(2026, 1, 1), 0.5)], "organization_id long, valid_from date, factor double")
    return {"sources": sources, "readings": readings, "running": running, "tariffs": tariffs, "bands": bands, "holidays": holidays, "factors": factors}


def test_days_that_are_due(spark):
    organizations = spark.createDataFrame([(1, "Asia/Seoul"), (2, "UTC"), (3, None)], "organization_id long, timezone string")
    ledger = spark.createDataFrame([(2, date(2026, 8, 2))], "organization_id long, day date")

    def due(now):
        return sorted((r.organization_id, r.day) for r in daily.due(organizations, ledger, now).collect())

    assert due("2026-08-03 16:59:59") == [(2, date(2026, 8, 2)), (3, date(2026, 8, 2))][1:], "01:59 in Seoul; organisation 2 is done"
    assert due("2026-08-03 17:00:00") == [(1, date(2026, 8, 3)), (3, date(2026, 8, 2))]


def test_rows_of_a_day(spark):
    t, day = tables(spark), date(2026, 8, 3)
    tasks = spark.createDataFrame([(1, day)], "organization_id long, day date")
    got = {(r.space_id, r.source_kind): r for r in daily.energy_rows(tasks, known=tasks, **t).collect()}
    # 24 kWh of power; the counter: half of 4 kWh, 10 kWh, 0 at the reset, 4/10 of 10 kWh
    assert round(got[7, "METERED"].kwh, 6) == 24 + 2 + 10 + 0 + 4 and got[7, "METERED"].includes_estimate
    assert round(got[8, "ESTIMATED"].kwh, 6) == 9.68 and got[8, "ESTIMATED"].krw == 968.0 and round(got[8, "ESTIMATED"].tco2, 9) == 0.00484
    assert (got[9, "METERED"].kwh, got[9, "METERED"].krw, got[9, "METERED"].tco2) == (0.0, None, 0.0), "no samples"
    assert (8, "ESTIMATED") not in {(r.space_id, r.source_kind) for r in daily.energy_rows(tasks, known=tasks.limit(0), **t).collect()}, "running times could not be asked"
    assert daily.energy_rows(tasks.limit(0), known=tasks, **t).count() == 0


def test_a_second_run_changes_nothing(spark, tmp_path):
    t, table, ledger = tables(spark), f"{tmp_path}/energy", f"{tmp_path}/runs"
    day = date(2026, 8, 3)
    tasks = spark.createDataFrame([(1, day)], "organization_id long, day date")
    other = spark.createDataFrame([(1, day, 7, "BILL_ALLOCATED", 5.0, 1.0, None, False), (1, day - timedelta(days=1), 7, "METERED", 3.0, None, None, False), (2, day, 7, "METERED", 4.0, None, None, False)], ROWS)
    other.write.partitionBy("organization_id", "day").parquet(table)

    def content():
        return sorted((r.organization_id, str(r.day), r.space_id, r.source_kind, r.kwh and round(r.kwh, 6)) for r in daily.read(spark, table, ROWS).collect())

    rows = daily.energy_rows(tasks, known=tasks, **t)
    daily.commit(spark, tasks, rows, table, ledger)
    first = content()
    assert len(first) == 6 and {(2, "2026-08-03", 7, "METERED", 4.0), (1, "2026-08-03", 7, "BILL_ALLOCATED", 5.0), (1, "2026-08-02", 7, "METERED", 3.0)} <= set(first)
    assert daily.due(spark.createDataFrame([(1, "Asia/Seoul")], "organization_id long, timezone string"), spark.read.parquet(ledger), "2026-08-03 18:00:00").count() == 0
    daily.commit(spark, tasks, rows, table, ledger)  # as after a crash before the ledger was written
    assert content() == first and spark.read.parquet(ledger).count() == 1
    daily.commit(spark, tasks, rows.where(F.lit(False)), table, ledger)
    assert {x[3] for x in content() if x[:2] == (1, "2026-08-03")} == {"BILL_ALLOCATED"}, "a recomputed day without rows loses those it had"
