"""The daily energy job: which days are due, their rows, and a commit that may run twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthlake.functions.times import minutes_of
from hearthlake.operators.energy import GAP_MINUTES, rated_usage
from hearthlake.operators.windows import ordered

#: Local hour from which the day before is final.
DUE_HOUR = 2
#: Kinds of rows that a run replaces; others of the same day stay.
KINDS = ["METERED", "ESTIMATED"]
DAY = ["organization_id", "day"]
HOUR = 3_600_000_000


def due(organizations: DataFrame, runs: DataFrame, now: str) -> DataFrame:
    """(organization_id, day): the local day before ``now`` of organisations where it is 2 o'clock or later, unless ``runs`` has it.

    ``organizations``: organization_id, timezone; ``runs`` (the ledger): organization_id, day.
    """
    local = F.from_utc_timestamp(F.lit(now).cast("timestamp"), F.coalesce("timezone", F.lit("UTC")))
    days = organizations.where(F.hour(local) >= DUE_HOUR).select("organization_id", F.date_sub(F.to_date(local), 1).alias("day"))
    return days.join(runs.select(*DAY), DAY, "left_anti")


def _bounded(tasks: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources of each day to do, with the instants where it begins and ends in the source's time zone."""
    rows = tasks.select(*DAY).join(sources, "organization_id")
    zone = F.coalesce("timezone", F.lit("UTC"))
    return rows.withColumns({"day_start": F.to_utc_timestamp(F.col("day").cast("timestamp"), zone), "day_end": F.to_utc_timestamp(F.date_add("day", 1).cast("timestamp"), zone)})


def metered_hours(tasks: DataFrame, sources: DataFrame, readings: DataFrame) -> DataFrame:
    """(organization_id, day, source_id, hour, kwh, estimated) of metered sources: their samples within the day, the last of the day before and the first
    of the day after, integrated (power in W) or differenced (counters in kWh), the part within the day by its hours.

    ``readings`` (device_id, metric_key, time, value, quality) are read for the days asked only.
    """
    first, last = tasks.agg(F.min("day"), F.max("day")).first()
    none = "organization_id long, day date, source_id long, hour timestamp, kwh double, estimated boolean"
    if first is None:
        return tasks.sparkSession.createDataFrame([], none)
    near = readings.where((F.col("time") >= F.date_sub(F.lit(first), 2).cast("timestamp")) & (F.col("time") < F.date_add(F.lit(last), 3).cast("timestamp")))
    near = near.where("quality = 0 AND value IS NOT NULL").select("device_id", "metric_key", "time", "value")
    spans = _bounded(tasks, sources.where("kind = 'METERED'")).select(*DAY, "source_id", "device_id", "metric_key", "cumulative", "day_start", "day_end")
    rows = near.join(spans, ["device_id", "metric_key"]).where("time >= day_start - INTERVAL 1 DAY AND time < day_end + INTERVAL 1 DAY")
    keys = [*DAY, "source_id", "cumulative", "day_start", "day_end"]
    side = F.when(F.col("time") < F.col("day_start"), -1).when(F.col("time") >= F.col("day_end"), 1).otherwise(0)
    outside = Window.partitionBy(*keys, "_side")
    rows = rows.withColumn("_side", side).withColumn("_edge", F.when(F.col("_side") < 0, F.max("time").over(outside)).when(F.col("_side") > 0, F.min("time").over(outside)))
    rows = rows.where(F.col("_edge").isNull() | (F.col("time") == F.col("_edge")))
    by = ordered(keys)
    rows = rows.withColumns({"_to": F.lead("time").over(by), "_next": F.lead("value").over(by)})
    rows = rows.withColumns({"_s": F.unix_micros("time"), "_e": F.unix_micros("_to")}).where("_e > _s")
    hours = (F.col("_e") - F.col("_s")) / HOUR
    kwh = F.when(F.coalesce("cumulative", F.col("metric_key") == "energy"), F.greatest(F.col("_next") - F.col("value"), F.lit(0.0))).otherwise((F.col("value") + F.col("_next")) / 2 / 1000 * hours)
    begin = F.unix_micros("day_start")
    rows = rows.withColumns({"_kwh": kwh, "_gap": hours * 60 > GAP_MINUTES, "_a": F.greatest("_s", begin) - begin, "_b": F.least("_e", F.unix_micros("day_end")) - begin}).where("_a < _b")
    rows = rows.withColumn("_h", F.explode(F.sequence(F.floor(F.col("_a") / HOUR), F.floor((F.col("_b") - 1) / HOUR))))
    part = (F.least("_b", (F.col("_h") + 1) * HOUR) - F.greatest("_a", F.col("_h") * HOUR)) / (F.col("_e") - F.col("_s"))
    sums = rows.groupBy(*DAY, "source_id", "day_start", "_h").agg(F.sum(F.col("_kwh") * part).alias("kwh"), F.bool_or("_gap").alias("estimated"))
    return sums.select(*DAY, "source_id", F.timestamp_micros(F.unix_micros("day_start") + F.col("_h") * HOUR).alias("hour"), "kwh", "estimated")


def estimated_hours(tasks: DataFrame, sources: DataFrame, running: DataFrame, known: DataFrame) -> DataFrame:
    """(organization_id, day, source_id, hour, kwh, estimated) of sources with a rated power: what they used while they ran and on standby, spread evenly over
    the day's hours.

    ``running``: organization_id, day, device_id, on_seconds; a device without a row did not run. ``known``: the days whose
    running times could be asked; where a day is not among them none of its sources has rows.
    """
    rows = _bounded(tasks.join(known.select(*DAY), DAY, "left_semi"), sources.where("kind = 'ESTIMATED' AND rated_w > 0"))
    rows = rows.join(running.select(*DAY, "device_id", "on_seconds"), [*DAY, "device_id"], "left")
    span = (F.unix_micros("day_end") - F.unix_micros("day_start")) / 1e6
    hours = F.greatest(F.lit(1), F.rint(span / 3600).cast("int"))
    kwh = rated_usage(F.col("rated_w"), F.coalesce("standby_w", F.lit(0.0)), F.coalesce("on_seconds", F.lit(0)).cast("double"), span)
    rows = rows.withColumns({"kwh": kwh / hours, "_h": F.explode(F.sequence(F.lit(0), hours - 1))})
    return rows.select(*DAY, "source_id", F.timestamp_micros(F.unix_micros("day_start") + F.col("_h") * HOUR).alias("hour"), "kwh", F.lit(True).alias("estimated"))


def tariff_rates(hours: DataFrame, tariffs: DataFrame, bands: DataFrame, holidays: DataFrame) -> DataFrame:
    """``hours`` (organization_id, site_id, timezone, hour) with rate: that of the tariff in force on the local day, the site's if it has one, else
    the organisation's; FLAT has one rate, others that of the first band that fits. Null where none does.

    tariffs: tariff_id, organization_id, site_id (null: all), valid_from, mode, flat_rate; bands: tariff_id, ordinal, months,
    day_type (WEEKDAY, WEEKEND_HOLIDAY), from_time, to_time, rate; holidays: organization_id, site_id, day.
    """
    local = F.from_utc_timestamp("hour", F.col("timezone"))
    rows = hours.withColumns({"_id": F.monotonically_increasing_id(), "_day": F.to_date(local), "_month": F.month(local), "_minute": F.hour(local) * 60 + F.minute(local)})
    days = rows.select("organization_id", "site_id", "_day").distinct()
    t = tariffs.select("tariff_id", F.col("organization_id").alias("_o"), F.col("site_id").alias("_site"), "valid_from", "mode", "flat_rate")
    fits = (F.col("organization_id") == F.col("_o")) & (F.col("valid_from") <= F.col("_day")) & (F.col("_site").isNull() | (F.col("_site") == F.col("site_id")))
    best = F.max_by(F.struct("tariff_id", "mode", "flat_rate"), F.struct(F.col("_site").isNotNull(), "valid_from"))
    days = days.join(t, fits, "left").groupBy("organization_id", "site_id", "_day").agg(best.alias("t"))
    off = holidays.select(F.col("organization_id").alias("_ho"), F.col("site_id").alias("_hs"), F.col("day").alias("_hd"), F.lit(True).alias("_off")).distinct()
    days = days.join(off, (F.col("organization_id") == F.col("_ho")) & (F.col("site_id") == F.col("_hs")) & (F.col("_day") == F.col("_hd")), "left")
    kind = F.when((F.weekday("_day") >= 5) | F.coalesce("_off", F.lit(False)), "WEEKEND_HOLIDAY").otherwise("WEEKDAY")
    days = days.select(F.col("organization_id").alias("_o"), F.col("site_id").alias("_s"), F.col("_day").alias("_d"), "t.*", kind.alias("_kind"))
    same = (F.col("organization_id") == F.col("_o")) & F.col("site_id").eqNullSafe(F.col("_s")) & (F.col("_day") == F.col("_d"))
    rows = rows.join(days, same, "left")
    b = bands.select(F.col("tariff_id").alias("_t"), "ordinal", "months", "day_type", minutes_of(F.col("from_time")).alias("_f"), minutes_of(F.col("to_time")).alias("_to"), F.col("rate").alias("_rate"))
    on = (F.col("tariff_id") == F.col("_t")) & F.array_contains("months", F.col("_month")) & (F.col("day_type") == F.col("_kind")) & (F.col("_minute") >= F.col("_f")) & (F.col("_minute") < F.col("_to"))
    found = rows.join(b, on, "left").groupBy("_id", *hours.columns, "mode", "flat_rate").agg(F.min_by("_rate", "ordinal").alias("_rate"))
    return found.select(*hours.columns, F.when(F.col("mode") == "FLAT", F.col("flat_rate")).otherwise(F.col("_rate")).alias("rate"))


def energy_rows(tasks: DataFrame, sources: DataFrame, readings: DataFrame, running: DataFrame, known: DataFrame, tariffs: DataFrame, bands: DataFrame, holidays: DataFrame, factors: DataFrame) -> DataFrame:
    """(organization_id, day, space_id, source_kind, kwh, krw, tco2, includes_estimate): the rows of each due day, one a space and kind of source.

    sources: organization_id, source_id, ordinal, space_id, site_id, timezone, device_id, metric_key, kind, cumulative,
    rated_w, standby_w. Site and time zone of a space are those of its first source. A metered source without samples
    counts 0. krw is null where no hour has a rate, tco2 where the organisation has no factor (organization_id,
    valid_from, factor in tCO2 a MWh) for the day.
    """
    keys = [*DAY, "space_id", "source_kind"]
    counted = _bounded(tasks, sources.where("kind = 'METERED'")).select(*DAY, "source_id").unionByName(estimated_hours(tasks, sources, running, known).select(*DAY, "source_id").distinct())
    named = counted.join(sources.select("organization_id", "source_id", "ordinal", "space_id", "site_id", "timezone", F.col("kind").alias("source_kind")), ["organization_id", "source_id"])
    place = F.struct("site_id", F.coalesce("timezone", F.lit("UTC")).alias("timezone"))
    spaces = named.groupBy(*keys).agg(F.min_by(place, "ordinal").alias("place")).select(*keys, "place.*")
    used = metered_hours(tasks, sources, readings).unionByName(estimated_hours(tasks, sources, running, known))
    used = used.join(named.select(*DAY, "source_id", "space_id", "source_kind"), [*DAY, "source_id"])
    used = used.groupBy(*keys, "hour").agg(F.sum("kwh").alias("kwh"), F.bool_or("estimated").alias("estimated")).join(spaces, keys)
    priced = tariff_rates(used, tariffs, bands, holidays)
    sums = priced.groupBy(*keys).agg(F.sum("kwh").alias("kwh"), F.round(F.sum(F.col("kwh") * F.col("rate")), 2).alias("krw"), F.bool_or("estimated").alias("estimated"))
    f = factors.select(F.col("organization_id").alias("_o"), "valid_from", "factor")
    factor = tasks.select(*DAY).join(f, (F.col("organization_id") == F.col("_o")) & (F.col("valid_from") <= F.col("day"))).groupBy(*DAY).agg(F.max_by("factor", "valid_from").alias("factor"))
    out = spaces.select(*keys).join(sums, keys, "left").join(factor, DAY, "left")
    kwh = F.coalesce("kwh", F.lit(0.0))
    return out.select(*keys, kwh.alias("kwh"), "krw", (kwh / 1000 * F.col("factor")).alias("tco2"), F.coalesce("estimated", F.lit(False)).alias("includes_estimate"))


def commit(spark: SparkSession, tasks: DataFrame, rows: DataFrame, table: str, ledger: str) -> None:
    """Writes ``rows`` in place of what the table at ``table`` (partitioned by organization_id and day) has of the same days and kinds, then notes the days in
    the ledger.

    Either may be run again: a day's partition is replaced as a whole, with its rows of other kinds, and a day is noted once. If the job ends between
    the two writes the day is still due, and the next run replaces the same rows. Days of ``tasks`` without rows lose those they had.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        old = spark.read.schema(rows.schema).parquet(table)
        kept = old.where(~F.col("source_kind").isin(KINDS)).join(tasks.select(*DAY), DAY, "left_semi")
        emptied = old.join(tasks.select(*DAY), DAY, "left_semi").select(*DAY).distinct()
        rows = rows.unionByName(kept)
        gone = emptied.join(rows.select(*DAY).distinct(), DAY, "left_anti")
        # a partition that is to be empty is replaced by one without rows that count
        rows = rows.unionByName(gone.withColumns({c.name: F.lit(None).cast(c.dataType) for c in rows.schema if c.name not in DAY}), allowMissingColumns=True)
    rows.write.mode("overwrite").partitionBy(*DAY).option("partitionOverwriteMode", "dynamic").parquet(table)
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    done = tasks.select(*DAY).distinct()
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        done = done.join(spark.read.schema(done.schema).parquet(ledger), DAY, "left_anti")
    done.write.mode("append").parquet(ledger)


def read(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The rows of the table that ``commit`` writes."""
    return spark.read.schema(schema).parquet(table).where("source_kind IS NOT NULL")
