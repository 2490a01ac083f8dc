"""Tables of analyses, runs and models: paging, filters, queues, key figures, promotion."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.operators.joins import within_intervals


def within_scope(rows: DataFrame, scope: str, allowed: list[int]) -> DataFrame:
    """Rows all of whose spaces are allowed."""
    return rows.where(F.size(F.array_except(scope, F.array(*[F.lit(a).cast("long") for a in allowed]).cast("array<bigint>"))) == 0)


def filtered(rows: DataFrame, **wanted: object) -> DataFrame:
    """Equal to each value that is given; None is no condition."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == F.lit(value))
    return rows


def latest(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of the last row of each key: an aggregation, without a sort of its rows."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("x")).select(*keys, "x.*")


def usage_counts(rows: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def promotable(queued: DataFrame, active: DataFrame, org: str, limit: int, order: list[str]) -> DataFrame:
    """The oldest queued rows of each organisation that its free places take."""
    free = active.groupBy(org).agg((F.lit(limit) - F.count("*")).alias("_free"))
    place = F.row_number().over(Window.partitionBy(org).orderBy(*order))
    return queued.withColumn("position", place).join(free, org, "left").where(F.col("position") <= F.coalesce("_free", F.lit(limit))).drop("_free")


def start_estimate(runs: DataFrame, keys: list[str], seconds: str, order: str, last: int = 20, default: float = 60.0) -> DataFrame:
    """(keys, seconds): the upper middle of the last durations of each key."""
    back = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    rows = runs.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= last)
    some = F.array_sort(F.collect_list(seconds))
    return rows.groupBy(*keys).agg(some.alias("_d")).select(*keys, F.coalesce(F.element_at("_d", (F.floor(F.size("_d") / 2) + 1).cast("int")), F.lit(default)).alias("seconds"))


def compliance(hourly: DataFrame, keys: list[str], metric: str, limits: DataFrame) -> DataFrame:
    """(keys, compliance): mean over metrics of the share of hours within [min, max]."""
    share = hourly.join(limits, metric).groupBy(*keys, metric).agg(F.avg(F.col("value").between(F.col("min"), F.col("max")).cast("double")).alias("share"))
    return share.groupBy(*keys).agg(F.avg("share").alias("compliance"))


def availability(quality: DataFrame, keys: list[str]) -> DataFrame:
    return quality.groupBy(*keys).agg(F.avg("completeness").alias("availability"))


def label_scores(events: DataFrame, labels: DataFrame, keys: list[str], slack: float) -> DataFrame:
    """(keys, precision, recall) of event intervals (start, end) against labelled times (at)."""
    spans = events.select(*keys, "start", "end")
    at = labels.select(*keys, F.col("at").alias("time"))
    hit = within_intervals(at, spans, keys, slack, "left_semi").groupBy(*keys).agg(F.count("*").alias("hit"))
    total = at.groupBy(*keys).agg(F.count("*").alias("labels"))
    points = labels.select(*keys, F.col("at").alias("start"), F.col("at").alias("end"))
    middle = events.select(*keys, F.timestamp_micros(((F.unix_micros("start") + F.unix_micros("end")) / 2).cast("long")).alias("time"))
    good = within_intervals(middle, points, keys, slack, "left_semi").groupBy(*keys).agg(F.count("*").alias("good"))
    made = events.groupBy(*keys).agg(F.count("*").alias("events"))
    out = total.join(hit, keys, "left").join(made, keys, "left").join(good, keys, "left").fillna(0, ["hit", "events", "good"])
    return out.select(*keys, F.when(F.col("events") > 0, F.col("good") / F.col("events")).alias("precision"), (F.col("hit") / F.col("labels")).alias("recall"))


def compared_runs(base: DataFrame, target: DataFrame, keys: list[str], metric: str, value: str) -> DataFrame:
    """Metrics that two runs have, their difference, its percentage and direction."""
    both = base.select(*keys, metric, F.col(value).alias("base")).join(target.select(*keys, metric, F.col(value).alias("target")), [*keys, metric])
    diff = F.col("target") - F.col("base")
    return both.withColumns({"diff": diff, "diff_pct": 100 * diff / F.nullif(F.abs("base"), F.lit(0.0)), "direction": F.when(diff > 0, "UP").when(diff < 0, "DOWN").otherwise("SAME")})


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` in which ``rows`` replace those of equal keys (write the result in place of the table)."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Those of ``rows`` that ``table`` has no key of, each once: what an append should write."""
    return rows.join(table.select(*keys), keys, "left_anti").dropDuplicates(keys)


def feedback_labels(feedback: DataFrame, runs: DataFrame, events: DataFrame) -> DataFrame:
    """(analysis_id, feedback_id, occurred_at, series_key, verdict): feedback of each analysis, whether it was given on one of its
    runs or on one of its events of the same organisation.

    feedback: feedback_id, organization_id, run_id, realtime_event_id, ...; runs: id, analysis_id; events: id, analysis_id,
    organization_id. The condition is an OR; as each side names one analysis at most, both are joined by key, once for all
    analyses, and a row belongs to the one or two that were found.
    """
    by_run = runs.select(F.col("id").alias("run_id"), F.col("analysis_id").alias("_run"))
    by_event = events.groupBy(F.col("id").alias("realtime_event_id"), "organization_id").agg(F.collect_set("analysis_id").alias("_events"))
    found = feedback.join(by_run, "run_id", "left").join(by_event, ["realtime_event_id", "organization_id"], "left")
    either = F.array_compact(F.array_union(F.array("_run"), F.coalesce("_events", F.array("_run"))))
    return found.select(F.explode(either).alias("analysis_id"), "feedback_id", "occurred_at", "series_key", "verdict")


def renumbered(runs: DataFrame, org: str, order: list[str], position: str = "queue_position", status: str = "status") -> DataFrame:
    """The queued runs whose place in their organisation's queue is not what they say, with the right one: what an update is to write."""
    place = F.row_number().over(Window.partitionBy(org).orderBy(*order))
    queued = runs.where(F.col(status) == "QUEUED").withColumn("_place", place)
    return queued.where(~F.col(position).eqNullSafe(F.col("_place"))).withColumn(position, F.col("_place")).drop("_place")


def changed(table: DataFrame, rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Those of ``rows`` that differ from ``table``'s row of their key in one of ``columns`` (nulls are equal), or have none there."""
    old = table.select(*keys, F.struct(*columns).alias("_old"))
    both = rows.join(old, keys, "left")
    same = F.col("_old").isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_old.{c}"))
    return both.where(~same).drop("_old")


def replace_days(rows: DataFrame, path: str, day: str = "day") -> None:
    """Writes the days that ``rows`` has in place of what ``path`` has of them; other days stay."""
    rows.write.mode("overwrite").partitionBy(day).option("partitionOverwriteMode", "dynamic").parquet(path)


def purge(rows: DataFrame, column: str, now: str, days: int) -> DataFrame:
    """What a purge keeps: rows no older than ``days``."""
    return rows.where(F.col(column) >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)))


def write_csv(rows: DataFrame, path: str, labels: dict[str, str] | None = None, most: int = 1_000_000) -> None:
    """CSV files with a header of labels; nested columns as JSON, nulls empty. Over ``most`` rows are refused."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    nested = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("struct", "array", "map")]
    out = rows.withColumns({n: F.to_json(n) for n in nested}) if nested else rows
    out.withColumnsRenamed(labels or {}).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def better_model(candidate: dict, active: dict | None) -> bool:
    """A candidate is promoted if it is not worse: MAE no larger, or precision no smaller; without figures it is."""
    if active is None:
        return True
    for name, sign in (("mae", 1), ("precision", -1)):
        if candidate.get(name) is not None and active.get(name) is not None:
            return sign * candidate[name] <= sign * active[name]
    return True


def canonical_hash(value: object) -> str:
    """SHA-256 of JSON with sorted keys and floats of 12 significant digits."""
    def plain(x: object) -> object:
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list | tuple):
            return [plain(v) for v in x]
        return float(f"{x:.12g}") if isinstance(x, float) else x

    return hashlib.sha256(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


_NAMES = {n: i for i, n in enumerate(("SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT"))} | {n: i for i, n in enumerate(("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"), 1)}


def _cron_field(text: str, lo: int, hi: int) -> set[int]:
    out: set[int] = set()
    for part in text.upper().split(","):
        body, _, step = part.partition("/")
        if body in ("*", "?"):
            a, b = lo, hi
        else:
            ends = [_NAMES[x] if x in _NAMES else int(x) for x in body.split("-")]
            a, b = ends[0], ends[-1] if len(ends) > 1 else (hi if step else ends[0])
        if len(part.split("-")) > 2 or a > b or a < lo or b > hi or (step and int(step) < 1):
            raise ValueError(f"bad field {text}")
        out |= set(range(a, b + 1, int(step) if step else 1))
    return out


def next_run(cron: str, after: datetime, zone: str = "Asia/Seoul") -> datetime:
    """The next time (UTC) of a cron expression of 5 fields (or 6, seconds first) in local time; days of
    month and of week are alternatives where both are given. ValueError if malformed or without a time in four years."""
    fields = cron.split()
    if len(fields) not in (5, 6):
        raise ValueError("five or six fields are needed")
    fields = fields if len(fields) == 6 else ["0", *fields]
    bounds = [(0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (0, 7)]
    second, minute, hour, day, month, week = (sorted(_cron_field(f, *b)) for f, b in zip(fields, bounds, strict=True))
    week = {d % 7 for d in week}
    any_day, any_week = fields[3] in "*?", fields[5] in "*?"
    now = after.astimezone(ZoneInfo(zone)).replace(tzinfo=None)
    for date in (now.date() + timedelta(days=k) for k in range(4 * 366)):
        in_day, in_week = date.day in day, (date.weekday() + 1) % 7 in week
        fits = in_week if any_day and not any_week else in_day if any_week else in_day or in_week
        if date.month in month and fits:
            of_day = (datetime.combine(date, time(h, m, s)) for h in hour for m in minute for s in second)
            found = next((t for t in of_day if t > now), None)
            if found:
                return found.replace(tzinfo=ZoneInfo(zone)).astimezone(ZoneInfo("UTC"))
    raise ValueError("no such time")
