"""Schedules: cron fields, expected slots, and arrivals matched to them."""

from __future__ import annotations

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.lineage import cut, spread

_BOUNDS = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 6)]


def cron_field(text: str, low: int, high: int) -> set[int]:
    """The numbers of one cron field: *, a, a-b, lists, and steps of these."""
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        first, _, last = span.partition("-")
        a = low if span == "*" else int(first)
        b = high if span == "*" or (step and not last) else int(last or first)
        if not low <= a <= b <= high or (step and int(step) < 1):
            raise ValueError(f"{text!r} is not within {low}-{high}")
        out |= set(range(a, b + 1, int(step or 1)))
    return out


def cron(expression: str) -> list[set[int]]:
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError("a schedule has five fields")
    return [cron_field(f, *b) for f, b in zip(fields, _BOUNDS, strict=True)]


def zone(name: str) -> ZoneInfo:
    try:
        return ZoneInfo(name)
    except Exception:  # any name that is no zone means UTC
        return ZoneInfo("UTC")


def slots(expression: str, tz: str, start: datetime, end: datetime, day_mode: str = "or", most: int = 501) -> list[datetime]:
    """Expected times (UTC, without zone) from start to end, both included, at most `most`; days by either field if both are restricted."""
    minute, hour, dom, month, dow = cron(expression)
    both = len(dom) < 31 and len(dow) < 7
    out, local = [], zone(tz)
    day = start.replace(tzinfo=ZoneInfo("UTC")).astimezone(local).date() - timedelta(days=1)
    while day <= end.date() + timedelta(days=1) and len(out) < most:
        on_dom, on_dow = day.day in dom, (day.weekday() + 1) % 7 in dow
        if day.month in month and ((on_dom or on_dow) if both and day_mode == "or" else (on_dom and on_dow)):
            for h in sorted(hour):
                for m in sorted(minute):
                    at = datetime(day.year, day.month, day.day, h, m, tzinfo=local).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)
                    if start <= at <= end:
                        out.append(at)
        day += timedelta(days=1)
    return sorted(out)[:most]


def next_run(expression: str, tz: str, after: datetime) -> datetime | None:
    """The first expected time after `after` within 366 days; days must meet both fields."""
    found = slots(expression, tz, after + timedelta(minutes=1), after + timedelta(days=366), "and", 1)
    return found[0] if found else None


def cron_values(field: Column, low: int, high: int) -> Column:
    """The sorted numbers of a cron field as an array: *, a, a-b, lists, and steps of these; null where it is none or out of bounds."""

    def numbers(part: Column) -> Column:
        span, step = F.split_part(part, F.lit("/"), F.lit(1)), F.split_part(part, F.lit("/"), F.lit(2))
        a, b = F.split_part(span, F.lit("-"), F.lit(1)), F.split_part(span, F.lit("-"), F.lit(2))
        first = F.when(span == "*", low).otherwise(a.try_cast("int"))
        last = F.when((span == "*") | ((step != "") & (b == "")), high).when(b == "", first).otherwise(b.try_cast("int"))
        by = F.when(step == "", 1).otherwise(step.try_cast("int"))
        return F.when((first >= low) & (first <= last) & (last <= high) & (by >= 1), F.sequence(first, last, by))

    found = F.transform(F.split(field, ","), lambda part: F.when(part.rlike(r"^([*]|[0-9]{1,4}(-[0-9]{1,4})?)(/[0-9]{1,4})?$"), numbers(part)))
    return F.when(~F.exists(found, lambda x: x.isNull()), F.array_sort(F.array_distinct(F.flatten(found))))


def expected_slots(schedules: DataFrame, start: str, end: str, day_mode: str = "or", most: int = 501) -> DataFrame:
    """(schedule_id, slot): the expected times from start to end (UTC, both included) of a table of schedules (schedule_id, expression, tz), at most `most` each, the earliest.

    As slots() has them, each schedule with an expression and a zone of its own. Slots are found once for each expression and zone that occurs: fields become arrays, days come from a
    sequence, and hours and minutes are exploded only on days that count; then each schedule takes its own. Local times that a clock change skips count as if it had come later, those
    it repeats as the first. `manual`, and what is no expression of five fields, has no slots; a name that is no zone means UTC. Null ids count as ids; repeated rows repeat their slots.
    """
    known = sorted(n for n in available_timezones() if "/" in n and not n.startswith(("Etc/", "SystemV/", "posix", "right")))
    zone = F.when(F.col("tz").isin(known), F.col("tz")).otherwise("UTC")
    asked = schedules.select("schedule_id", "expression", zone.alias("_zone"))
    fields = F.split(F.trim("expression"), r"\s+")
    own = cut(asked.select("expression", "_zone").distinct(), "asked")  # else Spark moves the filters on fields to where the schedules are read
    own = own.where(F.size(fields) == 5).select("expression", "_zone", *[cron_values(F.get(fields, n), *bounds).alias(f"_{n}") for n, bounds in enumerate(_BOUNDS)])
    own = cut(own.where(" and ".join(f"_{n} is not null" for n in range(5))), "expressions")
    span = F.sequence(F.date_sub(F.lit(start).cast("date"), 1), F.date_add(F.lit(end).cast("date"), 1))
    days = own.withColumn("_day", F.explode(span)).where(F.array_contains("_3", F.month("_day")))
    on_dom, on_dow = F.array_contains("_2", F.dayofmonth("_day")), F.array_contains("_4", F.dayofweek("_day") - 1)
    either = (F.size("_2") < 31) & (F.size("_4") < 7) & F.lit(day_mode == "or")
    days = days.where(F.when(either, on_dom | on_dow).otherwise(on_dom & on_dow))
    times = days.withColumn("_h", F.explode("_1")).withColumn("_m", F.explode("_0"))
    local = F.col("_day").cast("timestamp_ntz") + F.make_interval(hours=F.col("_h"), mins=F.col("_m"))
    times = times.withColumn("slot", F.convert_timezone(F.col("_zone"), F.lit("UTC"), local))
    times = times.where(F.col("slot").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    place = F.row_number().over(Window.partitionBy("expression", "_zone").orderBy("slot"))
    times = times.withColumn("_n", place).where(F.col("_n") <= most).groupBy("expression", "_zone").agg(F.collect_list("slot").alias("slots"))
    return spread(asked).join(cut(times, "slots"), ["expression", "_zone"]).select("schedule_id", F.explode("slots").alias("slot"))


def slot_windows(frame: DataFrame, lead_minutes: int = 120, grace_minutes: int = 60) -> DataFrame:
    """frame (feed, slot) with opens, deadline and closes: a slot ends with twice its grace or with the next slot."""
    minutes = lambda n: F.expr(f"INTERVAL {n} MINUTES")
    after = F.lead("slot").over(Window.partitionBy("feed").orderBy("slot"))
    return frame.withColumns({"opens": F.col("slot") - minutes(lead_minutes), "deadline": F.col("slot") + minutes(grace_minutes), "closes": F.least(F.col("slot") + minutes(2 * grace_minutes), after)})


def within(windows: DataFrame, arrivals: DataFrame, minutes: int = 360) -> DataFrame:
    """windows joined with the arrivals (feed, arrival_id, detected_at) of their feed from opens to closes, both included.

    Both sides are cut into stretches of `minutes`, and meet by feed and stretch: a window stands in each that it touches, an
    arrival in one, so that each pair is made once and no task holds all arrivals of a feed. Windows of any length are whole.
    """
    stretch = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (minutes * 60_000_000))
    left = windows.where("opens <= closes").withColumn("_stretch", F.explode(F.sequence(stretch("opens"), stretch("closes"))))
    right = arrivals.select("feed", "arrival_id", "detected_at", stretch("detected_at").alias("_stretch"))
    return left.join(right, ["feed", "_stretch"]).where("detected_at between opens and closes").drop("_stretch")


def match_arrivals(windows: DataFrame, arrivals: DataFrame) -> DataFrame:
    """(feed, slot, arrival_id, detected_at): slots in order take the earliest arrival in their window that is left.

    windows: feed, slot, opens, deadline, closes; arrivals: feed, arrival_id, detected_at (accepted ones). Windows of a feed
    that overlap, also by others between, are a group, and so are all from the first to the last that share an id: groups share no
    arrival. A group of one window takes its earliest arrival by an aggregate. In a group of m windows the slots before one
    take m - 1 arrivals at most, so of each slot's arrivals only the earliest m can count; they are matched by group.
    """
    by_feed = Window.partitionBy("feed")  # rows of windows, never of arrivals
    so_far, earlier = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    own, order = windows.select("feed", "slot", "opens", "closes").where("opens <= closes"), by_feed.orderBy("opens", "closes", "slot")
    own = own.withColumn("begins", F.coalesce(F.col("opens") > F.max("closes").over(order.rowsBetween(*earlier)), F.lit(True)))
    own = cut(own.withColumn("part", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(*so_far))).drop("begins"), "windows")
    # an id that came at several times may stand in windows that don't overlap
    again = arrivals.groupBy("feed", "arrival_id").agg(F.min("detected_at").alias("a"), F.max("detected_at").alias("b")).where("a < b").select("feed", "arrival_id")
    twice = within(own, arrivals.join(again, ["feed", "arrival_id"], "left_semi")).groupBy("feed", "arrival_id").agg(F.min("part").alias("part"), F.max("part").alias("to")).where("part < to")
    order = by_feed.orderBy("part")
    parts = own.groupBy("feed", "part").agg(F.count("*").alias("n")).join(twice.groupBy("feed", "part").agg(F.max("to").alias("to")), ["feed", "part"], "left")
    parts = parts.withColumn("begins", F.coalesce(F.col("part") > F.max("to").over(order.rowsBetween(*earlier)), F.lit(True)))
    parts = parts.select("feed", "part", "n", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(*so_far)).alias("group"))
    parts = parts.withColumn("m", F.sum("n").over(Window.partitionBy("feed", "group"))).drop("n")
    own = cut(own.join(parts, ["feed", "part"]), "groups")
    alone = match_disjoint(own.where("m = 1"), arrivals)
    inside = within(own.where("m > 1"), arrivals).groupBy("feed", "group", "m", "slot", "arrival_id").agg(F.min("detected_at").alias("detected_at"))
    rank = F.row_number().over(Window.partitionBy("feed", "group", "slot").orderBy("detected_at", "arrival_id"))
    inside = inside.withColumn("rank", rank).where("rank <= m").select("feed", "group", "slot", "arrival_id", "detected_at")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for slot, rows in pdf.sort_values(["slot", "detected_at", "arrival_id"]).groupby("slot", sort=True):
            for row in rows.itertuples():
                if row.arrival_id not in used:
                    used.add(row.arrival_id)
                    out.append((row.feed, slot, row.arrival_id, row.detected_at))
                    break
        return pd.DataFrame(out, columns=["feed", "slot", "arrival_id", "detected_at"])

    feed, arrival = windows.schema["feed"].dataType.simpleString(), arrivals.schema["arrival_id"].dataType.simpleString()
    when = windows.schema["slot"].dataType.simpleString()
    together = inside.groupBy("feed", "group").applyInPandas(greedy, f"feed {feed}, slot {when}, arrival_id {arrival}, detected_at {when}")
    return alone.unionByName(together)


def match_disjoint(windows: DataFrame, arrivals: DataFrame) -> DataFrame:
    """match_arrivals() where no two windows of a feed overlap: each takes its earliest arrival, by one aggregate."""
    first = within(windows.select("feed", "slot", "opens", "closes"), arrivals).groupBy("feed", "slot").agg(F.min(F.struct("detected_at", "arrival_id")).alias("m"))
    return first.select("feed", "slot", "m.arrival_id", "m.detected_at")


def slot_status(windows: DataFrame, matched: DataFrame, as_of: str) -> DataFrame:
    """windows with arrival_id, detected_at, status (ON_TIME, LATE, EXPECTED, MISSED_SLA or PAUSED) and delay_minutes.

    A slot without an arrival whose windows row says `paused` is PAUSED. The delay counts from the deadline in whole minutes, 1 at least: to the arrival where
    LATE, to as_of where MISSED_SLA; else it is 0.
    """
    out, now = windows.join(matched, ["feed", "slot"], "left"), F.lit(as_of).cast("timestamp")
    paused = F.coalesce(F.col("paused"), F.lit(False)) if "paused" in windows.columns else F.lit(False)
    status = F.when(paused & F.col("detected_at").isNull(), "PAUSED").when(F.col("detected_at") <= F.col("deadline"), "ON_TIME").when(F.col("detected_at").isNotNull(), "LATE").when(now <= F.col("deadline"), "EXPECTED").otherwise("MISSED_SLA")
    since = lambda c: F.greatest(F.lit(1), F.floor((F.unix_micros(c.cast("timestamp")) - F.unix_micros(F.col("deadline").cast("timestamp"))) / 60_000_000))
    out = out.withColumn("status", status)
    delay = F.when(F.col("status") == "LATE", since(F.col("detected_at"))).when(F.col("status") == "MISSED_SLA", since(now)).otherwise(F.lit(0))
    return out.withColumn("delay_minutes", delay.cast("long"))


def attainment(statuses: DataFrame) -> DataFrame:
    """(on_time, late, missed, sla_pct): the share on time of all that were due; 100 if none was."""
    sums = statuses.agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("ON_TIME", "on_time"), ("LATE", "late"), ("MISSED_SLA", "missed"))])
    due = F.col("on_time") + F.col("late") + F.col("missed")
    return sums.withColumn("sla_pct", F.when(due == 0, 100.0).otherwise(F.round(100.0 * F.col("on_time") / due, 1)))


def board(statuses: DataFrame, arrivals: DataFrame) -> DataFrame:
    """(feed, expected_at, arrival_id, detected_at, status, delay_minutes): slot_status() rows and, as UNSCHEDULED, the arrivals that no slot took.

    An unscheduled arrival is expected when it came and has no delay.
    """
    taken = statuses.where("arrival_id is not null").select("feed", "arrival_id")
    other = arrivals.join(taken, ["feed", "arrival_id"], "left_anti").select("feed", F.col("detected_at").alias("expected_at"), "arrival_id", "detected_at", F.lit("UNSCHEDULED").alias("status"), F.lit(0).cast("long").alias("delay_minutes"))
    return statuses.select("feed", F.col("slot").alias("expected_at"), "arrival_id", "detected_at", "status", "delay_minutes").unionByName(other)
