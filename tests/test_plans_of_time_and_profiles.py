"""Slots of a table of schedules against the function for one; merged profiles against the profile of the union; forms of timestamps."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from feedloom.operators import profile, schedule

EXPRESSIONS = ["0 8 * * *", "*/15 6-7 * * 1-5", "5 4 13 * 5", "30 2 * * *", "30 1 * * 0", "0-59/20,7 */9 1-31 1,3,11 *", "0 0 29 2 *", "59 23 31 12 *", "* * * * *", "5/10 3 * * *"]
ZONES = ["UTC", "America/New_York", "Europe/Berlin", "Asia/Kolkata", "nowhere/else", None]


def test_slots_of_many_schedules(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(EXPRESSIONS), rng.choice(ZONES)) for k in range(60)]
    bad = [(100, "manual", "UTC"), (101, "61 * * * *", "UTC"), (102, "* * * *", "UTC"), (103, None, "UTC"), (104, "5-1 * * * *", "UTC"), (105, "*/0 * * * *", "UTC"), (106, "a * * * *", "UTC"), (107, "1,,2 * * * *", "UTC")]
    frame = spark.createDataFrame(rows + bad, "schedule_id long, expression string, tz string")
    for start, end in (("2024-03-08 00:30:00", "2024-03-12 12:00:00"), ("2024-10-26", "2024-11-04")):  # both changes of the clock in both zones
        want = [(k, slot) for k, text, tz in rows for slot in schedule.slots(text, tz or "UTC", datetime.fromisoformat(start), datetime.fromisoformat(end), most=200)]
        got = [(r.schedule_id, r.slot) for r in schedule.expected_slots(frame, start, end, most=200).collect()]
        assert len(want) > 500 and sorted(got) == sorted(want)
    both = schedule.expected_slots(frame.where("schedule_id >= 100").union(spark.createDataFrame([(1, "5 4 13 * 5", "UTC")], frame.schema)), "2024-09-01", "2024-12-31", "and")
    assert [r.slot for r in both.collect()] == [datetime(2024, 9, 13, 4, 5), datetime(2024, 12, 13, 4, 5)] and schedule.expected_slots(frame.limit(0), "2024-01-01", "2024-02-01").count() == 0


def test_parts_merge_to_the_profile_of_the_union(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["a", "b", None, " "]), str(rng.randrange(30)), f"v{rng.randrange(3000)}", f"2024-01-{k % 28 + 1:02d}") for k in range(4000)]
    frame = spark.createDataFrame(rows, "k long, few string, num string, many string, day string")
    parts = [profile.profile_part(frame.where(F.col("k") % 3 == n), ["k"], f"p{n}", 1500) for n in range(3)]
    empty = profile.profile_part(frame.limit(0), ["k"], "none", 1500)
    merged = {r.column: r for r in profile.merge_parts(parts[2].union(parts[0]).union(empty).union(parts[1]), 1500).collect()}
    whole = {r.column: r for r in profile.profile(frame, ["k"], 1500).collect()}
    for column, one in whole.items():
        got = merged[column]
        assert (got.total, got.nulls, got.null_pct, got.distinct, got.inferred) == (one.total, one.nulls, one.null_pct, one.distinct, one.inferred)
    true = len({r[3] for r in rows})
    assert not merged["many"].is_exact and abs(merged["many"].estimate - true) < 0.04 * true and merged["few"].is_exact
    want = list(dict.fromkeys(r[2] for n in range(3) for r in rows if r[0] % 3 == n))[:5]
    assert merged["num"].firsts == want and merged["few"].estimate == 2


def test_forms_of_timestamps(spark):
    texts = ["2024-01-02 03:04:05", "2024-01-02T03:04:05", "2024-01-02T03:04:05.678Z", "2024-01-02T03:04:05+01:00", "2024-01-02 03:04:05.6", "2024-13-02 03:04:05", "2024-01-02"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    kinds = [r.kind for r in profile.classified(frame.select(F.col("t").alias("value"))).collect()]
    assert kinds == ["TIMESTAMP", "TIMESTAMP", "TIMESTAMP", "STRING", "STRING", "STRING", "DATE"]
    assert {r.form: r.n for r in profile.date_histogram(frame, ["t"]).collect()} == {"YYYY-MM-DD HH:MM:SS": 1, "ISO-8601": 2, "YYYY-MM-DD": 1}


def test_slots_are_made_once_an_expression(spark):
    rows = [(k, "*/30 * * * *" if k % 2 else "0 4 * * *", "Europe/Paris" if k % 3 else None) for k in range(12)] + [(None, "0 4 * * *", "UTC"), (5, "*/30 * * * *", "Europe/Paris"), (1, None, "UTC")]
    got = schedule.expected_slots(spark.createDataFrame(rows, "schedule_id long, expression string, tz string"), "2024-03-30", "2024-04-02", most=100)
    start, end = datetime(2024, 3, 30), datetime(2024, 4, 2)
    want = [(k, at) for k, e, tz in rows if e for at in schedule.slots(e, tz or "UTC", start, end, most=100)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "convert_timezone" not in plan  # schedules only take slots that stand in a table


def test_few_row_groups_are_dealt_over_the_cores(spark, tmp_path):
    from feedloom.functions.lineage import spread

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    dealt = spread(spark.read.parquet(str(tmp_path / "one"))).selectExpr("spark_partition_id() AS p")
    assert dealt.distinct().count() >= 4 and dealt.count() == 1000
