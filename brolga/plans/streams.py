"""Queries of the capture of windows, in batches and as streams over given tables, each stream with the SQL of its batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from brolga.operators import enroll
from brolga.plans.common import FRAMES, r, rounded
from brolga.sources.adapters import frames, table
from brolga.streaming import jobs


def observations(spark, d):
    """What frames stand for as observations: channels as the two mouths, one absence and one turn of the head now and then."""
    k = F.col("idx")
    return frames(spark, d).select(
        "file_index",
        F.floor(F.col("timestamp")).cast("long").alias("t_ms"),
        (F.floor(k / 7) % 11 != 3).alias("here"),
        (F.floor(k / 5) % 9 == 2).alias("turned"),
        F.when(k % 13 != 5, F.abs("gaze_x")).alias("mar"),
        (F.floor(k / 6) % 5 < 2).alias("other_here"),
        F.when(k % 17 != 2, F.col("AU6") / 4).alias("other_mar"),
        (F.floor(k / 20) % 3 != 1).alias("speech"),
    )


_SEEN = f"""{FRAMES}, obs as (select file_index as f, idx as k, floor(t)::bigint as t, idx // 7 % 11 <> 3 as here, idx // 5 % 9 = 2 as turned, case when idx % 13 <> 5 then abs(gaze_x) end as mar,
  idx // 6 % 5 < 2 as oh, case when idx % 17 <> 2 then AU6 / 4 end as om, idx // 20 % 3 <> 1 as speech from frames)"""


def smoothed_mouth(spark, d):
    rows = enroll.smoothed(observations(spark, d), "mar", "here", "turned")
    return rounded(rows.select("file_index", "t_ms", "smoothed"))


SMOOTHED = f"""with recursive {_SEEN}, run(f, k, m) as (select distinct f, -1::bigint, null::double from obs union all
  select o.f, o.k, case when not here then null when mar is not null and not turned then case when m is null then mar else m + (mar - m) / 3e0 end else m end from run join obs o on o.f = run.f and o.k = run.k + 1)
select o.f as file_index, t as t_ms, {r("m")} as smoothed from run join obs o on o.f = run.f and o.k = run.k"""


def capture_windows(spark, d):
    return enroll.capture_windows(observations(spark, d))


CAPTURES = f"""with recursive {_SEEN},
run as (select distinct f, -1::bigint as k, null::double as target, null::double as other, null::bigint as opened, null::bigint as deadline, null::bigint as before, 0 as c1, 0 as c2, 0 as c3,
    null::bigint as e0, null::bigint as e1, null::varchar as why, 0 as n1, 0 as n2, 0 as n3 from obs
  union all
  select f, k, target, other, nopen, case when opened is null or fin then null else ndead end, t, case when nopen is null then 0 else b1 + 1 end, case when nopen is null then 0 else b2 + oh::int end, case when nopen is null then 0 else b3 + coalesce(oh and other < 0.1, false)::int end,
    case when fin then opened end, case when fin then case when why = 'expired' then deadline else t end end, case when fin then why end, case when fin then c1 else 0 end, case when fin then c2 else 0 end, case when fin then c3 else 0 end
  from (select *, case when fin or opened is null then case when talks and not turned then t end else opened end as nopen, case when fin then 0 else c1 end as b1, case when fin then 0 else c2 end as b2, case when fin then 0 else c3 end as b3
    from (select *, why is not null as fin, case when deadline is null then case when (not here or not speech or coalesce(target < 0.1, false)) and not turned then t + 500 end when turned then deadline + t - before when talks then null else deadline end as ndead
      from (select *, case when opened is not null and deadline is not null and not turned then case when t >= deadline then 'expired' when oh and coalesce(other > 0.15, false) then 'interjection' end end as why
        from (select *, here and coalesce(target > 0.15, false) and speech as talks
          from (select o.f, o.k, o.t, o.here, o.turned, o.oh, o.speech, run.opened, run.deadline, run.before, run.c1, run.c2, run.c3,
              case when not here then null when mar is not null and not turned then case when run.target is null then mar else run.target + (2e0 / 6e0) * (mar - run.target) end else run.target end as target,
              case when not oh then null when om is not null then case when run.other is null then om else run.other + (2e0 / 6e0) * (om - run.other) end else run.other end as other
            from run join obs o on o.f = run.f and o.k = run.k + 1))))))
select f as file_index, e0 as start_ms, e1 as stop_ms, why as reason, n1 as frames, n2 as other_frames, n3 as other_closed from run where why is not null
union all select f, opened, before, 'end', c1, c2, c3 from (select *, row_number() over (partition by f order by k desc) as n from run) where n = 1 and opened is not null"""


def captured_stream(spark, d):
    """The same windows from a stream of the observations, each file ended by a row without a time."""
    path = jobs.shared_dir(spark)
    rows = observations(spark, d)
    ends = rows.select("file_index").distinct().select("file_index", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[1:]])
    whole = rows.unionByName(ends)
    whole.write.parquet(path)
    return jobs.drained(jobs.capture_stream(spark.readStream.schema(whole.schema).parquet(path), None))


def _event_stream(spark, d):
    rows = table(spark, d, "events")
    return spark.readStream.schema(rows.schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def state_changes(spark, d):
    """Of each user's events, as states of a session, those that change it."""
    told = jobs.changes(_event_stream(spark, d).select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("state"), F.col("ts").alias("updated_at")), None)
    out = jobs.drained(told)
    return out.select("session_id", "state", F.unix_micros("updated_at").alias("at_us"))


CHANGED = """select user_id::varchar as session_id, event_type as state, epoch_us(ts) as at_us from (select *, lag(event_type) over (partition by user_id order by ts, event_type) as past from events where event_type is not null) where event_type is distinct from past"""


def sliding_stream(spark, d):
    """Sliding means of events, weighted by the k of their properties; windows that end before the watermark at the end of the table."""
    k = F.get_json_object("props", "$.k").cast("double") / 100
    rows = _event_stream(spark, d).select((F.col("user_id") % 10).alias("file_index"), "ts", k.alias("joint_confidence"), "value")
    out = jobs.drained(jobs.sliding(rows, "2 hours", "1 hour", "30 minutes"))
    return rounded(out.select("file_index", F.unix_micros("start").alias("start_us"), "frame_count", "mean"), 9)


SLIDING = f"""with e as (select user_id % 10 as f, epoch_us(ts) as t, coalesce(json_extract_string(props, '$.k')::double / 100, 0) as w, value from events),
w as (select *, unnest([t // 3600000000 * 3600000000, t // 3600000000 * 3600000000 - 3600000000]) as s from e)
select f as file_index, s as start_us, count(*) as frame_count, {r("sum(w * value) / nullif(sum(case when value is not null then w end), 0)", 9)} as mean from w
group by 1, 2 having s + 7200000000 <= (select max(t) // 1000 * 1000 - 1800000000 from e)"""

ALL = {
    "smoothed_mouth": (smoothed_mouth, SMOOTHED),
    "capture_windows": (capture_windows, CAPTURES),
    "captured_stream": (captured_stream, CAPTURES),
    "state_changes": (state_changes, CHANGED),
    "sliding_stream": (sliding_stream, SLIDING),
}
