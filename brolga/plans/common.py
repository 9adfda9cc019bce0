"""SQL of the adapters, and rounding for comparison across engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brolga.functions.exprs import nearest

FRAMES = """frames as (
  select l_suppkey as file_index, l_suppkey % 10 as recording_id, idx, idx * 1000e0 / 30e0 as t,
         least(1e0, l_discount * 12) as w, case when l_linenumber <> 7 then l_extendedprice / 10000 end as macro_motion_energy,
         (l_quantity - 25) / 100 as gaze_x, (l_tax - 0.04e0) * 5 as gaze_y, l_extendedprice / 50000 - 1 as gaze_z,
         l_quantity / 50 as AU12, l_discount * 10 as AU6, l_tax * 10 as AU4,
         l_quantity / 60 as AU1, case when l_linenumber <> 6 then l_discount * 4 end as AU9, l_extendedprice / 80000 as AU25, l_tax * 6 as AU26,
         case when l_returnflag <> 'N' then 1e0 else 0e0 end as is_audio_active, case when l_linenumber <> 3 then l_tax * 12 end as face_confidence, case when l_linenumber = 1 then 1 else 0 end as is_blinking,
         l_returnflag as emotion_label
  from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 as idx from lineitem))"""

ASSIGNED = FRAMES + """,
assigned as (select *, unnest(range(greatest(0, floor((t - 2000) / 1000) + 1)::bigint, least(floor(t / 1000), ceil(mt / 1000) - 1)::bigint + 1)) as k
             from (select *, max(t) over (partition by file_index) as mt from frames))"""

INTERVALS = """intervals as (
  select conv_id as file_index, turn, past + pauses as start_ms, past + pauses + len as end_ms, role as label
  from (select *, coalesce(sum(len) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as past,
               sum(turn) over (partition by conv_id order by turn rows between unbounded preceding and current row)::bigint * 100 as pauses
        from (select *, coalesce(length(text), 0) * 50 as len from conversations)))"""

SCORED = """scored as (
  select l_suppkey % 6 as subject, l_suppkey as clip,
         row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 as window_id,
         case l_returnflag when 'A' then 'positive' when 'R' then 'negative' else 'neutral' end as label,
         l_quantity as quantity, case when l_linenumber <> 5 then l_extendedprice end as price, l_discount as discount, l_tax as tax from lineitem),
long as (select subject, clip, window_id, label, 'quantity' as channel, quantity as value from scored union all
         select subject, clip, window_id, label, 'price', price from scored union all
         select subject, clip, window_id, label, 'discount', discount from scored union all
         select subject, clip, window_id, label, 'tax', tax from scored)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, zero without sign."""
    of = lambda c: (nearest(F.col(c), digits) + 0.0).alias(c)
    return df.select(*[of(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(sql: str, digits: int = 6) -> str:
    """The same in SQL."""
    return f"round({sql}, {digits}) + 0e0"


def whole(c: str) -> Column:
    return F.col(c).cast("long").alias(c)
