"""Queries on the enrolment of sessions, file after file."""

from __future__ import annotations

from pyspark.sql import functions as F

from brolga.operators import pools
from brolga.plans.common import r, rounded
from brolga.sources.adapters import table


def sessions(spark, d):
    """Vectors as candidates of six sessions, twelve to a file: mixed with the session's first vector, its target, and its second, the other voice."""
    j, v = F.floor(F.col("vec_id") / 6), F.col("vec_id")
    rows = table(spark, d, "embeddings").select("vec_id", (v % 6).cast("string").alias("session"), j.alias("j"), F.col("embedding").cast("array<double>").alias("e"))
    ends = rows.where("j < 2").groupBy("session").agg(F.min_by(F.when(F.col("j") == 0, F.col("e")), F.when(F.col("j") == 0, v)).alias("t"), F.min_by(F.when(F.col("j") == 1, F.col("e")), F.when(F.col("j") == 1, v)).alias("o"))
    seed, click, anti = F.col("j").isin(0, 2), (F.col("j") == 6) & (v % 6 == 3), F.col("j") % 5 == 1
    target = F.when(seed, 2.0).when(click, 0.0).when(anti, 0.9 + (F.col("j") % 3) * 0.2 - (F.floor(F.col("j") / 12) % 4) * 0.5).otherwise((v % 11) * 0.35)
    other = F.when(seed, 0.0).when(click | anti, 2.0).otherwise((v % 7) * 0.25 + F.when(v % 6 == 5, 0.9).otherwise(0.0))
    mix = lambda a, b, w: F.zip_with(a, b, lambda x, y: x + w * y)
    return rows.join(ends, "session").select(
        "session",
        F.floor(F.col("j") / 12).alias("file_index"),
        v.alias("candidate_id"),
        F.when(seed, "seed").when(click, "click").when(anti, "anti").otherwise("voice").alias("kind"),
        mix(mix(F.col("e"), F.col("t"), target), F.col("o"), other).alias("vector"),
        (500 * (1 + v % 6) + (v % 7) * 300).alias("duration_ms"),
        (0.3 + (v % 13) / 13.0).alias("vad_coverage"),
        F.when(v % 9 != 0, 1 - (v % 8) / 30.0).alias("closed_share"),
    )


_LIKE_SEED = """base as (select vec_id, vec_id % 6 as s, vec_id // 6 as j, embedding::double[] as e from embeddings),
ends as (select s, arg_min(e, vec_id) filter (where j = 0) as t, arg_min(e, vec_id) filter (where j = 1) as o from base where j < 2 group by 1),
kinds as (select *, j // 12 as f, case when j in (0, 2) then 'seed' when j = 6 and s = 3 then 'click' when j % 5 = 1 then 'anti' else 'voice' end as kind from base join ends using (s)),
mixed as (select *, case kind when 'seed' then 2e0 when 'click' then 0e0 when 'anti' then 0.9e0 + (j % 3) * 0.2e0 - (j // 12 % 4) * 0.5e0 else (vec_id % 11) * 0.35e0 end as a,
       case kind when 'seed' then 0e0 when 'voice' then (vec_id % 7) * 0.25e0 + case when s = 5 then 0.9e0 else 0e0 end else 2e0 end as b, (500 * (1 + vec_id % 6) + (vec_id % 7) * 300)::double as w from kinds),
el as (select vec_id, s, f, kind, w, p, e[p] + a * t[p] + b * o[p] as x from (select *, unnest(range(1, len(e) + 1)) as p from mixed)),
size as (select vec_id, sqrt(sum(x * x)) as l from el group by 1),
seed as (select s, p, sum(w * x) as m from el where kind = 'seed' group by 1, 2),
like_seed as (select vec_id, sum(x * m) / (any_value(l) * sqrt(sum(m * m))) as sim from el join seed using (s, p) join size using (vec_id) group by 1)"""
_BASE = f"""{_LIKE_SEED},
foe as (select el.* from el join like_seed using (vec_id) where kind = 'click' or kind = 'anti' and sim <= 0.6),
files as (select distinct s, f from mixed),
before as (select files.s, files.f, p, sum(w * x) as m from files join foe on foe.s = files.s and (foe.f < files.f or kind = 'click' and foe.f = files.f) group by 1, 2, 3),
past as (select files.s, files.f, p, sum(w * x) as m from files join foe on foe.s = files.s and foe.f <= files.f group by 1, 2, 3),
cos1 as (select vec_id, sum(x * m) / (any_value(l) * sqrt(sum(m * m))) as sim from el join before using (s, f, p) join size using (vec_id) group by 1),
cos2 as (select vec_id, sum(x * m) / (any_value(l) * sqrt(sum(m * m))) as sim from el join past using (s, f, p) join size using (vec_id) group by 1),
gated as (select m.*, ls.sim as sim_seed, c1.sim as sim_anti, case when kind = 'voice' then
         case when 0.3 + (vec_id % 13) / 13e0 < 0.5 or vec_id % 9 <> 0 and 1 - (vec_id % 8) / 30e0 < 0.8 then 'A' when ls.sim < 0.7 then 'B' when c1.sim > 0.5 or ls.sim - c1.sim < 0.15 then 'C' end end as failed,
         c2.sim > 0.5 or ls.sim - c2.sim < 0.15 as still
       from mixed m join like_seed ls using (vec_id) left join cos1 c1 using (vec_id) left join cos2 c2 using (vec_id)),
part as (select *, case when kind = 'seed' or kind = 'voice' and failed is null then 1 when kind = 'voice' and failed = 'C' and not still then 2 end as part from gated),
grp as (select s, f, part, count(*) as n, sum(w)::bigint as ms from part where part is not null group by 1, 2, 3),
dots as (select a.s, a.f as fa, pa.part as qa, b.f as fb, pb.part as qb, a.vec_id, b.vec_id as other, sum(a.x * b.x) / (any_value(la.l) * any_value(lb.l)) as c
       from el a join part pa using (vec_id) join el b on b.s = a.s and b.p = a.p and b.vec_id > a.vec_id join part pb on pb.vec_id = b.vec_id join size la on la.vec_id = a.vec_id join size lb on lb.vec_id = b.vec_id
       where pa.part is not null and pb.part is not null group by all),
pairs as (select s, fa, qa, fb, qb, count(*) as k, sum(c) as c, sum(c * c) as c2 from dots group by all),
ordered as (select s, f, lag(f, 1, -1) over (partition by s order by f) as prev, exists (select 1 from past where past.s = files.s and past.f = files.f) as other from files),
run(s, f, ms, n, took, var, state, again) as (
  select distinct s, -1::bigint, 0::bigint, 0::bigint, []::bigint[], 0e0, '', 0::bigint from files
  union all
  select s, f, case when more then ms1 + ms2 else ms1 end, case when more then n1 + n2 else n1 end, case when more then list_append(took, f) else took end, case when more then v2 else v1 end,
         case when (case when more then ms1 + ms2 else ms1 end) >= enough and (case when more then v2 else v1 end) <= 0.05 then 'STRONG' when (case when more then ms1 + ms2 else ms1 end) >= 20000 then 'MARGINAL' else 'INSUFFICIENT' end,
         case when more then n2 else 0 end
  from (select *, n2 > 0 and other and ms1 >= 20000 and not (ms1 >= enough and v1 <= 0.05) as more from (
    select run.s, o.f, o.other, any_value(run.took) as took, case when o.other then 45000 else 60000 end as enough,
           any_value(run.ms) + coalesce(any_value(g1.ms), 0) as ms1, any_value(run.n) + coalesce(any_value(g1.n), 0) as n1, coalesce(any_value(g2.ms), 0) as ms2, coalesce(any_value(g2.n), 0) as n2,
           coalesce(greatest(0e0, sum(p.c2) filter (where p.in1) / nullif(sum(p.k) filter (where p.in1), 0) - pow(sum(p.c) filter (where p.in1) / nullif(sum(p.k) filter (where p.in1), 0), 2)), 0e0) as v1,
           coalesce(greatest(0e0, sum(p.c2) / sum(p.k) - pow(sum(p.c) / sum(p.k), 2)), 0e0) as v2
    from run join ordered o on o.s = run.s and o.prev = run.f left join grp g1 on g1.s = o.s and g1.f = o.f and g1.part = 1 left join grp g2 on g2.s = o.s and g2.f = o.f and g2.part = 2
      left join lateral (select pairs.*, (qa = 1 or list_contains(run.took, fa)) and (qb = 1 or list_contains(run.took, fb)) as in1 from pairs
        where pairs.s = o.s and fa <= o.f and fb <= o.f and (qa = 1 or fa = o.f or list_contains(run.took, fa)) and (qb = 1 or fb = o.f or list_contains(run.took, fb))) p on true
    group by run.s, o.f, o.other)))"""

CANDIDATES = f"""with recursive {_BASE}
select part.s::varchar as session, part.f as file_index, vec_id as candidate_id, kind, {r("sim_seed")} as sim_seed, {r("sim_anti")} as sim_anti, failed as failed_gate,
  cast(case when kind = 'seed' or kind = 'click' or kind = 'anti' and sim_seed <= 0.6 then 0 when part = 1 then 1 when part = 2 and list_contains(took, part.f) then 2 end as integer) as accepted_in
from part join run on run.s = part.s and run.f = part.f"""

FILES = f"""with recursive {_BASE},
own as (select a.s, f.f, count(distinct vec_id) as n from files f join foe a on a.s = f.s and a.f <= f.f group by 1, 2),
apair as (select a.s, greatest(a.f, b.f) as f, sum(a.x * b.x) / (any_value(la.l) * any_value(lb.l)) as c from foe a join foe b on a.s = b.s and a.p = b.p and a.vec_id < b.vec_id join size la on la.vec_id = a.vec_id join size lb on lb.vec_id = b.vec_id group by a.s, a.f, b.f, a.vec_id, b.vec_id),
avar as (select f.s, f.f, coalesce(greatest(0e0, avg(c * c) - pow(avg(c), 2)), 0e0) as v from files f join own on own.s = f.s and own.f = f.f left join apair a on a.s = f.s and a.f <= f.f group by 1, 2),
wide as (select s, f, v, coalesce(v - lag(v) over (partition by s order by f) > 0.05, false) as widened from avar),
held as (select run.s, run.f, el.p, sum(el.w * el.x) as m from run join part on part.s = run.s and part.f <= run.f and (part.part = 1 or part.part = 2 and part.f < run.f and list_contains(run.took, part.f)) join el on el.vec_id = part.vec_id group by 1, 2, 3),
mix as (select s, f, sum(held.m * past.m) / sqrt(sum(held.m * held.m) * sum(past.m * past.m)) as c from held join past using (s, f, p) group by 1, 2)
select run.s::varchar as session, run.f as file_index, state, ms as verified_ms, run.n as pool_size, {r("var")} as pool_variance, coalesce(own.n, 0) as anti_pool_size, {r("coalesce(wide.v, 0)")} as anti_variance, coalesce(widened, false) as anti_widened,
  {r("mix.c")} as contamination, case when mix.c > 0.6 then 'HALT' when mix.c > 0.45 then 'WARNING' else 'OK' end as level, again as second_pass, coalesce(bool_or(mix.c > 0.6) over (partition by run.s order by run.f), false) as halted, var > 0.05 as pool_wide
from run left join own using (s, f) left join wide using (s, f) left join mix using (s, f) where run.f >= 0"""


def enrolled_candidates(spark, d):
    """Each candidate with its likenesses, the gate that it failed and the pass that let it in."""
    rows, _ = pools.enrol(sessions(spark, d))
    return rounded(rows.select("session", "file_index", "candidate_id", "kind", "sim_seed", "sim_anti", "failed_gate", "accepted_in"))


def enrolled_files(spark, d):
    """The pools and their quality after each file of a session."""
    _, files = pools.enrol(sessions(spark, d))
    return rounded(files.drop("profile"))


ALL = {"enrolled_candidates": (enrolled_candidates, CANDIDATES), "enrolled_files": (enrolled_files, FILES)}
