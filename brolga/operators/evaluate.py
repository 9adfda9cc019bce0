"""Validation statistics over labelled windows: rank AUC, replication, pooling, leave-one-subject-out models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brolga.functions.exprs import island, percentile_rank
from brolga.functions.intervals import overlap, overlap_join
from brolga.functions.ranks import cumulated, pairs_won, quantile, quantiles

ADEQUATE = 30
HIGH = 0.60
EXPRESSED = 0.25
PURE = 0.6


def label_windows(windows: DataFrame, labels: DataFrame, on: list[str], width: float = 5000.0) -> DataFrame:
    """windows (on, window_id, start_ms, end_ms) with the label of largest overlap, 'Unlabeled' without, and the part it covers.

    labels: (on, start_ms, end_ms, label, ordinal); ties go to the smaller ordinal.
    """
    spans = labels.select(*on, F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), "label", "ordinal")
    met = overlap_join(windows, spans, on, width)
    met = met.withColumn("ov", overlap(F.col("start_ms"), F.col("end_ms"), F.col("r_start"), F.col("r_end")))
    best = met.groupBy(*on, "window_id").agg(F.max(F.struct("ov", (-F.col("ordinal")).alias("o"), "label")).alias("best"))
    out = windows.join(best, [*on, "window_id"], "left")
    length = F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms"))
    return out.select(*windows.columns, F.coalesce("best.label", F.lit("Unlabeled")).alias("label"), F.coalesce(F.col("best.ov") / length, F.lit(0.0)).alias("fraction"))


def pure(windows: DataFrame, least: float = PURE) -> DataFrame:
    return windows.where(F.col("fraction") >= least)


def rank_auc(rows: DataFrame, by: list[str], positive: Column, negative: Column, value: str = "value", least: int = 3) -> DataFrame:
    """Chance that a positive's value exceeds a negative's, ties half: by group; null under `least` a side.

    What counts as positive does not count as negative. A group is spread over tasks by its values.
    """
    rows = rows.where((positive | negative) & F.col(value).isNotNull())
    out = pairs_won(rows, by, value, positive, negative & ~positive)
    enough = (F.col("n_up") >= least) & (F.col("n_down") >= least)
    return out.select(*by, F.col("n_up").alias("n_pos"), F.col("n_down").alias("n_neg"), F.when(enough, F.col("won") / F.col("n_up") / F.col("n_down")).alias("auc"))


def is_label(name: str) -> Column:
    return F.col("label") == name


def within_clip_percentile(rows: DataFrame) -> DataFrame:
    """rows with pct: percentile rank of |value| among the clip's of the channel."""
    return rows.withColumn("pct", percentile_rank(F.abs("value"), F.col("subject"), F.col("clip"), F.col("channel")))


def centred(rows: DataFrame) -> DataFrame:
    """rows with centred: value less the median of the clip and channel."""
    return rows.withColumn("centred", F.col("value") - F.median("value").over(W.partitionBy("subject", "clip", "channel")))


def direction(positive: Column, negative: Column, least: float = EXPRESSED) -> Column:
    d = positive - negative
    return F.when(F.abs(d) >= least, F.signum(d)).otherwise(0.0).cast("int")


def subject_scores(rows: DataFrame) -> DataFrame:
    """(subject, channel): AUC of within-clip |value| percentiles, direction of the centred medians, counts per class.

    Percentiles and centring are by clip, whose windows are one group; what is by subject is spread by value.
    """
    rows = centred(within_clip_percentile(rows)).where(is_label("positive") | is_label("negative"))
    both = F.explode(F.array(F.struct(F.lit("pct").alias("of"), F.col("pct").alias("x")), F.struct(F.lit("centred").alias("of"), F.col("centred").alias("x")))).alias("_s")
    rows = rows.select("subject", "channel", "label", both).select("subject", "channel", "label", "_s.of", "_s.x")
    told = cumulated(rows, ["subject", "channel", "of"], "x", {"up": F.count(F.when(is_label("positive"), 1)), "down": F.count(F.when(is_label("negative"), 1))})
    won = F.sum(F.col("up") * (F.col("down_before") + F.col("down") / 2))
    by = told.groupBy("subject", "channel", "of").agg(F.max("up_total").alias("n_pos"), F.max("down_total").alias("n_neg"), won.alias("won"), quantile("x", "up", 0.5).alias("pos"), quantile("x", "down", 0.5).alias("neg"))
    of = lambda kind, c: F.max(F.when(F.col("of") == kind, F.col(c)))
    out = by.groupBy("subject", "channel").agg(of("pct", "n_pos").alias("n_pos"), of("pct", "n_neg").alias("n_neg"), of("pct", "won").alias("won"), of("centred", "pos").alias("pos"), of("centred", "neg").alias("neg"))
    enough = (F.col("n_pos") >= 3) & (F.col("n_neg") >= 3)
    auc = F.when(enough, F.col("won") / F.col("n_pos") / F.col("n_neg"))
    return out.select("subject", "channel", "n_pos", "n_neg", auc.alias("auc"), direction(F.col("pos"), F.col("neg")).alias("dir"))


def class_medians(rows: DataFrame, by: list[str], value: str, labels: tuple[str, ...]) -> DataFrame:
    """(by, and med_<label> for each label): exact medians of the classes, of any size; null for a class without values."""
    mid = quantiles(rows.where(F.col("label").isin(*labels)), [*by, "label"], value, {"_m": 0.5})
    return mid.groupBy(*by).agg(*[F.max(F.when(is_label(x), F.col("_m"))).alias(f"med_{x}") for x in labels])


def verdicts(scores: DataFrame, more: tuple[Column, ...] = ()) -> DataFrame:
    """By channel: whether its AUC is high in two thirds of the adequate subjects, and always in one direction.

    scores: (subject, channel, n_pos, n_neg, auc, dir); more: other aggregates by channel.
    """
    adequate = (F.col("n_pos") >= ADEQUATE) & (F.col("n_neg") >= ADEQUATE) & F.col("auc").isNotNull()
    n = F.count(F.when(adequate, 1))
    out = scores.groupBy("channel").agg(
        n.alias("n_adequate"),
        F.count(F.when(adequate & (F.col("auc") >= HIGH), 1)).alias("high"),
        F.count(F.when(adequate & (F.col("dir") > 0), 1)).alias("up"),
        F.count(F.when(adequate & (F.col("dir") < 0), 1)).alias("down"),
        *more,
    )
    need = F.ceil(F.col("n_adequate") * 2 / 3)
    magnitude = F.col("high") >= need
    one_way = (F.col("up") + F.col("down") >= need) & ((F.col("up") == 0) | (F.col("down") == 0))
    verdict = (
        F.when(F.col("n_adequate") < 2, "INSUFFICIENT-DATA")
        .when(one_way, F.when(magnitude, "REPLICATES").otherwise("DIRECTION-ONLY"))
        .when(F.col("high") > 0, "SUBJECT-SPECIFIC")
        .otherwise("NO-SIGNAL")
    )
    return out.withColumn("verdict", verdict)


def scorecard(scores: DataFrame, subjects: list, tracked: list[str]) -> DataFrame:
    """A row for each channel, with auc_<subject> and dir_<subject>, in order: the tracked channels before others, then by
    verdict, then by name. place is that order; `tracked` names the channels that were to be followed, whatever they score."""
    wide = tuple(F.max(F.when(F.col("subject") == s, F.col(k))).alias(f"{k}_{s}") for s in subjects for k in ("auc", "dir"))
    rows = verdicts(scores, wide).withColumn("tracked", F.col("channel").isin(tracked) if tracked else F.lit(False))
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("tracked"), "verdict", "channel")  # a row for each channel, which are few
    return rows.withColumn("place", F.row_number().over(order)).orderBy("place")


def every_second(rows: DataFrame) -> DataFrame:
    """Every other window of a clip, so that none overlap."""
    n = F.row_number().over(W.partitionBy("subject", "clip", "channel").orderBy("window_id"))
    return rows.withColumn("_n", n).where("_n % 2 = 1").drop("_n")


def domination(rows: DataFrame, top: int = 5) -> DataFrame:
    """(subject): how much of a window's sum of squares its largest channel and its largest `top` ones hold, median and p90."""
    window = W.partitionBy("subject", "clip", "window_id")
    sq = rows.where("value is not null").withColumn("_s", F.col("value") * F.col("value"))
    sq = sq.withColumn("_n", F.row_number().over(window.orderBy(F.desc("_s"), "channel")))
    by = sq.groupBy("subject", "clip", "window_id").agg(
        F.try_divide(F.max("_s"), F.sum("_s")).alias("one"), F.try_divide(F.sum(F.when(F.col("_n") <= top, F.col("_s"))), F.sum("_s")).alias("some")
    )
    return by.groupBy("subject").agg(F.median("one").alias("median_one"), F.percentile("one", 0.9).alias("p90_one"), F.median("some").alias("median_some"))


def alternative_norms(rows: DataFrame, drop: int = 5) -> DataFrame:
    """(subject, clip, window_id, label) with four ways to sum |value|: root of squares, median, without the largest, count over 3."""
    window = W.partitionBy("subject", "clip", "window_id")
    z = rows.where("value is not null").withColumn("_a", F.abs("value"))
    z = z.withColumn("_n", F.row_number().over(window.orderBy(F.desc("_a"), "channel")))
    return z.groupBy("subject", "clip", "window_id", "label").agg(
        F.sqrt(F.sum(F.col("_a") * F.col("_a"))).alias("l2"),
        F.median("_a").alias("median"),
        F.sqrt(F.coalesce(F.sum(F.when(F.col("_n") > drop, F.col("_a") * F.col("_a"))), F.lit(0.0))).alias("l2_rest"),
        F.count(F.when(F.col("_a") > 3, 1)).alias("over_3"),
    )


def auc_error(auc: Column, n_pos: Column, n_neg: Column) -> Column:
    """Standard error of an AUC after Hanley and McNeil (1982)."""
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    return F.sqrt(F.greatest(F.lit(1e-9), (auc * (1 - auc) + (n_pos - 1) * (q1 - auc * auc) + (n_neg - 1) * (q2 - auc * auc)) / (n_pos * n_neg)))


def random_effects(scores: DataFrame) -> DataFrame:
    """Pooled AUC by channel after DerSimonian and Laird: (k, pooled, se, tau2, q, i2). scores: (channel, auc, se)."""
    w = 1 / (F.col("se") * F.col("se"))
    rows = scores.where("auc is not null").withColumn("w", w)
    fixed = F.sum(F.col("w") * F.col("auc")) / F.sum("w")
    sums = rows.groupBy("channel").agg(F.count("*").alias("k"), fixed.alias("fixed"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"))
    rows = rows.join(sums, "channel")
    q = F.sum(F.col("w") * (F.col("auc") - F.col("fixed")) * (F.col("auc") - F.col("fixed")))
    het = rows.groupBy("channel", "k", "sw", "sw2").agg(q.alias("q"))
    spread = F.col("sw") - F.col("sw2") / F.col("sw")
    tau2 = F.when(spread > 0, F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / spread)).otherwise(0.0)
    i2 = F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / F.col("q"))).otherwise(0.0)
    het = het.select("channel", "k", "q", tau2.alias("tau2"), i2.alias("i2"))
    rows = rows.select("channel", "auc", "se").join(het, "channel").withColumn("v", 1 / (F.col("se") * F.col("se") + F.col("tau2")))
    return rows.groupBy("channel", "k", "q", "tau2", "i2").agg(
        (F.sum(F.col("v") * F.col("auc")) / F.sum("v")).alias("pooled"), (1 / F.sqrt(F.sum("v"))).alias("se")
    )


def candidates(pooled: DataFrame, consistency: DataFrame) -> DataFrame:
    """Channels whose 95 % interval leaves out one half, in four subjects or more, without much heterogeneity; strongest first."""
    rows = pooled.join(consistency, "channel").withColumns({"low": F.col("pooled") - 1.96 * F.col("se"), "high": F.col("pooled") + 1.96 * F.col("se")})
    fit = (F.col("k") >= 4) & ((F.col("low") > 0.5) | (F.col("high") < 0.5)) & (F.col("i2") < 0.6) & (F.col("consistency") >= 0.66)
    return rows.where(fit).orderBy(F.desc(F.abs(F.col("pooled") - 0.5)), "channel")


def answer_segments(windows: DataFrame) -> DataFrame:
    """windows (subject, clip, window_id, label) with seg: stretches of one label in the order of the clip."""
    order = W.partitionBy("subject", "clip").orderBy("window_id")
    return windows.withColumn("seg", island(F.coalesce(F.col("label") != F.lag("label").over(order), F.lit(True)), order))


def strongest_channel(rows: DataFrame) -> DataFrame:
    """For each subject the channel of highest AUC of subject-wide |value| percentiles; ties to the first by name.

    Percentiles are in the order of what they rank, so the AUC is that of |value| itself.
    """
    auc = rank_auc(rows.withColumn("_size", F.abs("value")), ["subject", "channel"], is_label("positive"), is_label("negative"), "_size")
    best = F.row_number().over(W.partitionBy("subject").orderBy(F.desc_nulls_last("auc"), "channel"))
    return auc.withColumn("n", best).where("n = 1").drop("n")


def focus_clip(windows: DataFrame, least: int = 20) -> DataFrame:
    """For each subject the clip in which the smaller class is largest, if it has `least` of either."""
    n = windows.groupBy("subject", "clip").agg(F.count(F.when(is_label("positive"), 1)).alias("n_pos"), F.count(F.when(is_label("negative"), 1)).alias("n_neg"))
    n = n.where(F.least("n_pos", "n_neg") >= least)
    best = F.row_number().over(W.partitionBy("subject").orderBy(F.desc(F.least("n_pos", "n_neg")), "clip"))
    return n.withColumn("r", best).where("r = 1").drop("r")


def stability(windows: DataFrame, value: str, baseline: Column) -> DataFrame:
    """By subject: medians of both classes and the baseline, shares over the baseline's p95 of all three, and whether the
    negative class stays near the baseline in both."""
    p95 = windows.where(baseline).groupBy("subject").agg(F.percentile(value, 0.95).alias("p95"), F.median(value).alias("base"))
    over = (F.col(value) > F.col("p95")).cast("double")
    side = lambda f, x: f(F.when(is_label(x), F.col(value)))
    flag = lambda x: F.avg(F.when(x, over))
    out = windows.join(p95, "subject").groupBy("subject", "base").agg(
        side(F.median, "positive").alias("med_pos"),
        side(F.median, "negative").alias("med_neg"),
        flag(baseline & F.col(value).isNotNull()).alias("flag_base"),
        flag(is_label("positive")).alias("flag_pos"),
        flag(is_label("negative")).alias("flag_neg"),
    )
    near = F.abs(F.col("med_neg") - F.col("base")) <= F.greatest(F.lit(1.0), 0.5 * F.abs(F.col("med_pos") - F.col("base")))
    return out.withColumn("stable", near & (F.col("flag_neg") <= F.col("flag_base") + 0.15))


def coupling_bars(aucs: DataFrame, telling: list[str], eye: str, strong: float = 0.69, close: float = 0.66, apart: float = 0.55) -> DataFrame:
    """By subject three bars over channel AUCs (subject, channel, auc): the best one reaches `strong` (PASS) or `close` (MISS);
    one of the telling channels is among the three best (ties by name, no AUC as 0); the eye channel reaches `apart`."""
    order = W.partitionBy("subject").orderBy(F.desc(F.coalesce("auc", F.lit(0.0))), "channel")
    rows = aucs.withColumn("_n", F.row_number().over(order))
    out = rows.groupBy("subject").agg(
        F.max("auc").alias("best"),
        F.max(F.when(F.col("_n") <= 3, F.col("channel").isin(telling))).alias("_told"),
        F.max(F.when(F.col("channel") == eye, F.col("auc"))).alias("eye"),
    )
    grade = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL")
    bar_1 = F.when(F.col("best") >= strong, "PASS").when(F.col("best") >= close, "MISS").otherwise("FAIL")
    return out.select("subject", "best", "eye", bar_1.alias("bar_1"), grade(F.col("_told")).alias("bar_2"), grade(F.col("eye") >= apart).alias("bar_3"))


def channel_ranking(rows: DataFrame, best: int = 20, worst: int = 5) -> DataFrame:
    """The channels of highest and of lowest AUC of |value|, positive against negative, with the medians of |value| by class
    and their place from the top (ties by name). rows: (channel, label, value); channels without an AUC are left out."""
    size = rows.withColumn("_a", F.abs("value"))
    auc = rank_auc(size, ["channel"], is_label("positive"), is_label("negative"), "_a").where("auc is not null")
    mid = class_medians(size, ["channel"], "_a", ("positive", "negative"))
    every = W.partitionBy(F.lit(0))  # a row for each channel, which are few
    out = auc.join(mid, "channel").withColumns({"place": F.row_number().over(every.orderBy(F.desc("auc"), "channel")), "_n": F.count("*").over(every)})
    return out.where((F.col("place") <= best) | (F.col("place") > F.col("_n") - worst)).drop("_n")


#: Spellings of labels that are taken for one another.
SPELLINGS = {"lie": "Lie", "lies": "Lie", "lei": "Lie", "truth": "Truth", "thruth": "Truth", "true": "Truth", "neutral": "Neutral", "netural": "Neutral"}


def normal_label(x: Column, spellings: dict[str, str] = SPELLINGS) -> Column:
    known = F.create_map(*[F.lit(v) for kv in spellings.items() for v in kv])
    return F.coalesce(known[F.lower(F.trim(x))], F.trim(x))


def compare_runs(now: DataFrame, before: DataFrame) -> DataFrame:
    return now.join(before.select("subject", "channel", F.col("auc").alias("auc_before")), ["subject", "channel"], "left").withColumn("change", F.col("auc") - F.col("auc_before"))


def package_checks(clips: DataFrame, labels: DataFrame, media: DataFrame, thin_ms: int = 10_000, short_s: float = 60.0, thin_s: float = 120.0) -> DataFrame:
    """Checks of a package (subject): PASS, WARN, FAIL or SKIP each, and the worst of them.

    clips: (subject, clip, baseline), clip null for one without a number; labels: (subject, clip, start_ms, end_ms, label);
    media: (subject, clip, duration_s, has_video, has_audio) of the clips that were probed. v1: two clips; v2: one baseline,
    all clips numbered; v3: numbers unique; e1: every numbered clip but the baseline has labels, and no others have; e2:
    intervals have length; e3: labels are known; e4: 10 s of them in a clip; m1: streams there; m2: the baseline is long
    enough.
    """
    known = F.col("label").isin("positive", "negative", "neutral")
    numbers = clips.where("clip is not null").groupBy("subject", "clip").agg(F.count("*").alias("n"), F.max(F.col("baseline").cast("int")).alias("base"))
    c = clips.groupBy("subject").agg(
        F.count("*").alias("clips"), F.count(F.when(F.col("baseline"), 1)).alias("bases"), F.count(F.when(F.col("clip").isNull(), 1)).alias("loose")
    ).join(numbers.groupBy("subject").agg(F.max("n").alias("same")), "subject", "left")
    of = labels.groupBy("subject", "clip").agg(
        F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("ms"), F.max((F.col("end_ms") <= F.col("start_ms")).cast("int")).alias("bad"), F.max((~known).cast("int")).alias("odd")
    )
    met = numbers.join(of, ["subject", "clip"], "full")
    e = met.groupBy("subject").agg(
        F.count(F.when(F.col("ms").isNotNull(), 1)).alias("labelled"),
        F.count(F.when((F.col("base") == 0) & F.col("ms").isNull(), 1)).alias("unlabelled"),
        F.count(F.when(F.col("n").isNull(), 1)).alias("orphans"),
        F.max("bad").alias("bad"),
        F.max("odd").alias("odd"),
        F.min("ms").alias("least"),
    )
    first = numbers.where("base = 1").select("subject", "clip", F.lit(True).alias("first"))
    m = media.join(first, ["subject", "clip"], "left").groupBy("subject").agg(
        F.max((~(F.col("has_video") & F.col("has_audio"))).cast("int")).alias("broken"), F.max(F.when(F.col("first"), F.col("duration_s"))).alias("base_s")
    )
    rows = c.join(e, "subject", "left").join(m, "subject", "left")
    grade = lambda *cases: F.coalesce(*[F.when(F.coalesce(x, F.lit(False)), y) for x, y in cases], F.lit("PASS"))
    none = F.coalesce("labelled", F.lit(0)) == 0
    checks = {
        "v1": grade((F.col("clips") < 2, "FAIL")),
        "v2": grade((F.col("bases") != 1, "FAIL"), (F.col("loose") > 0, "WARN")),
        "v3": grade((F.col("same") > 1, "FAIL")),
        "e1": grade((none, "WARN"), (F.col("unlabelled") > 0, "FAIL"), (F.col("orphans") > 0, "WARN")),
        "e2": grade((none, "SKIP"), (F.col("bad") == 1, "FAIL")),
        "e3": grade((none, "SKIP"), (F.col("odd") == 1, "WARN")),
        "e4": grade((none, "SKIP"), (F.col("least") < thin_ms, "WARN")),
        "m1": grade((F.col("broken").isNull(), "SKIP"), (F.col("broken") == 1, "FAIL")),
        "m2": grade((F.col("broken").isNull() | (F.col("bases") != 1), "SKIP"), (F.col("base_s").isNull(), "WARN"), (F.col("base_s") < short_s, "FAIL"), (F.col("base_s") < thin_s, "WARN")),
    }
    rows = rows.select("subject", *[x.alias(n) for n, x in checks.items()])
    every = F.array(*checks)
    return rows.withColumn("overall", F.when(F.array_contains(every, "FAIL"), "FAIL").when(F.array_contains(every, "WARN"), "WARN").otherwise("PASS"))


def readiness(subjects: DataFrame, least: int = 2) -> DataFrame:
    """subjects (subject, overall, recorded, labelled) with state and go: whether all of them may be scored.

    READY has a recording and labels, others are PENDING; overall null is SKIPPED. Nothing goes ahead if a package FAILs or
    fewer than `least` are READY.
    """
    state = F.when(F.coalesce(F.col("recorded") & F.col("labelled"), F.lit(False)), "READY").otherwise("PENDING")
    all_ = subjects.agg(F.count(F.when(F.col("overall") == "FAIL", 1)).alias("_bad"), F.count(F.when(state == "READY", 1)).alias("_ready"))
    rows = subjects.crossJoin(F.broadcast(all_))
    return rows.select("subject", F.coalesce("overall", F.lit("SKIPPED")).alias("intake"), state.alias("state"), ((F.col("_bad") == 0) & (F.col("_ready") >= least)).alias("go"))


def _folds(rows: DataFrame, channels: list[str], c: float, make=None, least: int = 0):
    """(held-out subject, its scored rows, model) for each subject that has `least` of both classes."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = rows.where(F.col("label").isin("positive", "negative")).na.fill(0.0, channels).withColumn("y", is_label("positive").cast("double"))
    # each fold reads them several times: written once to the shared folder, they are not centred anew for each pass
    rows = VectorAssembler(inputCols=channels, outputCol="_x").transform(rows).select("subject", "clip", "window_id", "label", "y", "_x").checkpoint()
    n = {(r.subject, r.y): r["count"] for r in rows.groupBy("subject", "y").count().collect()}
    for s in sorted({k for k, _ in n}):
        train, test = rows.where(F.col("subject") != s), rows.where(F.col("subject") == s)
        neg, pos = (sum(x for (k, y), x in n.items() if k != s and y == label) for label in (0.0, 1.0))
        if not (neg and pos) or min(n.get((s, 0.0), 0), n.get((s, 1.0), 0)) < least:
            continue
        train = train.withColumn("w", F.when(F.col("y") == 1, (neg + pos) / (2 * pos)).otherwise((neg + pos) / (2 * neg)))
        scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True).fit(train)
        make_one = make or (lambda n: LogisticRegression(featuresCol="_z", labelCol="y", weightCol="w", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False))
        model = make_one(neg + pos).fit(scaler.transform(train))
        said = model.transform(scaler.transform(test)).select("subject", "clip", "window_id", "label", vector_to_array("probability")[1].alias("score"))
        yield s, said, model


def loso(rows: DataFrame, channels: list[str], c: float = 0.5, make=None, least: int = 0) -> DataFrame:
    """Leave-one-subject-out logistic model over centred channels: (subject, clip, window_id, label, score) of held-out rows.

    rows: wide, label positive or negative. Missing values are 0; columns are scaled on the training subjects; classes weigh
    alike; L2 strength 1/(c*n). One fit for each subject (few) runs on all its training rows. make(n) may give another
    estimator. Subjects with under `least` rows of a class are not scored. A panel of channels is a shorter list of them.
    """
    out = None
    for _, said, _ in _folds(rows, channels, c, make, least):
        out = said if out is None else out.union(said)
    return out


def loso_coefficients(rows: DataFrame, channels: list[str], c: float = 0.5, least: int = 0) -> DataFrame:
    """(channel, subject, weight): what each held-out subject's model weighs the scaled channels with."""
    found = [(x, s, float(w)) for s, _, model in _folds(rows, channels, c, least=least) for x, w in zip(channels, model.coefficients, strict=True)]
    kind = rows.schema["subject"].dataType.simpleString()
    return rows.sparkSession.createDataFrame(found, f"channel string, subject {kind}, weight double")


def flag_rate(said: DataFrame, bound: float = 0.5) -> DataFrame:
    """By subject the share of held-out negative rows that score over the bound."""
    over = F.avg(F.when(is_label("negative"), (F.col("score") > bound).cast("double")))
    return said.groupBy("subject").agg(over.alias("flagged"), F.count(F.when(is_label("negative"), 1)).alias("n_neg"))


def loso_summary(aucs: DataFrame) -> DataFrame:
    """Mean, deviation and verdict over held-out AUCs (subject, auc)."""
    s = aucs.agg(F.avg("auc").alias("mean"), F.stddev_samp("auc").alias("sd"), F.count(F.when(F.col("auc") >= 0.58, 1)).alias("clear"), F.count("auc").alias("n"))
    verdict = (
        F.when(F.col("mean").isNull(), "INSUFFICIENT")
        .when((F.col("mean") >= 0.62) & (F.col("clear") >= 4), "GENERALIZES")
        .when(F.col("mean") >= 0.55, "WEAK/PARTIAL")
        .otherwise("SUBJECT-SPECIFIC")
    )
    return s.withColumn("verdict", verdict)


def labelled_windows(windows: DataFrame, labels: DataFrame) -> DataFrame:
    """Windows of recordings on the clock of their clip, without baseline clips and clips that have no labels.

    windows: (subject, clip, window_id, start_ms); labels: (subject, clip). The baseline is a subject's lowest clip.
    """
    clip, subject = W.partitionBy("subject", "clip"), W.partitionBy("subject")
    rows = windows.withColumns({"local_ms": F.col("start_ms") - F.min("start_ms").over(clip), "_base": F.min("clip").over(subject)})
    return rows.where("clip <> _base").drop("_base").join(labels.select("subject", "clip").distinct(), ["subject", "clip"], "left_semi")
