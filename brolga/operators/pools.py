"""Enrolment over the files of a session: what the pools hold after each file decides what the next one's gates let in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brolga.functions.exprs import cosine
from brolga.functions.vectors import moments, unit, vector_sums
from brolga.operators.enroll import too_like, triple_gate

#: Bounds of the pools: enough ms for either quality (more without an anti profile), the widest pool that is STRONG, how much a
#: pool may widen from one file to the next, and how like the other voice the target's pool may be.
STRONG_MS, STRONG_ALONE_MS, MARGINAL_MS, WIDE, WIDER, WARNING, HALT = 45_000, 60_000, 20_000, 0.05, 0.05, 0.45, 0.60

_KINDS = ("seed", "voice", "anti", "click")
_FILES = (
    "session string, file_index long, state string, verified_ms long, pool_size long, pool_variance double, anti_pool_size long, "
    "anti_variance double, anti_widened boolean, contamination double, level string, second_pass long, halted boolean, pool_wide boolean, profile array<double>"
)


def _in_order(files: DataFrame, begin: Callable[[], Callable[[pd.Series], tuple]], schema: str) -> DataFrame:
    """What a fold of its own makes of each session's files (session, file_index, ...) in order. Files pass in Arrow batches, so
    that a worker holds a batch and what the fold keeps, however many files there are."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = fold = None
        for pdf in parts:
            out = []
            for _, row in pdf.iterrows():
                if fold is None or row.session != session:
                    session, fold = row.session, begin()
                out.append(fold(row))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return files.repartition("session").sortWithinPartitions("session", "file_index").mapInPandas(run, schema)


def _anti_profiles() -> Callable[[pd.Series], tuple]:
    """Fold over a session's files: the anti profile that gates a file's voices and the one after the file's own candidates."""
    total = None

    def step(row: pd.Series) -> tuple:
        nonlocal total
        out = []
        for values in (row.clicked, row.own):
            if values is not None:
                total = np.asarray(values, float) + (0 if total is None else total)
            size = 0.0 if total is None else np.sqrt(total @ total)
            out.append(None if total is None else total / (size or 1.0))
        return (row.session, row.file_index, *out)

    return step


def _spread(n: int, s: np.ndarray, m: np.ndarray) -> float:
    """Population variance of the cosines of all pairs; 0 for under two."""
    if n < 2:
        return 0.0
    pairs = n * (n - 1)
    mean = (s @ s - n) / pairs
    return max(0.0, (m @ m - n) / pairs - mean * mean)


class _Pool:
    """How many vectors, how long, their weighted sum, and the moments of their unit vectors."""

    def __init__(self) -> None:
        self.n, self.ms, self.units = 0, 0, 0
        self.total = self.s = self.m = None

    def take(self, row: pd.Series, kind: str) -> int:
        n = row[f"n_{kind}"]
        if n != n or not n:
            return 0
        plus = lambda a, b: np.asarray(b, float) if a is None else a + np.asarray(b, float)
        self.n, self.ms, self.total = self.n + int(n), self.ms + int(row[f"ms_{kind}"]), plus(self.total, row[f"total_{kind}"])
        if row[f"units_{kind}"] == row[f"units_{kind}"]:
            self.units += int(row[f"units_{kind}"])
            self.s, self.m = plus(self.s, row[f"s_{kind}"]), plus(self.m, row[f"m_{kind}"])
        return int(n)

    def variance(self) -> float:
        return _spread(self.units, self.s, self.m) if self.units > 1 else 0.0

    def profile(self) -> np.ndarray | None:
        return None if self.total is None else self.total / (np.sqrt(self.total @ self.total) or 1.0)


def _fold() -> Callable[[pd.Series], tuple]:
    """Fold over a session's files, from what each file adds; a row says how the pools are after it."""
    mine, other, halted, last = _Pool(), _Pool(), False, None

    def step(row: pd.Series) -> tuple:
        nonlocal halted, last
        mine.take(row, "seed")
        mine.take(row, "first")
        other.take(row, "anti")
        variance, spread = mine.variance(), other.variance()
        widened = last is not None and other.n > 0 and spread - last > WIDER
        last = spread if other.n else last
        like = None if other.n == 0 or mine.n == 0 else float(mine.profile() @ other.profile())
        level = "OK" if like is None or like <= WARNING else "HALT" if like > HALT else "WARNING"
        halted = halted or level == "HALT"

        def state() -> str:
            enough = STRONG_MS if other.n else STRONG_ALONE_MS
            return "STRONG" if mine.ms >= enough and variance <= WIDE else "MARGINAL" if mine.ms >= MARGINAL_MS else "INSUFFICIENT"

        now, again = state(), 0
        if now == "MARGINAL" and other.n:
            again = mine.take(row, "second")
            variance = mine.variance()
            now = state()
        return (row.session, row.file_index, now, mine.ms, mine.n, variance, other.n, spread, widened, like, level, again, halted, variance > WIDE, mine.profile())

    return step


def enrol(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates with their gates, files with their pools) of an enrolment of each session, file after file.

    candidates: (session string, file_index, candidate_id, kind, vector, duration_ms, vad_coverage, closed_share); other columns go.
    kind is 'seed' (verified, makes the seed profile of the session and enters its pool), 'click' (a verified span of the other
    voice), 'anti' (a candidate for it, taken unless it is too like the seed) or 'voice' (a candidate for the target, gated).

    A file's voices pass the triple gate against the seed and the anti profile of all files before (and clicks of their own
    file); then the file's anti candidates enter. If the pool is MARGINAL after that, what failed gate C is gated once more,
    against the grown anti profile. Of a candidate: sim_seed, sim_anti, failed_gate of the first pass (null if it passed), and
    accepted_in: 0 for seeds and the other voice, 1 or 2 for voices, null if it stayed out. Of a file: the pools and their quality, with the
    warnings (the other voice's pool widened, the pool is wide, target too like the other voice) and `halted` from the file on
    where that likeness stops an enrolment; the rows after it are what would follow.

    Neither gate depends on what voices were let in, so both are worked out for all candidates at once; the anti profile
    follows from sums by file, and the pools from sums and moments by file and pass. Only rows of a session's files meet in
    one task, where they pass in order and are never held at once, and never its candidates. A session without a seed lets nothing in and has no sim_seed. Null vectors, kinds,
    sessions or file numbers take no part; an empty table gives two empty ones. Repeated rows count each time.
    """
    used = ["session", "file_index", "candidate_id", "kind", "vector", "duration_ms", "vad_coverage", "closed_share"]
    rows = candidates.select(F.col("session").cast("string").alias("session"), F.col("file_index").cast("long").alias("file_index"), *used[2:])
    rows = rows.where(F.col("kind").isin(*_KINDS) & F.col("vector").isNotNull() & F.col("session").isNotNull() & F.col("file_index").isNotNull())
    seeds = vector_sums(rows.where("kind = 'seed'"), ["session"], weight=F.col("duration_ms")).select("session", unit(F.col("total")).alias("_seed"))
    rows = rows.join(seeds, "session", "left").withColumn("sim_seed", F.when(F.col("_seed").isNotNull(), cosine(F.col("vector"), F.col("_seed")))).drop("_seed")
    other = (F.col("kind") == "click") | ((F.col("kind") == "anti") & F.col("sim_seed").isNotNull() & ~too_like(F.col("sim_seed")))

    files = rows.select("session", "file_index").distinct()
    by = ["session", "file_index"]
    summed = lambda kind: vector_sums(rows.where(other & (F.col("kind") == kind)), by, weight=F.col("duration_ms"))
    held = files.join(summed("click").select(*by, F.col("total").alias("clicked")), by, "left").join(summed("anti").select(*by, F.col("total").alias("own")), by, "left")
    profiles = _in_order(held, _anti_profiles, "session string, file_index long, anti_before array<double>, anti_after array<double>")

    rows = rows.join(profiles, by)
    likeness = lambda p: F.when(F.col(p).isNotNull(), cosine(F.col("vector"), F.col(p)))
    rows = rows.withColumns({"sim_anti": likeness("anti_before"), "_again": likeness("anti_after")}).drop("anti_before", "anti_after")
    first = triple_gate(rows.where("kind = 'voice'"), "sim_seed", "sim_anti").withColumnRenamed("failed_gate", "failed")
    first = first.withColumn("failed", F.when(F.col("sim_seed").isNull(), "B").otherwise(F.col("failed"))).withColumn("_first", F.col("failed").isNull()).drop("accepted")
    both = triple_gate(first, "sim_seed", "_again").withColumn("_second", (F.col("failed") == "C") & F.col("accepted"))
    voices = both.select(*by, *used[2:], "sim_seed", "sim_anti", F.col("failed").alias("failed_gate"), F.when(F.col("_first"), "first").when(F.col("_second"), "second").alias("_part"))
    apart = rows.where("kind <> 'voice'").withColumn("_part", F.when(F.col("kind") == "seed", "seed").when(other, "anti"))
    told = voices.unionByName(apart.select(*voices.columns[:-2], F.lit(None).cast("string").alias("failed_gate"), "_part"))

    parts = told.where("_part is not null")
    sums = vector_sums(parts, [*by, "_part"], weight=F.col("duration_ms")).withColumnRenamed("weight", "ms")
    sums = sums.join(moments(parts, [*by, "_part"]).withColumnRenamed("n", "units"), [*by, "_part"], "left")
    one = lambda c, kind: F.first(F.when(F.col("_part") == kind, F.col(c)), ignorenulls=True).alias(f"{c}_{kind}")
    wide = sums.groupBy(*by).agg(*[one(c, kind) for kind in ("seed", "first", "second", "anti") for c in ("n", "ms", "total", "units", "s", "m")])
    wide = files.join(wide, by, "left")
    state = _in_order(wide, _fold, _FILES)

    passed = F.when(F.col("_part") == "second", F.when(F.col("second_pass") > 0, 2)).when(F.col("_part") == "first", 1).when(F.col("_part").isNotNull(), 0)
    out = told.join(state.select(*by, "second_pass"), by).withColumn("accepted_in", passed)
    return out.select(*used, "sim_seed", "sim_anti", "failed_gate", "accepted_in"), state
