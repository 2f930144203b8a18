"""Panel columns as signals: scores against their own past, how well they lead incidents, correlations with a control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import panel as P
from .silver import K, snaps


def group_z(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Adds z_<value>: the distance from the group's mean in sample deviations; null where a group doesn't vary."""
    w = Window.partitionBy(*keys)
    z = lambda x: (F.col(x) - F.avg(x).over(w)) / F.nullif(F.stddev_samp(x).over(w), F.lit(0.0))
    return rows.select("*", *[z(x).alias(f"z_{x}") for x in values])


def partial_spearman(rows: DataFrame, keys: Sequence[str], x: str, y: str, control: str, least: int = 6) -> DataFrame:
    """(keys, n, r): Spearman's correlation of x and y once the linear effect of control's ranks is taken from both.

    Over complete rows; null under `least` of them, and if x or y is constant or told by the control alone. A constant control
    takes nothing away.
    """
    keys = list(keys)
    full = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(control).isNotNull())
    ranked = full.select(*keys, *[P.average_rank(v, keys).alias(n) for v, n in ((x, "_x"), (y, "_y"), (control, "_c"))])
    var = lambda a: F.var_pop(a)
    s = ranked.groupBy(*keys).agg(F.count("*").alias("n"), var("_x").alias("vx"), var("_y").alias("vy"), var("_c").alias("vc"), *[F.covar_pop(f"_{a}", f"_{b}").alias(a + b) for a, b in ("xy", "xc", "yc")])
    held = (F.col("vx") > 0) & (F.col("vy") > 0) & (F.col("n") >= least)
    of = lambda a: F.when(F.col("vc") > 0, F.col(f"{a}c") / F.sqrt(F.col(f"v{a}") * F.col("vc"))).otherwise(0.0)
    plain = F.col("xy") / F.sqrt(F.col("vx") * F.col("vy"))
    rest = (1 - of("x") * of("x")) * (1 - of("y") * of("y"))
    return s.select(*keys, "n", F.when(held, F.when(rest > 1e-12, (plain - of("x") * of("y")) / F.sqrt(rest))).alias("r"))


def signal_scores(panel: DataFrame, times: DataFrame, signals: Sequence[str], days: float = 7.0) -> DataFrame:
    """(netuid, t, signal, score) for every signal and snapshot: |z| against the median and MAD of the `days` before.

    Missing values are left out of that span; the score is null where the value is, where the span isn't whole yet, or where it has
    fewer than max(3, half a span) values. At MAD 0 the population deviation stands in, at least 1e-9. Rows that meet are in
    proportion to snapshots times the span.
    """
    long = panel.select(*K, *[F.col(s).cast("double").alias(s) for s in signals]).unpivot(K, list(signals), "signal", "v")
    long = long.join(times.groupBy("netuid").agg(F.first(snaps(days)).alias("span")), "netuid")
    past = long.filter("v is not null").select("netuid", "signal", F.col("t").alias("_t"), F.col("v").alias("_v"))
    met = long.filter("v is not null and t >= span").join(past, ["netuid", "signal"]).filter("_t < t and _t >= t - span")
    told = met.groupBy("netuid", "signal", "t", "v", "span").agg(F.percentile("_v", 0.5).alias("median"), F.collect_list("_v").alias("b")).filter("size(b) >= greatest(3, span div 2)")
    told = told.withColumn("mean", F.expr("aggregate(b, 0D, (s, x) -> s + x) / size(b)")).withColumn("sd", F.expr("sqrt(aggregate(b, 0D, (s, x) -> s + (x - mean) * (x - mean)) / size(b))"))
    told = told.withColumn("d", F.expr("array_sort(transform(b, x -> abs(x - median)))")).withColumn("mad", F.expr("(d[int((size(d) - 1) div 2)] + d[int(size(d) div 2)]) / 2"))
    spread = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(F.when(F.array_min("b") < F.array_max("b"), F.greatest("sd", F.lit(1e-9))).otherwise(1e-9))
    scores = told.select("netuid", "signal", "t", F.abs((F.col("v") - F.col("median")) / spread).alias("score"))
    return long.select(*K, "signal").join(scores, [*K, "signal"], "left")


def labelled(times: DataFrame, incidents: DataFrame, days: float = 3.0) -> DataFrame:
    """(netuid, t, label) of the snapshots that count: true in the `days` up to an incident, those after one left out. incidents: (netuid, t)."""
    span = times.groupBy("netuid").agg(F.first(snaps(days)).alias("span"))
    starts = incidents.join(span, "netuid").select("netuid", F.col("t").alias("_t"), "span").distinct()
    near = times.select(*K).join(starts, "netuid").filter("t >= _t - span and t <= _t + span").groupBy(*K).agg(F.bool_or(F.col("t") <= F.col("_t")).alias("label"))
    return times.select(*K).join(near, K, "left").filter("label is null or label").select(*K, F.coalesce("label", F.lit(False)).alias("label"))


def leading(scores: DataFrame, times: DataFrame, incidents: DataFrame, days: float = 3.0, alarm: float = 3.0) -> DataFrame:
    """A row a signal: AUC of its scores, part of the incidents with an alarm in the days before, median lead, false alarms, and whether it could be acted on.

    Incidents: (incident, netuid, t). A missing score is no alarm, and counts as a quiet snapshot. Ranks of a signal are
    taken over all its snapshots at once, a market's snapshots being few; no members or texts come here.
    """
    told = scores.join(labelled(times, incidents, days), K)
    quality = P.auc(told, ["signal"], "score", "label").select("signal", "auc")
    false = told.filter("not label").groupBy("signal").agg(F.avg(F.coalesce(F.col("score") >= alarm, F.lit(False)).cast("double")).alias("false_alarm_rate"))
    span = times.groupBy("netuid").agg(F.first(snaps(days)).alias("span"))
    hours = times.select(*K, "hours")
    starts = incidents.join(hours, K).join(span, "netuid").select("incident", "netuid", F.col("t").alias("_t"), F.col("hours").alias("_h"), "span")
    met = scores.join(hours, K).join(starts, "netuid").filter("t >= _t - span and t <= _t")
    first = met.groupBy("signal", "incident").agg(F.min(F.when(F.col("score") >= alarm, F.struct("t", (F.col("_h") - F.col("hours")).alias("lead")))).alias("x"))
    hit = first.groupBy("signal").agg(F.avg(F.col("x").isNotNull().cast("double")).alias("hit_rate"), F.percentile("x.lead", 0.5).alias("median_lead_hours"))
    out = quality.join(false, "signal", "left").join(hit, "signal", "left")
    return out.withColumn("actionable", F.coalesce((F.col("auc") >= 0.65) & (F.col("hit_rate") >= 0.3), F.lit(False)))


def top_signals(ranked: DataFrame, k: int = 3) -> DataFrame:
    """The k signals of the highest AUC; those without one don't count, ties go by name."""
    return ranked.filter("auc is not null").orderBy(F.desc("auc"), "signal").limit(k)


def jaccard(a: Column, b: Column) -> Column:
    """Common over all distinct elements of two arrays; null if both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every)
