"""Cost forecasts: priors, credibility blend and conformal bands, fitted and applied as joins with small tables.

Tasks are rows (archetype, project, cost_usd, turn_count, ...).  Everything is
in log cost; in the `oracle` regime turns are given and cost per turn is
modelled.  All fitted tables have a row for each archetype or project and
archetype, and are sums over one exchange.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import float_log, float_ratio
from tallyloom.operators.ranks import medians, quantiles
from tallyloom.operators.retrieval import Retrieval, Stability, dispersion_ratio, neighbourhoods, stability_band, stability_multiplier
from tallyloom.plans.shared import written

# The nominal one-sided quantile of an 80 % band; credibility without and with groups alike.
Z_80 = 1.2816
K_FEW_GROUPS, K_NO_SPREAD = 50.0, 200.0


#: A share of hits is only worth stating on so many tasks.
LEAST_REPORTABLE = 20
#: What a band rests on, beside it in every forecast from analogies.
DETAILS = ("abstain", "reason", "source", "history", "dispersion_ratio", "stability_band")


@dataclass
class Analogies:
    """index: the tasks (task_id, ts, y, ph, sh) that may be retrieved; a task is only ever given strictly earlier ones."""

    index: DataFrame
    retrieval: Retrieval = field(default_factory=Retrieval)
    stability: Stability = field(default_factory=Stability)


@dataclass
class Priors:
    archetype: DataFrame  # archetype, prior_mu, prior_s
    group: DataFrame  # project, archetype, group_mu, group_s, group_n
    totals: DataFrame  # one row: global_mu, global_s, k
    quantiles: DataFrame | None = None  # archetype, q; a null archetype holds the pooled one
    regime: str = "description"
    zeros: bool = False  # costs of nothing were fitted, with a log of -Infinity
    analogies: Analogies | None = None
    history: DataFrame | None = None  # project, shift, widening: what a project's own tasks add to every archetype's prior
    measured: DataFrame | None = None  # one row: refused, measured_n, measured_coverage on the calibration tasks


def log_turns(regime: str) -> Column:
    return F.log(F.greatest(F.lit(1.0), F.col("turn_count").cast("long").cast("double"))) if regime == "oracle" else F.lit(0.0)


def log_target(regime: str, zeros: bool = False) -> Column:
    """Null for costs that aren't positive, and those tasks are never fitted; with `zeros` -Infinity for a cost of nothing, as logs of floating-point numbers are."""
    y = F.when(F.col("cost_usd") > 0, F.log("cost_usd") - log_turns(regime))
    return y.when(F.col("cost_usd") == 0, float("-inf")) if zeros else y


def credibility(groups: DataFrame, k: float | None = None) -> DataFrame:
    """One row (global_mu, global_s, k): k is within-group over between-group variance, from counts, means and squares of groups(n, mu, ss)."""
    sums = groups.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum(F.col("n") * F.col("mu")).alias("y"), F.sum("ss").alias("within"), F.sum(F.when(F.col("n") >= 2, F.col("n") - 1)).alias("free"), F.sum(F.col("n") * F.col("mu") * F.col("mu")).alias("squares"), F.sum((F.col("n") * F.col("n")).cast("double")).alias("n2"))
    n, g = F.col("n"), F.col("g")
    mean = F.col("y") / n
    between = F.col("squares") - n * mean * mean
    spread = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("within") + between) / (n - 1)))).otherwise(0.0)
    epv = F.coalesce(F.try_divide(F.col("within"), F.col("free").cast("double")), spread * spread)
    vhm = F.try_divide(between - (g - 1) * epv, n - F.col("n2") / n)
    found = F.when((g < 2) | (n <= g) | vhm.isNull(), K_FEW_GROUPS).when((vhm <= 0) | (epv <= 0), K_NO_SPREAD).otherwise(F.least(F.lit(1000.0), F.greatest(F.lit(1.0), epv / vhm)))
    return sums.select(mean.alias("global_mu"), F.when(spread > 0, spread).otherwise(1.0).alias("global_s"), (F.lit(k) if k is not None else found).alias("k"))


def project_history(tasks: DataFrame, priors: Priors, k: float = 20.0, least: int = 3) -> DataFrame:
    """project, n, shift and widening from the residuals of fitted tasks about their archetype's mean.

    The shift is the mean residual by n / (n + k), the widening the same share of
    its standard error; projects of fewer than `least` tasks have none.
    """
    rows = tasks.select("project", "archetype", log_target(priors.regime, priors.zeros).alias("y")).where("y is not null").join(priors.archetype, "archetype", "left").crossJoin(F.broadcast(priors.totals))  # one row
    each = rows.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y") - F.coalesce("prior_mu", "global_mu")).alias("mean"), F.coalesce(F.stddev_samp(F.col("y") - F.coalesce("prior_mu", "global_mu")), F.lit(0.0)).alias("s"))
    n = F.col("n")
    return each.where(n >= least).select("project", "n", (F.col("mean") * n / (n + k)).alias("shift"), (F.col("s") / F.sqrt(n) * n / (n + k)).alias("widening"))


def with_project_history(priors: Priors, tasks: DataFrame, k: float = 20.0, least: int = 3) -> Priors:
    """The priors with a known project's own level in place of none where a cell of it is thin or missing."""
    return replace(priors, history=project_history(tasks, priors, k, least).drop("n"))


def fit_priors(tasks: DataFrame, regime: str = "description", k: float | None = None, zeros: bool = False) -> Priors:
    y = tasks.select("project", "archetype", log_target(regime, zeros).alias("y")).where("y is not null")
    cells = y.groupBy("project", "archetype").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mu"), F.when(F.count(F.lit(1)) > 1, F.var_pop("y") * F.count(F.lit(1))).otherwise(0.0).alias("ss"))
    totals = credibility(cells, k)
    by = y.groupBy("archetype").agg(F.avg("y").alias("prior_mu"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("s"))
    archetype = by.crossJoin(F.broadcast(totals)).select("archetype", "prior_mu", F.when(F.col("s") > 0, F.col("s")).otherwise(F.col("global_s")).alias("prior_s"))
    group = cells.select("project", "archetype", F.col("mu").alias("group_mu"), F.when(F.col("n") > 1, F.sqrt(F.col("ss") / (F.col("n") - 1))).otherwise(0.0).alias("group_s"), F.col("n").alias("group_n"))
    return Priors(archetype, group, totals, regime=regime, zeros=zeros)


def with_analogies(priors: Priors, tasks: DataFrame, retrieval: Retrieval = Retrieval(), stability: Stability = Stability()) -> Priors:
    """The priors with neighbourhoods instead of project cells; tasks(task_id, ts, ph, sh, cost_usd, ...) that can't be scored aren't retrieved."""
    index = tasks.select("task_id", "ts", log_target(priors.regime, priors.zeros).alias("y"), "ph", "sh").where("y is not null and ts is not null")
    return Priors(priors.archetype, priors.group, priors.totals, regime=priors.regime, zeros=priors.zeros, analogies=Analogies(index, retrieval, stability))


def _credible(mu: Column, s: Column, n: Column, mu_p: Column, s_p: Column, k: Column) -> tuple[Column, Column]:
    """Mean and deviation of n tasks (mu, s) blended with a prior by credibility n / (n + k)."""
    own = F.when((n >= 2) & (s > 0), s).otherwise(s_p)
    w = n / (n + k)
    variance = w * own * own + (1 - w) * s_p * s_p + w * w * own * own / n
    return w * mu + (1 - w) * mu_p, F.sqrt(F.greatest(variance, F.lit(1e-9)))


def _prior() -> tuple[Column, Column]:
    return F.coalesce("prior_mu", "global_mu"), F.when(F.col("prior_mu").isNull(), F.col("global_s")).otherwise(F.col("prior_s"))


def blend(tasks: DataFrame, priors: Priors) -> DataFrame:
    """Adds mu and sigma: the archetype's prior (else the global one) blended with the project's own tasks by credibility n / (n + k).

    With analogies a task's neighbourhood takes the place of its project's tasks,
    and the columns DETAILS say what it was and whether the task is refused.
    """
    rows = tasks.join(priors.archetype, "archetype", "left").crossJoin(F.broadcast(priors.totals))  # totals: one row
    if priors.analogies:
        return _blend_analogies(tasks, rows, priors.analogies)
    rows = rows.join(priors.group, ["project", "archetype"], "left")
    mu_p, s_p = _prior()
    if priors.history is not None:
        rows = rows.join(priors.history, "project", "left")
        wider = F.coalesce("widening", F.lit(0.0))
        mu_p, s_p = mu_p + F.coalesce("shift", F.lit(0.0)), F.sqrt(s_p * s_p + wider * wider)
    n = F.col("group_n")
    mu, sigma = _credible(F.col("group_mu"), F.col("group_s"), n, mu_p, s_p, F.col("k"))
    return rows.select(*(tasks[c] for c in tasks.columns), F.when(n.isNull(), mu_p).otherwise(mu).alias("mu"), F.when(n.isNull(), s_p).otherwise(sigma).alias("sigma"))


def _blend_analogies(tasks: DataFrame, rows: DataFrame, a: Analogies) -> DataFrame:
    """A refused task, and one without any history, keeps its prior; too little history is a refusal before anything else."""
    p, retrieval = a.stability, a.retrieval
    found = neighbourhoods(a.index, tasks, retrieval)
    mu_p, s_p = _prior()
    s, n, least = F.col("nb_s"), F.col("nb_n"), F.lit(retrieval.least_history)
    alike = F.col("source").isin("exact", "analogy")
    cold, none = F.col("history") < least, F.col("source") == "none"
    band = F.when(cold, "cold-start").when(none, "none").otherwise(stability_band(s, s_p, n, alike, p))
    rows = rows.join(found, "task_id").withColumns({"_mu": mu_p, "_s": s_p, "stability_band": band, "dispersion_ratio": F.when(~cold & ~none, dispersion_ratio(s, s_p, n))})
    refused = F.col("stability_band").isin("cold-start", *p.refused)
    times = stability_multiplier(F.col("stability_band"), p)
    if retrieval.mode == "replace":
        own = F.when((n >= 2) & (s > 0), s).otherwise(F.col("_s")) * times
        mu, sigma = F.col("nb_mu"), F.sqrt(F.greatest(own * own, F.lit(1e-9)))
    else:
        mu, sigma = _credible(F.col("nb_mu"), s, n, F.col("_mu"), F.col("_s"), F.col("k"))
        sigma = sigma * times
    keeps = refused | none
    return rows.select(
        *(tasks[c] for c in tasks.columns), F.when(keeps, F.col("_mu")).otherwise(mu).alias("mu"), F.when(keeps, F.col("_s")).otherwise(sigma).alias("sigma"),
        refused.alias("abstain"), F.when(refused, refusal_text(F.col("stability_band"), F.col("history"), retrieval.least_history, F.col("dispersion_ratio"))).alias("reason"), "source", "history", "dispersion_ratio", "stability_band",
    )


def refusal_text(band: Column, history: Column, least: int, ratio: Column) -> Column:
    """Why there is no forecast, for someone who doesn't know the method."""
    cold = F.format_string(f"There is too little to go by: {least} finished tasks are needed for a forecast, and there are %d so far.", history)
    spread = F.format_string("Tasks like this one cost very different amounts, %.1f times the usual spread, so a range would be a guess.", ratio)
    return (
        F.when(band == "cold-start", cold).when(band == "unstable", spread)
        .when(band == "unknown", "Just one earlier task is like this one, which doesn't show how much such tasks vary.")
        .when(band == "no-analogy", "No earlier task is like this one, so there is nothing to compare it with.")
    )


def conformal_level(n: Column, alpha: float) -> Column:
    return F.least(F.lit(1.0), F.ceil((n + 1) * (1 - alpha)) / n)


def calibrate(priors: Priors, tasks: DataFrame, alpha: float = 0.2, least: int = 20) -> Priors:
    """Finite-sample quantiles of |y - mu| / sigma for archetypes with at least `least` scores, and of all scores together.

    Refused tasks are counted and left out.  Afterwards `measured` tells how many
    of the same tasks' costs lie within the bands that the quantiles give them.
    """
    blended = blend(tasks, priors)
    if priors.analogies:
        blended = written(blended, "blended")
    answered = blended.where("not abstain") if priors.analogies else blended
    scored = answered.withColumn("score", F.abs(log_target(priors.regime, priors.zeros) - F.col("mu")) / F.col("sigma")).where("score is not null and sigma > 0")
    rows = scored.select(F.explode(F.array(F.struct(F.lit(True).alias("own"), "archetype"), F.struct(F.lit(False).alias("own"), F.lit(None).cast("string").alias("archetype")))).alias("g"), "score").select("g.*", "score")
    found = quantiles(rows, ["own", "archetype"], "score", {"q": lambda n: conformal_level(n, alpha)}, lambda low, high, share: low + (high - low) * share)
    none = tasks.sparkSession.range(1).select(F.lit(None).cast("string").alias("archetype"))  # one row: the pooled quantile is there without any score
    by = found.where((F.col("n") >= least) & F.col("own")).select("archetype", "q")
    pooled = none.join(found.where(~F.col("own")).select("q"), F.lit(True), "left").select("archetype", F.coalesce("q", F.lit(Z_80)).alias("q"))
    priors.quantiles = by.unionByName(pooled)
    refused = F.col("abstain") if priors.analogies else F.lit(False)
    scores = log_target(priors.regime, priors.zeros).isNotNull() & ~refused
    hit = scores & F.col("cost_usd").between(F.col("p10"), F.col("p90"))
    counts = _banded(blended, priors).where(log_target(priors.regime, priors.zeros).isNotNull()).agg(F.count_if(refused).alias("refused"), F.count_if(scores).alias("measured_n"), F.count_if(hit).alias("hits"))
    priors.measured = counts.select("refused", "measured_n", F.try_divide(F.col("hits").cast("double"), "measured_n").alias("measured_coverage"))
    return priors


def _banded(rows: DataFrame, priors: Priors) -> DataFrame:
    """Adds p10, p50 and p90 in order to blended tasks; a refused task has none."""
    columns = rows.columns
    if priors.quantiles is None:
        q = F.lit(Z_80)
    else:
        own = priors.quantiles.where("archetype is not null").withColumnRenamed("q", "own_q")
        pooled = priors.quantiles.where("archetype is null").select(F.when(F.col("q") > 0, F.col("q")).otherwise(Z_80).alias("pooled_q"))
        rows = rows.join(own, "archetype", "left").crossJoin(F.broadcast(pooled))  # pooled: one row
        q = F.coalesce("own_q", "pooled_q")
    shift = log_turns(priors.regime)
    half = q * F.col("sigma")
    bands = [F.exp(mu + shift).alias(name) for mu, name in ((F.col("mu") - half, "p10"), (F.col("mu"), "p50"), (F.col("mu") + half, "p90"))]
    if priors.analogies:
        bands = [F.when(~F.col("abstain"), b).alias(name) for b, name in zip(bands, ("p10", "p50", "p90"), strict=True)]
    return rows.select(*columns, *bands)


def forecast(tasks: DataFrame, priors: Priors) -> DataFrame:
    """Adds p10, p50 and p90 in dollars; costs aren't read.

    With analogies a refused task has no band but a reason; DETAILS say what each
    forecast rests on, measured_n and measured_coverage how often bands like it held.
    """
    rows = _banded(blend(tasks, priors), priors)
    if priors.analogies:
        known = priors.measured is not None
        measured = priors.measured if known else tasks.sparkSession.range(1).select(F.lit(None).cast("long").alias("measured_n"), F.lit(None).cast("double").alias("measured_coverage"))
        return rows.crossJoin(F.broadcast(measured.select("measured_n", "measured_coverage")))  # one row
    return rows


def coverage_reportable(n: Column) -> Column:
    """Whether a share of hits among n tasks is worth stating."""
    return F.coalesce(n, F.lit(0)) >= LEAST_REPORTABLE


def forecast_metrics(rows: DataFrame, target: float = 0.8) -> DataFrame:
    """One row: n, hits, coverage in percent, its gap, medians of relative and log error and of p90 / p10."""
    hit, cost, p50 = F.col("cost_usd").between(F.col("p10"), F.col("p90")), F.col("cost_usd"), F.col("p50")
    rows = rows.select(hit.alias("hit"), float_ratio(F.abs(p50 - cost), cost).alias("relative"), F.abs(float_log(float_ratio(cost, p50))).alias("log_error"), float_ratio(F.col("p90"), F.col("p10")).alias("ratio"))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit")).alias("hits"))
    out = counts.join(medians(rows, [], ["relative", "log_error", "ratio"]), F.lit(True), "left")  # one row each
    share = F.try_divide(F.col("hits").cast("double"), F.col("n"))
    return out.select("n", "hits", F.round(100 * share, 3).alias("coverage_pct"), F.round(100 * F.abs(share - target), 3).alias("calibration_gap_pct"), F.round(100 * F.col("relative"), 3).alias("median_relative_error_pct"), F.round("log_error", 6).alias("median_absolute_log_error"), F.round("ratio", 6).alias("median_interval_ratio_p90_p10"))
