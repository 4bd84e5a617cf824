from tallyloom.operators.forecast import calibrate, fit_priors, forecast, forecast_metrics
from tallyloom.sources.synthetic import priced_tasks

# Published hits, coverage, log error and P90 / P10 of the seeded corpus.
PINNED = [
    ((432, 576, 720), "description", (144, 103, 71.528, 0.251264, 2.447496)),
    ((432, 576, 720), "oracle", (144, 107, 74.306, 0.317795, 3.458729)),
    ((396, 540, 612), "description", (72, 48, 66.667, 0.249627, 2.231383)),
    ((396, 540, 612), "oracle", (72, 54, 75.0, 0.324198, 3.051127)),
]


def test_published_quality_of_the_seeded_corpus(spark):
    tasks = priced_tasks(spark).cache()
    for (fit_end, calibration_end, test_end), regime, (n, hits, coverage, log_error, ratio) in PINNED:
        part = lambda a, b: tasks.where(f"`order` >= {a} and `order` < {b}")
        priors = calibrate(fit_priors(part(0, fit_end), regime), part(fit_end, calibration_end))
        got = forecast_metrics(forecast(part(calibration_end, test_end), priors)).first()
        assert (got.n, got.hits, got.coverage_pct) == (n, hits, coverage)
        assert abs(got.median_interval_ratio_p90_p10 - ratio) < 2e-6
        assert abs(got.median_absolute_log_error - log_error) < 2e-6


def test_future_costs_are_not_read(spark):
    tasks = priced_tasks(spark)
    priors = calibrate(fit_priors(tasks.where("`order` < 400")), tasks.where("`order` between 400 and 500"))
    after = tasks.where("`order` > 500")
    a, b = (sorted((r.order, round(r.p50, 9)) for r in forecast(x, priors).collect()) for x in (after, after.selectExpr("order", "project", "archetype", "-1.0D cost_usd", "turn_count")))
    assert a == b
