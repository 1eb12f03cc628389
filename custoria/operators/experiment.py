"""Design and readout of conversion experiments, one output row per experiment or design point.

Visits are aggregated once by (experiment, variant); everything after that is arithmetic on
a few columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from custoria.functions.columns import as_double, percent, ratio, thousands
from custoria.functions.probability import add_normal_cdf, add_power, add_power_shift, t_p_value, z_value
from custoria.sources.reuse import settle

CONTROL, TREATMENT = "control", "treatment"
ALPHA, POWER = 0.05, 0.80

# ---- design ---------------------------------------------------------------------------------


def target_rate(design: DataFrame) -> DataFrame:
    """Add the rate to detect: baseline raised by the relative effect."""
    return design.withColumn("target_cr", F.col("baseline_cr") * (1 + F.col("mde_relative")))


def effect_size(design: DataFrame) -> DataFrame:
    """Add Cohen's h of target against baseline; null if the target is no rate any more."""
    angle = F.asin(F.sqrt("target_cr")) - F.asin(F.sqrt("baseline_cr"))
    return design.withColumn("effect_size", F.when(F.col("target_cr") <= 1, 2 * angle))


def required_sample(design: DataFrame) -> DataFrame:
    """Add visitors per arm and in total for a two-sided test at `alpha` with `power`.

    Null unless 0 < alpha < power < 1 and the effect is not zero, and where the total is no 64-bit number any more.
    """
    step = add_power_shift(design, as_double("alpha"), as_double("power"), "_shift_needed")
    step = step.withColumn("_n", F.ceil(2 * F.pow(F.try_divide("_shift_needed", "effect_size"), F.lit(2)).cast("decimal(38,4)")))
    fits = F.col("_n") <= (2**63 - 1) // 2
    return (
        step.withColumn("n_per_group", F.when(fits, F.col("_n")).cast("bigint"))
        .withColumn("total_n", F.col("n_per_group") * 2)
        .drop("_shift_needed", "_n")
    )


def plan_experiments(design: DataFrame) -> DataFrame:
    """(baseline_cr, mde_relative, alpha, power) to target, effect size and sample sizes."""
    return required_sample(effect_size(target_rate(design)))


def design_menu(
    baselines: DataFrame,
    effects: tuple[float, ...] = (0.15,),
    alphas: tuple[float, ...] = (ALPHA,),
    powers: tuple[float, ...] = (POWER,),
) -> DataFrame:
    """Every baseline with every choice of effect, level and power."""

    def choices(values: tuple[float, ...]) -> Column:
        return F.explode(F.array(*[F.lit(float(v)) for v in values]))

    return (
        baselines.withColumn("mde_relative", choices(effects))
        .withColumn("alpha", choices(alphas))
        .withColumn("power", choices(powers))
    )


# The grid of the published power curve.
def fixed_grid(planned: DataFrame, start: int = 500, stop: int = 20_000, step: int = 250) -> DataFrame:
    """Sample sizes from `start` up to, not including, `stop`."""
    return planned.withColumn("n", F.explode(F.sequence(F.lit(start), F.lit(stop - 1), F.lit(step))))


def relative_grid(planned: DataFrame) -> DataFrame:
    """Sample sizes around the required one: from a tenth of it up to twice it."""
    required = F.col("n_per_group")
    start = F.greatest(F.lit(200).cast("bigint"), F.floor(required / 10))
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(required / 40))
    stop = required * 2 - 1
    return planned.withColumn("n", F.explode(F.when(start <= stop, F.sequence(start, stop, step))))


def power_at(grid: DataFrame) -> DataFrame:
    """Add the power reached with `n` visitors per arm."""
    shift = F.col("effect_size") * F.sqrt(F.col("n") / 2)
    return add_power(grid, shift, as_double("alpha"), "power_at_n")


# ---- readout --------------------------------------------------------------------------------


def arms(visits: DataFrame) -> DataFrame:
    """Visitors, conversions and order values of the converters, per experiment and variant.

    Order values count as they are, unrounded. Visits without an experiment or a variant belong to none.
    """
    value = F.when(F.col("converted") == 1, F.col("order_value"))
    named = visits.filter(F.col("experiment_id").isNotNull() & F.col("variant").isNotNull())
    per_arm = named.groupBy("experiment_id", "variant").agg(
        F.count("converted").alias("visitors"),
        F.count_if(F.col("converted") == 1).alias("conversions"),
        F.count(value).alias("orders"),
        F.avg(value).alias("aov"),
        F.stddev_pop(value).alias("aov_std"),
        F.var_samp(value).alias("aov_var"),
    )
    return per_arm.select(
        "experiment_id",
        "variant",
        "visitors",
        "conversions",
        "orders",
        ratio("conversions", "visitors").alias("conversion_rate"),
        "aov",
        "aov_std",
        F.try_divide("aov_std", F.sqrt(as_double("orders"))).alias("aov_se"),
        "aov_var",
    )


def side_by_side(per_arm: DataFrame) -> DataFrame:
    """One row per experiment with both arms, as `control_*` and `treatment_*`.

    Any other variant is an error: compare it on its own with `against_control`.
    """
    measures = [c for c in per_arm.columns if c not in ("experiment_id", "variant")]
    told = F.concat(F.lit("no control or treatment: "), F.col("variant"))
    known = F.col("variant").isin(CONTROL, TREATMENT)
    checked = per_arm.withColumn("variant", F.when(known, F.col("variant")).otherwise(F.raise_error(told)))
    return checked.groupBy("experiment_id").agg(
        *[
            F.max(F.when(F.col("variant") == arm, F.col(m))).alias(f"{arm}_{m}")
            for arm in (CONTROL, TREATMENT)
            for m in measures
        ]
    )


def against_control(per_arm: DataFrame) -> DataFrame:
    """Arms of an experiment with several treatments as one experiment per treatment, named `experiment/variant`."""
    others = per_arm.filter(F.col("variant") != CONTROL)
    control = per_arm.filter(F.col("variant") == CONTROL)
    names = others.select("experiment_id", F.concat_ws("/", "experiment_id", "variant").alias("_name"))
    renamed = others.withColumns({"experiment_id": F.concat_ws("/", "experiment_id", "variant"), "variant": F.lit(TREATMENT)})
    paired = names.join(control, "experiment_id").withColumn("experiment_id", F.col("_name")).select(*per_arm.columns)
    return renamed.unionByName(paired)


def lift(pairs: DataFrame) -> DataFrame:
    """Add absolute and relative lift of the conversion rate."""
    gain = F.col("treatment_conversion_rate") - F.col("control_conversion_rate")
    return pairs.withColumns(
        {
            "absolute_lift": gain,
            "relative_lift": F.try_divide(gain, "control_conversion_rate"),
            "incremental_per_1000": gain * 1000,
        }
    )


def conversion_z(pairs: DataFrame) -> DataFrame:
    """Add the pooled two-proportion z statistic."""
    pooled = ratio(
        F.col("treatment_conversions") + F.col("control_conversions"),
        F.col("treatment_visitors") + F.col("control_visitors"),
    )
    spread = pooled * (1 - pooled) * (ratio(F.lit(1), "treatment_visitors") + ratio(F.lit(1), "control_visitors"))
    gain = F.col("treatment_conversion_rate") - F.col("control_conversion_rate")
    return pairs.withColumn("z_stat", F.try_divide(gain, F.sqrt(spread)))


def conversion_p(pairs: DataFrame) -> DataFrame:
    """Add the one-sided p-value of treatment > control."""
    return add_normal_cdf(pairs, -F.col("z_stat"), "p_conversion")


def wilson(pairs: DataFrame, arm: str, alpha: float = ALPHA) -> DataFrame:
    """Add the Wilson interval of one arm's rate and its distances from the rate."""
    z = z_value(1 - alpha / 2)
    n, p = as_double(f"{arm}_visitors"), F.col(f"{arm}_conversion_rate")
    bottom = 1 + F.try_divide(F.lit(z * z), n)
    centre = p + F.try_divide(F.lit(z * z), 2 * n)
    reach = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n))
    low, high = (centre - reach) / bottom, (centre + reach) / bottom
    return pairs.withColumns(
        {
            f"{arm}_ci_low": low,
            f"{arm}_ci_high": high,
            f"{arm}_error_low": p - low,
            f"{arm}_error_high": high - p,
        }
    )


def aov_t(pairs: DataFrame) -> DataFrame:
    """Add the pooled-variance t statistic of the order values and its degrees of freedom."""
    n1, n0 = as_double("treatment_orders"), as_double("control_orders")
    dof = n1 + n0 - 2
    pooled = F.try_divide((n1 - 1) * F.col("treatment_aov_var") + (n0 - 1) * F.col("control_aov_var"), dof)
    error = F.sqrt(pooled * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n0)))
    return pairs.withColumns(
        {"t_stat": F.try_divide(F.col("treatment_aov") - F.col("control_aov"), error), "dof": dof}
    )


def aov_p(pairs: DataFrame) -> DataFrame:
    """Add the two-sided p-value of the order value difference."""
    return pairs.withColumn("p_aov", t_p_value(F.col("t_stat"), F.col("dof")))


def significance(pairs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Add yes/no flags for both tests."""

    def flag(p: str) -> Column:
        return F.when(F.col(p) < alpha, "YES").otherwise("NO")

    return pairs.withColumns(
        {"conversion_significant": flag("p_conversion"), "aov_significant": flag("p_aov")}
    )


def conversion_flag(pairs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Add whether p < alpha, decided on z itself: no p-value is needed."""
    return pairs.withColumn("significant", F.coalesce(F.col("z_stat") > z_value(1 - alpha), F.lit(False)))


def impact(pairs: DataFrame) -> DataFrame:
    """Add expected revenue per visitor of both arms, the net lift and its sign."""

    def per_visitor(arm: str) -> Column:
        return F.col(f"{arm}_conversion_rate") * F.coalesce(F.col(f"{arm}_aov"), F.lit(0.0))

    net = per_visitor(TREATMENT) - per_visitor(CONTROL)
    return pairs.withColumns(
        {
            "revenue_control": per_visitor(CONTROL),
            "revenue_treatment": per_visitor(TREATMENT),
            "net_lift": net,
            "lift_sign": F.when(net > 0, "positive").otherwise("negative"),
        }
    )


def recommendation(pairs: DataFrame) -> DataFrame:
    """Add the advice from `significant` and `net_lift`: two-way and three-way."""
    # The wording of the advice.
    wins = F.col("significant") & (F.col("net_lift") > 0)
    return pairs.withColumns(
        {
            "advice": F.when(wins, "Roll out").otherwise("Do not roll out as-is"),
            "advice_detailed": F.when(wins, "Roll out")
            .when(F.col("significant"), "Do not roll out as-is")
            .otherwise("Inconclusive"),
        }
    )


def readout(visits: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The full result of every experiment in `visits`."""
    pairs = lift(side_by_side(arms(visits)))
    pairs = conversion_p(conversion_z(pairs))
    for arm in (CONTROL, TREATMENT):
        pairs = wilson(pairs, arm, alpha)
    pairs = significance(aov_p(aov_t(pairs)), alpha)
    return recommendation(impact(conversion_flag(pairs, alpha)))


def with_design(
    results: DataFrame,
    effect: float = 0.15,
    alpha: float = ALPHA,
    power: float = POWER,
    baseline: float | None = None,
) -> DataFrame:
    """Add the design to every result: for the planned `baseline` rate, or for the control arm's rate where none was."""
    chosen = {"mde_relative": F.lit(effect), "alpha": F.lit(alpha), "power": F.lit(power)}
    rate = F.col("control_conversion_rate") if baseline is None else F.lit(float(baseline))
    # Saved, one row per experiment: the optimiser would otherwise unfold the constants through every step of the design.
    return plan_experiments(settle(results.withColumns({"baseline_cr": rate, **chosen}), "designed"))


def summary(designed: DataFrame) -> DataFrame:
    """The eight report lines per experiment, as (experiment_id, metric, value)."""
    # The labels of the published summary.
    lines = {
        "Baseline conversion rate": percent("baseline_cr"),
        "Target conversion rate (design)": percent("target_cr"),
        "Required sample size per group": thousands("n_per_group"),
        "Observed control CR": percent("control_conversion_rate"),
        "Observed treatment CR": percent("treatment_conversion_rate"),
        "Conversion z-test p-value": F.format_string("%.5f", "p_conversion"),
        "AOV t-test p-value": F.format_string("%.5f", "p_aov"),
        "Revenue-per-visitor lift": F.format_string("Rs.%.2f", "net_lift"),
    }
    named = designed.select("experiment_id", *[value.alias(name) for name, value in lines.items()])
    return named.unpivot(["experiment_id"], list(lines), "metric", "value")
