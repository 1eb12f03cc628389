"""Experiment design and readout. The twins sum series, since DuckDB has no normal or t functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, sql, view
from custoria.functions.probability import z_value
from custoria.operators import experiment
from custoria.plans import reports
from custoria.sources import star

# The choices of the interactive page.
EFFECTS = (0.05, 0.15, 0.25, 0.50)
ALPHAS, POWERS = (0.01, 0.05, 0.10), (0.70, 0.80, 0.90)
Z95 = z_value(0.975)


def phi_sql(z: str) -> str:
    """Normal distribution function as 1/2 + density x sum of z^(2k+1) / (2k+1)!!.

    Beyond 9 deviations it is 0 or 1 to far more digits than are compared.
    """
    near = f"greatest(-9, least(9, {z}))"
    return f"""(CASE WHEN ({z}) IS NULL THEN NULL ELSE 0.5::DOUBLE + exp(-({near}) * ({near}) / 2) / sqrt(2 * pi()) * ({near}) * list_sum(list_transform(range(150),
        lambda k: CASE WHEN k = 0 THEN 1::DOUBLE ELSE pow(abs({near}), 2 * k) /
          exp((k + 1) * ln(2) + lgamma(k + 1.5) - 0.5 * ln(pi())) END)) END)"""


def t_sql(t: str, dof: str) -> str:
    """Two-sided t p-value as 1 - incomplete beta at t^2 / (dof + t^2), by its power series."""
    y = f"(({t}) * ({t}) / ({dof} + ({t}) * ({t})))"
    b = f"({dof} / 2)"
    return f"""(1 - exp(0.5 * ln({y}) + {b} * ln(1 - {y}) + lgamma(0.5 + {b}) - lgamma(0.5) - lgamma({b})) / 0.5 *
        (1 + list_sum(list_transform(range(200), lambda k: exp(lgamma(1.5) + lgamma(k + 1) - lgamma(k + 2.5)
             - lgamma(0.5 + {b}) - lgamma(k + 1) + lgamma(k + 1.5 + {b}) + (k + 1) * ln({y}))))))"""


for _suffix in ("", "_all"):
    view(
        f"arm{_suffix}",
        f"visit{_suffix}",
        text=f"""
        SELECT experiment_id, variant, count(*) AS n, count(*) FILTER (converted = 1) AS c,
               CAST(count(*) FILTER (converted = 1) AS DOUBLE) / count(*) AS cr, count(order_value) AS o,
               avg(order_value) AS aov,
               var_samp(order_value) AS v, stddev_pop(order_value) AS sd
        FROM visit{_suffix} GROUP BY 1, 2""",
    )
    view(
        f"pair{_suffix}",
        f"arm{_suffix}",
        text=f"""
        SELECT *, cr1 - cr0 AS gain, (cr1 - cr0) / nullif(sqrt(pooled * (1 - pooled) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n0)), 0) AS z,
               (aov1 - aov0) / nullif(sqrt(((o1 - 1) * v1 + (o0 - 1) * v0) / (o1 + o0 - 2) * (1.0::DOUBLE / o1 + 1.0::DOUBLE / o0)), 0) AS t,
               CAST(o1 + o0 - 2 AS DOUBLE) AS dof, cr0 * coalesce(aov0, 0) AS rev0, cr1 * coalesce(aov1, 0) AS rev1,
               cr1 * coalesce(aov1, 0) - cr0 * coalesce(aov0, 0) AS net
        FROM (SELECT a.experiment_id, a.n AS n0, b.n AS n1, a.c AS c0, b.c AS c1, a.cr AS cr0, b.cr AS cr1,
                     a.o AS o0, b.o AS o1, a.aov AS aov0, b.aov AS aov1, a.v AS v0, b.v AS v1,
                     CAST(a.c + b.c AS DOUBLE) / (a.n + b.n) AS pooled
              FROM arm{_suffix} a JOIN arm{_suffix} b USING (experiment_id)
              WHERE a.variant = 'control' AND b.variant = 'treatment')""",
    )
    view(
        f"base{_suffix}",
        f"arm{_suffix}",
        text=f"SELECT experiment_id, cr AS baseline_cr FROM arm{_suffix} WHERE variant = 'control'",
    )


def numbers(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


# Normal quantiles of the menu, for 1 - alpha / 2 and for the power.
CUT = {0.01: 2.5758293035489004, 0.05: 1.959963984540054, 0.10: 1.6448536269514722}
REACH = {0.70: 0.5244005127080407, 0.80: 0.8416212335729143, 0.90: 1.2815515655446004}


def case_sql(column: str, values: dict[float, float]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = {k!r}::DOUBLE THEN {v!r}::DOUBLE" for k, v in values.items()) + " END"


def newton_sql(source: str) -> str:
    """A better shift `d`: both tails together shall have the power."""
    density = "(exp(-(d - cut) * (d - cut) / 2) - exp(-(d + cut) * (d + cut) / 2)) / sqrt(2 * pi())"
    return f"""(SELECT * EXCLUDE (d), d - ({phi_sql('d - cut')} + {phi_sql('-d - cut')} - power) / ({density}) AS d FROM {source})"""


def planned_sql(suffix: str, effects, alphas, powers) -> str:
    first = f"""(SELECT *, CASE WHEN target_cr <= 1 THEN 2 * (asin(sqrt(target_cr)) - asin(sqrt(baseline_cr))) END AS h,
                 {case_sql('alpha', CUT)} AS cut, {case_sql('alpha', CUT)} + {case_sql('power', REACH)} AS d
          FROM (SELECT *, baseline_cr * (1 + mde_relative) AS target_cr
                FROM base{suffix}, (SELECT unnest({numbers(effects)}) AS mde_relative),
                     (SELECT unnest({numbers(alphas)}) AS alpha), (SELECT unnest({numbers(powers)}) AS power)))"""
    return f"""
    SELECT * EXCLUDE (cut, d), CAST(ceil(2 * pow(d / nullif(h, 0), 2)) AS BIGINT) AS n_per_group
    FROM {newton_sql(newton_sql(first))}"""


view("planned", "base", text=planned_sql("", EFFECTS, ALPHAS, POWERS))
view("planned_one", "base", text=planned_sql("", (0.15,), (0.05,), (0.80,)))
view("planned_all", "base_all", text=planned_sql("_all", (0.15,), (0.05,), (0.80,)))


def baselines(spark, folder, mode="daily"):
    """The control arm's rate of every experiment: the baseline of its next design."""
    per_arm = experiment.arms(star.visits(spark, folder, mode))
    return per_arm.filter(F.col("variant") == "control").select(
        "experiment_id", F.col("conversion_rate").alias("baseline_cr")
    )


def menu(spark, folder):
    return experiment.design_menu(baselines(spark, folder), EFFECTS, ALPHAS, POWERS)


def pairs(spark, folder):
    return experiment.side_by_side(experiment.arms(star.visits(spark, folder)))


def r9(*names):
    return [F.round(name, 9).alias(name) for name in names]


def r6(*names):
    """Sums of order values depend on the order of the rows in their last digits."""
    return [F.round(name, 6).alias(name) for name in names]


KEYS = ("experiment_id", "mde_relative", "alpha", "power")

# ---- design ---------------------------------------------------------------------------------


@query("X01_target_rate", sql("planned", f"SELECT {', '.join(KEYS)}, target_cr FROM planned"))
def x01(spark, folder):
    return experiment.target_rate(menu(spark, folder)).select(*KEYS, "target_cr")


@query("X02_effect_size", sql("planned", f"SELECT {', '.join(KEYS)}, round(h, 9) AS effect_size FROM planned"))
def x02(spark, folder):
    table = experiment.effect_size(experiment.target_rate(menu(spark, folder)))
    return table.select(*KEYS, *r9("effect_size"))


@query("X03_required_sample", sql("planned", f"SELECT {', '.join(KEYS)}, n_per_group FROM planned"))
def x03(spark, folder):
    return experiment.plan_experiments(menu(spark, folder)).select(*KEYS, "n_per_group")


@query("X04_total_sample", sql("planned", f"SELECT {', '.join(KEYS)}, 2 * n_per_group AS total_n FROM planned"))
def x04(spark, folder):
    return experiment.plan_experiments(menu(spark, folder)).select(*KEYS, "total_n")


def power_sql(source: str, n: str, columns: str) -> str:
    shift = f"h * sqrt({n} / 2.0::DOUBLE)"
    cut = "CASE " + " ".join(f"WHEN alpha = {a!r}::DOUBLE THEN {z_value(1 - a / 2)!r}::DOUBLE" for a in ALPHAS) + " END"
    return f"""
    SELECT {columns}, round({phi_sql('d - cut')} + {phi_sql('-d - cut')}, 9) AS power_at_n
    FROM (SELECT *, {shift} AS d, {cut} AS cut FROM {source})"""


@query(
    "X05_power_at_n",
    sql("planned", power_sql("(SELECT *, n_per_group AS n FROM planned)", "n", f"{', '.join(KEYS)}, n")),
)
def x05(spark, folder):
    planned = experiment.plan_experiments(menu(spark, folder)).withColumn("n", F.col("n_per_group"))
    return experiment.power_at(planned).select(*KEYS, "n", *r9("power_at_n"))


FIXED_GRID = "(SELECT *, CAST(unnest(range(500, 20000, 250)) AS INTEGER) AS n FROM planned_one)"
RELATIVE_GRID = """(SELECT *, unnest(range(greatest(200, n_per_group // 10), n_per_group * 2,
                                         greatest(1, n_per_group // 40))) AS n FROM planned_one)"""


def planned_one(spark, folder):
    return experiment.plan_experiments(experiment.design_menu(baselines(spark, folder)))


@query("X06_power_curve", sql("planned_one", power_sql(FIXED_GRID, "n", "experiment_id, n")))
def x06(spark, folder):
    table = experiment.power_at(experiment.fixed_grid(planned_one(spark, folder)))
    return table.select("experiment_id", "n", *r9("power_at_n"))


@query("X06_power_curve_relative", sql("planned_one", power_sql(RELATIVE_GRID, "n", "experiment_id, n")))
def x06_relative(spark, folder):
    table = experiment.power_at(experiment.relative_grid(planned_one(spark, folder)))
    return table.select("experiment_id", "n", *r9("power_at_n"))


# ---- readout --------------------------------------------------------------------------------


@query(
    "X07_conversion_rate",
    sql("arm", "SELECT experiment_id, variant, n AS visitors, c AS conversions, cr AS conversion_rate FROM arm"),
)
def x07(spark, folder):
    table = experiment.arms(star.visits(spark, folder))
    return table.select("experiment_id", "variant", "visitors", "conversions", "conversion_rate")


@query(
    "X08_lift",
    sql("pair", "SELECT experiment_id, gain AS absolute_lift, gain / nullif(cr0, 0) AS relative_lift FROM pair"),
)
def x08(spark, folder):
    return experiment.lift(pairs(spark, folder)).select("experiment_id", "absolute_lift", "relative_lift")


@query(
    "X09_two_proportion_z",
    sql(
        "pair",
        f"SELECT experiment_id, round(z, 9) AS z_stat, round({phi_sql('-z')}, 9) AS p_conversion FROM pair",
    ),
)
def x09(spark, folder):
    table = experiment.conversion_p(experiment.conversion_z(pairs(spark, folder)))
    return table.select("experiment_id", *r9("z_stat", "p_conversion"))


def wilson_sql(arm: int, name: str) -> str:
    z, n, p = repr(Z95), f"n{arm}", f"cr{arm}"
    centre = f"({p} + {z} * {z} / (2 * {n}))"
    reach = f"{z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0::DOUBLE * {n} * {n}))"
    bottom = f"(1 + {z}::DOUBLE * {z} / {n})"
    low, high = f"({centre} - {reach}) / {bottom}", f"({centre} + {reach}) / {bottom}"
    return f"""round({low}, 9) AS {name}_ci_low, round({high}, 9) AS {name}_ci_high,
        round({p} - {low}, 9) AS {name}_error_low, round({high} - {p}, 9) AS {name}_error_high"""


WILSON_SQL = f"{wilson_sql(0, 'control')}, {wilson_sql(1, 'treatment')}"
WILSON = [f"{arm}_{end}" for arm in ("control", "treatment") for end in ("ci_low", "ci_high", "error_low", "error_high")]


@query("X10_wilson_interval", sql("pair", f"SELECT experiment_id, {WILSON_SQL} FROM pair"))
def x10(spark, folder):
    table = experiment.wilson(experiment.wilson(pairs(spark, folder), "control"), "treatment")
    return table.select("experiment_id", *r9(*WILSON))


@query(
    "X11_order_value_t",
    sql("pair", f"SELECT experiment_id, round(t, 8) AS t_stat, dof, round({t_sql('t', 'dof')}, 8) AS p_aov FROM pair"),
)
def x11(spark, folder):
    table = experiment.aov_p(experiment.aov_t(pairs(spark, folder)))
    return table.select("experiment_id", F.round("t_stat", 8).alias("t_stat"), "dof", F.round("p_aov", 8).alias("p_aov"))


@query(
    "X12_significance",
    sql(
        "pair",
        f"""SELECT experiment_id, z > {z_value(0.95)!r} AS significant,
            CASE WHEN {phi_sql('-z')} < 0.05 THEN 'YES' ELSE 'NO' END AS conversion_significant,
            CASE WHEN {t_sql('t', 'dof')} < 0.05 THEN 'YES' ELSE 'NO' END AS aov_significant FROM pair""",
    ),
)
def x12(spark, folder):
    table = experiment.aov_p(experiment.aov_t(experiment.conversion_p(experiment.conversion_z(pairs(spark, folder)))))
    table = experiment.conversion_flag(experiment.significance(table))
    return table.select("experiment_id", "significant", "conversion_significant", "aov_significant")


@query(
    "X13_order_value_error",
    sql("arm", "SELECT experiment_id, variant, o AS orders, round(aov, 6) AS aov, round(sd / sqrt(o), 9) AS aov_se FROM arm"),
)
def x13(spark, folder):
    table = experiment.arms(star.visits(spark, folder))
    return table.select("experiment_id", "variant", "orders", *r6("aov"), *r9("aov_se"))


@query(
    "X14_incremental_per_1000",
    sql("pair", "SELECT experiment_id, gain * 1000 AS incremental_per_1000 FROM pair"),
)
def x14(spark, folder):
    return experiment.lift(pairs(spark, folder)).select("experiment_id", "incremental_per_1000")


SIGN_SQL = "CASE WHEN net > 0 THEN 'positive' ELSE 'negative' END AS lift_sign"


@query(
    "X15_revenue_per_visitor",
    sql(
        "pair",
        f"""SELECT experiment_id, round(rev0, 6) AS revenue_control, round(rev1, 6) AS revenue_treatment,
            round(net, 6) AS net_lift, {SIGN_SQL} FROM pair""",
    ),
)
def x15(spark, folder):
    return experiment.impact(pairs(spark, folder)).select(
        "experiment_id", *r6("revenue_control", "revenue_treatment", "net_lift"), "lift_sign"
    )


@query("P14_conditional_label", sql("pair", f"SELECT experiment_id, {SIGN_SQL} FROM pair"))
def p14(spark, folder):
    return experiment.impact(pairs(spark, folder)).select("experiment_id", "lift_sign")


ADVICE_SQL = f"""
    CASE WHEN z > {z_value(0.95)!r} AND net > 0 THEN 'Roll out' ELSE 'Do not roll out as-is' END AS advice,
    CASE WHEN z > {z_value(0.95)!r} AND net > 0 THEN 'Roll out' WHEN z > {z_value(0.95)!r} THEN 'Do not roll out as-is'
         ELSE 'Inconclusive' END AS advice_detailed"""


@query("X16_recommendation", sql("pair", f"SELECT experiment_id, {ADVICE_SQL} FROM pair"))
def x16(spark, folder):
    table = experiment.impact(experiment.conversion_flag(experiment.conversion_z(pairs(spark, folder))))
    return experiment.recommendation(table).select("experiment_id", "advice", "advice_detailed")


def line_sql(metric: str, value: str) -> str:
    return f"SELECT experiment_id, '{metric}' AS metric, {value} AS value FROM pair_all JOIN planned_all USING (experiment_id)"


@query(
    "X17_summary",
    sql(
        "pair_all planned_all",
        " UNION ALL ".join(
            [
                line_sql("Baseline conversion rate", "printf('%.2f%%', baseline_cr * 100)"),
                line_sql("Target conversion rate (design)", "printf('%.2f%%', target_cr * 100)"),
                line_sql("Required sample size per group", "format('{:,}', n_per_group)"),
                line_sql("Observed control CR", "printf('%.2f%%', cr0 * 100)"),
                line_sql("Observed treatment CR", "printf('%.2f%%', cr1 * 100)"),
                line_sql("Conversion z-test p-value", f"printf('%.5f', {phi_sql('-z')})"),
                line_sql("AOV t-test p-value", f"printf('%.5f', {t_sql('t', 'dof')})"),
                line_sql("Revenue-per-visitor lift", "printf('Rs.%.2f', net)"),
            ]
        ),
    ),
)
def x17(spark, folder):
    return reports.experiment_summary(star.visits(spark, folder, "all"))


@query(
    "Q10_experiment_readout",
    sql(
        "pair",
        f"""SELECT experiment_id, n0 AS control_visitors, n1 AS treatment_visitors, c0 AS control_conversions,
            c1 AS treatment_conversions, cr0 AS control_conversion_rate, cr1 AS treatment_conversion_rate,
            gain AS absolute_lift, gain / nullif(cr0, 0) AS relative_lift, gain * 1000 AS incremental_per_1000,
            round(z, 9) AS z_stat, round({phi_sql('-z')}, 9) AS p_conversion, {WILSON_SQL},
            round(aov0, 6) AS control_aov, round(aov1, 6) AS treatment_aov, round(t, 8) AS t_stat, dof, round({t_sql('t', 'dof')}, 8) AS p_aov,
            round(rev0, 6) AS revenue_control, round(rev1, 6) AS revenue_treatment, round(net, 6) AS net_lift, {SIGN_SQL}, {ADVICE_SQL} FROM pair""",
    ),
)
def q10(spark, folder):
    table = experiment.readout(star.visits(spark, folder))
    exact = [
        f"{arm}_{m}" for m in ("visitors", "conversions", "conversion_rate") for arm in ("control", "treatment")
    ]
    return table.select(
        "experiment_id",
        *exact,
        "absolute_lift",
        "relative_lift",
        "incremental_per_1000",
        *r9("z_stat", "p_conversion", *WILSON),
        F.round("t_stat", 8).alias("t_stat"),
        "dof",
        F.round("p_aov", 8).alias("p_aov"),
        *r6("control_aov", "treatment_aov", "revenue_control", "revenue_treatment", "net_lift"),
        "lift_sign",
        "advice",
        "advice_detailed",
    )


@query(
    "Q11_experiment_design",
    sql(
        "planned",
        f"""SELECT {', '.join(KEYS)}, baseline_cr, target_cr, round(h, 9) AS effect_size, n_per_group,
            2 * n_per_group AS total_n FROM planned""",
    ),
)
def q11(spark, folder):
    table = experiment.plan_experiments(menu(spark, folder))
    return table.select(*KEYS, "baseline_cr", "target_cr", *r9("effect_size"), "n_per_group", "total_n")
