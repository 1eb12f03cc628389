"""Command line: `spark-submit -m`-style runs of the composed results.

    python -m custoria overview --data DIR --out DIR [--format csv|parquet]
    python -m custoria churn    --data DIR --out DIR [--window-days 90] [--rounds 300] ...
    python -m custoria spend    --data DIR --out DIR
    python -m custoria cohorts  --data DIR --out DIR
    python -m custoria experiment --visits PATH --out DIR [--baseline 0.12] [--effect 0.15] [--alpha 0.05] [--power 0.8]
"""

from __future__ import annotations

import argparse

from custoria import session
from custoria.plans import churn, reports, spend
from custoria.sources.readers import open_shop, open_visits


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="custoria")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("overview", "churn", "spend", "cohorts", "experiment"):
        one = commands.add_parser(name)
        one.add_argument("--visits" if name == "experiment" else "--data", required=True, dest="data")
        one.add_argument("--out", required=True)
        one.add_argument("--format", default="csv", choices=("csv", "parquet"))
        if name == "experiment":
            one.add_argument("--alpha", type=float, default=0.05)
            one.add_argument("--power", type=float, default=0.80)
            one.add_argument("--effect", type=float, default=0.15, help="relative lift to detect")
            one.add_argument("--baseline", type=float, help="planned rate; by default the control arm's")
        if name in ("churn", "spend"):
            one.add_argument("--interactive", action="store_true", help="the settings of the interactive page")
            one.add_argument("--window-days", type=int, default=90)
            one.add_argument("--rounds", type=int)
            one.add_argument("--resume", help="shared folder where boosting saves its trees and goes on after an interruption")
            one.add_argument("--as-of", help="last date of the data; saves the scan that looks it up")
        if name == "churn":
            one.add_argument("--trees", type=int)
    return top


def main(arguments: list[str] | None = None) -> None:
    given = parser().parse_args(arguments)
    spark = session.tune(session.build("custoria"))
    with session.scratch_scope(spark):
        run(spark, given)


def run(spark, given: argparse.Namespace) -> None:
    if given.command == "experiment":
        visits = open_visits(spark, given.data, given.format)
        reports.write_experiment(visits, given.out, given.effect, given.alpha, given.power, given.baseline)
        return
    shop = open_shop(spark, given.data, given.format)
    if given.command == "overview":
        reports.write_overview(shop, given.out)
    elif given.command == "cohorts":
        reports.write_cohorts(shop, given.out)
    elif given.command == "churn":
        named = {"trees": given.trees, "rounds": given.rounds, "as_of": given.as_of, "resume": given.resume}
        named = {"window_days": given.window_days, **{k: v for k, v in named.items() if v is not None}}
        make = churn.ChurnSettings.interactive if given.interactive else churn.ChurnSettings
        settings = make(**named)
        reports.write_churn(shop, given.out, settings)
    else:
        named = {"rounds": given.rounds, "as_of": given.as_of, "resume": given.resume}
        named = {"window_days": given.window_days, **{k: v for k, v in named.items() if v is not None}}
        settings = (spend.SpendSettings.interactive if given.interactive else spend.SpendSettings)(**named)
        reports.write_spend(shop, given.out, settings)


if __name__ == "__main__":
    main()
