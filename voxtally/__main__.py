"""Command line: ``spark-submit`` or ``python -m voxtally <command> ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtally.functions import fixed
from voxtally.functions.runs import parse_run_name
from voxtally.operators import bandwidth, events, makespan, model
from voxtally.plans import reports
from voxtally.plans.increment import increment_pipeline
from voxtally.session import build_session
from voxtally.sources import logs


def _runs(spark: SparkSession, log_dir: str) -> DataFrame:
    spans = makespan.makespans(logs.read_event_logs(spark, log_dir), "line")
    return spans.select("*", *parse_run_name(F.col("run")))


def _save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def increment(spark: SparkSession, a: argparse.Namespace) -> None:
    increment_pipeline(
        spark,
        a.input,
        a.output,
        a.iterations,
        materialize=a.materialize,
        events=a.benchmark,
        work_dir=a.work_dir,
        overflow=a.overflow,
    )


def makespans(spark: SparkSession, a: argparse.Namespace) -> None:
    log = logs.read_event_logs(spark, a.log_dir)
    first = events.driver_rows(log).groupBy("run").agg(
        F.min_by(F.struct("node", "executor"), "line").alias("at")
    )
    spans = makespan.makespans(log, "line").join(first, "run")
    columns = (F.col(c) for c in ("run", "makespan", "at.node", "at.executor"))
    makespan.write_makespans(spans.select(makespan.makespan_line(*columns).alias("value")), a.output)


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    _save(reports.comparison(_runs(spark, a.log_dir), a.exp, a.condition), a.output)


def speedup(spark: SparkSession, a: argparse.Namespace) -> None:
    curve = model.speedup_curve(_runs(spark, a.log_dir))
    _save(curve.select("fs", "run", "rate", "speedup"), a.output)


def io(spark: SparkSession, a: argparse.Namespace) -> None:
    log = logs.read_event_logs(spark, a.log_dir)
    named = log.select("*", *parse_run_name(F.col("run")))
    _save(bandwidth.distribution(bandwidth.io_bandwidths(named)), a.output)


def timeline(spark: SparkSession, a: argparse.Namespace) -> None:
    log = logs.read_event_logs(spark, a.log).filter(F.col("_corrupt").isNull())
    based = events.rebase(log, F.lit(a.rebase))
    events.write_timeline(events.timeline(based, ["line"]), a.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="voxtally", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(fn, *positional: str, text: str) -> argparse.ArgumentParser:
        p = sub.add_parser(fn.__name__, help=text)
        p.set_defaults(run=fn)
        for name in positional:
            p.add_argument(name)
        return p

    p = command(increment, "input", "output", text="add 1 to every voxel of all images, n times")
    p.add_argument("iterations", type=int)
    p.add_argument("--benchmark", action="store_true", help="also save timed events")
    p.add_argument("--materialize", action="store_true", help="write every step")
    p.add_argument("--work_dir", help="where steps are written")
    p.add_argument("--overflow", choices=["raise", "wrap"], default="raise")
    command(makespans, "log_dir", "output", text="one makespan line per log")
    p = command(report, "log_dir", "output", text="comparison table of an experiment")
    p.add_argument("exp", type=int, choices=sorted(fixed.AXES))
    p.add_argument("-c", "--condition", type=float, help="delay (1) or iterations (4)")
    command(speedup, "log_dir", "output", text="speed-up against write rate")
    command(io, "log_dir", "output", text="I/O bandwidth distributions")
    p = command(timeline, "log", "output", text="tasks of one log as JSON")
    p.add_argument("--rebase", action="store_true", help="times relative to the driver's start")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(build_session(), args)


if __name__ == "__main__":
    main()
