"""Run names: ``<engine>_<fs>_<n>it<blocks><image>_<delay>delay.out``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from voxtally.functions import fixed

RUN_NAME = r"^(sp|np)_[a-z]+_\d+it\d+(HBB|BB|MRI)_[0-9]+(\.[0-9]+)?delay(\.out)?$"


def parse_run_name(run: Column) -> list[Column]:
    """Typed columns of a run name, all null for a name of another shape.

    Filters on these columns are pushed to the scan, where nothing is shared
    between expressions. So each column is one pattern check, which a select
    of several shares, and plain string functions.
    """
    ok = F.rlike(run, F.lit(RUN_NAME))

    def between(text: Column, mark: str, n: int) -> Column:
        return F.substring_index(F.substring_index(text, mark, n), mark, -1)

    count = between(run, "_", 3)
    chunks = F.substring_index(count, "it", -1)
    image = (
        F.when(F.endswith(chunks, F.lit("HBB")), "HBB")
        .when(F.endswith(chunks, F.lit("BB")), "BB")
        .otherwise("MRI")
    )
    fields = {
        "engine": F.substring_index(run, "_", 1),
        "fs": between(run, "_", 2),
        "iterations": F.substring_index(count, "it", 1).try_cast("int"),
        "blocks": F.rtrim(chunks, F.lit("HBMRI")).try_cast("int"),
        "image": image,
        "delay": F.substring_index(between(run, "_", 4), "delay", 1).try_cast("double"),
    }
    return [F.when(ok, value).alias(name) for name, value in fields.items()]


def delay_text(delay: Column) -> Column:
    """A delay as written in run names: 2.4, 14.67, and 320 without '.0'."""
    text = F.regexp_replace(delay.cast("decimal(20,6)").cast("string"), r"0+$", "")
    return F.regexp_replace(text, r"\.$", "")


def render_run_name(
    engine: Column, fs: Column, iterations: Column, tag: Column, delay: Column | None
) -> Column:
    """Inverse of :func:`parse_run_name`; ``tag`` is blocks + image (125BB).

    A condition without a delay has no delay part.
    """
    head = F.concat(
        engine, F.lit("_"), fs, F.lit("_"), iterations.cast("string"), F.lit("it"), tag
    )
    if delay is None:
        return head
    return F.when(delay.isNull(), head).otherwise(
        F.concat(head, F.lit("_"), delay_text(delay), F.lit("delay.out"))
    )


def engine_of_framework(framework: Column) -> Column:
    return F.when(framework == "spark", F.lit("sp")).otherwise(F.lit("np"))


def dataset_tag(dataset: Column) -> Column:
    """Run-name tag of a dataset name, null for an unknown one."""
    tags = [item for name, (tag, _) in fixed.DATASETS.items() for item in (F.lit(name), F.lit(tag))]
    return F.try_element_at(F.create_map(*tags), dataset)
