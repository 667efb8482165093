"""Event lines: ``name start end node filename executor``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from voxtally.functions import fixed

_NUMBER = r"-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?"
EVENT_LINE = rf"^(Read file|Write file|[^ ]+) {_NUMBER} {_NUMBER} [^ ]+ [^ ]+ -?[0-9]+$"
FIELDS = ["name", "start", "end", "node", "filename", "executor"]


def phase_name(first: Column) -> Column:
    """Name of a phase from the first word of its line."""
    out = first
    for odd, name in fixed.IRREGULAR_PHASES.items():
        out = F.when(first == odd.split(" ")[0], F.lit(name)).otherwise(out)
    return out


def parse_event(line: Column) -> list[Column]:
    """Typed fields of an event line; other lines go to ``_corrupt`` whole.

    Only the first field can hold a blank, so the others are counted from
    the end of the line.
    """
    ok = F.rlike(line, F.lit(EVENT_LINE))

    def from_end(n: int) -> Column:
        return F.substring_index(F.substring_index(line, " ", -n), " ", 1)

    values = [
        phase_name(F.substring_index(line, " ", 1)),
        from_end(5).try_cast("double"),
        from_end(4).try_cast("double"),
        from_end(3),
        from_end(2),
        from_end(1).try_cast("bigint"),
    ]
    return [
        *[F.when(ok, v).alias(n) for n, v in zip(FIELDS, values)],
        F.when(~ok, line).alias("_corrupt"),
    ]


def seconds_text(seconds: Column) -> Column:
    """Seconds with six decimals, never in scientific notation."""
    return seconds.cast("decimal(26,6)").cast("string")


def render_event(
    name: Column, start: Column, end: Column, node: Column, filename: Column, executor: Column
) -> Column:
    return F.concat_ws(
        " ", name, seconds_text(start), seconds_text(end), node, filename, executor.cast("string")
    )


def duration(start: Column, end: Column) -> Column:
    return end - start
