"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted once into cells of source, language and topic. The
cells' token weights are raked: scaled to the target shares of each of the
three in turn, again and again, until all three hold to a tolerance. A cell's
weight over its own tokens says how much more or less of it is wanted; a common
factor turns this into probabilities that spend a budget of tokens in
expectation, and a hash of each document's id decides. Columns, windows and
joins only, no Python.

Cells are as few as combinations of values, whatever the number of documents,
and are made with partial sums, so a hot source costs one row for each task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtally.llm.common import under_safe_names, unit_hash, whole_text
from voxtally.session import literal_table, materialize

#: What a dimension's shares are to be: weights by value (a mapping, or a table of value and weight), or the power of the
#: present token shares; powers below 1 lift rare values.
Target = float | Mapping[str, float] | DataFrame
TARGETS: Mapping[str, Target] = {"source": 0.5, "lang": 0.5, "topic": 0.5}
DIMENSIONS = ("source", "lang", "topic")
#: Sweeps go on until no share is off by more than this, or so many are done; after so many the shares are looked at.
TOLERANCE = 1e-12
MOST_SWEEPS = 200
SWEEPS_A_TABLE = 8
#: So many sweeps are one plan: the driver's memory goes by its windows, one for each dimension of each sweep.
SWEEPS_A_PLAN = 2
#: Up to so many cells are raked in one task, without shuffles; more are shuffled by each dimension.
CELLS_IN_A_TASK = 200_000
BUDGET = 0.5
SEED = "mix"
NONE = "(null)"
_SYMBOLS = "#$%&*{}[]<>=;|~^"


def n_tokens(text: Column) -> Column:
    """Words between blanks and line feeds; a text without any counts one."""
    blanks = F.length(text) - F.length(F.replace(F.replace(text, F.lit(" ")), F.lit("\n")))
    return (blanks + 1).cast("bigint")


def topic(text: Column) -> Column:
    """What a text mainly is, by its characters: symbols, figures, lines, short or prose."""
    n = F.length(text)
    symbols = n - F.length(F.translate(text, _SYMBOLS, ""))
    digits = n - F.length(F.translate(text, "0123456789", ""))
    lines = n - F.length(F.replace(text, F.lit("\n")))
    return (
        F.when(symbols * 50 > n, "symbols")
        .when(digits * 50 > n, "figures")
        .when(lines * 400 > n, "lines")
        .when(n < 400, "short")
        .otherwise("prose")
    )


def described(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with ``_tokens`` and a value of each dimension; null is a value too."""
    text = whole_text(text_col)
    return docs.select(
        "*",
        n_tokens(text).alias("_tokens"),
        F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("_source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("_lang"),
        topic(text).alias("_topic"),
    )


def target_shares(cells: DataFrame, dim: str, target: Target) -> DataFrame:
    """``(dim, _share)`` of each value that occurs, scaled to sum to one.

    Values that a mapping or table leaves out get no share; values that it
    has and the cells do not are passed over. Without any weight on a value
    that occurs, all shares are null, and so are the weights.
    """
    sums = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("_sum"))
    if isinstance(target, (int, float)):
        wanted = sums.select(dim, F.pow("_sum", F.lit(float(target))).alias("_want"))
    else:
        if not isinstance(target, DataFrame):
            target = literal_table(cells.sparkSession, [(k, float(v)) for k, v in target.items()], ["value", "want"])
        # a value that the table repeats has the sum of its weights
        given = target.toDF(dim, "_want").groupBy(dim).agg(F.sum(F.col("_want").cast("double")).alias("_want"))
        wanted = sums.join(given, dim, "left").select(dim, F.coalesce("_want", F.lit(0.0)).alias("_want"))
    wanted = materialize(wanted, "targets")
    whole = wanted.agg(F.sum("_want")).first()[0]
    return wanted.select(dim, (F.col("_want") / F.lit(whole or None).cast("double")).alias("_share"))


def rake(cells: DataFrame, dims: list[str], tolerance: float = TOLERANCE, most: int = MOST_SWEEPS) -> tuple[DataFrame, float, int]:
    """Scale the column ``w`` of the cells to the ``<dim>_share`` of each dimension's values.

    Returns the cells, the largest difference left between a share and its
    target, and the number of sweeps. Targets that exclude each other (a source
    that only has one language, say) leave a difference. A few sweeps make one
    written table, which keeps the plan short and survives lost executors.
    """
    one_task = cells.count() <= CELLS_IN_A_TASK
    if one_task:
        cells = cells.coalesce(1)
    gap, done = None, 0
    while done < most:
        for at in range(min(SWEEPS_A_TABLE, most - done)):
            if at and at % SWEEPS_A_PLAN == 0:
                cells = materialize(cells, "swept")
                cells = cells.coalesce(1) if one_task else cells
            for dim in dims:
                total = F.sum("w").over(Window.partitionBy(dim))
                cells = cells.withColumn("w", F.when(total > 0, F.col("w") * F.col(f"{dim}_share") / total).otherwise(F.lit(0.0)))
            done += 1
        off = [F.abs(F.sum("w").over(Window.partitionBy(d)) - F.col(f"{d}_share")) for d in dims]
        written = materialize(cells.withColumn("_off", F.greatest(F.lit(0.0), F.lit(0.0), *off)), "raked")
        gap = written.agg(F.max("_off")).first()[0]
        cells = written.drop("_off")
        if gap is None or gap <= tolerance:
            break
        if done < most and one_task:
            cells = cells.coalesce(1)
    return cells, gap or 0.0, done


def with_probability(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Add ``weight``, the wanted over the present share, and ``probability``.

    The probability is the weight times a factor, at most one. The factor that
    spends ``budget`` of all tokens is found from below, by counting full the
    cells that reach one and giving what is left to the others, until no
    further cell gets full. Where all wanted cells are full, less is spent.
    """
    whole = cells.agg(F.sum("tokens").alias("n")).first()[0]
    if whole is None:
        return cells.withColumns({"weight": F.lit(1.0), "probability": F.lit(1.0)})
    cells = cells.withColumn("weight", F.col("w") * F.lit(float(whole)) / F.col("tokens"))
    factor = budget
    while True:
        full = F.col("weight") * F.lit(factor) >= 1
        row = cells.agg(
            F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"),
            F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("weight"))).alias("rest"),
        ).first()
        better = (budget * whole - row["full"]) / row["rest"] if row["rest"] else factor
        # equal cells get full together, so each step takes in at least one more weight
        if better <= factor * (1 + 1e-12):
            break
        factor = better
    return cells.withColumn("probability", F.round(F.least(F.lit(1.0), F.col("weight") * F.lit(factor)), 6))


def fitted_cells(
    rows: DataFrame, targets: Mapping[str, Target] = TARGETS, budget: float = BUDGET,
    tolerance: float = TOLERANCE, most_sweeps: int = MOST_SWEEPS,
) -> DataFrame:
    """``(_source, _lang, _topic, tokens, w, weight, probability, gap, sweeps)`` of described documents.

    ``gap`` is the largest difference left between a share and its target, and
    ``sweeps`` how many it took. Dimensions without a target are left as they
    come.
    """
    dims = [f"_{d}" for d in DIMENSIONS if d in targets]
    cells = rows.groupBy(*[f"_{d}" for d in DIMENSIONS]).agg(F.sum("_tokens").alias("tokens"))
    cells = materialize(cells, "cells")
    start = cells.withColumn("w", F.col("tokens").cast("double"))
    for dim in dims:
        shares = target_shares(cells, dim, targets[dim[1:]])
        start = start.join(materialize(shares, "shares").withColumnRenamed("_share", f"{dim}_share"), dim)
    raked, gap, sweeps = rake(materialize(start, "start"), dims, tolerance, most_sweeps)
    return with_probability(raked, budget).withColumns({"gap": F.lit(float(gap)), "sweeps": F.lit(sweeps)})


def sampled(docs: DataFrame, cells: DataFrame, seed: str = SEED, id_col: str = "doc_id") -> DataFrame:
    """Described documents with weight, probability and ``sampled``."""
    fitted = materialize(cells.select("_source", "_lang", "_topic", "weight", "probability"), "fitted")
    fitted = fitted.withColumnsRenamed({"weight": "_weight", "probability": "_probability"})
    out = docs.join(fitted, ["_source", "_lang", "_topic"])
    return out.withColumn("_sampled", unit_hash(F.col(id_col), seed) < F.col("_probability"))


def mix(
    docs: DataFrame, budget: float = BUDGET, targets: Mapping[str, Target] = TARGETS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: ``(id, source, lang, topic, n_tokens, weight, probability, sampled)``.

    A null source or language is a value of its own, ``(null)``; a null text
    is empty, and a text without words counts one token. Rows that repeat an
    id are decided alike; a null id is decided as the word null. An empty
    table gives no rows. Other columns are ignored.
    """
    narrow = described(docs.select(F.col(id_col), F.col(text_col), "source", "lang"), text_col)
    narrow = materialize(narrow.select(id_col, "_tokens", "_source", "_lang", "_topic"), "described")
    out = sampled(narrow, fitted_cells(narrow, targets, budget), seed, id_col)
    return out.select(
        id_col,
        F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"), F.round("_weight", 6).alias("weight"),
        F.col("_probability").alias("probability"), F.col("_sampled").alias("sampled"),
    )


def mixed(
    docs: DataFrame, budget: float = BUDGET, targets: Mapping[str, Target] = TARGETS, seed: str = SEED,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The sampled documents, with the columns they came with."""

    def choose(rows: DataFrame) -> DataFrame:
        columns = rows.columns
        rows = described(rows, text_col)
        counted = materialize(rows.select("_tokens", "_source", "_lang", "_topic"), "described")
        out = sampled(rows, fitted_cells(counted, targets, budget), seed, id_col)
        return out.where("_sampled").select(*columns)

    return under_safe_names(docs, [id_col, text_col, "source", "lang"], choose)
