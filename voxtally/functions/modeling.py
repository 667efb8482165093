"""Bandwidth and write-rate expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from voxtally.functions import fixed


def chunk_mb(image: Column, blocks: Column) -> Column:
    """Size of one chunk in MB of 2**20 bytes, as the I/O study takes it."""
    return (
        F.when(image == "HBB", F.lit(fixed.HBB_CHUNK_BYTES / fixed.MIB))
        .when(image == "BB", F.lit(float(fixed.BB_TOTAL_MB)) / blocks)
        .when(image == "MRI", F.lit(fixed.MRI_CHUNK_BYTES / fixed.MIB))
    )


def bandwidth(size: Column, seconds: Column) -> Column:
    """Size over time, where a duration of zero counts as 4 ms."""
    return size / F.when(seconds == 0, F.lit(fixed.ZERO_DURATION_FLOOR_S)).otherwise(seconds)


def compute_volume(delay: Column, iterations: Column, blocks: Column) -> Column:
    """C: seconds of computing in the whole run."""
    return delay * iterations * blocks


def data_volume(image_mib: Column, iterations: Column) -> Column:
    """D: MiB written in the whole run."""
    return image_mib * iterations


def write_rate(
    fs: Column, d: Column, c: Column, fs_mib_s: Column, gamma: Column, gamma_cluster: Column
) -> Column:
    """Data rate of the run over what its storage gives each task.

    Node-local storage is shared by the tasks of a node, the shared file
    system by all tasks. Memory-backed storage has no rate limit of this kind;
    its axis is D itself.
    """
    tasks = F.when(fs == fixed.SHARED_FS, gamma_cluster).otherwise(gamma)
    return F.when(fs == fixed.MEMORY_BACKED_FS, d).otherwise((d / c) / (fs_mib_s / tasks))


def cache_covers(ratio: Column) -> Column:
    """True when page cache can absorb every write (rate at or below 1)."""
    return ratio <= 1


def model_violation(ratio: Column, speedup: Column) -> Column:
    """Measured speed-up on the other side of 1 than the ratio says."""
    return ((ratio > 1) & (speedup < 1)) | ((ratio < 1) & (speedup > 1))


def region(ratio: Column, speedup: Column) -> Column:
    return (
        F.when(model_violation(ratio, speedup), F.lit("violation"))
        .when(cache_covers(ratio), F.lit("cached"))
        .otherwise(F.lit("limited"))
    )


def break_even(fs_mib_s: Column, rate: Column) -> Column:
    """Tasks at a time at which the storage becomes the bottleneck, to the
    nearest whole task."""
    return F.round(fs_mib_s / rate).cast("bigint")
