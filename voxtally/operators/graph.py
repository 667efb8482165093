"""Steps with named inputs and outputs, compiled into one Arrow UDF.

A step is a function whose parameters are outputs of other steps, or the
chunk itself, and whose results get names. The order follows from the names,
so a mean that one step gives can be an input of the next two. A chunk goes to
Python and back once, whatever the number of steps.
"""

from __future__ import annotations

import socket
import threading
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

#: The names that every chunk brings: its voxels as an n-d array, and its sides.
GIVEN = ("voxels", "shape")
TIMES = "array<struct<step:string,start:double,end:double,node:string,executor:bigint>>"


@dataclass(frozen=True)
class NamedStep:
    name: str
    fn: Callable[..., Any]
    inputs: tuple[tuple[str, str], ...]  # parameter, and the name of what it gets
    outputs: tuple[str, ...]
    params: tuple[tuple[str, Any], ...]

    def run(self, known: dict[str, Any]) -> None:
        got = self.fn(**{p: known[n] for p, n in self.inputs}, **dict(self.params))
        if len(self.outputs) == 1:
            known[self.outputs[0]] = got
            return
        if not isinstance(got, tuple) or len(got) != len(self.outputs):
            raise ValueError(f"step {self.name} has to give a tuple of {', '.join(self.outputs)}")
        known.update(zip(self.outputs, got))


@dataclass(frozen=True)
class StepGraph:
    """A set of named steps; the order in which they are added does not matter."""

    steps: tuple[NamedStep, ...] = field(default=())

    def step(
        self, fn: Callable[..., Any], outputs: str | Sequence[str], inputs: Mapping[str, str] | Sequence[str] = ("voxels",),
        name: str | None = None, **params: Any,
    ) -> StepGraph:
        """Add a step. ``inputs`` maps parameters to names, or lists names that are parameters too."""
        pairs = tuple(inputs.items()) if isinstance(inputs, Mapping) else tuple((n, n) for n in inputs)
        made = (outputs,) if isinstance(outputs, str) else tuple(outputs)
        name = name or getattr(fn, "__name__", "step")
        if not made:
            raise ValueError(f"step {name} gives nothing")
        taken = {o for s in self.steps for o in s.outputs} | set(GIVEN)
        for o in made:
            if o in taken or made.count(o) > 1:
                raise ValueError(f"there is already an output called {o}")
        return replace(self, steps=(*self.steps, NamedStep(name, fn, pairs, made, tuple(params.items()))))

    def ordered(self, wanted: Sequence[str]) -> list[NamedStep]:
        """The steps that the wanted outputs need, each after those it needs itself."""
        maker = {o: s for s in self.steps for o in s.outputs}
        out: list[NamedStep] = []
        done: set[int] = set()
        # a stack of steps that are being entered, so that a cycle is a step met again in it
        for goal in wanted:
            if goal in GIVEN:
                continue
            if goal not in maker:
                raise ValueError(f"no step gives {goal}")
            path: list[tuple[NamedStep, Iterator[tuple[str, str]]]] = [(maker[goal], iter(maker[goal].inputs))]
            while path:
                step, inputs = path[-1]
                if id(step) in done:
                    path.pop()
                    continue
                for _, needed in inputs:
                    if needed in GIVEN:
                        continue
                    if needed not in maker:
                        raise ValueError(f"no step gives {needed}, which {step.name} needs")
                    other = maker[needed]
                    if any(other is s for s, _ in path):
                        names = " -> ".join([*[s.name for s, _ in path], other.name])
                        raise ValueError(f"steps need each other: {names}")
                    if id(other) not in done:
                        path.append((other, iter(other.inputs)))
                        break
                else:
                    out.append(step)
                    done.add(id(step))
                    path.pop()
        return out

    def column(self, voxels: Column, shape: Column, results: Mapping[str, str], times: bool = False) -> Column:
        """A struct of the named results, each of the type given for it.

        Arrays are flattened in file order. With ``times``, a further field
        ``times`` says when, where and by which thread each step ran.
        """
        if not results:
            raise ValueError("name the results")
        steps = self.ordered(list(results))
        fields = [T.StructField(n, T.DataType.fromDDL(k)) for n, k in results.items()]
        if times:
            fields.append(T.StructField("times", T.DataType.fromDDL(TIMES)))
        schema = T.StructType(fields)
        kinds = {f.name: to_arrow_type(f.dataType) for f in fields}

        def cell(name: str, value: Any) -> Any:
            if value is None or not pa.types.is_list(kinds[name]):
                return value.item() if isinstance(value, np.generic) else value
            flat = np.asarray(value).reshape(-1, order="F")
            kept = flat.astype(kinds[name].value_type.to_pandas_dtype(), copy=False)
            if kept.dtype != flat.dtype and not np.array_equal(kept, flat, equal_nan=flat.dtype.kind == "f"):
                raise ValueError(f"{name}: values of type {flat.dtype} do not fit {kinds[name]}")
            return kept

        @F.arrow_udf(schema)
        def run(voxels: pa.Array, shape: pa.Array) -> pa.Array:
            node, executor = socket.gethostname(), threading.get_ident()
            columns: dict[str, list] = {n: [] for n in kinds}
            for v, dims in zip(voxels, shape):
                dims = dims.as_py()
                block = None if not v.is_valid else v.values.to_numpy(zero_copy_only=False).copy().reshape(dims, order="F")
                known: dict[str, Any] = {"voxels": block, "shape": dims}
                log = []
                for step in steps:
                    began = time.time()
                    if block is not None:
                        step.run(known)
                        log.append({"step": step.name, "start": began, "end": time.time(), "node": node, "executor": executor})
                for n in results:
                    columns[n].append(cell(n, None if block is None else known[n]))
                if times:
                    columns["times"].append(log)
            return pa.StructArray.from_arrays([pa.array(columns[n], k) for n, k in kinds.items()], names=list(kinds))

        return run(voxels, shape)

    def apply(self, chunks: DataFrame, results: Mapping[str, str], voxels: str = "voxels", times: bool = False) -> DataFrame:
        """The chunks with the results as columns; one named like a column takes its place.

        All steps need the whole image: chunks of images in several blocks fail.
        A null chunk has null results, and no step runs on it.
        """
        source = F.col(voxels)
        if "n_blocks" in chunks.columns:
            refused = F.raise_error(F.lit("a step needs the whole image")).cast(chunks.schema[voxels].dataType)
            source = F.when(F.col("n_blocks") == 1, source).otherwise(refused)
        names = [*results, *(["times"] if times else [])]
        rest = [c for c in chunks.columns if c not in names]
        done = chunks.select(*rest, self.column(source, F.col("shape"), results, times).alias("_results"))
        return done.select(*rest, *[F.col(f"_results.{n}").alias(n) for n in names])
