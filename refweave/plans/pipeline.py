"""A small registry of named steps: functions whose parameter names are the steps or inputs they need."""

from __future__ import annotations

import hashlib
import inspect
import time
import uuid
from collections.abc import Callable, MutableMapping
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from refweave.sources import readers, sinks


class PipelineError(ValueError):
    pass


@dataclass(frozen=True)
class Step:
    name: str
    function: Callable
    needs: dict[str, str]  # parameter -> step or input
    optional: frozenset[str] = frozenset()
    when: tuple[tuple[str, object], ...] = ()
    fields: tuple[str, ...] = ()
    kind: str = "node"


@dataclass
class Pipeline:
    """Steps by name; the config chooses among variants, and only what is asked for is built."""

    config: dict = field(default_factory=dict)
    steps: dict[str, Step] = field(default_factory=dict)
    cache: MutableMapping[str, object] | None = None
    adapters: list = field(default_factory=list)  # told of each step: before(step), after(step, value, seconds), failed(step, error, seconds)

    def add(self, function: Callable, name: str | None = None, when: dict | None = None, fields: tuple[str, ...] = (), kind: str = "node", bind: dict[str, str] | None = None) -> Pipeline:
        """``name__variant`` registers as ``name``. ``when``: the config values under which the step counts. ``fields``: the function returns these parts, each a step. ``bind``: a parameter's step if it isn't its own name."""
        when = when or {}
        if any(self.config.get(k) != v for k, v in when.items()):
            return self
        name = (name or function.__name__).split("__")[0]
        if name in self.steps:
            raise PipelineError(f"two steps are called {name}")
        params = inspect.signature(function).parameters
        needs = {p: (bind or {}).get(p, p) for p in params}
        optional = frozenset(p for p, x in params.items() if x.default is not inspect.Parameter.empty)
        self.steps[name] = Step(name, function, needs, optional, tuple(when.items()), fields, kind)
        for k, part in enumerate(fields):
            self.steps[part] = Step(part, lambda whole, k=k, part=part: whole[part] if isinstance(whole, dict) else whole[k], {"whole": name})
        return self

    def add_each(self, function: Callable, specs: dict[str, dict]) -> Pipeline:
        """A step for each spec: values for some parameters, or ("step", name) for others."""
        for name, spec in specs.items():
            bound = {p: x[1] for p, x in spec.items() if isinstance(x, tuple) and x[:1] == ("step",)}
            fixed = {p: x for p, x in spec.items() if p not in bound}
            free = [p for p in inspect.signature(function).parameters if p not in fixed]

            def call(*args, free=tuple(free), fixed=fixed):
                return function(**dict(zip(free, args, strict=True)), **fixed)

            self.steps[name] = Step(name, call, {p: bound.get(p, p) for p in free})
        return self

    def source(self, name: str, path: str, kind: str = "parquet", schema: str | None = None, metadata: bool = False, position: bool = False) -> Pipeline:
        """A step that reads a file of the kind, from the input ``spark``; ``position`` adds ``source_pos``. With ``metadata`` it loads both, as ``name`` and ``name_metadata``."""
        read = SOURCES[kind]

        def load(spark):
            df = read(spark, path, schema, position)
            return readers.with_metadata(df, path) if metadata else df

        if not metadata:
            return self.add(load, name, kind="source")
        return self.add(load, f"{name}_loaded", fields=(name, f"{name}_metadata"), kind="source")

    def sink(self, name: str, of: str, path: str, kind: str = "parquet") -> Pipeline:
        """A step that writes the step ``of`` as a file of the kind and gives its metadata."""
        write = SINKS[kind]

        def save(df):
            return write(df, path)

        return self.add(save, name, kind="sink", bind={"df": of})

    def include(self, other: Pipeline) -> Pipeline:
        """The other's steps too; a name that both have is an error."""
        if clash := self.steps.keys() & other.steps.keys():
            raise PipelineError(f"two steps are called {sorted(clash)}")
        self.steps |= other.steps
        return self

    def order(self, outputs: list[str], inputs: set[str] = frozenset()) -> list[str]:
        """The steps that the outputs need, each after its own needs. Missing inputs and cycles raise before anything runs."""
        out, state, missing = [], {}, set()

        def visit(name: str, path: tuple[str, ...]) -> None:
            if name in inputs or state.get(name) == "done":
                return
            if name in path:
                raise PipelineError("cycle: " + " -> ".join([*path, name]))
            step = self.steps.get(name)
            if step is None:
                missing.add(name)
                return
            for p, need in step.needs.items():
                if p in step.optional and need not in self.steps and need not in inputs:
                    continue
                visit(need, (*path, name))
            state[name] = "done"
            out.append(name)

        for name in outputs:
            visit(name, ())
        if missing:
            raise PipelineError(f"missing inputs: {sorted(missing)}")
        return out

    def execute(self, outputs: list[str], inputs: dict | None = None) -> dict:
        """The outputs' values. DataFrames stay lazy; only savers run jobs."""
        values = dict(inputs or {})
        for name in self.order(outputs, set(values)):
            if self.cache is not None and name in self.cache:
                values[name] = self.cache[name]
                continue
            step = self.steps[name]
            args = {p: values[need] for p, need in step.needs.items() if need in values}
            for adapter in self.adapters:
                adapter.before(step)
            began = time.time()
            try:
                values[name] = step.function(*args.values()) if len(args) == len(step.needs) else step.function(**args)
            except Exception as error:
                for adapter in self.adapters:
                    adapter.failed(step, error, time.time() - began)
                raise
            for adapter in self.adapters:
                adapter.after(step, values[name], time.time() - began)
            if self.cache is not None and step.kind != "sink":
                self.cache[name] = values[name]
                values[name] = self.cache[name]
        return {name: values[name] for name in outputs}

    def dot(self, outputs: list[str] | None = None, inputs: set[str] = frozenset(), deduplicate_inputs: bool = True) -> str:
        """Graphviz text of all steps, or of those that the outputs need. Inputs are a node each, or one for each step that takes them."""
        names = self.order(outputs, inputs) if outputs else list(self.steps)
        lines = ["digraph {"]
        lines += [f'  "{n}" [shape={"box" if self.steps[n].kind == "node" else "cylinder"}];' for n in names]
        for n in names:
            for need in dict.fromkeys(self.steps[n].needs.values()):
                given = need not in self.steps
                node = need if not given or deduplicate_inputs else f"{need} of {n}"
                if given:
                    lines.append(f'  "{node}" [shape=plaintext, label="{need}"];')
                lines.append(f'  "{node}" -> "{n}";')
        return "\n".join([*dict.fromkeys(lines), "}"])


def _placed(df: DataFrame, position: bool) -> DataFrame:
    return readers.with_position(df) if position else df


#: How sources are read and sinks written, by kind.
SOURCES: dict[str, Callable] = {
    "parquet": lambda spark, path, schema, position: readers.read_parquet(spark, path, position),
    "csv": lambda spark, path, schema, position: _placed(readers.read_csv(spark, path, schema), position),
    "tsv": lambda spark, path, schema, position: _placed(readers.read_literal_tsv(spark, path), position),
}
SINKS: dict[str, Callable] = {
    "parquet": lambda df, path: sinks.write_parquet(df, path),
    "strings": lambda df, path: sinks.write_parquet(df, path, as_strings=True),
    "lines": lambda df, path: sinks.write_lines(df, path, df.columns[0]),
}


class RunTracker:
    """An adapter that keeps a row for each step of a run: what ran, when, how long, and how it ended."""

    COLUMNS = "run string, pipeline string, tags map<string,string>, step string, kind string, started timestamp, seconds double, outcome string, columns array<string>"

    def __init__(self, pipeline: str, tags: dict[str, str] | None = None):
        self.run, self.pipeline, self.tags, self.rows = uuid.uuid4().hex, pipeline, tags or {}, []

    def before(self, step: Step) -> None:
        self._started = datetime.now(UTC).replace(tzinfo=None)

    def _add(self, step: Step, seconds: float, outcome: str, columns: list[str] | None) -> None:
        self.rows.append((self.run, self.pipeline, self.tags, step.name, step.kind, self._started, seconds, outcome, columns))

    def after(self, step: Step, value: object, seconds: float) -> None:
        self._add(step, seconds, "done", value.columns if isinstance(value, DataFrame) else None)

    def failed(self, step: Step, error: Exception, seconds: float) -> None:
        self._add(step, seconds, f"{type(error).__name__}: {error}", None)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.COLUMNS)

    def save(self, spark: SparkSession, path: str) -> None:
        """Appends the run's rows to a table of runs."""
        self.table(spark).coalesce(1).write.mode("append").parquet(path)


class TableCache(MutableMapping):
    """Results of steps as tables in a folder, found again by step and key (what the inputs and the code were); other values stay in the process."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key, self.held = spark, folder.rstrip("/"), hashlib.sha256(key.encode()).hexdigest()[:16], {}

    def _path(self, name: str) -> str:
        return f"{self.folder}/{self.key}/{name}"

    def __contains__(self, name: object) -> bool:
        return name in self.held or readers.exists(self.spark, f"{self._path(str(name))}/_SUCCESS")

    def __getitem__(self, name: str) -> object:
        return self.held[name] if name in self.held else self.spark.read.parquet(self._path(name))

    def __setitem__(self, name: str, value: object) -> None:
        if isinstance(value, DataFrame):
            value.write.mode("overwrite").parquet(self._path(name))
        else:
            self.held[name] = value

    def __delitem__(self, name: str) -> None:
        self.held.pop(name, None)

    def __iter__(self):
        return iter([*self.held, *(x.rsplit("/", 1)[-1] for x in readers.subfolders(self.spark, f"{self.folder}/{self.key}"))])

    def __len__(self) -> int:
        return len(list(iter(self)))
