"""Running the tasks under their four conditions, with results, steps and timings."""

from __future__ import annotations

import ast
import hashlib
import inspect
import io
import platform
import statistics
import textwrap
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONDITIONS = ("bronze", "silver", "gold", "monolithic")
STATUS = ("ok", "failed")
#: The columns of a run's result.
RESULT_SCHEMA = (
    "run_id string, task string, dataset string, condition string, seed bigint, source_snapshot string, pipeline_version string, status string, "
    "rows bigint, preprocessing_loc bigint, function_count bigint, transformation_steps bigint, output_hash string, join_matching_rate double"
)
IDENTITY = ("run_id", "task", "dataset", "condition", "seed", "source_snapshot", "pipeline_version", "status")
MEASURED = ("rows", "preprocessing_loc", "function_count", "transformation_steps", "output_hash")


@dataclass
class Steps:
    """The steps of a run; only those of the top level count, and a step that raises counts too."""

    names: list[str] = field(default_factory=list)
    depth: int = 0

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        if not self.depth:
            self.names.append(name)
        self.depth += 1
        try:
            yield
        finally:
            self.depth -= 1


@dataclass(frozen=True)
class RunContext:
    spark: SparkSession
    task: str
    condition: str
    dataset: str
    load: Callable[[str, str], DataFrame]
    source_snapshot: str = "unknown"
    pipeline_version: str = "unknown"
    seed: int = 0
    params: Mapping = field(default_factory=dict)
    steps: Steps = field(default_factory=Steps)


@dataclass(frozen=True)
class Task:
    """prepare: a function of the context for each condition; analyze: shared by all of them."""

    name: str
    prepare: Mapping[str, Callable[[RunContext], DataFrame]]
    analyze: Callable[[DataFrame], DataFrame]


def output_hash(df: DataFrame, places: int = 9) -> str:
    """A digest of a result's content: the order of rows and partitions does not count, and doubles
    are rounded far above the noise of summing in another order."""
    from terrace.operators.compare import content_digest

    doubles = {c: F.format_number(c, places) for c, t in df.dtypes if t in ("double", "float")}
    return content_digest(df.withColumns(doubles) if doubles else df).first()["digest"]


def run_condition(task: Task, ctx: RunContext) -> dict:
    """A row of results. The action is forced here, so that a lazy failure becomes a failed row."""
    if ctx.condition not in task.prepare:
        raise ValueError(f"{task.name} has no condition {ctx.condition}")
    prepare = task.prepare[ctx.condition]
    row = {"run_id": uuid.uuid4().hex, "task": task.name, "dataset": ctx.dataset, "condition": ctx.condition, "seed": ctx.seed, "source_snapshot": ctx.source_snapshot, "pipeline_version": ctx.pipeline_version, "status": "ok"}
    try:
        prepared = prepare(ctx)
        result = task.analyze(prepared)
        code = code_metrics(prepare)
        row |= {"rows": prepared.count(), "preprocessing_loc": code["loc"], "function_count": code["functions"], "transformation_steps": len(ctx.steps.names), "output_hash": output_hash(result), "join_matching_rate": ctx.params.get("join_matching_rate")}
    except Exception:
        row["status"] = "failed"
    return row


def result_violations(results: DataFrame) -> DataFrame:
    """One row that counts the broken rules of a result table, in one aggregation."""
    ok = F.col("status") == "ok"
    rules = {f"null_{c}": F.count_if(F.col(c).isNull()) for c in IDENTITY}
    rules |= {f"unmeasured_{c}": F.count_if(ok & F.col(c).isNull()) for c in MEASURED}
    rules |= {
        "condition": F.count_if(~F.col("condition").isin(*CONDITIONS)),
        "status": F.count_if(~F.col("status").isin(*STATUS)),
        "bounds": F.count_if((F.col("rows") < 0) | (F.col("seed") < 0) | ~F.col("join_matching_rate").between(0, 1)),
        "repeated_run_id": F.count(F.lit(1)) - F.count_distinct("run_id"),
    }
    return results.agg(*[r.alias(k) for k, r in rules.items()])


class ResultStore:
    """Result rows as a Parquet table; every append is checked as a whole before it is written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def load(self) -> DataFrame:
        self._recover()
        try:
            return self.spark.read.schema(RESULT_SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], RESULT_SCHEMA)

    def _places(self):
        """The file system, the table's path and the path beside it where a new version is written."""
        context = self.spark.sparkContext
        table, beside = (context._jvm.org.apache.hadoop.fs.Path(self.path + end) for end in ("", ".next"))
        return table.getFileSystem(context._jsc.hadoopConfiguration()), table, beside

    def _recover(self) -> None:
        """Finishes a replacement that was cut off after the old table had gone."""
        files, table, beside = self._places()
        if not files.exists(table) and files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(beside, "_SUCCESS")):
            files.rename(beside, table)

    def append(self, rows: Sequence[Mapping]) -> None:
        names = [f.split()[0] for f in RESULT_SCHEMA.split(", ")]
        if unknown := sorted({k for r in rows for k in r} - set(names)):
            raise ValueError(f"unknown column {unknown[0]}")
        new = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RESULT_SCHEMA)
        broken = {k: v for k, v in result_violations(self.load().unionByName(new)).first().asDict().items() if v}
        if broken:
            raise ValueError(f"results break the schema: {broken}")
        new.coalesce(1).write.mode("append").parquet(self.path)

    def query(self, status: str | None = "ok", **equal: str) -> DataFrame:
        df = self.load()
        for c, v in {**equal, **({"status": status} if status else {})}.items():
            df = df.filter(F.col(c) == v)
        return df

    def drop_task(self, task: str) -> None:
        """Removes a task's rows. The others are written beside the table, which goes only when they are
        whole; load() finishes the replacement where it was cut off in between."""
        files, table, beside = self._places()
        self.load().filter(~F.col("task").eqNullSafe(task)).coalesce(1).write.mode("overwrite").parquet(beside.toString())
        files.delete(table, True)
        if not files.rename(beside, table):
            raise OSError(f"{beside.toString()} could not take the table's place")


# ---- code metrics ------------------------------------------------------------------------------


def effective_lines(source: str) -> int:
    """Lines that hold code. Blank lines and lines of a comment alone do not count, unless they lie in
    a text of several lines; lines of docstrings never do."""
    nodes = list(ast.walk(ast.parse(source)))
    span = lambda n: range(n.lineno, n.end_lineno + 1)
    texts = {line for n in nodes if isinstance(n, ast.JoinedStr) or isinstance(n, ast.Constant) and isinstance(n.value, str | bytes) for line in span(n)}
    owners = [n for n in nodes if hasattr(n, "body") and isinstance(n, ast.Module | ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef)]
    docs = {line for n in owners if ast.get_docstring(n) is not None for line in span(n.body[0])}
    plain = {at for at, line in enumerate(io.StringIO(source, newline=None), 1) if line.strip() and not line.lstrip().startswith("#")}
    return len((plain | texts) - docs)


def code_metrics(function: Callable) -> dict[str, int]:
    """loc, functions and recorded steps of a preparation; net_loc leaves the lines of steps out."""
    source = textwrap.dedent(inspect.getsource(function))
    tree = ast.parse(source)
    steps = [n for n in ast.walk(tree) if isinstance(n, ast.With) and any("step(" in ast.unparse(i) for i in n.items)]
    loc = effective_lines(source)
    return {"loc": loc, "net_loc": loc - len(steps), "functions": sum(isinstance(n, ast.FunctionDef | ast.Lambda) for n in ast.walk(tree)), "steps": len(steps)}


def redefined(source: str, shared: str) -> set[str]:
    """Names of functions and classes that a module defines although the shared one has them."""
    names = lambda s: {n.name for n in ast.walk(ast.parse(s)) if isinstance(n, ast.FunctionDef | ast.ClassDef)}
    return names(source) & names(shared)


# ---- reproducibility and timing ----------------------------------------------------------------


def reproducibility(digests: Sequence[str | None]) -> dict:
    """Of repeated builds: successes, different digests, and whether all agree (None below two)."""
    good = [d for d in digests if d is not None]
    counts = {d: good.count(d) for d in dict.fromkeys(good)}
    return {"runs": len(digests), "ok": len(good), "digests": dict(sorted(counts.items(), key=lambda x: -x[1])), "equal": len(counts) == 1 if len(good) >= 2 else None}


SCENARIOS = {"S1": "analysis", "S2": "gold", "S3": "silver", "S4": "source"}
STAGES = ("source", "silver", "gold", "analysis")


def schedule(rounds: int, strategies: Sequence[str] = ("materialized", "monolithic"), warmup: int = 1) -> list[tuple[int, bool, str]]:
    """(round, warm-up, strategy): the order turns round from one round to the next."""
    out = []
    for r in range(warmup + rounds):
        order = strategies if r % 2 == 0 else tuple(reversed(strategies))
        out += [(r, r < warmup, s) for s in order]
    return out


def materialized(stages: Mapping[str, Callable], store: Callable[[str, DataFrame], DataFrame], load: Callable[[str], DataFrame], scenario: str) -> DataFrame:
    """Rebuilds what a scenario invalidates, each layer written and read again; earlier layers are
    read from the store. The last stage's frame is the answer."""
    first = STAGES.index(SCENARIOS[scenario])
    df = load(STAGES[first - 1]) if first else None
    for name in STAGES[first:]:
        df = stages[name](df)
        if name != "analysis":
            df = store(name, df)
    return df


def monolithic(stages: Mapping[str, Callable]) -> DataFrame:
    """Source to answer as one plan without a stored layer."""
    df = None
    for name in STAGES:
        df = stages[name](df)
    return df


def timed(action: Callable[[], object]) -> float:
    began = time.perf_counter()
    action()
    return time.perf_counter() - began


def measure(runs: Mapping[str, Callable[[], DataFrame]], rounds: int = 5) -> list[dict]:
    """Seconds of each strategy by the schedule; the terminal action collects the answer."""
    return [{"round": r, "warmup": w, "strategy": s, "seconds": timed(lambda s=s: runs[s]().collect())} for r, w, s in schedule(rounds, tuple(runs))]


def paired(rows: Sequence[Mapping]) -> dict[str, float]:
    """Median ratio and difference of monolithic to materialized over the rounds that have both."""
    by_round: dict[int, dict] = {}
    for r in rows:
        if not r["warmup"]:
            by_round.setdefault(r["round"], {})[r["strategy"]] = r["seconds"]
    both = [x for x in by_round.values() if len(x) == 2]
    return {"pairs": len(both), "ratio": statistics.median(x["monolithic"] / x["materialized"] for x in both), "delta": statistics.median(x["monolithic"] - x["materialized"] for x in both)}


def machine() -> dict[str, str | int]:
    import os

    return {"system": platform.platform(), "cpus": os.cpu_count() or 0, "python": platform.python_version()}


def fingerprint(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
