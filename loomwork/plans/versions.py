"""Versioned datasets: one Parquet folder per version, a pointer for undo and redo, recipes that replay on new data."""

from __future__ import annotations

import difflib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.steps import StepError, apply_step


@dataclass
class Version:
    number: int
    path: str
    op: str
    params: dict
    rows: int
    columns: list[tuple[str, str]]
    parent: int | None


@dataclass
class Dataset:
    """A name over the current version's table; stepping back moves the pointer, a new step drops the versions after it."""

    spark: SparkSession
    name: str
    folder: str
    versions: list[Version] = field(default_factory=list)
    current: int = -1

    def _write(self, df: DataFrame, op: str, params: dict) -> Version:
        seen = Observation()
        path = f"{self.folder}/{self.name}/{uuid.uuid4().hex}"
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        v = Version(self.current + 1, path, op, params, seen.get["rows"], df.dtypes, self.current if self.current >= 0 else None)
        self.versions = [*self.versions[: self.current + 1], v]
        self.current = v.number
        self.frame().createOrReplaceTempView(self.name)
        return v

    def ingest(self, df: DataFrame) -> Version:
        return self._write(df, "ingest", {})

    def frame(self, number: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.versions[self.current if number is None else number].path)

    def preview(self, op: str, params: dict, n: int = 20) -> dict:
        """Columns before and after, the change in rows, and the first rows; nothing is written."""
        before = self.frame()
        after = apply_step(before, op, params)
        return {"before": before.columns, "after": after.columns, "rows": after.count() - self.versions[self.current].rows, "first": after.limit(n)}

    def apply(self, op: str, params: dict) -> Version:
        return self._write(apply_step(self.frame(), op, params), op, params)

    def move(self, steps: int) -> int:
        """Undo (negative) or redo."""
        self.current = min(max(0, self.current + steps), len(self.versions) - 1)
        self.frame().createOrReplaceTempView(self.name)
        return self.current

    def recipe(self) -> list[dict]:
        return [{"op": v.op, "params": v.params} for v in self.versions[1 : self.current + 1]]

    def export_recipe(self) -> str:
        return json.dumps(self.recipe(), default=str)

    def refresh(self, df: DataFrame, steps: list[dict] | None = None) -> dict:
        """Replay the recipe on new data; stop at the first step that no longer applies and keep what worked."""
        steps = self.recipe() if steps is None else steps
        out, done = df, 0
        for s in steps:
            try:
                new = apply_step(out, s["op"], s["params"])
                new.schema
            except (StepError, AnalysisException) as e:
                self._write(out, "refresh", {"steps": done})
                return {"applied": done, "stopped_at": s, "error": str(e).splitlines()[0]}
            out, done = new, done + 1
        self._write(out, "refresh", {"steps": done})
        return {"applied": done, "stopped_at": None, "error": None}


def linear(nodes: dict[str, dict], edges: list[tuple[str, str]]) -> list[dict]:
    """Steps of an edited graph in order: one source, a chain without branches or cycles."""
    after: dict[str, str] = {}
    for a, b in edges:
        if a not in nodes or b not in nodes:
            raise StepError(f"edge {a}-{b}: unknown node; close: {difflib.get_close_matches(a, nodes, 1)}")
        if a in after:
            raise StepError(f"{a} has two followers")
        after[a] = b
    heads = set(nodes) - set(after.values())
    if len(heads) != 1 or len(set(after.values())) < len(after):
        raise StepError("a graph needs one source and one chain")
    chain, at = [], heads.pop()
    while at is not None:
        chain.append(at)
        at = after.get(at)
    if len(chain) != len(nodes):
        raise StepError("the chain does not reach every node")
    return [nodes[n] for n in chain if nodes[n].get("op") != "source"]


def replay(df: DataFrame, steps: list[dict]) -> DataFrame:
    for s in steps:
        df = apply_step(df, s["op"], s["params"])
    return df
