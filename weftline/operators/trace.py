"""Counts and times of stages, taken while the job runs: no extra pass over the data."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Trace:
    """Rows of every stage of one batch. ``stage`` marks a DataFrame; the counts are there once an action has run."""

    name: str = "batch"
    started: float = field(default_factory=time.time)
    seen: list[tuple[str, Observation]] = field(default_factory=list)

    def stage(self, name: str, df: DataFrame, requests: str = "request_id") -> DataFrame:
        o = Observation(f"{self.name}-{name}-{len(self.seen)}")
        self.seen.append((name, o))
        columns = [F.count(F.lit(1)).alias("rows")]
        if requests in df.columns:
            columns.append(F.approx_count_distinct(requests).alias("requests"))
        return df.observe(o, *columns)

    def counts(self) -> list[dict]:
        return [{"stage": name, **o.get} for name, o in self.seen]

    def line(self) -> str:
        """One line of JSON for a log."""
        return json.dumps({"name": self.name, "total_ms": round((time.time() - self.started) * 1000, 1), "stages": self.counts()})

    def report(self) -> str:
        rows = [f"{'stage':<20}{'rows':>12}"] + [f"{c['stage']:<20}{c['rows']:>12}" for c in self.counts()]
        return "\n".join(rows)
