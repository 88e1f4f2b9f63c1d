"""Counters, gauges and histograms with a text exposition, and row counts observed in running plans."""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

SECONDS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0)
COUNTERS = ("searches_total", "documents_indexed_total", "documents_deleted_total", "snapshots_total", "merges_total")
GAUGES = ("documents", "applied_position", "segments", "deleted_documents")
HISTOGRAMS = ("search_seconds", "index_seconds", "snapshot_seconds")


@dataclass
class Metrics:
    counters: dict[tuple[str, str], float] = field(default_factory=lambda: {(c, ""): 0 for c in COUNTERS})
    gauges: dict[str, float] = field(default_factory=lambda: dict.fromkeys(GAUGES, 0))
    seen: dict[str, list[float]] = field(default_factory=lambda: {h: [0.0] * (len(SECONDS) + 2) for h in HISTOGRAMS})

    def count(self, name: str, by: float = 1, label: str = "") -> None:
        self.counters[(name, label)] = self.counters.get((name, label), 0) + by

    def gauge(self, name: str, value: float) -> None:
        self.gauges[name] = value

    def observe(self, name: str, value: float) -> None:
        """Counts the value in its bucket; the last two places are the sum and what lies above all buckets."""
        h = self.seen.setdefault(name, [0.0] * (len(SECONDS) + 2))
        at = bisect.bisect_left(SECONDS, value)
        h[at if at < len(SECONDS) else -1] += 1
        h[-2] += value

    def text(self) -> str:
        """One line a sample, histograms cumulatively."""
        out = []
        for (name, label), v in sorted(self.counters.items()):
            out.append(f"{name}{{mode=\"{label}\"}} {v:g}" if label else f"{name} {v:g}")
        out += [f"{n} {v:g}" for n, v in sorted(self.gauges.items())]
        for name, h in sorted(self.seen.items()):
            below = 0.0
            for b, n in zip(SECONDS, h, strict=False):
                below += n
                out.append(f'{name}_bucket{{le="{b:g}"}} {below:g}')
            n = below + h[-1]
            out += [f'{name}_bucket{{le="+Inf"}} {n:g}', f"{name}_sum {h[-2]:g}", f"{name}_count {n:g}"]
        return "\n".join(out) + "\n"


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows, with their number in ``observation.get`` once an action has run: no pass of its own."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows")), o
