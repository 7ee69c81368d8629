"""Wall-clock sections and memory readings of a run."""

from __future__ import annotations

import resource
import threading
import time
import tracemalloc
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Section:
    name: str
    seconds: float
    peak_mb: float
    python_mb: float


def resident_mb() -> float:
    """Resident memory of the driver's Python process now (its peak where the system does not say)."""
    statm = Path("/proc/self/statm")
    if statm.exists():
        return int(statm.read_text().split()[1]) * resource.getpagesize() / 2**20
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


class Profiler:
    """Named sections with their time, the peak of resident memory sampled every interval seconds, and Python's own peak.

    trace turns on tracemalloc, which slows Python code; python_mb is 0 without it.
    """

    def __init__(self, interval: float = 0.05, trace: bool = False) -> None:
        self.sections: list[Section] = []
        self.interval, self.trace = interval, trace

    @contextmanager
    def section(self, name: str) -> Iterator[None]:
        done, peak = threading.Event(), [resident_mb()]

        def sample() -> None:
            while not done.wait(self.interval):
                peak[0] = max(peak[0], resident_mb())

        watcher = threading.Thread(target=sample, daemon=True)
        mine = self.trace and not tracemalloc.is_tracing()
        if mine:
            tracemalloc.start()
        began = time.perf_counter()
        watcher.start()
        try:
            yield
        finally:
            took = time.perf_counter() - began
            done.set()
            watcher.join()
            own = tracemalloc.get_traced_memory()[1] / 2**20 if self.trace else 0.0
            if mine:
                tracemalloc.stop()
            self.sections.append(Section(name, took, max(peak[0], resident_mb()), own))

    def report(self) -> str:
        """A line per section, slowest first."""
        rows = sorted(self.sections, key=lambda s: -s.seconds)
        return "\n".join(f"{s.name}: {s.seconds:.3f} s, peak {s.peak_mb:.0f} MB" for s in rows)
