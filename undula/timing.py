"""How long the stages of a plan take, measured by the tasks while they run: no pass of its own.

Each stage is the Python work of one operator.  Its seconds, calls and rows are accumulators that tasks add to
and the driver reads; what Spark itself does between stages (scans, exchanges) isn't in them.  A task that
runs twice counts twice.
"""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession


class StageTimers:
    def __init__(self, spark: SparkSession):
        self.sc = spark.sparkContext
        self.stages: dict[str, tuple] = {}

    def _of(self, name: str) -> tuple:
        if name not in self.stages:
            self.stages[name] = (self.sc.accumulator(0.0), self.sc.accumulator(0), self.sc.accumulator(0))
        return self.stages[name]

    def batches(self, name: str, work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
        """work over batches, without the time it waits for its input or for who takes its output."""
        seconds, calls, rows = self._of(name)

        def timed(given: Iterator) -> Iterator:
            waited = 0.0

            def source() -> Iterator:
                nonlocal waited
                while True:
                    began = time.perf_counter()
                    batch = next(given, None)
                    waited += time.perf_counter() - began
                    if batch is None:
                        return
                    rows.add(len(batch))
                    calls.add(1)
                    yield batch

            made = work(source())
            while True:
                waited, began = 0.0, time.perf_counter()
                out = next(made, None)
                seconds.add(time.perf_counter() - began - waited)
                if out is None:
                    return
                yield out

        return timed

    def groups(self, name: str, work: Callable) -> Callable:
        """work over one group, or over two that go together."""
        seconds, calls, rows = self._of(name)

        def run(table, *other):
            began = time.perf_counter()
            out = work(table, *other)
            seconds.add(time.perf_counter() - began)
            calls.add(1)
            rows.add(table.num_rows)
            return out

        return (lambda table, other: run(table, other)) if len(inspect.signature(work).parameters) == 2 else (lambda table: run(table))

    def found(self) -> dict[str, tuple[float, int, int]]:
        """(seconds, calls, rows) of each stage so far, in the order of the plan."""
        return {name: tuple(a.value for a in parts) for name, parts in self.stages.items()}
