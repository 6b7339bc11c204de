"""Extraction runs: a job's state machine over saved tables; one run works at a time, results are read in windows."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .operators import shape

MAX_PAGES = 2000


@dataclass
class Run:
    id: str
    path: str
    status: str = "Pending"
    done: int = 0
    total: int = 0
    error: str | None = None
    started: float = field(default_factory=time.time)
    ended: float | None = None


class Runs:
    """Starts jobs that write a table of pages, and shows what they wrote."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.all, self.gate, self.lock = spark, {}, threading.Semaphore(1), threading.Lock()

    def start(self, job: Callable[[Run], DataFrame], path: str, pages: int) -> Run:
        if pages > MAX_PAGES:
            raise ValueError(f"{pages} pages; at most {MAX_PAGES} are taken at once")
        run = Run(uuid.uuid4().hex, path, total=pages)
        with self.lock:
            self.all[run.id] = run
        threading.Thread(target=self._work, args=(run, job), daemon=True).start()
        return run

    def _work(self, run: Run, job: Callable[[Run], DataFrame]) -> None:
        with self.gate:
            run.status = "Running"
            try:
                job(run).write.mode("overwrite").parquet(run.path)
                run.status, run.done = "Completed", run.total
            except Exception as why:  # a run reports its failure, whatever it was
                run.status, run.error = "Failed", str(why)[:500]
            run.ended = time.time()

    def status(self, id: str) -> Run:
        return self.all[id]

    def result(self, id: str, start: int = 1, count: int = 10, block: bool = False) -> DataFrame:
        run = self.all[id]
        if run.status != "Completed":
            raise RuntimeError(f"run {id} is {run.status}")
        return shape.page_window(self.spark.read.parquet(run.path), start, count, block)
