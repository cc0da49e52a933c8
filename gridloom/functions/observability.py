"""Logging, a profiler that names Spark's jobs, a tracer, and a monitor of this machine's processes."""

from __future__ import annotations

import contextlib
import functools
import json
import logging
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from gridloom.functions.cache_stats import profile_summary

ENTRY = "name string, start_time double, end_time double, duration double, metadata map<string,string>"


def setup_logging(level: int = logging.INFO, file: str | None = None) -> logging.Logger:
    """Console, and all messages in a file. Called again it adds no second handler."""
    log = logging.getLogger("gridloom")
    log.setLevel(logging.DEBUG if file else level)
    names = {h.get_name() for h in log.handlers}
    for name, handler, at in [("console", logging.StreamHandler, level)] + ([(file, functools.partial(logging.FileHandler, file), logging.DEBUG)] if file else []):
        if name not in names:
            made = handler()
            made.set_name(name)
            made.setLevel(at)
            made.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
            log.addHandler(made)
    return log


@dataclass
class Profiler:
    """Named, nestable spans. With a session, the jobs of a span carry its name."""

    spark: SparkSession | None = None
    enabled: bool = True
    entries: list[dict] = field(default_factory=list)

    @contextlib.contextmanager
    def span(self, name: str, **metadata: object) -> Iterator[None]:
        if not self.enabled:
            yield
            return
        if self.spark is not None:
            self.spark.sparkContext.setJobDescription(name)
        start = time.time()
        try:
            yield
        finally:
            end = time.time()
            self.entries.append({"name": name, "start_time": start, "end_time": end, "duration": end - start, "metadata": {k: str(v) for k, v in metadata.items()}})
            if self.spark is not None:
                self.spark.sparkContext.setJobDescription(None)

    def timed(self, name: str | None = None) -> Callable:
        def wrap(f: Callable) -> Callable:
            @functools.wraps(f)
            def run(*args, **kwargs):
                with self.span(name or f.__name__):
                    return f(*args, **kwargs)

            return run

        return wrap

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.entries, ENTRY)

    def summary(self, spark: SparkSession) -> DataFrame:
        return profile_summary(self.frame(spark)).orderBy("total", ascending=False)

    def export(self, path: str) -> None:
        """All entries, and as flat spans in milliseconds."""
        flat = [{"name": e["name"], "start_ms": e["start_time"] * 1e3, "duration_ms": e["duration"] * 1e3} for e in self.entries]
        with open(path, "w") as f:
            json.dump({"entries": self.entries, "spans": flat}, f)

    def reset(self) -> None:
        self.entries.clear()


@dataclass
class TraceEvent:
    type: str
    name: str
    depth: int
    timestamp: float
    metadata: dict[str, str]


@dataclass
class Tracer:
    """Begin, end and log events with their depth."""

    events: list[TraceEvent] = field(default_factory=list)
    depth: int = 0

    def begin(self, name: str, **metadata: object) -> None:
        self._note("begin", name, metadata)
        self.depth += 1

    def end(self, name: str, **metadata: object) -> None:
        self.depth = max(0, self.depth - 1)
        self._note("end", name, metadata)

    def log(self, message: str, **metadata: object) -> None:
        self._note("log", message, metadata)

    def _note(self, kind: str, name: str, metadata: dict[str, object]) -> None:
        self.events.append(TraceEvent(kind, name, self.depth, time.time(), {k: str(v) for k, v in metadata.items()}))

    def lines(self) -> list[str]:
        return [f"{'  ' * e.depth}{e.type} {e.name}" for e in self.events]

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump([asdict(e) for e in self.events], f)

    def reset(self) -> None:
        self.events.clear()
        self.depth = 0


_shared = Profiler()


def profiler() -> Profiler:
    """The one that is shared by all who ask."""
    return _shared


class ResourceMonitor:
    """Peak and mean memory and mean CPU of this process and its children, sampled while a block runs. Needs psutil."""

    def __init__(self, every: float = 0.1):
        self.every, self.samples = every, []
        self._stop = threading.Event()

    def __enter__(self) -> ResourceMonitor:
        import psutil

        top = psutil.Process()

        def watch() -> None:
            while not self._stop.wait(self.every):
                with contextlib.suppress(psutil.Error):
                    family = [top, *top.children(recursive=True)]
                    self.samples.append((sum(p.memory_info().rss for p in family) / 1e6, sum(p.cpu_percent() for p in family)))

        self._thread = threading.Thread(target=watch, daemon=True)
        self._start = time.time()
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.seconds = time.time() - self._start
        self._stop.set()
        self._thread.join()
        rss, cpu = zip(*self.samples) if self.samples else ((0.0,), (0.0,))
        self.peak_mb, self.mean_mb, self.mean_cpu = max(rss), sum(rss) / len(rss), sum(cpu) / len(cpu)
