"""Status of a run: how many rows each stage has passed on, counted while they pass, and told to a hook.

A hook is called with the stage's name and its counts; what it raises is ignored, since status never breaks a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

Hook = Callable[[str, dict], None]


def _told(hook: Hook | None, stage: str, counts: dict) -> None:
    if hook is not None:
        try:
            hook(stage, counts)
        except Exception:  # noqa: BLE001 - a hook's errors are its own
            pass


class Status:
    """Counts of stages of batch plans: watch() a stage's rows, run an action, then read counts()."""

    def __init__(self, hook: Hook | None = None):
        self.hook, self.stages = hook, {}

    def watch(self, df: DataFrame, stage: str, **also: Column) -> DataFrame:
        """df, whose rows are counted as they pass; also: more aggregates by name. A stage has its own name."""
        if stage in self.stages:
            raise ValueError(f"stage {stage} is watched already")
        self.stages[stage] = Observation(stage)
        return df.observe(self.stages[stage], F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in also.items()))

    def counts(self) -> dict[str, dict]:
        """Of each stage, once an action has run all of them; told to the hook in order."""
        out = {stage: dict(seen.get) for stage, seen in self.stages.items()}
        for stage, counts in out.items():
            _told(self.hook, stage, counts)
        return out


class StreamStatus(StreamingQueryListener):
    """Tells a hook the counts of each batch of streams whose stages are observed by name, and when a query ends."""

    def __init__(self, hook: Hook):
        self.hook = hook

    def onQueryStarted(self, event) -> None:
        _told(self.hook, "started", {"id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        for stage, counts in event.progress.observedMetrics.items():
            _told(self.hook, stage, {"batch": event.progress.batchId} | counts.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        _told(self.hook, "failed" if event.exception else "done", {"id": str(event.id)})


def watched_stream(df: DataFrame, stage: str) -> DataFrame:
    """A stream whose rows are counted in each batch, for StreamStatus."""
    return df.observe(stage, F.count(F.lit(1)).alias("rows"))
