"""Recorders of results: configuration, metrics and row-level outputs, through Spark's writers, so that any file system will do."""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.processors import shorten_base64
from ..functions.tokenizers import NotAvailable


class Recorder(Protocol):
    def record_config(self, config: dict, group: str | None = None) -> None: ...

    def record_metrics(self, summary: DataFrame, group: str | None = None) -> None: ...

    def record_outputs(self, rows: DataFrame, group: str | None = None) -> None: ...

    def is_metrics_saved(self, group: str | None = None) -> bool: ...


class FolderRecorder:
    """JSON under ``folder[/group]/{config,metrics,outputs}``; what is there is an error unless ``force``."""

    def __init__(self, spark: SparkSession, folder: str, force: bool = False):
        self.spark, self.folder, self.mode = spark, folder.rstrip("/"), "overwrite" if force else "error"

    def _path(self, name: str, group: str | None) -> str:
        return "/".join([self.folder, *([group] if group else []), name])

    def record_config(self, config: dict, group: str | None = None) -> None:
        text = json.dumps(config, indent=4, default=str, ensure_ascii=False)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(self.mode).text(self._path("config", group))

    def record_metrics(self, summary: DataFrame, group: str | None = None) -> None:
        summary.coalesce(1).write.mode(self.mode).json(self._path("metrics", group))

    def record_outputs(self, rows: DataFrame, group: str | None = None) -> None:
        strings = {c: shorten_base64(F.col(f"`{c}`")) for c, t in rows.dtypes if t == "string"}
        rows.withColumns(strings).write.mode(self.mode).json(self._path("outputs", group))

    def is_metrics_saved(self, group: str | None = None) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path("metrics/_SUCCESS", group))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)


class TrackingRecorder:
    """The place of an experiment tracker, which needs a network."""

    def __init__(self, *_: object, **__: object):
        raise NotAvailable("experiment trackers need a network")
