"""Reuse of expensive results, keyed by name, parameters and input files.

A result is kept as a Parquet table in the shared folder rather than in executor memory:
a lost executor then costs one re-read, not a recomputation of everything above it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from custoria.session import run_dir, scratch_path
from custoria.sources import files


class ResultStore:
    """Saved results keyed by name, parameters and the files they were made from.

    By default they are one application's; with a `folder`, which must be shared and lasting, later ones find them, too.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self._spark = spark
        self._root = folder.rstrip("/") if folder else run_dir(spark)

    def path(self, name: str, inputs: Sequence[DataFrame] = (), **parameters) -> str:
        text = json.dumps([parameters, [self._fingerprint(i) for i in inputs]] if inputs else parameters, sort_keys=True, default=str)
        return f"{self._root}/{name}/{hashlib.md5(text.encode()).hexdigest()}"

    def _fingerprint(self, frame: DataFrame) -> str:
        """Of the paths, sizes and times of all files that `frame` reads: new, changed and lost files alter it."""
        mark = hashlib.md5()
        for file in sorted(frame.inputFiles()):
            mark.update(f"{file} {files.stamp(self._spark, file)};".encode())
        return mark.hexdigest()

    def has(self, name: str, inputs: Sequence[DataFrame] = (), **parameters) -> bool:
        return files.committed(self._spark, self.path(name, inputs, **parameters))

    def get(self, name: str, build: Callable[[], DataFrame], inputs: Sequence[DataFrame] = (), **parameters) -> DataFrame:
        """The saved result for these parameters and the present `inputs`; built and saved on first use.

        It is written aside and then renamed, so no reader ever sees half of one. Of writers at the same time the first one's
        result stays and the others use it.
        """
        path = self.path(name, inputs, **parameters)
        if not files.committed(self._spark, path):
            aside = f"{path}.{uuid.uuid4().hex[:12]}"
            build().write.parquet(aside)
            if not files.rename(self._spark, aside, path):
                files.delete(self._spark, aside)
        return self._spark.read.parquet(path)

    def forget(self, name: str, inputs: Sequence[DataFrame] = (), **parameters) -> None:
        """Drop one saved result, so that the next `get` builds it anew."""
        files.delete(self._spark, self.path(name, inputs, **parameters))

    def evict(self, name: str, keep: int) -> int:
        """Drop all but the `keep` newest results of a name; how many went."""
        found = [n for n in files.names(self._spark, f"{self._root}/{name}") if "." not in n]
        newest = sorted(found, key=lambda n: (-files.modified(self._spark, f"{self._root}/{name}/{n}"), n))
        for old in newest[keep:]:
            files.delete(self._spark, f"{self._root}/{name}/{old}")
        return len(newest[keep:])


def settle(frame: DataFrame, label: str) -> DataFrame:
    """Write `frame` to the shared folder and read it back, cutting its lineage."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return spark.read.parquet(path)
