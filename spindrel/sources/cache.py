"""Results kept in the shared folder: read-through with a time to live, forgetting by prefix, and conditional reads."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: seconds a result lives, by what it is ----
LIFETIMES = {"directory": 10_800, "graph": 10_800, "search": 300, "content": 60, "miss": 60}


class Cache:
    """Results as Parquet below one folder that all executors share; every failure of the cache falls back to computing."""

    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.folder, self.clock = spark, folder.rstrip("/"), clock
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, key: str) -> str:
        prefix, _, rest = key.partition(":")
        return f"{self.folder}/{prefix}/{hashlib.sha256(rest.encode()).hexdigest()[:16]}"

    def _age(self, place: str) -> float | None:
        mark = self._path(f"{place}/_SUCCESS")
        return self.clock() - self._fs.getFileStatus(mark).getModificationTime() / 1000 if self._fs.exists(mark) else None

    def get(self, key: str, build: Callable[[], DataFrame | None], seconds: float | None = None) -> DataFrame | None:
        """The kept result of `key` (kind:rest), or what `build` gives, which is kept. None, a miss, is kept too, for a shorter time."""
        place = self._place(key)
        seconds = LIFETIMES.get(key.partition(":")[0], LIFETIMES["directory"]) if seconds is None else seconds
        try:
            age = self._age(place)
            if age is not None and age < seconds:
                return self.spark.read.parquet(place)
            age = self._age(f"{place}.miss")
            if age is not None and age < LIFETIMES["miss"]:
                return None
        except Exception:  # noqa: BLE001 - a broken cache must not break the read
            return build()
        made = build()
        if made is None:
            self.spark.range(0).write.mode("overwrite").parquet(f"{place}.miss")
            return None
        made.write.mode("overwrite").parquet(place)
        return self.spark.read.parquet(place)

    def forget(self, prefix: str) -> None:
        """Drop every result whose key begins with a kind."""
        self._fs.delete(self._path(f"{self.folder}/{prefix}"), True)

    def warm(self, builds: dict[str, Callable[[], DataFrame | None]]) -> None:
        """Compute what is asked first after a start."""
        for key, build in builds.items():
            self.get(key, build)


def content_tag(payload: bytes) -> str:
    return hashlib.sha1(payload).hexdigest()


def if_changed(payload: bytes, known: str | None) -> bytes | None:
    """The payload, or None if its reader's tag says they have it."""
    return None if known == content_tag(payload) else payload


def tile_reader(read: Callable[[str, str], bytes], most: int = 512) -> Callable[[str, str], bytes]:
    """A reader of tiles (version, key) that keeps the last ones; a version's tiles never change."""
    return lru_cache(maxsize=most)(read)

