"""Small driver-side state: which packs are pinned, attached and excluded."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession


@dataclass
class RepoState:
    """Ids of packs in the order in which they were added, and how many hits to show."""

    top_k: int = 8
    pinned: list[str] = field(default_factory=list)
    attached: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)

    @property
    def active(self) -> list[str]:
        """Pinned, then attached, once each, without the excluded."""
        return [p for p in dict.fromkeys(self.pinned + self.attached) if p not in self.excluded]

    def add(self, where: str, *packs: str) -> None:
        held = getattr(self, where)
        held.extend(p for p in dict.fromkeys(packs) if p not in held)

    def drop(self, where: str, *packs: str) -> None:
        setattr(self, where, [p for p in getattr(self, where) if p not in packs])

    def clear_attached(self) -> None:
        self.attached = []


def _store(path: str, spark: SparkSession | None):
    """Hadoop's file system and path for a URI, or nothing for a path of this machine."""
    if spark is None or "://" not in path:
        return None
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def load_state(path: str, spark: SparkSession | None = None) -> RepoState:
    """Defaults where there is no file, or it can't be read or holds fields of other types."""
    try:
        if store := _store(path, spark):
            raw = json.loads(spark.read.text(path, wholetext=True).first()[0]) if store[0].exists(store[1]) else {}
        else:
            with open(path, encoding="utf-8") as f:
                raw = json.load(f)
        out = RepoState(**{k: raw[k] for k in RepoState.__dataclass_fields__ if k in raw})
        lists = (out.pinned, out.attached, out.excluded)
        whole = isinstance(out.top_k, int) and all(isinstance(x, list) and all(isinstance(p, str) for p in x) for x in lists)
        return out if whole else RepoState()
    except (OSError, ValueError, TypeError):
        return RepoState()


def save_state(path: str, state: RepoState, spark: SparkSession | None = None) -> None:
    if store := _store(path, spark):
        stream = store[0].create(store[1], True)
        stream.write(bytearray(json.dumps(asdict(state), indent=2).encode()))
        stream.close()
        return
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(asdict(state), f, indent=2)
    os.replace(f"{path}.new", path)
