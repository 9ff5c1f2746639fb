"""A sink for streams that stays small: numbered batches, merged level by level.

Every micro-batch is a folder of its own. ``fan`` folders of one level are merged into one
of the next, so after n batches there are at most about ``fan`` times the logarithm of n
folders. Which folders count is said by a manifest, a small file that is replaced as a
whole: whoever reads keeps to one manifest and sees every batch exactly once, before or
after a merge, and also after a crash between writing a folder and naming it.

A sink has one writer, as a streaming query has one checkpoint.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from wardline.sources.storage import Folder

Merge = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Part:
    """A folder with the rows of the batches from ``first`` to ``last``."""

    name: str
    first: int
    last: int
    level: int


@dataclass(frozen=True)
class Manifest:
    version: int
    parts: tuple[Part, ...]

    def holds(self, batch: int) -> bool:
        return any(p.first <= batch <= p.last for p in self.parts)


class LevelledSink:
    """``merge`` makes of the rows of several parts those of one; by default they are put together.

    The last ``kept`` manifests, and the folders they name, stay for those who read them.
    """

    def __init__(self, spark: SparkSession, root: str, merge: Merge = lambda rows: rows, fan: int = 8, kept: int = 32):
        if fan < 2 or kept < 1:
            raise ValueError("fan must be 2 at least, kept 1 at least")
        self.spark, self.root, self.merge, self.fan, self.kept = spark, root, merge, fan, kept
        self._data, self._manifests = Folder(spark, f"{root}/data"), Folder(spark, f"{root}/manifests")

    # -- manifests

    def _versions(self) -> list[int]:
        return sorted(int(name.removesuffix(".json")) for name in self._manifests.names() if name.endswith(".json"))

    def _load(self, version: int) -> Manifest:
        said = json.loads(self._manifests.read(f"{version:010d}.json"))
        return Manifest(version, tuple(Part(**p) for p in said["parts"]))

    def manifest(self) -> Manifest:
        """The newest manifest; of a sink not yet written, one without parts."""
        versions = self._versions()
        return self._load(versions[-1]) if versions else Manifest(0, ())

    def _swap(self, parts: list[Part], after: Manifest) -> Manifest:
        """Name ``parts`` as what counts. Fails if another writer has done so since ``after``."""
        now = Manifest(after.version + 1, tuple(parts))
        self._manifests.create(f"{now.version:010d}.json", json.dumps({"parts": [asdict(p) for p in parts]}))
        return now

    # -- rows

    def _rows(self, parts: list[Part] | tuple[Part, ...]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.root}/data/{p.name}" for p in parts))

    def _write(self, rows: DataFrame, first: int, last: int, level: int) -> Part:
        part = Part(f"{first:010d}-{last:010d}-{uuid.uuid4().hex}", first, last, level)
        # the hint lets AQE make as many files as the rows need
        rows.hint("rebalance").write.parquet(f"{self.root}/data/{part.name}")
        return part

    def commit(self, rows: DataFrame, batch: int) -> None:
        """Add a batch. One that is there already, as after a failure, is not added again.

        Its rows are computed all the same: a stateful query saves its state while they are.
        """
        known = self.manifest()
        if known.holds(batch):
            rows.write.format("noop").mode("overwrite").save()
        else:
            known = self._swap([*known.parts, self._write(rows, batch, batch, 0)], known)
        self.compact(known)

    def compact(self, known: Manifest | None = None) -> None:
        """Merge the parts of each level that has ``fan`` of them, and drop what no kept manifest names."""
        known = known or self.manifest()
        merged = False
        while full := self._full_level(known):
            first, last = min(p.first for p in full), max(p.last for p in full)
            part = self._write(self.merge(self._rows(full)), first, last, full[0].level + 1)
            known = self._swap([p for p in known.parts if p not in full] + [part], known)
            merged = True
        if merged:
            self.vacuum()

    def _full_level(self, known: Manifest) -> list[Part]:
        for level in sorted({p.level for p in known.parts}):
            parts = sorted((p for p in known.parts if p.level == level), key=lambda p: p.first)
            if len(parts) >= self.fan:
                return parts[: self.fan]
        return []

    def vacuum(self) -> None:
        """Delete manifests before the last ``kept``, and folders that none of the others names."""
        versions = self._versions()
        named = {p.name for v in versions[-self.kept :] for p in self._load(v).parts}
        for version in versions[: -self.kept]:
            self._manifests.remove(f"{version:010d}.json")
        for name in self._data.names():
            if name not in named:
                self._data.remove(name)

    def read(self, schema: str | None = None, pinned: Manifest | None = None) -> DataFrame:
        """All rows by one manifest, the newest unless given. An unwritten sink has no rows, of ``schema``."""
        parts = (pinned or self.manifest()).parts
        if not parts and schema is not None:
            return self.spark.createDataFrame([], schema)
        return self.merge(self._rows(parts))
