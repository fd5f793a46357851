"""S6 + S7: versions of a model in one folder, published by a manifest.

``publish`` writes a model into a folder of its own and then renames a small
manifest into place.  Only manifests are looked at by readers, so a model that
is half written, or whose writer died, is never seen, and a reader keeps the
folder that its manifest named while newer versions appear beside it.  A version
number is claimed by creating a file that must not exist, so two writers never
publish the same number.

    root/v-<unique>/          the model
    root/claim-00000003       taken by the writer of version 3
    root/manifest-00000003.json
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from sardonyx.session import delete_path

#: Versions left when older ones are deleted: a reader has as long as it takes to publish this many.
KEEP = 3


class Version(NamedTuple):
    number: int
    path: str
    meta: dict


class ModelStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self) -> list[str]:
        if not self._fs.exists(self._path("")):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")))

    def numbers(self) -> list[int]:
        """The published versions, oldest first."""
        return [int(n[9:17]) for n in self._names() if n.startswith("manifest-") and n.endswith(".json")]

    def version(self, number: int) -> Version:
        stream = self._fs.open(self._path(f"manifest-{number:08d}.json"))
        try:
            said = json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()
        return Version(number, f"{self.root}/{said['folder']}", said["meta"])

    def latest(self) -> Version | None:
        found = self.numbers()
        return self.version(found[-1]) if found else None

    def load(self, number: int | None = None) -> tuple[PipelineModel, Version]:
        """A version's model (by default the latest); the version says which folder is pinned."""
        found = self.latest() if number is None else self.version(number)
        if found is None:
            raise FileNotFoundError(f"no published model in {self.root}")
        return PipelineModel.load(found.path), found

    def _claim(self) -> int:
        taken = [int(n[-8:]) for n in self._names() if n.startswith("claim-")]
        number = max([0, *taken, *self.numbers()]) + 1
        while True:
            try:
                self._fs.create(self._path(f"claim-{number:08d}"), False).close()
                return number
            except Exception as e:  # py4j wraps the store's "already exists"
                if "exist" not in str(e).lower():
                    raise
                number += 1

    def publish(self, model: PipelineModel, meta: dict | None = None, keep: int = KEEP) -> Version:
        """Write ``model`` and make it the latest version; ``meta`` is kept in its manifest."""
        folder = f"v-{uuid.uuid4().hex[:12]}"
        model.write().save(f"{self.root}/{folder}")
        number = self._claim()
        draft = self._path(f"draft-{folder}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"folder": folder, "meta": meta or {}}).encode()))
        out.close()
        if not self._fs.rename(draft, self._path(f"manifest-{number:08d}.json")):
            raise OSError(f"version {number} of {self.root} could not be published")
        self._delete_old(keep)
        return Version(number, f"{self.root}/{folder}", meta or {})

    def _delete_old(self, keep: int) -> None:
        for number in self.numbers()[:-keep] if keep else []:
            old = self.version(number)
            for name in (f"manifest-{number:08d}.json", f"claim-{number:08d}"):  # out of sight first
                self._fs.delete(self._path(name), False)
            delete_path(self.spark, old.path)
