"""Named settings and the pairs compared last, as small JSON files in any store that Spark reads."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from .catalog import _files

RECENT = 10


class JsonFiles:
    """Small JSON values by name under a path; a write replaces the value."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> tuple:
        if not re.fullmatch(r"[\w .-]+", name) or name.startswith("."):
            raise ValueError(f"{name!r} can't be a name")
        return _files(self.spark, f"{self.path}/{name}.json")

    def save(self, name: str, value: object) -> None:
        fs, where = self._at(name)
        out = fs.create(where, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def load(self, name: str) -> object | None:
        fs, where = self._at(name)
        return json.loads(self.spark.read.text(where.toString(), wholetext=True).first()[0]) if fs.exists(where) else None

    def names(self) -> list[str]:
        fs, where = _files(self.spark, self.path)
        found = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(n[: -len(".json")] for n in found if n.endswith(".json") and not n.startswith("."))

    def delete(self, name: str) -> bool:
        fs, where = self._at(name)
        return fs.delete(where, False)


class RecentPairs:
    """The last RECENT pairs, the newest first, each once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.files = JsonFiles(spark, path)

    def all(self) -> list[tuple[str, str]]:
        return [tuple(p) for p in self.files.load("recent") or []]

    def add(self, source: str, target: str) -> None:
        others = [p for p in self.all() if (p[0].lower(), p[1].lower()) != (source.lower(), target.lower())]
        self.files.save("recent", [(source, target), *others][:RECENT])
