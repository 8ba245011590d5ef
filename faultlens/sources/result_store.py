"""Stored results with commits: merges that rewrite the parts they touch, writes that happen wholly and once.

A store is a folder. Rows lie in Parquet folders by (mode, bucket of the case) below `data/<write>`; nothing there is
ever changed. `commits/<version>.json` lists, for every part, the folders that make it up, and a reader follows the
latest one: a write that stopped half-way has no commit and is not seen, an earlier version stays readable. A commit
takes its place by a rename that fails where another write was faster. It also names the batch that was written, and
a batch that has a commit already is not written again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.plans.materialize import materialize
from faultlens.sources.results import insert_missing, upsert_results

PART = ["__mode", "__bucket"]


class WriteConflict(RuntimeError):
    """Another write was committed first; the same write may be repeated on top of it."""


@dataclass(frozen=True)
class Commit:
    """What a version consists of: schema and, by (mode, bucket), folders and number of rows."""

    version: int = 0
    schema: str | None = None
    parts: dict[tuple[str, int], tuple[tuple[str, ...], int]] = field(default_factory=dict)
    batches: tuple[str, ...] = ()

    def to_json(self) -> str:
        parts = [{"mode": m, "bucket": b, "folders": list(f), "rows": n} for (m, b), (f, n) in sorted(self.parts.items())]
        return json.dumps({"version": self.version, "schema": self.schema, "batches": list(self.batches), "parts": parts})

    @staticmethod
    def of(text: str) -> Commit:
        d = json.loads(text)
        return Commit(d["version"], d["schema"], {(p["mode"], p["bucket"]): (tuple(p["folders"]), p["rows"]) for p in d["parts"]}, tuple(d["batches"]))


class ResultStore:
    """Rows keyed by (case_id, mode).

    The number of parts is bounded by modes times `buckets`, so commits and the choice of parts stay small however
    many cases there are. `buckets` belongs to a store: give the same number each time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, remembered: int = 1000):
        self.spark, self.path, self.buckets, self.remembered = spark, path.rstrip("/"), buckets, remembered
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    # --- files ------------------------------------------------------------------------------
    def _at(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _fs(self):
        return self._at("commits").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._at("commits")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def commit(self, version: int | None = None) -> Commit:
        """The latest commit, or that of a version; an empty one where nothing was written."""
        if version is None:
            known = self.versions()
            if not known:
                return Commit()
            version = known[-1]
        stream = self._fs().open(self._at("commits", f"{version:012d}.json"))
        try:
            return Commit.of(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, commit: Commit) -> None:
        fs, temporary = self._fs(), self._at("commits", f".{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        try:
            out.write(bytearray(commit.to_json().encode()))
        finally:
            out.close()
        place = self._at("commits", f"{commit.version:012d}.json")
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self._conf)
        try:
            files.rename(temporary, place, self.spark._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(temporary, False)
            if fs.exists(place):
                raise WriteConflict(f"version {commit.version} exists") from e
            raise

    # --- reading ----------------------------------------------------------------------------
    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of the latest (or of an earlier) version; None where nothing was ever written."""
        commit = self.commit(version)
        return None if commit.schema is None else self._rows(commit, list(commit.parts))

    def _rows(self, commit: Commit, parts: list[tuple[str, int]]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(commit.schema))
        folders = [f"{self.path}/data/{f}" for p in parts if p in commit.parts for f in commit.parts[p][0]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    # --- writing ----------------------------------------------------------------------------
    def upsert(self, new: DataFrame, batch: str | None = None) -> int:
        """Keep the latest row of every (case, mode); returns the version. Parts without new rows keep their files."""
        return self._merge(new, batch, upsert_results)

    def insert_missing(self, new: DataFrame, batch: str | None = None) -> int:
        """Add the rows whose (case, mode) the store lacks."""
        return self._merge(new, batch, insert_missing)

    def append(self, new: DataFrame, batch: str | None = None) -> int:
        """Add all rows; parts get one more folder, and no row is read."""
        return self._merge(new, batch, None)

    def _merge(self, new: DataFrame, batch: str | None, merge) -> int:
        last = self.commit()
        if batch is not None and batch in last.batches:
            return last.version
        bucket = F.pmod(F.xxhash64("case_id"), F.lit(self.buckets)).cast("int")
        placed = lambda df: df.withColumns({"__mode": F.coalesce("mode", F.lit("")), "__bucket": bucket})
        new = materialize(new, "new-results")
        # At most modes x buckets rows.
        touched = [(r["__mode"], r["__bucket"]) for r in placed(new).select(*PART).distinct().collect()]
        rows = new
        if merge is not None and last.schema is not None:
            rows = merge(self._rows(last, touched), new)
        elif merge is not None:
            rows = merge(self.spark.createDataFrame([], new.schema), new)
        written = self._write(placed(rows))
        schema = T.StructType([f for f in rows.schema.fields if f.name not in PART])
        if last.schema is not None and merge is None:
            schema = _both(T.StructType.fromJson(json.loads(last.schema)), schema)
        parts = dict(last.parts)
        for part in touched:
            folders, n = written.get(part, ((), 0))
            if merge is None and part in parts:
                folders, n = (*parts[part][0], *folders), parts[part][1] + n
            parts[part] = (folders, n)
        batches = (*last.batches, *([batch] if batch is not None else []))[-self.remembered :]
        commit = Commit(last.version + 1, json.dumps(schema.jsonValue()), parts, batches)
        self._publish(commit)
        return commit.version

    def _write(self, rows: DataFrame) -> dict[tuple[str, int], tuple[tuple[str, ...], int]]:
        """Write rows below a new folder; by part, its folder and number of rows."""
        name = uuid.uuid4().hex
        rows.repartition(*PART).write.partitionBy(*PART).parquet(f"{self.path}/data/{name}")
        back = self.spark.read.schema("case_id string, mode string").parquet(f"{self.path}/data/{name}")
        folder = F.regexp_extract("_metadata.file_path", rf"/{name}/(.*)/[^/]+$", 1)
        bucket = F.pmod(F.xxhash64("case_id"), F.lit(self.buckets)).cast("int")
        found = back.groupBy(F.coalesce("mode", F.lit("")).alias("m"), bucket.alias("b"), folder.alias("f")).agg(F.count(F.lit(1)).alias("n"))
        decode = self._jvm.java.net.URI.create
        return {(r["m"], r["b"]): ((f"{name}/{decode(r['f']).getPath()}",), r["n"]) for r in found.collect()}

    def vacuum(self, keep: int = 1) -> list[int]:
        """Forget all but the latest versions, and delete folders that none of those left lists; returns what is left.

        Not while another write is under way: its folder has no commit yet.
        """
        fs, known = self._fs(), self.versions()
        left = known[-max(1, keep) :]
        used = {f.split("/", 1)[0] for v in left for folders, _ in self.commit(v).parts.values() for f in folders}
        for v in known[: len(known) - len(left)]:
            fs.delete(self._at("commits", f"{v:012d}.json"), False)
        if fs.exists(self._at("data")):
            for s in fs.listStatus(self._at("data")):
                if s.getPath().getName() not in used:
                    fs.delete(s.getPath(), True)
        return left


def _both(old: T.StructType, new: T.StructType) -> T.StructType:
    """Columns of both; rows written before a column came have nulls there."""
    have = set(old.names)
    return T.StructType([*old.fields, *(f for f in new.fields if f.name not in have)])
