"""A table in versions: updates write only the parts that change, appear as a whole or not at all, and can be taken back.

A row's part is the hash of its key. Parts are Parquet folders that are never changed; a version is a manifest, a small file that names each part's folder. A
new version comes about by one rename of its manifest to the next number, which fails if another writer was faster: readers see the
old version or the new one. Unchanged rows are found by a digest that is stored with them, so comparing reads keys and digests alone, and an update without
changes writes nothing. An earlier version stays readable until ``expire``; ``roll_back`` makes one the newest again without moving rows.

Keys are unique and not null (``write`` says so otherwise); a null in an update can leave the old value as it is. What a failed attempt has
left is named by no manifest; ``expire`` deletes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer has made this version."""


@dataclass
class Version:
    number: int
    parts: dict[int, str]  # part -> folder
    written: list[int]  # parts that this version wrote itself
    schema: str


class VersionedTable:
    def __init__(self, spark: SparkSession, folder: str, key: str, parts: int = 64):
        self.spark, self.folder, self.key, self.parts = spark, folder.rstrip("/"), key, parts

    # ---- manifests

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("versions")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def version(self, number: int | None = None) -> Version | None:
        known = self.versions()
        number = (known[-1] if known else None) if number is None else number
        if number is None:
            return None
        if number not in known:
            raise KeyError(f"{self.folder} has no version {number}")
        found = json.loads(self.spark.read.text(f"{self.folder}/versions/v{number:08d}.json", wholetext=True).first()[0])
        return Version(number, {int(k): v for k, v in found["parts"].items()}, found["written"], found["schema"])

    def _commit(self, version: Version) -> Version:
        body = json.dumps({"parts": version.parts, "written": version.written, "schema": version.schema})
        draft, final = self._path(f"versions/.{uuid.uuid4().hex}"), self._path(f"versions/v{version.number:08d}.json")
        out = self._fs().create(draft, False)
        out.write(bytearray(body.encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            self._fs().delete(draft, False)
            if "AlreadyExists" in str(error):
                raise Conflict(f"{self.folder} has got version {version.number} meanwhile") from None
            raise
        return version

    # ---- rows

    def _marked(self, rows: DataFrame) -> DataFrame:
        columns = sorted(c for c in rows.columns if c != self.key)
        digest = F.sha2(F.to_json(F.struct(self.key, *columns), {"ignoreNullFields": "false"}), 256)
        return rows.withColumn("_digest", digest).withColumn("_part", F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int"))

    def _stored(self, version: Version, parts: Sequence[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(version.schema))
        paths = sorted({v for k, v in version.parts.items() if parts is None or k in parts})
        return self.spark.read.schema(schema.add("_digest", "string")).parquet(*paths) if paths else self.spark.createDataFrame([], schema.add("_digest", "string"))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        version = self.version(number)
        if version is None:
            raise KeyError(f"{self.folder} has no version")
        return self._stored(version).drop("_digest")

    def _put(self, marked: DataFrame, parts: Sequence[int], before: Version | None, schema: str) -> Version:
        """Writes the given parts anew and commits; a part without rows is left out."""
        data = f"{self.folder}/data/{uuid.uuid4().hex}"
        marked.repartition(max(1, len(parts)), "_part").write.partitionBy("_part").parquet(data)
        fs, folder = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path(data)
        new = {int(n.split("=")[1]): f"{data}/{n}" for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.startswith("_part=")}
        kept = {k: v for k, v in before.parts.items() if k not in parts} if before else {}
        return self._commit(Version(before.number + 1 if before else 1, kept | new, sorted(new), schema))

    def write(self, rows: DataFrame) -> Version:
        """All rows as the next version, whatever was there before."""
        bad = rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("n")).where(F.col(self.key).isNull() | (F.col("n") > 1)).limit(1).collect()
        if bad:
            raise ValueError(f"{self.key} {bad[0][0]} isn't a unique key")
        before = self.version()
        every = range(self.parts)
        return self._put(self._marked(rows), every, before, rows.schema.json())

    def update(self, rows: DataFrame, keep_old_for_null: bool = False) -> Version:
        """Adds new keys and replaces changed rows; without any the newest version is returned as it is. rows have the table's columns, or with
        keep_old_for_null some of them."""
        before = self.version()
        if before is None:
            return self.write(rows)
        stored = self._stored(before)
        columns = [c for c in stored.columns if c != "_digest"]
        if keep_old_for_null:
            old = stored.select(self.key, *(F.col(c).alias(f"_old_{c}") for c in columns if c != self.key))
            filled = [F.coalesce(F.col(c) if c in rows.columns else F.lit(None), F.col(f"_old_{c}")).cast(stored.schema[c].dataType).alias(c) for c in columns if c != self.key]
            rows = rows.join(old, self.key, "left").select(self.key, *filled)
        marked = self._marked(rows.select(*(F.col(c).cast(stored.schema[c].dataType).alias(c) for c in columns)))
        known = stored.select(self.key, F.col("_digest").alias("_known"))
        changed = marked.join(known, self.key, "left").where(F.col("_known").isNull() | (F.col("_known") != F.col("_digest"))).drop("_known")
        return self._merge(before, changed, changed.select(self.key))

    def remove(self, keys: DataFrame) -> Version:
        """Without the rows of the given keys."""
        before = self.version()
        gone = self._stored(before).join(keys.select(self.key).distinct(), self.key, "left_semi")
        marked = self._marked(gone.drop("_digest"))
        return self._merge(before, marked.limit(0), marked.select(self.key), marked)

    def _merge(self, before: Version, added: DataFrame, gone: DataFrame, touching: DataFrame | None = None) -> Version:
        parts = [r[0] for r in (added if touching is None else touching).select("_part").distinct().collect()]  # at most as many as the table has
        if not parts:
            return before
        stays = self._stored(before, parts).join(gone, self.key, "left_anti").withColumn("_part", F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int"))
        return self._put(stays.unionByName(added), parts, before, before.schema)

    def roll_back(self, number: int) -> Version:
        """An earlier version as the newest one."""
        old, now = self.version(number), self.version()
        return self._commit(Version(now.number + 1, old.parts, [], old.schema))

    def expire(self, keep: int = 2) -> list[int]:
        """Deletes all but the newest `keep` versions, and folders that no version left names. No writer may be at work meanwhile."""
        known = self.versions()
        gone, fs = known[: max(0, len(known) - keep)], self._fs()
        used = {path.split("/data/")[1] for n in known[len(gone) :] for path in self.version(n).parts.values()}
        for n in gone:
            fs.delete(self._path(f"versions/v{n:08d}.json"), False)
        for write in fs.listStatus(self._path("data")):
            name = write.getPath().getName()
            parts = [p.getPath().getName() for p in fs.listStatus(write.getPath())]
            stale = [p for p in parts if f"{name}/{p}" not in used]
            if len(stale) == len(parts):
                fs.delete(write.getPath(), True)
            else:
                for p in (p for p in stale if p.startswith("_part=")):
                    fs.delete(self._path(f"data/{name}/{p}"), True)
        return gone
