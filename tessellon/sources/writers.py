"""Sinks. Every stage writes a new folder; Spark's commit protocol makes it whole or absent."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.operators import ordering


def parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def packed_json_lines(rows: DataFrame, key: str, folder: str, file_bytes: int = 128 << 20, order: str | None = None) -> DataFrame:
    """Rows of a key lie together in one file of JSON lines, many keys in a file: files hold about file_bytes (a key that is larger has one of its own). Returns
    the manifest (key, file, rows, bytes), which is also written; keys lie in their order, so a manifest's files are ranges of keys."""
    line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    sized = rows.select(F.col(key).alias("_key"), (F.octet_length(line) + 1).cast("long").alias("_bytes"), "*")
    keys = sized.groupBy("_key").agg(F.count(F.lit(1)).alias("rows"), F.sum("_bytes").alias("bytes"))
    # the middle of a key says which file it is in, so a file holds less than twice file_bytes unless one key does
    filed = ordering.placed(keys, [F.col("_key")], weight="bytes", place="_before").withColumn("_file", F.floor((F.col("_before") + F.col("bytes") / 2) / file_bytes))
    met = sized.drop("_bytes").join(filed.select(F.col("_key").alias("_k"), "_file"), F.col("_key").eqNullSafe(F.col("_k"))).drop("_k")
    dealt = met.repartition("_file").sortWithinPartitions("_file", "_key", *([order] if order else [])).drop("_key")
    dealt.write.mode("overwrite").partitionBy("_file").option("ignoreNullFields", False).json(f"{folder}/data")
    manifest = filed.select(F.col("_key").alias("key"), F.concat(F.lit(f"{folder}/data/_file="), F.col("_file").cast("string")).alias("file"), "rows", "bytes")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return rows.sparkSession.read.parquet(f"{folder}/manifest")


def read_packed(spark: SparkSession, folder: str, schema: str, key_col: str, keys: list) -> DataFrame:
    """Rows of a few keys: only the files that the manifest names for them are read."""
    files = [r["file"] for r in spark.read.parquet(f"{folder}/manifest").where(F.col("key").isin(keys)).select("file").distinct().collect()]
    return spark.read.schema(schema).json(files).where(F.col(key_col).isin(keys)) if files else spark.createDataFrame([], schema)


def record_files(rows: DataFrame, folder: str, name_col: str = "name", body_col: str = "body") -> DataFrame:
    """Writes a file for each row (name, body: string or binary). A file is written beside its name and renamed, so it is there whole or not at all, and one
    that holds the same bytes already is left alone. Returns name, bytes and whether it was written."""

    def run(batches: Iterator[pa.RecordBatch]):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            out = []
            for name, body in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                path, same = f"{root}/{name}", False
                info = store.get_file_info(path)
                if info.type == fs.FileType.File and info.size == len(body):
                    with store.open_input_stream(path, compression=None) as source:
                        same = source.read() == body
                if not same:
                    draft = f"{path}.{uuid.uuid4().hex}.tmp"
                    with store.open_output_stream(draft, compression=None) as target:
                        target.write(body)
                    store.move(draft, path)
                out.append((name, len(body), not same))
            names, sizes, fresh = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(fresh, pa.bool_())], ["name", "bytes", "written"])

    return rows.select(F.col(name_col).alias("name"), F.col(body_col).cast("binary").alias("body")).mapInArrow(run, "name string, bytes long, written boolean")


def json_body(*columns: str) -> Column:
    """A row as JSON text: nulls kept, other characters than ASCII as they are, indented by two."""

    @F.pandas_udf("string")
    def pretty(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: json.dumps(json.loads(x), ensure_ascii=False, indent=2))

    return pretty(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def csv_with_header(df: DataFrame, path: str) -> None:
    """Arrays are joined by commas."""
    flat = [F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def report(checks: DataFrame, gate: str, status: str) -> str:
    """A gate report as JSON: its status, its checks and how many have each status; a gate has a few dozen checks at most."""
    rows = [r.asDict() for r in checks.select("id", "metric", "actual", "threshold", "status").orderBy("id").collect()]
    counts = {s: sum(r["status"] == s for r in rows) for s in ("PASS", "WARN", "FAIL")}
    return json.dumps({"gate": gate, "status": status, "checks": rows, "summary": counts}, ensure_ascii=False, indent=2)


def markdown(checks: DataFrame, title: str) -> str:
    """A gate report as text; a gate has a few dozen checks at most."""
    rows = checks.select("id", "metric", "actual", "threshold", "status").orderBy("id").collect()
    lines = [f"# {title}", "", "| id | metric | actual | threshold | status |", "|-|-|-|-|-|"]
    return "\n".join([*lines, *("| " + " | ".join(str(v) for v in r) + " |" for r in rows)]) + "\n"
