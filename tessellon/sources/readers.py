"""Readers with declared schemas. Malformed records are kept apart, not lost in silence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_META = "doc_id string, source_domain string, source_bucket string, doctype string, requested_url string, final_url string, redirect_chain array<string>, http_status int, content_type string, content_length bigint, fetched_at timestamp, sha256_raw string, visible_title string, visible_date date, rss_pubdate date, headline string, notes string, latency_ms double, last_modified_http string"
NORMALIZED = "doc_id string, company string, doctype string, title string, publish_date string, url string, final_url string, source_domain string, section string, topic string, persona_tags array<string>, language string, text string, word_count int, token_count int, ingestion_ts timestamp, hash_sha256 string, html_title string, meta_published_time string, last_modified_http string, byline string, press_location string, ticker_mentions array<string>, pdf_page_map string"
CHUNK = "chunk_id string, doc_id string, seq_no int, text string, word_count int, token_count int, start_char int, end_char int, local_heads array<string>, metadata_snapshot struct<company:string,doctype:string,date:string,url:string,title:string,topic:string,persona_tags:array<string>>"
EMBEDDING = "chunk_id string, doc_id string, seq_no int, token_count int, l2_norm float, vector array<float>"
EVAL_SEED = "eval_id string, persona string, query_text string, expected_doc_id string, expected_chunk_id string, expected_answer_keyphrases array<string>, source_type string, created_from_url string, label_date date, difficulty string, notes string"

#: Payloads of a document in the order in which they are looked for.
PAYLOADS = (".raw.html", ".pdf", ".json")
#: Payload bytes that a task holds at a time.
READ_BYTES = 8 << 20
# Queries that stand in for missing labelled ones.
FALLBACK_QUERIES = [("vp_customer_experience", "Agentforce product announcement"), ("cio", "remaining performance obligation definition"), ("vp_sales_ops", "latest earnings results")]


def json_records(spark: SparkSession, path: str, schema: str, multi_line: bool = False, recursive: bool = False, glob: str | None = None, with_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good rows, with their file's path if asked for, and the texts of the bad ones."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    marked = T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    file = [F.col("_metadata.file_path").alias("_file")] if with_file else []
    rows = reader.text(path, wholetext=multi_line).where(F.trim("value") != "").select("value", parsed.alias("r"), *file)
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return rows.where(~bad).select(*(F.col(f"r.{f.name}").alias(f.name) for f in kind.fields), *(["_file"] if with_file else [])), rows.where(bad).select(F.col("value").alias("_corrupt"))


def documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One JSON file for each document, of several with one doc_id the last file's; and the texts of malformed files."""
    good, bad = json_records(spark, path, NORMALIZED, multi_line=True, with_file=True)
    last = Window.partitionBy("doc_id").orderBy(F.col("_file").desc())
    return good.where("doc_id is not null").withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn", "_file"), bad


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return json_records(spark, path, CHUNK)[0]


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """file and lines, without parsing them."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count("*").alias("lines"))


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    return json_records(spark, folder, RAW_META, multi_line=True, recursive=True, glob="*.meta.json")[0]


def payload_paths(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, path, ending and length of the first payload that each document has. The listing alone is read: no payload's bytes. A file
    without bytes counts as missing (Spark's readers pass over such files)."""
    name = F.element_at(F.split("path", "/"), -1)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", name.alias("name"))
    rank, ending = F.lit(None).cast("int"), F.lit(None).cast("string")
    for k, kind in enumerate(PAYLOADS):
        fits = F.col("name").endswith(kind) & ~F.col("name").endswith(".meta.json")
        rank, ending = F.when(fits, k).otherwise(rank), F.when(fits, kind).otherwise(ending)
    found = listed.withColumn("rank", rank).withColumn("ending", ending).where("rank is not null")
    found = found.withColumn("doc_id", F.left("name", F.length("name") - F.length("ending")))
    return found.groupBy("doc_id").agg(F.min(F.struct("rank", "path", "ending", "length")).alias("p")).select("doc_id", "p.path", "p.ending", "p.length")


def with_content(rows: DataFrame, path_col: str = "path") -> DataFrame:
    """rows with the bytes of the file that each names. Tasks read the files themselves, after all filters and exchanges, and hold
    one file and READ_BYTES of others at a time."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            start, held, size = 0, [], 0
            for k, uri in enumerate(batch.column(names.index(path_col)).to_pylist()):
                store, path = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
                with store.open_input_stream(path, compression=None) as source:
                    held.append(source.read())
                size += len(held[-1])
                if size >= READ_BYTES:
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(held)).columns, pa.array(held, pa.binary())], [*names, "content"])
                    start, held, size = k + 1, [], 0
            yield pa.RecordBatch.from_arrays([*batch.slice(start, len(held)).columns, pa.array(held, pa.binary())], [*names, "content"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())]))


def eligible_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Sidecars of answered requests with the first payload that exists: the sidecar's fields, path, ending, length and content. Sidecars and paths
    are joined first; only the chosen payloads are read, and their bytes take part in no exchange."""
    answered = sidecars(spark, folder).where("http_status = 200")
    return with_content(answered.join(payload_paths(spark, folder), "doc_id"))


def with_sidecars(docs: DataFrame, side: DataFrame, prefix: str = "side_") -> DataFrame:
    """docs with the fields of their sidecars, null where there is none; of several sidecars of one document the one fetched last stays."""
    fields = [c for c in side.columns if c != "doc_id"]
    one = side.groupBy("doc_id").agg(F.max_by(F.struct(*fields), F.struct(F.coalesce("fetched_at", F.lit(0).cast("timestamp")), F.coalesce("final_url", F.lit("")))).alias("s"))
    return docs.join(one.select("doc_id", *(F.col(f"s.{c}").alias(f"{prefix}{c}") for c in fields)), "doc_id", "left")


def eval_seed(spark: SparkSession, path: str, fallback: list[tuple[str, str]] = FALLBACK_QUERIES, times: int = 15) -> DataFrame:
    """Labelled queries from JSON lines; where there is no such file, the fallback's queries `times` times over."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return json_records(spark, path, EVAL_SEED)[0]
    rows = spark.createDataFrame([(p, q) for p, q in fallback * times], "persona string, query_text string")
    kind = T.StructType.fromDDL(EVAL_SEED)
    return rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields))


def csv_with_header(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV; a byte-order mark before the first name is ignored."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("encoding", "UTF-8").csv(path)


def log_hits(spark: SparkSession, path: str, words: list[str], newest: int = 5) -> DataFrame:
    """For the newest files, how many lines hold each word."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("t"))
    files = rows.select("file", "t").distinct().orderBy(F.col("t").desc(), F.col("file").desc()).limit(newest).select("file")
    return rows.join(F.broadcast(files), "file").agg(*(F.count_if(F.col("value").contains(w)).alias(w) for w in words))


def decode_html(content: Column) -> Column:
    """UTF-8 with malformed bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))


def feed_items(feeds: DataFrame, column: str = "xml") -> DataFrame:
    """link, title, pub_date text of each item of RSS documents."""
    item = F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<item\b.*?</item>"), F.lit(0)))
    part = lambda name: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("item", rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1), r"<!\[CDATA\[|\]\]>", "")), F.lit(""))
    return feeds.select(item.alias("item")).select(part("link").alias("link"), part("title").alias("title"), part("pubDate").alias("pub_date"))


def page_links(html: Column) -> Column:
    """Targets of a page's links, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref=["']([^"']+)["']"""), F.lit(1)))
