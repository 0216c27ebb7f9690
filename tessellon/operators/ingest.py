"""Pages saved by hand and feeds: what becomes a raw document, under which id, and what is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellon.functions import dates, urls
from tessellon.functions import text as tx
from tessellon.operators import normalize


def document_id(doctype: str, prefix: Column, day: Column, title: Column, url: Column) -> Column:
    from tessellon.operators.metadata import doc_id

    return doc_id(prefix, F.lit(doctype), day, title, url)


def feed_map(items: DataFrame) -> DataFrame:
    """feed_key and the UTC day of feed items (link, pub_date): each under its key and under the key with the default page. Of several items for one key
    the first by link stays."""
    key = urls.feed_key(F.col("link"))
    i = items.where(tx.blank_to_null(F.col("link")).isNotNull()).select("link", dates.utc_day(F.col("pub_date")).alias("day"), F.explode(F.array(key, F.concat(key, F.lit("/default.aspx")))).alias("feed_key"))
    return i.groupBy("feed_key").agg(F.min_by("day", "link").alias("rss_day"))


def saved_pages(pages: DataFrame, manifest: DataFrame, feed: DataFrame, existing: DataFrame, prefix: str, doctype: str = "press", bucket: str = "investor_news") -> DataFrame:
    """pages (file, html) to raw records with a status: WARN where neither the page nor the manifest (file, url) names a URL, SKIP where the id
    exists (existing: doc_id), else OK. The page's canonical URL comes before the manifest's; the feed's day (feed: link, pub_date) before the page's."""
    h = F.col("html")
    p = pages.select("file", "html", normalize.canonical_url(h).alias("own"), normalize.page_title(h).alias("visible_title"), normalize.page_day(h).alias("visible_date"))
    p = p.join(manifest.groupBy("file").agg(F.min("url").alias("listed")), "file", "left")
    p = p.withColumn("requested_url", urls.feed_key(F.coalesce("own", "listed"))).join(feed_map(feed).withColumnRenamed("feed_key", "requested_url"), "requested_url", "left")
    day = F.coalesce("rss_day", "visible_date")
    p = p.withColumn("doc_id", document_id(doctype, F.lit(prefix), day, F.coalesce("visible_title", "requested_url"), F.col("requested_url")))
    p = p.join(existing.select("doc_id", F.lit(True).alias("there")).distinct(), "doc_id", "left")
    status = F.when(F.col("requested_url").isNull(), "WARN").when(F.col("there"), "SKIP").otherwise("OK")
    notes = F.concat(F.lit("manual_save=1"), F.when(F.col("rss_day").isNotNull(), "; feed=ir_rss").otherwise(""))
    content = F.col("html").cast("binary")
    return p.select(
        "file", status.alias("status"), F.when(status != "WARN", F.col("doc_id")).alias("doc_id"), urls.host(F.col("requested_url")).alias("source_domain"), F.lit(bucket).alias("source_bucket"), F.lit(doctype).alias("doctype"),
        "requested_url", F.col("requested_url").alias("final_url"), F.lit(200).alias("http_status"), F.lit("text/html").alias("content_type"), F.octet_length(content).cast("long").alias("content_length"), F.sha2(content, 256).alias("sha256_raw"),
        "visible_title", "visible_date", F.col("rss_day").alias("rss_pubdate"), F.col("visible_title").alias("headline"), notes.alias("notes"),
    )


def feed_entries(feeds: DataFrame, index: DataFrame, limits: dict[str, int], total: int) -> DataFrame:
    """feeds (feed, link, place) cut to each feed's limit by place, once by link's key (first feed by name, then place); if these are fewer than `total`,
    index links (link, place) that aren't among them fill up."""
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)), F.col("feed"))
    nth = F.row_number().over(Window.partitionBy("feed").orderBy("place", "link"))
    f = feeds.withColumn("nth", nth).where(F.col("nth") <= F.coalesce(limit, F.lit(0))).withColumn("key", urls.feed_key(F.col("link")))
    f = f.groupBy("key").agg(F.min_by(F.struct("feed", "link", "nth"), F.struct("feed", "nth")).alias("f")).select("key", "f.feed", "f.link", F.col("f.nth").alias("place"))
    have = f.count()
    more = index.withColumn("key", urls.feed_key(F.col("link"))).groupBy("key").agg(F.min_by(F.struct("link", "place"), F.struct("place", "link")).alias("i")).join(f.select("key"), "key", "left_anti")
    more = more.select("key", F.lit("index").alias("feed"), "i.link", "i.place").orderBy("place", "link").limit(max(0, total - have))
    return f.unionByName(more.withColumn("place", F.col("place").cast("int")))


def with_manifest(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """pages (file, ...) with url: the manifest's, null where it names none."""
    return pages.join(manifest.groupBy("file").agg(F.min("url").alias("url")), "file", "left")


def index_manifests(vectors: DataFrame, names: dict[str, str], id_col: str, vec_col: str, batch: int = 500) -> DataFrame:
    """One row for each batch that would be sent to each backend's index (names: backend -> index): its number, rows, first and last id, and vector
    length. Batches follow the ids' order in ranges of like size, so no task holds all ids."""
    rows = vectors.select(F.col(id_col).alias("id"), F.size(vec_col).alias("dim"))
    numbered = rows.withColumn("batch", F.floor(F.col("id") / batch))
    each = numbered.groupBy("batch").agg(F.count("*").alias("rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max("dim").alias("dim"))
    targets = F.array(*(F.struct(F.lit(b).alias("backend"), F.lit(i).alias("index_name")) for b, i in names.items()))
    return each.withColumn("t", F.explode(targets)).select("t.backend", "t.index_name", "batch", "rows", "first_id", "last_id", "dim")
