"""Sources and sinks: blocks, keyed stores, change detection, listings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import ingest, knowledge_base
from ..session import cut, shared_dir, table
from ..sources import store
from .registry import query

_HEAD = r"(length(text) <= 60 AND NOT regexp_matches(trim(text), '[.!?:;,]$') AND regexp_matches(trim(text), '\S\s+\S'))"
_HASH = "substr(sha256(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 1, 16)"


@query("SELECT doc_id, CAST(n - 1 AS BIGINT) AS n_block, block FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS block, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE trim(block) <> ''")
def doc_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of each document with their place."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n_block", "block"))
    return lines.where(F.trim("block") != "").select("doc_id", F.col("n_block").cast("long").alias("n_block"), "block")


@query(f"SELECT doc_id, {_HASH} AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", store.content_hash("doc_id", "text").alias("content_hash"))


def versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the store: without the newest source, and with trimmed texts of another."""
    docs = table(spark, sf, "documents")
    old = docs.where("source != 'src3'").withColumn("content_hash", store.content_hash("doc_id", "text"))
    text = F.when(F.col("source") == "src5", F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    new = docs.where("source != 'src7'").withColumn("text", text).withColumn("content_hash", store.content_hash("doc_id", "text"))
    return old, new


_VERSIONS = f"""o AS (SELECT *, {_HASH} AS content_hash FROM documents WHERE source <> 'src3'),
n AS (SELECT *, {_HASH} AS content_hash FROM (SELECT doc_id, CASE WHEN source = 'src5' THEN text || ' ' ELSE text END AS text, lang, source, n_chars FROM documents WHERE source <> 'src7'))"""


@query(f"""WITH {_VERSIONS} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'NEW' WHEN n.doc_id IS NULL THEN 'DELETED' WHEN o.content_hash = n.content_hash THEN 'UNCHANGED' ELSE 'CHANGED' END AS change
FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def incremental_diff(spark: SparkSession, sf: str) -> DataFrame:
    old, new = versions(spark, sf)
    return store.diff(old, new, "doc_id", "content_hash")


@query(f"WITH {_VERSIONS} SELECT doc_id, content_hash, length(text) AS n FROM n UNION ALL SELECT doc_id, content_hash, length(text) FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)")
def kb_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old, new = versions(spark, sf)
    keep = lambda df: df.select("doc_id", "content_hash", F.length("text").cast("long").alias("n"))
    return store.upsert(keep(old), keep(new), "doc_id")


_INGESTED = f"""{_VERSIONS}, m AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, n.doc_id IS NOT NULL AS again, o.doc_id IS NOT NULL AND n.content_hash IS NOT DISTINCT FROM o.content_hash AS same,
  coalesce(n.content_hash, o.content_hash) AS content_hash, coalesce(n.text, o.text) AS text, o.text AS old_text, coalesce(n.source, o.source) AS source, o.doc_id IS NOT NULL AS before FROM o FULL JOIN n ON o.doc_id = n.doc_id),
b AS (SELECT doc_id, n, text, {_HEAD} AS head FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM m) WHERE trim(text) <> ''),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, CAST(length(text) AS INTEGER) AS size, text || CASE WHEN head OR regexp_matches(text, '[.!?]$') THEN chr(10) ELSE '' END AS piece FROM b),
f AS (SELECT doc_id, i, size AS acc, 0 AS c, piece FROM s WHERE i = 1 UNION ALL SELECT doc_id, i, CASE WHEN cut THEN size ELSE acc + size END, CASE WHEN cut THEN c + 1 ELSE c END, piece FROM
  (SELECT s.doc_id, s.i, s.size, f.acc, f.c, s.piece, s.head OR (f.acc + s.size > 512 AND f.acc >= 60) AS cut FROM f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1)),
k AS (SELECT doc_id, CAST(max(c) + 1 AS INTEGER) AS n_chunks, md5(string_agg(piece, '' ORDER BY i)) AS chunks_md5 FROM f GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_INGESTED} SELECT doc_id, content_hash, n_chunks, chunks_md5, source, CASE WHEN again THEN '2' ELSE '1' END AS pass, CASE WHEN before AND (same OR NOT again) THEN '1' END AS first,
CASE WHEN doc_id % 3 = 0 AND again AND doc_id % 2 = 0 THEN length(text) || ' * x' WHEN doc_id % 3 = 0 AND before THEN length(old_text) || ' * x' END AS expression, n_chunks AS n_vectors FROM m JOIN k USING (doc_id)""")
def ingest_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """What a knowledge base holds after two rounds of documents: first one without a source, then one without another and with changed texts of a third.

    Metadata of unchanged documents are merged, changed ones are cut into chunks again, those that don't come again stay. A third of the documents
    have a formula; in the second round those of odd ids have one that is turned away as well, so theirs stay as they were.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/base-{uuid.uuid4().hex}"
    base = knowledge_base(spark, folder)
    for number, docs in enumerate(versions(spark, sf), 1):
        about = F.create_map(F.lit("source"), F.col("source"), F.lit("pass"), F.lit(str(number)), *([F.lit("first"), F.lit("1")] if number == 1 else []))
        own = docs.where("doc_id % 3 = 0")
        formulas = own.select("doc_id", F.lit("weight").alias("name"), F.concat(F.length("text").cast("string"), F.lit(" * x")).alias("expression"), F.lit(True).alias("valid"))
        if number == 2:
            formulas = formulas.union(own.where("doc_id % 2 = 1").select("doc_id", F.lit("worse"), F.lit("import x"), F.lit(False)))
        ingest(base, docs, about.cast("map<string,string>"), formulas, "rounds", number)
    base.vacuum()  # the first round's files
    chunks = base.read("chunk").groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_chunk", "text"))), lambda x: x["text"]), "").cast("binary")).alias("chunks_md5"), F.count("embedding").cast("int").alias("n_vectors"))
    whole = base.read("doc").join(chunks, "doc_id").join(base.read("formula").select("doc_id", "expression"), "doc_id", "left")
    found = cut(whole.select("doc_id", "content_hash", "n_chunks", "chunks_md5", *[F.try_element_at("meta", F.lit(k)).alias(k) for k in ("source", "pass", "first")], "expression", "n_vectors"))
    base.remove()
    return found


@query(f"WITH {_VERSIONS} SELECT o.doc_id, o.source, CASE WHEN o.content_hash = n.content_hash THEN 'refreshed' ELSE 'stale' END AS state, CASE WHEN o.content_hash = n.content_hash THEN n.n_chars + 1 ELSE o.n_chars END AS n_chars FROM o LEFT JOIN n ON o.doc_id = n.doc_id")
def kb_meta_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata is replaced only where the content hash hasn't changed."""
    old, new = versions(spark, sf)
    both = old.join(new.select("doc_id", F.col("content_hash").alias("h"), F.col("n_chars").alias("m")), "doc_id", "left")
    same = F.coalesce(F.col("content_hash") == F.col("h"), F.lit(False))
    return both.select("doc_id", "source", F.when(same, "refreshed").otherwise("stale").alias("state"), F.when(same, F.col("m") + 1).otherwise(F.col("n_chars")).alias("n_chars"))


@query("SELECT label, count(*) AS n, count(*) FILTER (len(embedding) = 64) AS n_right, CAST(max(len(embedding)) AS INTEGER) AS widest FROM embeddings GROUP BY 1")
def dim_guard(spark: SparkSession, sf: str) -> DataFrame:
    size = F.size("embedding")
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(size == 64).alias("n_right"), F.max(size).alias("widest"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def session_last_write(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return store.last_write(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""SELECT doc_id, CASE WHEN repaired IS NOT NULL THEN 'repaired' WHEN original IS NOT NULL THEN 'original' END AS version, coalesce(repaired, original) AS source FROM
(SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.source AS original, b.source AS repaired FROM documents a FULL JOIN (SELECT doc_id, 'repaired-' || source AS source FROM documents WHERE lang = 'fr') b ON a.doc_id = b.doc_id)""")
def version_resolve(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    repaired = docs.where("lang = 'fr'").select("doc_id", F.concat(F.lit("repaired-"), "source").alias("repaired"))
    both = docs.select("doc_id", F.col("source").alias("original")).join(repaired, "doc_id", "full")
    return both.select("doc_id", F.when(F.col("repaired").isNotNull(), "repaired").when(F.col("original").isNotNull(), "original").alias("version"), F.coalesce("repaired", "original").alias("source"))


@query("SELECT source, lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars, min(doc_id) AS first_doc FROM documents GROUP BY 1, 2")
def doc_listing(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.min("doc_id").alias("first_doc"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), '-') AS title, CAST(len(regexp_extract_all(html, '<p[ >]')) AS INTEGER) AS n_paragraphs, len(html) AS n_chars FROM pages""")
def page_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Title and paragraph count of raw pages."""
    title = F.coalesce(F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")), F.lit("-"))
    return table(spark, sf, "pages").select("page_id", title.alias("title"), F.size(F.regexp_extract_all("html", F.lit("<p[ >]"), F.lit(0))).alias("n_paragraphs"), F.length("html").cast("long").alias("n_chars"))
