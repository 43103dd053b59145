"""Ingest as one operation: change detection, chunks, vectors, formulas, and one commit of all tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import cut
from ..sources.store import content_hash
from ..sources.versioned import SHARED, Versioned
from . import documents as D
from .index import with_vectors

#: The tables of a knowledge base, all under ``doc_id``.
SCHEMAS = {
    "doc": "doc_id long, content_hash string, n_chunks int, meta map<string,string>",
    "chunk": "doc_id long, n_chunk int, heading string, text string, embedding array<double>",
    "formula": "doc_id long, name string, expression string",
}


def knowledge_base(spark: SparkSession, folder: str, buckets: int = 16) -> Versioned:
    """The store in ``folder``, made if it isn't there. ``buckets`` should make a bucket a few hundred megabytes; it is fixed by the first commit."""
    return Versioned(spark, folder, SCHEMAS, "doc_id", buckets)


def merged(old: Column, new: Column) -> Column:
    """Two maps as one: all keys, values of the second where both have one; null counts as empty."""
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def ready(formulas: DataFrame) -> DataFrame:
    """Documents whose formulas (doc_id, name, expression, valid) may replace those stored: they have some, and none is turned away."""
    return formulas.groupBy("doc_id").agg(F.bool_and(F.coalesce("valid", F.lit(False))).alias("all")).where("all").select("doc_id")


def _changed(texts: DataFrame, given: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of the documents of ``given`` that are not the same, of ``texts`` (doc_id, text, content_hash). The fewer ids, of those to take or to leave,
    are shared with every task; texts are dealt out only if both are many, and those of ids that repeat.
    """
    n_same, n_other, n_again = given.agg(F.count_if("same"), F.count_if(~F.col("same")), F.count_if(F.col("n") > 1)).first()
    few = lambda df, n: F.broadcast(df) if n <= SHARED else df.hint("merge")
    leave, take = given.where("same OR n > 1").select("doc_id"), given.where("NOT same AND n = 1").select("doc_id")
    once = texts.join(few(leave, n_same + n_again), "doc_id", "left_anti") if n_same + n_again <= n_other else texts.join(few(take, n_other), "doc_id", "left_semi")
    if not n_again:
        return once.select("doc_id", "text")
    again = texts.join(few(given.where("NOT same AND n > 1").select("doc_id", "content_hash"), n_again), ["doc_id", "content_hash"], "left_semi")
    return once.select("doc_id", "text").unionByName(again.groupBy("doc_id").agg(F.min("text").alias("text")))


def ingest(
    store: Versioned, docs: DataFrame, meta: Column | None = None, formulas: DataFrame | None = None, stream: str | None = None, batch: int | None = None, force: bool = False,
    before_publish: Callable[[str], None] | None = None,
) -> int:
    """The store's version after ``docs`` (doc_id, text) have been taken in; all of their rows appear with it, or none.

    A document with the stored hash keeps its chunks and vectors, and its metadata are merged, unless ``force`` is set. A new or changed one is cut into chunks
    and its chunks get vectors; one without any chunk leaves what is stored as it is. ``formulas`` (doc_id, name, expression, valid) replace a document's
    only if all are valid. Of rows that repeat an id the one of least hash counts; rows without an id are left out.
    A batch of a stream that has been taken in already changes nothing.
    """
    if stream is not None and store.manifest()["batches"].get(stream, -1) >= batch:
        return store.manifest()["version"]
    none = F.create_map().cast("map<string,string>")
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", (none if meta is None else meta).alias("meta"), content_hash("doc_id", "text").alias("content_hash"))
    # by hashes: no text is kept or dealt out for it
    given = texts.groupBy("doc_id").agg(F.min("content_hash").alias("content_hash"), F.min_by("meta", "content_hash").alias("meta"), F.count("*").alias("n"))
    stored = store.read("doc").select("doc_id", F.col("content_hash").alias("old_hash"), F.col("n_chunks").alias("old_chunks"), F.col("meta").alias("old_meta"))
    given = cut(given.join(stored, "doc_id", "left").withColumn("same", F.coalesce(F.col("content_hash") == F.col("old_hash"), F.lit(False)) & F.lit(not force)))
    chunks = D.chunk_texts(_changed(texts.select("doc_id", "text", "content_hash"), given))
    held = store.stage("chunk", with_vectors(chunks.withColumn("w", tokens(F.col("text"))), "w", "embedding"))
    sizes = cut(store.staged("chunk", held).groupBy("doc_id").agg(F.count("*").cast("int").alias("n_chunks")))
    fresh = given.where("NOT same").join(sizes, "doc_id").select("doc_id", "content_hash", "n_chunks", "meta")
    kept = given.where("same").select("doc_id", "content_hash", F.col("old_chunks").alias("n_chunks"), merged(F.col("old_meta"), F.col("meta")).alias("meta"))
    rows = cut(fresh.unionByName(kept))
    new, gone = {"doc": rows, "chunk": held}, {"doc": rows, "chunk": sizes}
    if formulas is not None:
        may = cut(ready(formulas).join(rows.select("doc_id"), "doc_id", "left_semi"))
        new["formula"], gone["formula"] = formulas.join(may, "doc_id", "left_semi").select("doc_id", "name", "expression").distinct(), may
    return store.commit(new, gone, stream, batch, before_publish)
