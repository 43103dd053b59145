"""Document structure: chunks, headings, breadcrumbs and quality signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters at which a chunk is closed, and the least that it must have by then.
CHUNK, LEAST = 512, 60


def blocks(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n`` and ``text`` of the lines that aren't blank."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "text"))
    return lines.where(F.trim("text") != "")


def chunks(docs: DataFrame, most: int = CHUNK, least: int = LEAST) -> DataFrame:
    """``doc_id``, ``n_chunk``, ``n_blocks``, ``n_chars``: lines folded into chunks in order.

    A chunk is closed before a line that would take it over ``most`` characters, if it has ``least`` already; a longer
    line stays whole. The fold is one pass over a document's line lengths, within its row.
    """
    sizes = F.transform(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), lambda x: F.length(x))
    zero = F.struct(F.lit(0).alias("size"), F.lit(0).alias("blocks"), F.array().cast("array<struct<blocks:int,size:int>>").alias("done"))

    def step(acc: Column, size: Column) -> Column:
        full = (acc["size"] + size > most) & (acc["size"] >= least)
        closed = F.concat(acc["done"], F.array(F.struct(acc["blocks"].alias("blocks"), acc["size"].alias("size"))))
        return F.struct(F.when(full, size).otherwise(acc["size"] + size).alias("size"), F.when(full, 1).otherwise(acc["blocks"] + 1).alias("blocks"), F.when(full, closed).otherwise(acc["done"]).alias("done"))

    def last(acc: Column) -> Column:
        return F.when(acc["blocks"] > 0, F.concat(acc["done"], F.array(F.struct(acc["blocks"].alias("blocks"), acc["size"].alias("size"))))).otherwise(acc["done"])

    folded = docs.select("doc_id", F.posexplode(F.aggregate(sizes, zero, step, last)).alias("n_chunk", "c"))
    return folded.select("doc_id", "n_chunk", F.col("c.blocks").alias("n_blocks"), F.col("c.size").alias("n_chars"))


def is_heading(text: Column) -> Column:
    """A short line of at least two words without an end of sentence."""
    return (F.length(text) <= 60) & ~F.trim(text).rlike(r"[.!?:;,]$") & F.trim(text).rlike(r"\S\s+\S")


def breadcrumbs(lines: DataFrame) -> DataFrame:
    """``lines`` with the heading that each stands under, carried forward within its document."""
    line = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("heading", F.last(F.when(is_heading(F.col("text")), F.col("text")), ignorenulls=True).over(line))


def quality(coverage: Column, rotated: Column, skew: Column, clarity: Column) -> Column:
    """The quality score from 0 to 1, four decimals."""
    raw = 1 - 0.35 * (1 - coverage) - F.when(rotated, 0.15).otherwise(0.0) - 0.20 * F.least(skew / 10, F.lit(1.0)) - 0.30 * (1 - clarity)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)


def complexity(textless: Column, table: Column, pages: Column, image: Column) -> Column:
    """A level from 1 to 5."""
    add = lambda c, n: F.when(c, n).otherwise(0)
    return F.least(F.lit(5), 1 + add(textless, 3) + add(table, 1) + add(pages > 20, 1) + add(image > 0.3, 1))


def union_length(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``key`` and ``covered``: the length of the union of each key's intervals, by the running greatest end."""
    line = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(end).over(line), F.col(start))
    return intervals.select(key, F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), before)).alias("new")).groupBy(key).agg(F.sum("new").alias("covered"))


def chunk_texts(docs: DataFrame, most: int = CHUNK, least: int = LEAST) -> DataFrame:
    """``doc_id``, ``n_chunk``, ``heading`` and ``text``: lines folded into chunks as in ``chunks``, and a heading begins a new chunk.

    A chunk's lines are run on, but for a new line after a heading and after the end of a sentence. The fold is one pass within a document's row.
    """
    lines = F.transform(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), lambda x: F.struct(x.alias("text"), is_heading(x).alias("head")))
    piece = lambda x: F.concat(x["text"], F.when(x["head"] | x["text"].rlike(r"[.!?]\z"), "\n").otherwise(""))
    chunk = lambda acc: F.struct(acc["heading"].alias("heading"), acc["text"].alias("text"))
    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("heading"), F.array().cast("array<struct<heading:string,text:string>>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["size"] > 0) & (x["head"] | ((acc["size"] + F.length(x["text"]) > most) & (acc["size"] >= least)))
        return F.struct(
            F.when(full, piece(x)).otherwise(F.concat(acc["text"], piece(x))).alias("text"),
            (F.when(full, 0).otherwise(acc["size"]) + F.length(x["text"])).alias("size"),
            F.when(x["head"], x["text"]).otherwise(acc["heading"]).alias("heading"),
            F.when(full, F.array_append(acc["done"], chunk(acc))).otherwise(acc["done"]).alias("done"),
        )

    folded = F.aggregate(lines, zero, step, lambda acc: F.when(acc["size"] > 0, F.array_append(acc["done"], chunk(acc))).otherwise(acc["done"]))
    return docs.select("doc_id", F.posexplode(folded).alias("n_chunk", "c")).select("doc_id", "n_chunk", "c.heading", "c.text")
