"""A corpus pipeline of five stages over ``documents``; each works on what the stage before kept.

1. toxicity: documents that the model rejects (score of 0.5 or more) go.
2. near_duplicates: of each group of texts that links of five-word similarity 0.8 or more reach, met by SimHash blocks, one row stays:
   that of least id.
3. decontamination: documents with a copied or edited benchmark passage go.
4. personal_data: spans of personal data are replaced by their kind.
5. tokens: a row per document with the number of ids and digests of ids and decoded text.

All but the last return the columns of ``documents``. Rows are told apart by id and text, never by id alone: rows with
a null id are kept or dropped by their text; further columns, whatever their names, keep their values; in a group of near-duplicates a row with an id goes before one without,
and of rows of one id that of least digest; different texts of one id stay if they aren't near-duplicates.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.llm import bpe, decontam, pii, simhash, toxicity
from quillspan.llm.archives import located
from quillspan.llm.queries import VOCABULARY
from quillspan.llm.rows import digest_of, shared_if_small
from quillspan.session import cut, shared_dir, ship, table


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``digest`` (of the text) and ``given``, the whole row, so that no column meets one of a stage's own, whatever it is called."""
    whole = F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns])
    return docs.select(docs["doc_id"].alias("doc_id"), digest_of(docs["text"]).alias("digest"), whole.alias("given"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that ``packed`` packed."""
    return rows.select(*[F.col("given").getField(c).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = packed(docs).withColumn("text", F.col("given").getField("text"))
    return unpacked(toxicity.score(rows, model, keep=("given",)).where("score < 0.5"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = packed(docs)
    texts = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n_rows"))
    texts = cut(texts.join(simhash.similar_texts(docs), "digest", "left").withColumn("root", F.coalesce("root", "digest")))
    first = texts.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "digest")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    decided = texts.join(first, "root").select(F.col("doc_id").alias("id"), F.col("digest").alias("same"), stays.alias("stays"), "n_rows")
    decided = cut(decided.where("NOT stays OR n_rows > 1").drop("n_rows"))
    joined = rows.join(shared_if_small(decided), rows["doc_id"].eqNullSafe(F.col("id")) & (rows["digest"] == F.col("same")), "left")
    line = Window.partitionBy("doc_id", "digest").orderBy(F.xxhash64("given"))
    again = joined.where("stays").withColumn("n", F.row_number().over(line)).where("n = 1")
    return unpacked(joined.where("stays IS NULL").select("given").unionByName(again.select("given")), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = packed(docs)
    texts = docs.select(digest_of(docs["text"]).alias("doc_id"), docs["text"].alias("text"))
    hit = cut(decontam.contaminated(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("hit")).distinct())
    return unpacked(rows.join(shared_if_small(hit), rows["digest"] == hit["hit"], "left_anti"), docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def count_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.digest(docs, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", hide_personal_data),
    ("tokens", count_tokens),
]

#: Learnt models, components and alignments aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again. The folder goes when the last is done."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{n}")
            docs = spark.read.parquet(f"{folder}/{n}")
    done = cut(docs)
    system, path = located(folder)
    system.delete_dir(path)
    return done
