"""The corpus pipeline: documents in, packed training sequences out.

Five stages, each one operator of ``costwise.llm``; a stage's result is
written as Parquet and read again as the next one's documents. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costwise.llm import langid, line_dedup, mixing, near_dedup, packing
from costwise.llm.common import WORD_REGEX, id_text, stage

#: Documents below this posterior are of no learned language for certain.
MIN_SCORE = 0.5


def _like(docs: DataFrame, columns: list[str], rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`").cast(docs.schema[c].dataType).alias(c) for c in columns])


def _resized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where the table has it."""
    return docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in docs.columns else docs


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (naive Bayes over character n-grams, fitted on the labelled rows that are not held out).

    Rejects documents without a letter or text and those whose language is
    uncertain (posterior below ``MIN_SCORE``). Every language is kept; ``lang``
    takes the prediction where the label is null. Rows are judged one by one,
    so repeated rows and null ids need no rule.
    """
    columns = docs.columns
    model = langid.fit(docs.filter(~langid.held_out()))
    sent = [F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")]
    judged = langid.predict(docs, model, keep=sent)
    kept = judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    rows = kept.select(*[F.col("_row").getField(c).alias(c) if c != "lang" else F.coalesce(F.col("_row").getField(c), F.col("lang_pred")).alias(c) for c in columns])
    return _like(docs, columns, rows)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated lines leave all documents but the last; documents that had text and lost all of it go."""
    cut = line_dedup.dedup_lines(docs)
    rest = cut.filter((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    return _resized(_like(docs, docs.columns, rest))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (five words, similarity 0.8): one row of each group stays.

    Groups are made of texts alone, each named by its SHA-256, so rows that
    repeat an id and rows with a null id are judged by their own texts. The
    row with the smallest doc_id stays, of equal ids the first by text; a null
    id only where no member has an id. Texts without words are in no group:
    they stay once per id and text.
    """
    key = F.coalesce(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), F.lit(b"")).alias("_key")
    judged = near_dedup.near_duplicates(docs.select(key, "text"), "_key", id_type="binary")
    texts = judged.select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_group"), (F.col("n_shingles") > 0).alias("_words")).distinct()
    texts = stage(texts.join(docs.select(key, F.col("doc_id").cast("long").alias("_id")).groupBy("_key").agg(F.min("_id").alias("_least")), "_key"), "near-texts")
    least = texts.filter("_words").groupBy("_group").agg(F.min("_least").alias("_kept"))
    of_groups = texts.filter("_words").join(least, "_group").filter(F.col("_least").eqNullSafe(F.col("_kept"))).select("_key", id_text(F.col("_kept")).alias("_id"), "_group", F.lit("").alias("_alone"))
    rows = docs.select(key, id_text(F.col("doc_id").cast("long")).alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))  # names cannot clash
    alone = rows.select("_key", "_id").join(texts.filter("NOT _words").select("_key", "_group"), "_key").select("_key", "_id", "_group", F.col("_id").alias("_alone")).distinct()
    again = Window.partitionBy("_group", "_alone").orderBy("_row.text")
    kept = rows.join(of_groups.unionByName(alone), ["_key", "_id"]).withColumn("_place", F.row_number().over(again)).filter("_place = 1")
    return _like(docs, docs.columns, kept.select("_row.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: a document appears once per full pass, and its stretch of words once more.

    The stretch starts at word ``first`` and goes on from the document's start
    if it reaches the end; its words are joined by one blank. Documents of
    which the mix takes no word go, also those without words. Rows that repeat
    an id are matched with their shares by source and size.
    """
    count = F.coalesce(F.regexp_count("text", F.lit(WORD_REGEX)), F.lit(0))
    same_id = Window.partitionBy("_id").orderBy("_source", "_size", "_tie")
    shares = mixing.mix_sources(docs).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), (F.col("taken") * 8 + F.col("whole")).alias("_tie"), "size", "taken", "first", "whole")
    shares = shares.withColumn("_n", F.row_number().over(same_id)).filter("taken > 0").select(F.col("_id").alias("_share_id"), F.col("_n").alias("_share_n"), "size", "taken", "first", "whole")
    mine = [F.col(f"`{c}`").alias(f"_d_{c}") for c in docs.columns]
    rows = docs.select(*mine, F.col("doc_id").alias("_id"), F.col("source").alias("_source"), count.cast("long").alias("_size"), F.xxhash64("text").alias("_tie")).withColumn("_n", F.row_number().over(same_id))
    rows = rows.join(shares, F.col("_id").eqNullSafe(F.col("_share_id")) & (F.col("_n") == F.col("_share_n")))
    words = F.regexp_extract_all("_d_text", F.lit(WORD_REGEX), F.lit(0))
    n = (F.col("taken") - F.col("whole") * F.col("size")).cast("int")
    begin = F.col("first").cast("int")
    stretch = F.concat(F.slice(words, begin + 1, n), F.slice(words, 1, F.greatest(F.lit(0), begin + n - F.col("size").cast("int"))))
    copies = F.concat(
        F.array_repeat(F.col("_d_text"), F.col("whole").cast("int")),
        F.when(n > 0, F.array(F.array_join(stretch, " "))).otherwise(F.array().cast("array<string>")),
    )
    dealt = rows.withColumn("_d_text", F.explode(copies))
    return _resized(_like(docs, docs.columns, dealt.select(*[F.col(f"`_d_{c}`").alias(c) for c in docs.columns])))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 1024 tokens; one row per piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mix_sources", mix),
    ("pack", pack),
]

#: Naive Bayes, sketches and byte-pair encoding are beyond SQL; tests/llm/test_pipeline.py has a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
