"""Exact dedup by skew-safe combining.

Three stages, each of which compares the full content, never only a digest:

1. locally, every map task merges its own equal texts (the partial half of a
   grouping by digest, salt and content), so that a task sends one row per
   text whatever the number of copies it read;
2. salted groups (digest, salt, content) merge what the tasks of one salt
   sent, which spreads a text that every task holds over ``salts`` reducers;
3. the salt winners (at most ``salts`` rows per text) merge globally.

Stage 1 also writes the narrow facts of every row (id, length, digest, a hash of
the original text). These look up their group by the digest alone, which is
exact wherever a digest stands for one content; rows of digests that stand for
several contents (found in stage 3) are looked up by digest and content. Groups
that hold a large share of all rows are few; they are broadcast, so that their
members stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costwise.llm.common import WHITE_REGEX, stage


#: Groups that hold this share of all rows, and at least so many, are broadcast: at most its inverse of them (200 bytes each).
HOT_SHARE, HOT_ROWS = 1e-3, 1000
#: Copies of one row that one task writes out.
_CUT = 1 << 16


def _base(docs: DataFrame, id_col: str, text_col: str, digest_hex: int) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    norm = F.regexp_replace(text, WHITE_REGEX, "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.char_length(text).cast("long").alias("n_chars"), F.xxhash64(text).alias("tie"), norm.alias("norm")).select(
        "doc_id", "n_chars", "tie", "norm", F.substring(F.sha2(F.col("norm").cast("binary"), 256), 1, digest_hex).alias("digest")
    )


def _rank():
    """Longest first, then the smallest id (null last), as one number of fixed width, so that groupings hash and never sort."""
    wide = "decimal(38,0)"
    place = F.coalesce(F.lit(str(1 << 63)).cast(wide) - F.col("doc_id").cast(wide), F.lit(0).cast(wide))  # 1 to 2^64, 0 for null
    return (F.col("n_chars").cast("decimal(12,0)") * F.lit(str(1 << 65)).cast("decimal(21,0)") + place).cast(wide)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8, digest_hex: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after deleting white space
    (U+0020, U+0009-U+000D). Exactly one row of each group is kept: that with
    the most code points in its original text; of those the smallest doc_id
    (null after every other); of those one by a hash of the original text, and
    of rows equal in id and text any one. A null text counts as empty; a group
    of null ids alone has a null ``keep_id`` and one kept row all the same.
    Every row counts in ``group_size``. An empty table gives no rows; other
    columns are ignored. ``digest_hex`` shortens the digest for tests of
    collisions.
    """
    base = _base(docs, id_col, text_col, digest_hex)
    rank = _rank()
    salted = (
        base.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "salt", "norm")
        .agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("n"))
    )
    contents = salted.groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    full = F.sha2(F.col("norm").cast("binary"), 256)
    per_digest = stage(
        contents.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.max("best").alias("best"), F.sum("n").alias("group_size"), F.max(full).alias("text_sha256")), "dedup-groups"
    )
    rows = stage(base.select("doc_id", "tie", "digest", rank.alias("rank")), "dedup-rows")
    facts = ["doc_id", "tie", "digest", "rank", "best", "group_size", "text_sha256"]
    clean = per_digest.filter("contents = 1").drop("contents")
    hot_rows = max(HOT_ROWS, int(rows.count() * HOT_SHARE))
    hot = clean.filter(F.col("group_size") >= hot_rows)
    met = rows.join(clean.filter(F.col("group_size") < hot_rows), "digest").select(*facts).unionByName(rows.join(F.broadcast(hot), "digest").select(*facts))
    collided = per_digest.filter("contents > 1").select("digest")
    if collided.limit(1).count():  # two texts under one digest: look up by content
        exact = contents.join(collided, "digest").select("digest", "norm", "best", F.col("n").alias("group_size"), full.alias("text_sha256"))
        met = met.unionByName(base.withColumn("rank", rank).join(exact, ["digest", "norm"]).select(*facts))
    return _one_kept(met)


def _one_kept(met: DataFrame) -> DataFrame:
    """Marks one row of each group: of the rows of the best rank the one with the smallest hash, of equal ones one."""
    met = stage(met, "dedup-met").withColumn("first", F.col("rank") == F.col("best"))
    out = lambda df, keep_id, kept: df.select("doc_id", keep_id.alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")
    wide = "decimal(38,0)"
    place = F.col("best") % F.lit(str(1 << 65)).cast(wide)  # the rank's last part is the id
    keep_id = F.when(place > 0, (F.lit(str(1 << 63)).cast(wide) - place).cast("long"))
    n_first, n_groups = met.filter("first").agg(F.count(F.lit(1)), F.count_distinct("text_sha256")).first()
    if n_first == n_groups:
        return out(met, keep_id, F.col("first"))
    # some groups have several rows of the best rank: rows of one id (or null), equal but for white space
    firsts = met.filter("first").groupBy("text_sha256", "tie", "doc_id", "best", "group_size").agg(F.count(F.lit(1)).alias("copies"))
    chosen = firsts.groupBy(F.col("text_sha256").alias("_sha")).agg(F.min("tie").alias("_tie"))
    firsts = firsts.join(chosen, F.col("text_sha256") == F.col("_sha")).withColumn("wins", F.col("tie") == F.col("_tie"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {_CUT}"))).alias("_chunk")
    spread = firsts.select("*", chunk).repartition("text_sha256", "tie", "_chunk")
    spread = spread.withColumn("_at", F.explode(F.sequence(F.col("_chunk") * _CUT, F.least((F.col("_chunk") + 1) * _CUT, "copies") - 1)))
    return out(met.filter("NOT first"), keep_id, F.lit(False)).unionByName(out(spread, keep_id, F.col("wins") & (F.col("_at") == 0)))


SQL = r"""
WITH base AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS n
  FROM documents
), ranked AS (
  SELECT doc_id, norm,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM base
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM ranked
"""
