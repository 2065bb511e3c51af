"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources get a target number of tokens by weight; the mix is made of equal
blocks of ``block_tokens`` tokens. Blocks go to the highest quotients
``weight / (2 n + 1)``, twice:

1. to sources, by their targets. The house is the number of blocks for which
   one block is the divisor, so a source's quota is its target over the block
   size, rounded half up: the block of quotient target / (2 n + 1) is in the
   mix exactly when that is at least half a block;
2. within a source to its shards, by the shards' sizes, so that quotas are
   integers that add up to the source's quota. A shard is a hash slice of a
   source's documents; there are about sqrt(tokens) of them, so neither a
   shard's documents nor a source's shards make a large window.

Then a shard strings its documents in seeded order into a ring of tokens,
cuts the ring into blocks from a seeded start and takes the first ``quota``
blocks; going round again repeats a document. All of it is DataFrame and SQL
functions; texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costwise.llm.common import WORD_REGEX, id_text, md5_bits, stage

WEIGHTS = (5, 2, 1)
#: Sources up to which the table of targets (one narrow row each) is broadcast.
BROADCAST_SOURCES = 100_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block_tokens: int = 4, shard_tokens: int = 64) -> DataFrame:
    """One row per source: src, source, source_size, target, quota, n_shards.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes. A target stops at ``most`` times its source's
    size and the excess is shared again by weight: the target is
    min(most * size, weight * level), and the level is the largest of
    (total - caps of the k tightest sources) / (weights of the others).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", "src").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    # one row per source from here on: the windows span the table of sources, not documents
    per = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("src", (F.row_number().over(order) - 1).cast("long"))
        .withColumn("w", w)
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("room", F.col("cap") / F.col("w"))
        .withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("w_all", F.sum("w").over(everything))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(by_room), F.lit(0.0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(by_room), F.lit(0.0)))
        .withColumn("level", F.max((F.col("total") - F.col("caps_before")) / (F.col("w_all") - F.col("w_before"))).over(everything))
        .withColumn("target", F.least(F.col("cap"), F.col("w") * F.col("level")))
    )
    return per.select(
        "src",
        "source",
        "source_size",
        "target",
        F.floor(F.col("target") / block_tokens + 0.5).alias("quota"),
        F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("source_size") / shard_tokens))).cast("long").alias("n_shards"),
    )


def shard_quotas(shards: DataFrame) -> DataFrame:
    """Sainte-Laguë within each source: (src, shard, shard_size, source_size, quota) -> blocks per shard.

    Starting from the rounded shares, the seats still missing (or too many) go
    to (or come from) the highest (lowest) quotients. A shard can gain or lose
    at most about 1 + its size over the mean size, so that many quotients per
    shard are ranked and the result is that of ranking them all.
    """
    share = F.col("quota") * F.col("shard_size") / F.col("source_size")
    n_shards = F.count(F.lit(1)).over(Window.partitionBy("src"))
    near = (
        shards.filter("source_size > 0")
        .withColumn("near", F.floor(share + 0.5))
        .withColumn("reach", F.ceil(F.lit(3) + 2 * F.col("shard_size") * n_shards / F.col("source_size")))
        .withColumn("lack", F.col("quota") - F.sum("near").over(Window.partitionBy("src")))
    )
    seats = near.select(
        "src",
        "shard",
        "shard_size",
        "lack",
        "near",
        F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("near") - F.col("reach")), F.col("near") + F.col("reach"))).alias("seat"),
    ).filter("shard_size > 0")
    best = Window.partitionBy("src").orderBy(F.desc("quotient"), "shard", "seat")
    # the seats below the ranked ones are taken for certain; fill up to the quota from the ranked ones
    ranked = (
        seats.withColumn("quotient", F.col("shard_size") / (2 * F.col("seat") + 1))
        .withColumn("rank", F.row_number().over(best))
        .withColumn("inside", F.sum(F.when(F.col("seat") < F.col("near"), 1).otherwise(0)).over(Window.partitionBy("src")))
        .withColumn("open", F.col("inside") + F.col("lack"))
    )
    return ranked.groupBy("src", "shard").agg(
        (F.min("seat") + F.sum(F.when(F.col("rank") <= F.col("open"), 1).otherwise(0))).alias("blocks")
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    block_tokens: int = 4,
    seed: int = 0,
    shard_tokens: int = 64,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, first, whole.

    ``size`` counts words (null text: 0). ``taken`` is the number of words the
    mix takes from the document, repeats counted: ``whole`` full passes and a
    stretch that starts at word ``first`` (wrapping to word 0 at most once).
    No document gives more than ``most`` (up to a block's rounding: exactly 2)
    times its size. A null source is a source of its own, the last one. Rows
    with equal ids are rows of their own (equal rows are interchangeable); a
    null id is hashed as the empty string. An empty table gives no rows;
    sources without words take none. The same rows and seed give the same mix
    for any partitioning.
    """
    sizes = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_REGEX)), F.lit(0)).cast("long").alias("size"),
        ),
        "mix-sizes",
    )
    per_source = stage(targets(sizes, weights, share, most, block_tokens, shard_tokens), "mix-targets")
    n_sources = per_source.count()
    small = F.broadcast(per_source) if n_sources <= BROADCAST_SOURCES else per_source
    key = id_text(F.col("doc_id"))
    rows = sizes.join(small.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("shard", md5_bits(F.concat(F.lit(f"{seed}:shard:"), key)) % F.col("n_shards")).withColumn(
        "pos", md5_bits(F.concat(F.lit(f"{seed}:order:"), key))
    )
    shards = rows.groupBy("src", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("quota").alias("quota"))
    quotas = shard_quotas(shards)
    ring = Window.partitionBy("src", "shard")
    order = ring.orderBy("pos", "doc_id", "size")
    seat = F.concat(F.lit(f"{seed}:start:"), F.col("src").cast("string"), F.lit(":"), F.col("shard").cast("string"))
    placed = (
        rows.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("length", F.sum("size").over(ring))
        .join(quotas, ["src", "shard"], "left")
        .withColumn("words", F.least(F.coalesce("blocks", F.lit(0)) * block_tokens, F.floor(F.lit(most) * F.col("length"))).cast("long"))
        .withColumn("length1", F.greatest("length", F.lit(1)))
        .withColumn("start", md5_bits(seat) % F.col("length1"))
        .withColumn("whole", F.floor(F.col("words") / F.col("length1")).cast("long"))
        .withColumn("rest", F.col("words") % F.col("length1"))
        .withColumn("begin", F.col("end") - F.col("size"))
    )
    zero = F.lit(0).cast("long")

    def overlap(lo, hi):
        return F.greatest(zero, F.least(F.col("end"), hi) - F.greatest(F.col("begin"), lo))

    stop = F.col("start") + F.col("rest")
    ahead = overlap(F.col("start"), F.least(stop, F.col("length")))
    behind = overlap(zero, F.greatest(zero, stop - F.col("length")))
    return placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + ahead + behind).alias("taken"),
        F.when(ahead > 0, F.greatest(zero, F.col("start") - F.col("begin"))).otherwise(zero).alias("first"),
        "whole",
    )


#: Independent twin: quotients of all seats are ranked, targets are found by sharing the excess again and again.
SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM sizes GROUP BY source
), caps AS (
  SELECT *, [5.0, 2.0, 1.0][1 + src % 3]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM per
), levels AS (
  SELECT 0 AS step, (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE / sum(w) FROM caps) AS level
  UNION ALL
  SELECT step + 1, (SELECT ((SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE FROM caps) - sum(CASE WHEN cap <= w * level THEN cap ELSE 0 END)) / sum(CASE WHEN cap <= w * level THEN 0 ELSE w END) FROM caps)
  FROM levels WHERE step < (SELECT count(*) FROM caps)
), goal AS (
  SELECT *, least(cap, w * (SELECT max(level) FROM levels WHERE NOT isnan(level) AND NOT isinf(level))) AS target FROM caps
), plan AS (
  SELECT *, CAST(floor(target / 4 + 0.5) AS BIGINT) AS quota, greatest(1, CAST(ceil(sqrt(source_size::DOUBLE / 64)) AS BIGINT)) AS n_shards FROM goal
), dealt AS (
  SELECT s.doc_id, s.size, p.*, ('0x' || substr(md5('0:shard:' || coalesce(s.doc_id::VARCHAR, '')), 1, 15))::BIGINT % p.n_shards AS shard,
    ('0x' || substr(md5('0:order:' || coalesce(s.doc_id::VARCHAR, '')), 1, 15))::BIGINT AS pos
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
), shards AS (
  SELECT src, shard, sum(size) AS shard_size, any_value(quota) AS quota FROM dealt GROUP BY src, shard
), seats AS (
  SELECT src, shard, quota, shard_size::DOUBLE / (2 * seat + 1) AS quotient, seat FROM shards, LATERAL (SELECT unnest(range(quota)) AS seat) WHERE shard_size > 0
), won AS (
  SELECT src, shard, count(*) AS blocks FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY quotient DESC, shard, seat) AS r FROM seats) WHERE r <= quota GROUP BY src, shard
), placed AS (
  SELECT d.*, CAST(sum(size) OVER (PARTITION BY d.src, d.shard ORDER BY pos, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fin,
    CAST(sum(size) OVER (PARTITION BY d.src, d.shard) AS BIGINT) AS length, coalesce(w2.blocks, 0) AS blocks,
    ('0x' || substr(md5('0:start:' || d.src || ':' || d.shard), 1, 15))::BIGINT AS h
  FROM dealt d LEFT JOIN won w2 ON d.src = w2.src AND d.shard = w2.shard
), ring AS (
  SELECT *, fin - size AS beg, greatest(length, 1) AS len1, least(blocks * 4, 2 * length) AS words FROM placed
), cut AS (
  SELECT *, h % len1 AS st, words // len1 AS passes, words % len1 AS rest FROM ring
)
SELECT doc_id, size, source_size, target, CAST(passes * size
  + greatest(0, least(fin, least(st + rest, length)) - greatest(beg, st))
  + greatest(0, least(fin, st + rest - length) - beg) AS BIGINT) AS taken
FROM cut
"""
