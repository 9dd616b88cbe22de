"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only).

1. Targets: sources in code-point order (null last) get repeating weights and share the budget; a
   source stops at ``max_repeats`` times its size and the excess is shared again by weight. That is
   water-filling, solved in closed form: with sources sorted by cap/weight, the level is the maximum
   over k of (budget - caps before k) / (weights from k on).
2. The mix is dealt in blocks of ``block_tokens`` words. Sources get whole blocks by Sainte-Laguë
   (highest quotients target / (2k+1)); the blocks of a source then go to its shards, again by
   Sainte-Laguë over the shards' sizes. Both are computed by rounding at the common divisor and then
   handing out or taking back the few seats that are left by highest quotient, which is the same
   apportionment without walking seat by seat. Sources too small for whole blocks (fewer than ``precision`` for
   a shard) are apportioned among themselves in blocks of one word, so that they change no other source's blocks.
3. A source with n documents has ceil(sqrt(n)) shards of about sqrt(n) documents, so that neither the
   window over a source's shards nor that over a shard's documents gathers a large source in a task.
   Within a shard the documents lie on a line in seeded order. The shard's quota covers it in whole
   passes, and the rest is a run of blocks from a seeded block on, wrapping around.

Empty and null texts have size 0 and take 0. Null sources are one source, the last. Repeated rows are
rows of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, durable, free_name, table


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hex_number(digest: Column, start: int) -> Column:
    """Eight hex digits as a number, the same in every SQL engine."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights=(5, 2, 1), share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """sources (source, source_size) with sid (1, 2, ...), weight, cap and target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("sid", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        ranked.withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("target", F.least(F.col("cap"), F.col("weight") * F.max("level").over(everything)))
        .drop("budget", "level")
    )


def sainte_lague(df: DataFrame, seats: Column, claim: str, group: list[str], key: str, out: str) -> DataFrame:
    """df with ``out``: how many of ``seats`` (constant in a group) each row gets by its ``claim``.

    Ties go to the smaller ``key``. Starting from the seats that rounding at the divisor
    sum(claim)/seats gives, at most (left + rows) * claim / sum(claim) + 1 seats of a row can change,
    which bounds the quotients to look at to a few times the number of rows.
    """
    w = Window.partitionBy(*group)
    first = (
        df.withColumn("_seats", seats)
        .withColumn("_sum", F.sum(claim).over(w))
        .withColumn("_rows", F.count(F.lit(1)).over(w))
        .withColumn("_share", F.when(F.col("_sum") > 0, F.col(claim) / F.col("_sum")).otherwise(F.lit(0.0)))
        .withColumn("_base", F.floor(F.col("_share") * F.col("_seats") + 0.5).cast("long"))
        .withColumn("_left", F.col("_seats") - F.sum("_base").over(w))
        .withColumn("_reach", F.ceil((F.abs("_left") + F.col("_rows")) * F.col("_share")).cast("long") + 1)
    )
    giving = F.col("_left") > 0
    steps = first.select(
        *group, key, claim, "_base", "_left",
        F.explode(F.when(F.col("_left") == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_reach")))).alias("_j"),
    ).filter(giving & (F.col(claim) > 0) | ~giving & (F.col("_j") < F.col("_base")))
    divisor = F.when(giving, 2 * (F.col("_base") + F.col("_j")) + 1).otherwise(2 * (F.col("_base") - F.col("_j")) - 1)
    quotient = F.col(claim).cast("double") / divisor
    changed = (
        steps.withColumn("_q", F.when(giving, -quotient).otherwise(quotient))
        .withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy("_q", F.when(giving, F.col(key)).otherwise(-F.col(key)))))
        .filter(F.col("_place") <= F.abs("_left"))
        .groupBy(*group, key)
        .agg(F.sum(F.signum("_left")).cast("long").alias("_delta"))
    )
    return (
        first.join(changed, [*group, key], "left")
        .withColumn(out, F.col("_base") + F.coalesce("_delta", F.lit(0).cast("long")))
        .drop("_seats", "_sum", "_rows", "_share", "_base", "_left", "_reach", "_delta")
    )


def mix(
    docs: DataFrame, weights=(5, 2, 1), share: float = 1.0, max_repeats: int = 3, block_tokens: int | None = None, seed: int = 42, precision: int = 100
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): the words that the mix takes of each row of docs.

    docs needs doc_id, text and source. block_tokens: words in a block; by default the largest number
    up to 1024 for which all targets together hold ``precision`` blocks for each shard, 1 at least.
    """
    rows = durable(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.coalesce("text", F.lit("")).alias("t")).select(
            "doc_id", "source", "size",
            F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5("t")).cast("binary")).alias("digest"),
        ),
        "mix-sizes",
    )
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, share, max_repeats)
    sources = sources.withColumn("shards", F.ceil(F.sqrt("n")).cast("long"))
    in_order = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # sums of doubles: always in the same order
    fit = F.coalesce(F.floor(F.sum("target").over(in_order) / (F.sum("shards").over(in_order) * precision)), F.lit(1))
    block = F.lit(block_tokens) if block_tokens else F.least(F.lit(1024), F.greatest(F.lit(1), fit))
    sources = sources.withColumn("block", block.cast("long"))
    sources = sources.withColumn("block", F.when(F.col("target") >= F.col("block") * F.col("shards") * precision, F.col("block")).otherwise(F.lit(1).cast("long")))
    of_block = Window.partitionBy("block").orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seats = F.floor(F.sum("target").over(of_block) / F.col("block") + 0.5).cast("long")
    sources = durable(sainte_lague(sources, seats, "target", ["block"], "sid", "blocks"), "mix-sources")

    dealt = rows.join(sources.select(F.col("source").alias("_source"), "sid", "shards"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumn("shard", F.pmod(_hex_number(F.col("digest"), 1), F.col("shards"))).drop("shards")
    shards = dealt.groupBy("sid", "shard").agg(F.sum("size").alias("length"))
    shards = shards.join(sources.select("sid", "source_size", "target", "block", "blocks"), "sid")
    shards = sainte_lague(shards, F.col("blocks"), "length", ["sid"], "shard", "quota")
    begin = F.md5(F.concat_ws(":", F.lit(str(seed + 1)), "sid", "shard").cast("binary"))
    plan = (
        shards.withColumn("words", F.least(F.col("quota") * F.col("block"), F.col("length") * max_repeats))
        .withColumn("passes", F.when(F.col("length") > 0, F.floor(F.col("words") / F.col("length"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("words") - F.col("passes") * F.col("length"))
        .withColumn("first", F.pmod(_hex_number(begin, 1), F.greatest(F.lit(1), F.ceil(F.col("length") / F.col("block")))) * F.col("block"))
        .select("sid", "shard", "source_size", "target", "length", "passes", "rest", F.col("first").cast("long").alias("first"))
    )
    line = Window.partitionBy("sid", "shard").orderBy("digest", "doc_id", "size")
    placed = dealt.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("start", F.col("end") - F.col("size"))

    def covered(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(F.col("end"), high) - F.greatest(F.col("start"), low))

    stop = F.col("first") + F.col("rest")
    taken = F.col("passes") * F.col("size") + covered(F.col("first"), F.least(stop, F.col("length"))) + covered(F.lit(0).cast("long"), stop - F.col("length"))
    return placed.join(plan, ["sid", "shard"]).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as the mix takes them: each as often as its words were taken, rounded to whole documents.

    Rows without words stay as they are, once. Rows that share a doc_id (or have none) share its counts: each stays as often as all of
    them together were taken of their words.
    """
    one, times = free_name("mix_id", docs), free_name("mix_times", docs)
    counts = (
        mix(docs.select("doc_id", "text", "source"), **options)
        .groupBy(F.col("doc_id").alias(one))
        .agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
        .select(one, F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int").alias(times))
        .filter(F.col(times) > 0)
    )
    joined = docs.join(counts, docs["doc_id"].eqNullSafe(counts[one]))
    copies = joined.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return copies.drop(one, times)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, ''))) AS digest
  FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source
), s1 AS (
  SELECT *, CAST(CASE (sid - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap, CAST(ceil(sqrt(n)) AS BIGINT) AS shards FROM s0
), s2 AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s1
), s3 AS (
  SELECT *, least(cap, weight * max(level) OVER ()) AS target FROM s2
), s4 AS (
  SELECT *, CAST(least(1024, greatest(1, floor(sum(target) OVER () / (sum(shards) OVER () * 100)))) AS BIGINT) AS big FROM s3
), s5 AS (
  SELECT *, CASE WHEN target >= big * shards * 100 THEN big ELSE 1 END AS block FROM s4
), s6 AS (
  SELECT *, sum(target) OVER w AS whole, count(*) OVER w AS srcs, CAST(floor(sum(target) OVER w / block + 0.5) AS BIGINT) AS seats FROM s5 WINDOW w AS (PARTITION BY block)
), q AS (
  SELECT sid, block, target / (2 * k + 1) AS quotient, seats FROM s6, range(CAST(ceil(target / whole * (seats + srcs)) + 2 AS BIGINT)) r(k) WHERE target > 0
), won AS (
  SELECT sid, count(*) AS blocks FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY quotient DESC, sid) AS place FROM q) WHERE place <= seats GROUP BY sid
), s AS (
  SELECT s6.*, coalesce(blocks, 0) AS blocks FROM s6 LEFT JOIN won USING (sid)
), dealt AS (
  SELECT doc_id, size, digest, sid, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % shards AS shard FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), h0 AS (
  SELECT sid, shard, CAST(sum(size) AS BIGINT) AS length FROM dealt GROUP BY ALL
), h1 AS (
  SELECT *, sum(length) OVER (PARTITION BY sid) AS total, count(*) OVER (PARTITION BY sid) AS shard_count FROM h0
), hq AS (
  SELECT sid, shard, blocks, CAST(length AS DOUBLE) / (2 * k + 1) AS quotient FROM h1 JOIN s USING (sid), range(CAST(ceil(length / total * (blocks + shard_count)) + 2 AS BIGINT)) r(k) WHERE length > 0
), hw AS (
  SELECT sid, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY quotient DESC, shard) AS place FROM hq) WHERE place <= blocks GROUP BY ALL
), plan AS (
  SELECT h1.sid, h1.shard, length, least(coalesce(quota, 0) * block, length * 3) AS words, source, source_size, target,
    (CAST('0x' || substr(md5('43:' || h1.sid || ':' || h1.shard), 1, 8) AS BIGINT) % greatest(1, CAST(ceil(length / block) AS BIGINT))) * block AS first
  FROM h1 JOIN s USING (sid) LEFT JOIN hw ON hw.sid = h1.sid AND hw.shard = h1.shard
), line AS (
  SELECT *, sum(size) OVER (PARTITION BY sid, shard ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING) AS stop FROM dealt
), placed AS (
  SELECT doc_id, source, size, source_size, target, length, first, stop, stop - size AS start, CASE WHEN length > 0 THEN words // length ELSE 0 END AS passes, words - CASE WHEN length > 0 THEN words // length ELSE 0 END * length AS rest
  FROM line JOIN plan USING (sid, shard)
)
SELECT doc_id, source, size, source_size, target, CAST(passes * size + greatest(0, least(stop, least(first + rest, length)) - greatest(start, first)) + greatest(0, least(stop, first + rest - length) - greatest(start, 0)) AS BIGINT) AS taken
FROM placed
"""
