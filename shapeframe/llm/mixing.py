"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame functions only).

1. Each source's target: its weight's part of ``share`` times all words; what a source has above ``cap`` times
   its own size is dealt again by weight (water filling, solved in closed form over the sorted sources).
2. The mix is cut into blocks of ``block`` words. Blocks go to sources, and then to each source's shards, by the
   highest quotients weight / (2k - 1): integer quotas, which add up.
3. A shard lines up its documents in seeded order; its words form a circle of blocks. From a seeded block on, it
   takes as many blocks as its quota says, around the circle at most ``cap`` times, so no document is taken more
   than ``cap`` times.

4. Quotas are whole blocks, and a shard's last block may be partial: where a shard cannot take more than ``cap`` times its
   words, and where a source's blocks aren't its target to the word, the difference goes to (or comes from) its shards in
   order. So each source takes its target, rounded to a word, however few words it has.

``ranges`` tells which words of a document the mix takes: (start, stop) for each time around the circle.

A source has one shard per ``shard_words`` words up to ``max_shards``; a hot source so spreads over many tasks, and a
shard's window holds only (hash, id, size) rows, and the carried columns. Shards are a small table; sources too, unless
they are domains (their windows then still hold one narrow row for each). Documents are shuffled once, without their
text unless it is carried.

Edge cases: null or empty text has size 0 and takes 0; a null source is a source, ordered last; null ids sort first
within a shard; rows equal in id and source are dealt separately, in order of size; no documents give no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, words


#: Columns of the result; a carried column of such a name gets an underscore.
RESULT = ("doc_id", "source", "size", "source_size", "target", "taken", "ranges", "shard")


def _hash(*parts: Column | str) -> Column:
    """A non-negative 32-bit number from the seed and what follows."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def apportion(parties: DataFrame, group: list[str], weight: str, seats: str, order: list[Column], out: str) -> DataFrame:
    """Adds Sainte-Lague seats: in each group, ``seats`` (equal in all its rows) go one by one to the highest weight / (2k - 1).

    With S parties and N seats, divisors total / (N - S/2) and total / (N + S/2) bound each party's seats from both
    sides, so only O(S) quotients are compared, whatever N is.
    """
    every = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    total, half = F.sum(weight).over(every), F.count("*").over(every) / 2
    p = parties.withColumn("_total", total).withColumn("_half", half)
    exact = lambda n: F.when(F.col("_total") > 0, F.col(weight) * n / F.col("_total")).otherwise(F.lit(0.0))
    p = p.withColumn("_low", F.greatest(F.lit(0), F.ceil(exact(F.col(seats) - F.col("_half")) - 0.5) - 1).cast("long"))
    p = p.withColumn("_high", F.greatest(F.col("_low"), F.floor(exact(F.col(seats) + F.col("_half")) + 0.5) + 1).cast("long"))
    p = p.withColumn("_left", F.col(seats) - F.sum("_low").over(every))
    q = p.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_high") - F.col("_low"))))
    quotient = F.when(F.col("_k") > 0, F.col(weight) / (2 * (F.col("_low") + F.col("_k")) - 1))
    q = q.withColumn("_quotient", quotient)
    rank = F.row_number().over(every.orderBy(F.col("_quotient").desc_nulls_last(), *order))
    q = q.withColumn("_won", ((F.col("_k") > 0) & (F.col("_quotient") > 0) & (rank <= F.col("_left"))).cast("long"))
    keep = [c for c in parties.columns]
    return q.groupBy(*keep).agg((F.max("_low") + F.sum("_won")).alias(out))


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """sources: (source, source_size). Adds weight and target."""
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    every = Window.partitionBy(F.lit(0))
    s = s.withColumn("_most", F.lit(float(cap)) * F.col("source_size")).withColumn("_ratio", F.col("_most") / F.col("weight"))
    by_ratio = every.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_rank", F.row_number().over(by_ratio))
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("_most").over(before), F.lit(0.0))
    shared = F.sum("weight").over(every) - F.sum("weight").over(onward) + F.col("weight")
    s = s.withColumn("_level", left / shared)
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_rank", "_level"))).over(every)["_level"]
    s = s.withColumn("target", F.least(F.col("_most"), F.coalesce(first * F.col("weight"), F.col("_most"))))
    return s.select("source", "source_size", "weight", "target")


def mix_sources(
    documents: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    block: int = 32,
    seed: str = "mix",
    shard_words: int = 50_000,
    max_shards: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, ranges, shard, and the carried columns."""
    whole = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    sized = cut(whole.select("doc_id", "source", "size"))
    sources = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap))
    sources = sources.withColumn("_shards", F.least(F.lit(max_shards), F.greatest(F.lit(1), F.floor(F.col("source_size") / shard_words))).cast("long"))
    s = sources.withColumnRenamed("source", "_source")
    s = small(s)

    def shard_of(rows: DataFrame) -> DataFrame:
        d = rows.join(s, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight")
        d = d.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("~")))))
        return d.withColumn("shard", F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") % F.col("_shards"))

    shards = shard_of(sized).groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("target").alias("target"))
    seats = sources.withColumn("_seats", F.floor(F.sum("target").over(Window.partitionBy(F.lit(0))) / block + 0.5).cast("long"))
    won = apportion(seats, [], "target", "_seats", [F.col("source").asc_nulls_last()], "blocks").select(F.col("source").alias("_source"), "blocks")
    shards = shards.join(small(cut(won)), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    quotas = apportion(shards, ["source"], "shard_size", "blocks", [F.col("shard")], "_quota")
    start = (_hash(seed, F.col("source"), F.col("shard")) % F.greatest(F.lit(1), F.floor(F.col("shard_size") / block))) * block
    # Blocks to words: what a source misses goes to shards with room, what it has too much comes from its shards, in order.
    room = F.floor(F.lit(float(cap)) * F.col("shard_size")).cast("long")
    quotas = quotas.withColumn("_take", F.least(F.col("_quota") * block, room)).withColumn("_room", room - F.col("_take"))
    of_source = Window.partitionBy("source")
    before = of_source.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    missing = F.floor(F.col("target") + 0.5).cast("long") - F.sum("_take").over(of_source)
    quotas = quotas.withColumn("_missing", missing)
    quotas = quotas.withColumn("_more", F.greatest(F.lit(0), F.least(F.col("_room"), F.col("_missing") - F.coalesce(F.sum("_room").over(before), F.lit(0)))))
    quotas = quotas.withColumn("_less", F.greatest(F.lit(0), F.least(F.col("_take"), -F.col("_missing") - F.coalesce(F.sum("_take").over(before), F.lit(0)))))
    quotas = quotas.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", (F.col("_take") + F.col("_more") - F.col("_less")).cast("long").alias("_take"), start.cast("long").alias("_start"))
    dealt = shard_of(whole if carry else sized).join(small(cut(quotas)), F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))

    line = Window.partitionBy("source", "shard").orderBy("_h", F.col("doc_id").asc_nulls_first(), "size")
    dealt = dealt.withColumn("_end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    stop, laps = F.col("_start") + F.col("_take"), []
    for lap in range(int(cap) + 1):
        a = F.col("_end") - F.col("size") + lap * F.col("shard_size")
        laps.append(F.struct(F.greatest(F.col("_start") - a, F.lit(0)).cast("long").alias("start"), F.least(stop - a, F.col("size")).cast("long").alias("stop")))
    ranges = F.filter(F.array(*laps), lambda r: r["start"] < r["stop"])
    taken = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    dealt = dealt.withColumn("ranges", ranges)
    return dealt.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "ranges", "shard", *[F.col(f"_carry_{c}").alias(f"{c}_" if c in RESULT else c) for c in carry])


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1] AS weight FROM src),
ratio AS (SELECT *, 2.0::DOUBLE * source_size AS most, (2.0::DOUBLE * source_size) / weight AS ratio FROM weighed),
level AS (SELECT *, row_number() OVER w AS rank,
    (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / (sum(weight) OVER () - sum(weight) OVER (w ROWS UNBOUNDED PRECEDING) + weight) AS level
    FROM ratio WINDOW w AS (ORDER BY ratio, source ASC NULLS LAST)),
target AS (SELECT source, source_size, least(most, coalesce((arg_min(level, rank) FILTER (WHERE level <= ratio) OVER ()) * weight, most)) AS target FROM level),
seats AS (SELECT *, floor(sum(target) OVER () / 32 + 0.5)::BIGINT AS n, sum(target) OVER () AS total, (count(*) OVER ()) / 2 AS half FROM target),
bounds AS (SELECT *, greatest(0, ceil(CASE WHEN total > 0 THEN target * (n - half) / total ELSE 0 END - 0.5) - 1)::BIGINT AS low,
    floor(CASE WHEN total > 0 THEN target * (n + half) / total ELSE 0 END + 0.5)::BIGINT + 1 AS high FROM seats),
quot AS (SELECT *, target / (2 * k - 1) AS quotient, n - sum(low) OVER () AS remaining FROM bounds LEFT JOIN LATERAL (SELECT unnest(generate_series(low + 1, greatest(low, high))) AS k) ON true),
left_over AS (SELECT *, (SELECT max(n) - sum(low) FROM bounds) AS rest FROM (SELECT * EXCLUDE (remaining) FROM quot)),
ranked AS (SELECT *, (quotient > 0 AND row_number() OVER (ORDER BY quotient DESC NULLS LAST, source ASC NULLS LAST) <= rest)::BIGINT AS won FROM left_over),
blocks AS (SELECT source, (max(low) + sum(won))::BIGINT AS blocks FROM ranked GROUP BY source),
dealt AS (SELECT s.*, t.source_size, t.target, md5('mix:' || coalesce(s.doc_id::VARCHAR, '~')) AS h,
    ('0x' || md5('mix:' || coalesce(s.doc_id::VARCHAR, '~'))[1:8])::BIGINT % least(4096, greatest(1, floor(t.source_size / 50000)))::BIGINT AS shard
    FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source),
shards AS (SELECT d.source, d.shard, sum(d.size)::BIGINT AS shard_size, max(b.blocks) AS blocks FROM dealt d JOIN blocks b ON d.source IS NOT DISTINCT FROM b.source GROUP BY d.source, d.shard),
sbounds AS (SELECT *, greatest(0, ceil(CASE WHEN total > 0 THEN shard_size * (blocks - half) / total ELSE 0 END - 0.5) - 1)::BIGINT AS low,
    floor(CASE WHEN total > 0 THEN shard_size * (blocks + half) / total ELSE 0 END + 0.5)::BIGINT + 1 AS high
    FROM (SELECT *, (sum(shard_size) OVER (PARTITION BY source))::DOUBLE AS total, (count(*) OVER (PARTITION BY source)) / 2 AS half FROM shards)),
srest AS (SELECT *, blocks - sum(low) OVER (PARTITION BY source) AS rest FROM sbounds),
squot AS (SELECT *, shard_size / (2 * k - 1) AS quotient FROM srest LEFT JOIN LATERAL (SELECT unnest(generate_series(low + 1, greatest(low, high))) AS k) ON true),
swon AS (SELECT *, (quotient > 0 AND row_number() OVER (PARTITION BY source ORDER BY quotient DESC NULLS LAST, shard) <= rest)::BIGINT AS won FROM squot),
quota AS (SELECT source, shard, max(shard_size) AS shard_size, least((max(low) + sum(won))::BIGINT * 32, floor(2.0 * max(shard_size))::BIGINT) AS take, floor(2.0 * max(shard_size))::BIGINT AS most,
    (('0x' || md5('mix:' || coalesce(source, '~') || ':' || shard::VARCHAR)[1:8])::BIGINT % greatest(1, floor(max(shard_size) / 32))::BIGINT) * 32 AS start FROM swon GROUP BY source, shard),
missed AS (SELECT q.*, floor(t.target + 0.5)::BIGINT - sum(take) OVER (PARTITION BY q.source) AS missing,
    coalesce(sum(most - take) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room_before, coalesce(sum(take) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS take_before
    FROM quota q JOIN target t ON q.source IS NOT DISTINCT FROM t.source WINDOW w AS (PARTITION BY q.source ORDER BY shard)),
exact AS (SELECT source, shard, shard_size, start, take + greatest(0, least(most - take, missing - room_before)) - greatest(0, least(take, -missing - take_before)) AS take FROM missed),
lined AS (SELECT d.*, q.shard_size, q.take, q.start, sum(d.size) OVER (PARTITION BY d.source, d.shard ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS stop
    FROM dealt d JOIN exact q ON d.source IS NOT DISTINCT FROM q.source AND d.shard = q.shard)
SELECT doc_id, size, source_size, target,
    (greatest(0, least(start + take, stop) - greatest(start, stop - size)) + greatest(0, least(start + take, stop + shard_size) - greatest(start, stop - size + shard_size))
    + greatest(0, least(start + take, stop + 2 * shard_size) - greatest(start, stop - size + 2 * shard_size)))::BIGINT AS taken
FROM lined
"""
