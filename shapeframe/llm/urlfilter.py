"""URL verdicts: host and path rules, and exact list membership by a Bloom filter cascade (DataFrame functions only).

The cascade's first level encodes the listed keys; the keys of the corpus that wrongly pass it are encoded by the next
level, the listed keys that wrongly pass that one by the third, and so on until nobody wrongly passes. As the levels
were tested against every key of the corpus, a walk down the levels gives exact membership for each of them.

A level is a row of segments of 32,768 bits (built by bitmap_construct_agg over pre-aggregated keys). While a level
has at most ``max_segments`` segments (a proven bound: 4 KB each), it travels to the tasks inside the expression, and
rows are judged without any join. A larger level stays a distributed table: keys meet their segment by a shuffled
join, and rows then meet their key.

Edge cases: a null url, or one without ://, has empty host and path; the empty host is a key like others. Repeated
rows are judged alike. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii

BITS = 32768
Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_after(url), r"^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substr(url, at + 3))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule, as host + path, and its verdict; nulls if none fits."""
    name, verdict = F, F
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = name.when(fits, h + p), verdict.when(fits, v)
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


class Level:
    """One Bloom filter: ``hashes`` bits of each key in the segment that its hash picks."""

    def __init__(self, keys: DataFrame, key: str, n: int, number: int, bits_per_key: int, hashes: int, max_segments: int):
        self.number, self.hashes = number, hashes
        self.segments = max(1, -(-n * bits_per_key // BITS))
        bits = keys.select(self.segment(F.col(key)).alias("segment"), F.explode(F.array(*self.places(F.col(key)))).alias("bit"))
        rows = bits.groupBy("segment").agg(F.bitmap_construct_agg(F.col("bit")).alias("bitmap"))
        self.local = self.segments <= max_segments
        if self.local:
            packed = bytearray(self.segments * BITS // 8)
            for r in rows.toLocalIterator():
                packed[r.segment * BITS // 8 : (r.segment + 1) * BITS // 8] = r.bitmap
            self.packed = F.lit(bytes(packed))
        else:
            self.rows = cut(rows)

    def segment(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.number), key), F.lit(self.segments)).cast("long")

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(1000 * i + self.number), key), F.lit(BITS)).cast("long") for i in range(1, self.hashes + 1)]

    def holds(self, key: Column, bitmap: Column | None = None) -> Column:
        """Whether all bits are set, in the packed level or in the key's own segment."""
        packed, base = (self.packed, self.segment(key) * (BITS // 8)) if bitmap is None else (bitmap, F.lit(0).cast("long"))
        out = F.lit(True)
        for place in self.places(key):
            byte = F.conv(F.hex(F.substr(packed, (base + F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
            out = out & (F.pmod(F.shiftright(byte * 256, 8) / F.pow(F.lit(2), place % 8), F.lit(2)) >= 1)
        return F.coalesce(out, F.lit(False))

    def mark(self, df: DataFrame, key: str, out: str) -> DataFrame:
        if self.local:
            return df.withColumn(out, self.holds(F.col(key)))
        s = self.rows.select(F.col("segment").alias("_segment"), F.col("bitmap").alias("_bitmap"))
        joined = df.withColumn("_at", self.segment(F.col(key))).join(s, F.col("_at") == F.col("_segment"), "left")
        return joined.withColumn(out, self.holds(F.col(key), F.col("_bitmap"))).drop("_at", "_segment", "_bitmap")


class Cascade:
    """Exact membership among the keys of ``universe`` (key, listed): one row per key, materialised."""

    def __init__(self, universe: DataFrame, key: str = "key", listed: str = "listed", bits_per_key: tuple[int, int] = (12, 4), hashes: tuple[int, int] = (6, 2), max_segments: int = 2048):
        self.levels: list[Level] = []
        inside, outside = universe.where(F.col(listed)).select(key), universe.where(~F.col(listed)).select(key)
        while (n := inside.count()) > 0:
            i = min(len(self.levels), 1)
            level = Level(inside, key, n, len(self.levels) + 1, bits_per_key[i], hashes[i], max_segments)
            self.levels.append(level)
            wrong = cut(level.mark(outside, key, "_held").where("_held").select(key))
            inside, outside = wrong, inside

    @property
    def local(self) -> bool:
        return all(x.local for x in self.levels)

    def verdict(self, marks: list[Column]) -> Column:
        """The first level that does not hold the key decides; odd levels encode listed keys."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~marks[i], F.lit(i % 2 == 1)).otherwise(out)
        return out

    def member(self, df: DataFrame, key: str, out: str) -> DataFrame:
        """df with a boolean: whether the key is listed. Defined for the universe's keys."""
        if self.local:
            return df.withColumn(out, self.verdict([x.holds(F.col(key)) for x in self.levels]))
        keys, names = df.select(F.col(key).alias("_key")).distinct(), []
        for x in self.levels:
            names.append(f"_held{x.number}")
            keys = x.mark(keys, "_key", names[-1])
        keys = keys.select("_key", self.verdict([F.col(n) for n in names]).alias(out))
        return df.join(keys, df[key].eqNullSafe(F.col("_key")), "left").drop("_key")


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", max_segments: int = 2048) -> DataFrame:
    """page_id, host, path, rule, verdict, listed.

    A rule decides where one fits. Else the list does: hosts that have a page which a rule blocks are listed, and the
    cascade over all hosts of the corpus tells whether a page's host is.
    """
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    p = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": name, "_by_rule": verdict})
    hosts = cut(p.groupBy(F.col("host").alias("key")).agg(F.max(F.coalesce(F.col("_by_rule") == "block", F.lit(False))).alias("listed")))
    p = Cascade(hosts, max_segments=max_segments).member(p, "host", "listed")
    return p.select("page_id", "host", "path", "rule", F.coalesce("_by_rule", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


RULES: list[Rule] = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

ORACLE = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
r AS (SELECT p.*, (SELECT arg_max(h || rules.p, length(h || rules.p)) FROM rules WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, rules.p)) AS rule,
    (SELECT arg_max(v, length(h || rules.p)) FROM rules WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, rules.p)) AS v FROM p),
listed AS (SELECT DISTINCT host FROM r WHERE v = 'block')
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""
