r"""Deleting later copies of repeated line runs (DataFrame functions only).

A run of consecutive lines of one document with at least ``min_words`` words is a copy if the same lines start at an
earlier place of the corpus, in order of (doc_id with nulls last, hash of text, line number). A line goes when some
copy holds it; first occurrences stay.

Method: a suffix array over line ids by prefix doubling. Level k names each place by the 2^k lines that start there;
the name of level k + 1 is made from the names at i and i + 2^k. Names are 128-bit hashes instead of dense ranks, so
that no global sort is needed; equal names are the same interval of the suffix array, whose common prefix is at least
2^k lines. Only lines that occur twice or more enter (any other line ends every repeat), and only runs of them that
reach ``min_words``. In a run, each place opens the shortest window of enough words to its right, and closes the
shortest to its left; together these windows cover exactly the lines of all repeated runs (see the tests, which
compare with all runs). A window of m lines, 2^k <= m < 2^(k+1), is keyed by m and the level-k names at its two ends.
Copies of one window meet in one pre-aggregated group (a hot line's or window's rows are dealt to many tasks); overlapping copies merge into intervals of lines.

Edge cases: null text gives null text and no lines; an empty text is one line without words; rows equal in id and
text are one place and so not copies of each other (they are treated alike); null ids come last; other columns are
kept by ``dedup_documents`` and ignored by the rest; a very long document is one row and its lines are dealt by run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Sieve, cut, fresh, small, words

#: A key with more than one in HOT of all rows is hot (so fewer than HOT keys are); its rows are dealt to SALTS tasks.
HOT, SALTS = 2_000, 64


def _meet(rows: DataFrame, groups: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """rows whose keys are in groups, with the groups' other columns but n; hot keys' rows are dealt by their place.

    groups is materialised and has a row for each key, with its number of rows as n.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT > total
    names = [f"_g{i}" for i in range(len(keys))]
    listed = groups.where(hot).select(*[F.col(k).alias(g) for k, g in zip(keys, names, strict=True)])
    same = [F.col(k) == F.col(g) for k, g in zip(keys, names, strict=True)]
    salt = F.when(F.col("_g0").isNotNull(), F.pmod(F.xxhash64(F.lit(9), *place), F.lit(SALTS))).otherwise(0).cast("int")
    rows = rows.join(F.broadcast(listed), same, "left").withColumn("_salt", salt).drop(*names)
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(groups.withColumn("_salt", F.explode(salts)).drop("n"), [*keys, "_salt"]).drop("_salt")


def _lines(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = documents.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("ln", "line"))
    return d.select("id", "th", "ln", F.xxhash64(F.lit(0), "line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "line")


def repeated_runs(documents: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines to delete: id, th (hash of text), cuts (array of (lo, hi), disjoint, 0-based, inclusive)."""
    lines = _lines(documents, id_col, text_col)
    twice = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    active = lines.select("id", "th", "ln", "h1", "h2", words(F.col("line")).alias("w"))
    active = _meet(active, cut(twice), ["h1", "h2"], ["id", "th", "ln"]).dropDuplicates(["id", "th", "ln"])
    place = Window.partitionBy("id", "th").orderBy("ln")
    active = active.withColumn("run", F.col("ln") - F.row_number().over(place))
    run = Window.partitionBy("id", "th", "run")
    active = active.withColumn("cw", F.sum("w").over(run.orderBy("ln")))
    active = active.withColumn("all", F.sum("w").over(run)).where(F.col("all") >= min_words).drop("all")
    active = cut(active)

    # Shortest windows: of the points at or beyond a value the nearest, as a running minimum in falling order.
    def nearest(point, query, falling: bool) -> DataFrame:
        both = active.select("id", "th", "run", point.alias("v"), F.lit(0).alias("kind"), "ln").unionByName(active.select("id", "th", "run", query.alias("v"), F.lit(1).alias("kind"), "ln"))
        line = run.orderBy(F.col("v").desc() if falling else F.col("v").asc(), "kind", "ln").rowsBetween(Window.unboundedPreceding, 0)
        found = (F.min if falling else F.max)(F.when(F.col("kind") == 0, F.col("ln"))).over(line)
        return both.withColumn("to", found).where("kind = 1 AND to IS NOT NULL").select("id", "th", "run", "ln", "to")

    right = nearest(F.col("cw"), F.col("cw") - F.col("w") + min_words, True).select("id", "th", "run", F.col("ln").alias("a"), F.col("to").alias("e"))
    left = nearest(F.col("cw") - F.col("w"), F.col("cw") - min_words, False).select("id", "th", "run", F.col("to").alias("a"), F.col("ln").alias("e"))
    windows = cut(right.unionByName(left).where("a <= e").dropDuplicates())
    longest = windows.agg(F.max(F.col("e") - F.col("a") + 1)).first()[0] or 1

    # Prefix doubling inside the runs: names of level k at each line, and of the 2^k lines that end there.
    named, levels = active.select("id", "th", "run", "ln", F.struct("h1", "h2").alias("n0")), longest.bit_length()
    for k in range(levels - 1):
        here, there = F.col(f"n{k}"), F.lead(f"n{k}", 1 << k).over(run.orderBy("ln"))
        named = named.withColumn("_next", there)
        both = F.struct(F.xxhash64(F.lit(2), here, F.col("_next")).alias("h1"), F.xxhash64(F.lit(3), here, F.col("_next")).alias("h2"))
        named = named.withColumn(f"n{k + 1}", F.when(F.col("_next").isNotNull(), both)).drop("_next")
    for k in range(levels):
        named = named.withColumn(f"b{k}", F.lag(f"n{k}", (1 << k) - 1).over(run.orderBy("ln")))
    named = cut(named)
    w = windows.withColumn("m", F.col("e") - F.col("a") + 1)
    for side, at in (("n", "a"), ("b", "e")):
        names = named.select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("ln").alias("_ln"), *[f"{side}{k}" for k in range(levels)])
        w = w.join(names, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")) & (F.col(at) == F.col("_ln"))).drop("_id", "_th", "_ln")
    level = F.floor(F.log2(F.col("m") + 0.5)).cast("int")
    key = F.struct("m", F.get(F.array(*[f"n{k}" for k in range(levels)]), level).alias("first"), F.get(F.array(*[f"b{k}" for k in range(levels)]), level).alias("last"))
    w = w.select("id", "th", "a", "e", F.xxhash64(F.lit(4), key).alias("k1"), F.xxhash64(F.lit(5), key).alias("k2"), F.struct(F.col("id").isNull().alias("nil"), "id", "th", "a").alias("at"))
    w = cut(w)
    first = w.groupBy("k1", "k2").agg(F.min("at").alias("origin"), F.count("*").alias("n")).where("n > 1")
    copies = _meet(w, cut(first), ["k1", "k2"], ["id", "th", "a"]).where(F.col("at") > F.col("origin"))

    # Union of the copies' intervals, by document.
    doc = Window.partitionBy("id", "th").orderBy("a", "e")
    reach = F.max("e").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = copies.select("id", "th", "a", "e", reach.alias("reach")).withColumn("new", (F.col("reach").isNull() | (F.col("a") > F.col("reach") + 1)).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy("id", "th", "island").agg(F.min("a").alias("lo"), F.max("e").alias("hi"))
    return islands.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("cuts"))


def dedup_documents(documents: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents, the text without copies, and _n_lines and _n_removed (which replace columns of these names).

    With few cuts they are broadcast; else only documents that a Bloom filter doesn't tell from those with cuts are shuffled.
    """
    documents = documents.drop("_n_lines", "_n_removed")
    h, i, x, y = (fresh(documents, n) for n in ("_cut_hash", "_cut_id", "_cut_cuts", "_cut_th"))
    cuts = cut(repeated_runs(documents, min_words, id_col, text_col).select(F.col("id").alias(i), F.col("th").alias(y), F.col("cuts").alias(x)))
    text, key = F.col(text_col), F.col(id_col)
    d = documents.withColumn(h, F.xxhash64(text))
    on = (F.col(h) == F.col(y)) & key.eqNullSafe(F.col(i))
    listed = small(cuts)
    if listed is cuts:
        may = Sieve(cuts, i, y).may(key, F.col(h))
        clear = d.where(~may).withColumns({c: F.lit(None).cast(cuts.schema[c].dataType) for c in (i, y, x)})
        d = d.where(may).join(cuts, on, "left").unionByName(clear)
    else:
        d = d.join(listed, on, "left")
    kept = F.filter(F.split(text, "\n", -1), lambda line, at: ~F.exists(F.col(x), lambda r: (at >= r["lo"]) & (at <= r["hi"])))
    gone = F.aggregate(F.col(x), F.lit(0).cast("long"), lambda n, r: n + (r["hi"] - r["lo"] + 1))
    d = d.withColumn("_n_lines", F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long"))
    d = d.withColumn("_n_removed", F.coalesce(gone, F.lit(0)).cast("long"))
    d = d.withColumn(text_col, F.when(F.col(x).isNull(), text).otherwise(F.array_join(kept, "\n")))
    return d.drop(h, i, x, y)


#: All shortest windows by plain comparison of their lines.
ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS ln FROM d),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l),
c AS (SELECT doc_id, ln, w, sum(w) OVER (PARTITION BY doc_id ORDER BY ln) AS cw FROM w),
r AS (SELECT x.doc_id, x.ln AS a, min(y.ln) AS e FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.ln >= x.ln AND y.cw >= x.cw - x.w + 50 GROUP BY ALL),
f AS (SELECT x.doc_id, max(y.ln) AS a, x.ln AS e FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.ln <= x.ln AND y.cw - y.w <= x.cw - 50 GROUP BY x.doc_id, x.ln),
win AS (SELECT * FROM r UNION SELECT * FROM f),
keyed AS (SELECT win.doc_id, a, e, lines[a + 1 : e + 1] AS body FROM win JOIN d ON win.doc_id = d.doc_id),
copies AS (SELECT doc_id, a, e FROM (SELECT *, min((doc_id, a)) OVER (PARTITION BY body) AS origin FROM keyed) WHERE (doc_id, a) > origin),
gone AS (SELECT DISTINCT c.doc_id, l.ln FROM copies c JOIN l ON c.doc_id = l.doc_id AND l.ln BETWEEN c.a AND c.e),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.ln) FILTER (WHERE g.ln IS NULL) AS text, count(*) AS n_lines, count(g.ln) AS n_removed
    FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.ln = g.ln GROUP BY l.doc_id)
SELECT documents.doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents LEFT JOIN kept ON documents.doc_id = kept.doc_id
"""
