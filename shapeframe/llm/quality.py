r"""Quality rules: counts per document, and a hashed n-gram log-likelihood ratio against the corpus.

Two multinomials over hashed byte n-grams are counted: the trusted target (documents that the labels call good) and
the raw corpus (all documents). A document's score is the mean over its n-grams of log(p_target / p_raw), so it does
not grow with length; documents below ``threshold`` are rejected. The corpus's junk is likelier under the raw
multinomial than under the target, so it scores well below 0; clean text scores about 0, so the threshold of -0.3 nats per
n-gram leaves room for the noise of short texts.

The target's labels are a sample of at most ``max_labels`` good ones, chosen by hash of the id (a documented bound);
the raw counts cover all documents. Counts are added up in the tasks, then by bucket; 2 x 2^bits numbers reach the
driver, whatever the input.

Edge cases: null or empty text has no words, fails the base rule and scores 0; a text shorter than n bytes scores 0;
without labels the target is the corpus and every score is 0, which passes; repeated rows count as often as they
occur and are judged alike; labels of unknown documents and null labels or ids are ignored; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from .common import over_batches

#: Fixed by the contract.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_STATS = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("score", T.DoubleType())])


def ngram_buckets(data: np.ndarray, at: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each byte n-gram, and its row."""
    k = len(data) - n + 1
    if k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(k, np.uint32)
    for i, m in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)[:n]):
        h += (data[i : i + k].astype(np.uint32) + np.uint32(1)) * np.uint32(m)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = row[:k] == row[n - 1 :]
    return (h >> np.uint32(32 - bits)).astype(np.int64)[whole], row[:k][whole]


def base_counts(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    rows = len(at) - 1
    w = arrays.Words(data, at)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    chars = total(w.inside & ((data & 0xC0) != 0x80))
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    symbols = total(table[data])
    whole = data.tobytes()
    dup = np.zeros(rows, np.int64)
    for i in range(rows):
        seen: set[bytes] = set()
        for line in whole[at[i] : at[i + 1]].split(b"\n"):
            if line in seen:
                dup[i] += bool(line.strip(b" \t\n\x0b\x0c\r"))
            else:
                seen.add(line)
    grams, first = w.grams(3)
    repeat = np.zeros(len(w.hash), bool)
    if len(grams):
        own = arrays.mix(grams + w.row[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(own)
        same = own[order][1:] == own[order][:-1]
        twice = np.zeros(len(own), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for i in range(3):
            repeat[first[twice] + i] = True
    return [w.count, chars, symbols, dup, np.bincount(w.row[repeat], minlength=rows)]


def ngram_counts(documents: DataFrame, trusted: list[int], n: int, bits: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(raw, target) counts by bucket."""
    ids = np.array(sorted(trusted), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            good = np.isin(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False), ids) & np.asarray(batch.column(0).is_valid())
            for a, b, data, at in arrays.chunks(batch.column(1)):
                bucket, row = ngram_buckets(data, at, n, bits)
                raw += np.bincount(bucket, minlength=1 << bits)
                if good[a:b].any():
                    target += np.bincount(bucket[good[a:b][row]], minlength=1 << bits)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    counts = documents.select(F.col(id_col).cast("long"), text_col).transform(over_batches, count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    for b, r, t in counts.collect():
        raw[b], target[b] = r, t
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(p_target / p_raw) by bucket.

    The target is smoothed by the corpus, as if it held one more n-gram of it for each bucket that the corpus uses, and
    1 % of its own size. So a target that is small for the corpus's variety says little, and a larger one much.
    """
    if not raw.sum() or not target.sum():
        return np.zeros(len(raw))
    p_raw = (raw + 1e-3) / (raw + 1e-3).sum()
    prior = np.count_nonzero(raw) + 0.01 * target.sum()
    return np.log((target + prior * p_raw) / (target.sum() + prior)) - np.log(p_raw)


def fit(documents: DataFrame, labels: DataFrame, n: int, bits: int, max_labels: int, id_col: str, text_col: str) -> np.ndarray:
    """The log-likelihood ratio of each bucket."""
    good = labels.where("quality = 1").where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"))
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    return log_ratios(*ngram_counts(documents, [r[0] for r in chosen.collect()], n, bits, id_col, text_col))


def scores(data: np.ndarray, at: np.ndarray, ratio: np.ndarray, n: int, bits: int) -> np.ndarray:
    bucket, row = ngram_buckets(data, at, n, bits)
    return np.bincount(row, ratio[bucket], minlength=len(at) - 1) / np.maximum(np.bincount(row, minlength=len(at) - 1), 1)


def judge(
    documents: DataFrame,
    labels: DataFrame,
    threshold: float = -0.3,
    n: int = 3,
    bits: int = 15,
    max_labels: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, the base counts, score, base_failed and kept, a row for each document."""
    ratio = fit(documents, labels, n, bits, max_labels, id_col, text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, at in arrays.chunks(batch.column(1)):
                mean = scores(data, at, ratio, n, bits)
                stats = [pa.array(x, pa.int64()) for x in base_counts(data, at)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *stats, pa.array(mean)], _STATS.names)

    s = documents.select(F.col(id_col).cast("long"), text_col).transform(over_batches, score, _STATS)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return s.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def keep_good(
    documents: DataFrame,
    labels: DataFrame,
    threshold: float = -0.3,
    n: int = 3,
    bits: int = 15,
    max_labels: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The documents that judge() keeps, with all their columns; each is judged where it is read.

    Null and empty texts fail the base rules and go; repeated rows stay or go together; ids aren't read, but for the labels;
    an empty table stays empty.
    """
    ratio = fit(documents, labels, n, bits, max_labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch], at_col: int = documents.columns.index(text_col)) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for a, b, data, at in arrays.chunks(batch.column(at_col)):
                words, *_, repeated = base_counts(data, at)
                failed = (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)
                keep[a:b] = ~failed & (scores(data, at, ratio, n, bits) >= threshold)
            yield batch.filter(pa.array(keep))

    return documents.transform(over_batches, run, documents.schema)


#: For tables with at most max_labels good labels.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
windows AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest([array_to_string(w[i : i + 2], ' ') for i in range(1, len(w) - 1)]) AS g FROM w WHERE len(w) >= 3),
again AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS times FROM windows),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS o(k) WHERE times > 1 GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
hexes AS (SELECT r, regexp_extract_all(hex(encode(text)), '..') AS h FROM d),
bytes AS (SELECT r, unnest(generate_series(1, len(h))) AS i, ('0x' || unnest(h))::BIGINT + 1 AS b FROM hexes),
grams AS (SELECT r, b * 2654435761 + lead(b) OVER byte_order * 2246822519 + lead(b, 2) OVER byte_order * 3266489917 AS h FROM bytes WINDOW byte_order AS (PARTITION BY r ORDER BY i)),
mixed AS (SELECT r, (h % 4294967296)::BIGINT AS h FROM grams WHERE h IS NOT NULL),
buckets AS (SELECT r, ((xor(h, h >> 15)::HUGEINT * 739982445 % 4294967296)::BIGINT >> 17) AS bucket FROM mixed),
counted AS (SELECT r, bucket, count(*) AS n FROM buckets GROUP BY r, bucket),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
corpus AS (SELECT bucket, sum(n)::DOUBLE AS raw, coalesce(sum(n) FILTER (WHERE doc_id IN (SELECT doc_id FROM good)), 0)::DOUBLE AS target FROM counted JOIN d ON counted.r = d.r GROUP BY bucket),
total AS (SELECT sum(raw) AS raw, sum(target) AS target, count(*) + 0.01 * sum(target) AS prior, sum(raw) + 32768 * 1e-3 AS smooth FROM corpus),
ratio AS (SELECT bucket, CASE WHEN t.target = 0 THEN 0 ELSE ln((c.target + t.prior * (c.raw + 1e-3) / t.smooth) / (t.target + t.prior)) - ln((c.raw + 1e-3) / t.smooth) END AS ratio FROM corpus c, total t),
scored AS (SELECT r, sum(n * ratio) / sum(n) AS score FROM counted JOIN ratio ON counted.bucket = ratio.bucket GROUP BY r),
base AS (SELECT d.doc_id, len(w.w)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in w.w]), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(score, 0) AS score
    FROM d JOIN w ON d.r = w.r LEFT JOIN dup ON d.r = dup.r LEFT JOIN repeated ON d.r = repeated.r LEFT JOIN scored ON d.r = scored.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND score >= -0.3 AS kept
FROM base
"""
