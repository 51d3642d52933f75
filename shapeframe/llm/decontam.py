"""Benchmark decontamination: a BM25 index of the test items, searched by every training passage with block-max pruning.

The index is inverted: for each term the test items that hold it, with their BM25 contributions, in blocks of items
with each block's largest contribution. Training texts are cut into overlapping passages; each is a query, and all
items above their threshold (a part ``min_score`` of the item's score for its own text) are retrieved:

1. Essential terms. Each item's terms are essential from the rarest on, until the rest can contribute at most ``slack``
   of the item's own score. Common words so are never looked at first, as in WAND's choice of a pivot.
2. Block-max bound. A passage's essential terms add up each block's largest contributions. Only passages with a block
   whose sum reaches the smallest score that its items still need go on: first with what the essential terms contribute
   to each item, then, for what still can reach its threshold, with the full score.
3. Verification. A retrieved item leaks if the passage holds at least ``min_overlap`` of the 5-word shingles of both its
   question (first half) and its answer (second half).

All passages of a batch are searched side by side in numpy. The index goes to the tasks in slices of at most
``slice_words`` words (a proven bound); more items mean more slices, each searched by all texts, so no side grows with
the data. Nothing is shuffled.

Words are runs of letters and digits (any byte beyond ASCII counts as a letter), in lower case. A passage is twice as
long as a slice's longest item and half overlaps the next, so each copy of an item lies in one passage.

Edge cases: null and empty texts leak nothing; items without words match nothing; items with fewer than ten words
compare one shingle of the words they have; equal items are all reported; items with a null id are searched like others
and reported with a null id, a row for each of them; repeated documents are reported as often as
they occur; null ids of documents stay null; other columns are kept by ``drop_leaks`` and ignored by ``find_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import over_batches

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
N = 5


class PassageWords(arrays.Words):
    """Words of letters and digits only, in lower case."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.inside = arrays._LOWER[data], at, _WORD[data]
        self.starts, self.ends = arrays.runs(self.inside, at)
        self.row = np.searchsorted(at, self.starts, "right") - 1
        self.hash = arrays.segment_hashes(self.data, self.starts, self.ends)
        self.count = np.bincount(self.row, minlength=len(at) - 1)
        self.first = np.cumsum(self.count) - self.count


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the n-word windows of some word hashes."""
    if n < 1 or len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        h += words[i : len(words) - n + 1 + i] * arrays._SHIFTS[i]
    return np.unique(arrays.mix(h))


class Index:
    """Inverted index of one slice of test items."""

    def __init__(self, items: list[tuple[int | None, str]], min_score: float, slack: float, min_overlap: float, block: int = 16, k1: float = 1.2, b: float = 0.75):
        coded = [(t or "").encode() for _, t in items]
        w = PassageWords(np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)]))
        order = np.argsort(w.count, kind="stable")
        order = order[w.count[order] > 0]
        self.ids = [items[i][0] for i in order]
        self.min_overlap, self.block = min_overlap, block
        own = [w.hash[w.first[i] : w.first[i] + w.count[i]] for i in order]
        self.terms = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        n, lengths = len(own), np.array([len(x) for x in own], np.int64)
        self.longest = int(lengths.max()) if n else 1
        item = np.repeat(np.arange(n), lengths)
        pair, tf = np.unique(item * max(1, len(self.terms)) + np.searchsorted(self.terms, np.concatenate(own) if own else np.zeros(0, np.uint64)), return_counts=True)
        item, term = pair // max(1, len(self.terms)), pair % max(1, len(self.terms))
        df = np.bincount(term, minlength=len(self.terms))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * lengths / lengths.mean()) if n else lengths
        score = idf[term] * tf * (k1 + 1) / (tf + norm[item])
        whole = np.bincount(item, score, minlength=n)
        self.threshold = min_score * whole
        # Essential terms: of each item, all but the most common ones that add up to at most slack of its score.
        essential = np.zeros(len(self.terms), bool)
        common = np.lexsort((term, -df[term], item))
        rest = np.cumsum(score[common]) - np.repeat(np.cumsum(whole) - whole, np.bincount(item, minlength=n))
        essential[term[common][rest > slack * whole[item[common]]]] = True
        self.essential = essential
        missing = np.bincount(item[~essential[term]], score[~essential[term]], minlength=n)
        self.blocks = -(-n // block)
        self.needs = np.full(self.blocks, np.inf)
        self.item_needs = self.threshold - missing - 1e-9
        np.minimum.at(self.needs, np.arange(n) // block, self.item_needs)
        # Postings by term: items with scores, and blocks with their largest score.
        by_term = np.argsort(term, kind="stable")
        self.items, self.scores = item[by_term], score[by_term]
        self.posted = np.searchsorted(term[by_term], np.arange(len(self.terms) + 1))
        tb, first = np.unique(term[by_term] * max(1, self.blocks) + self.items // block, return_index=True)
        self.block_of, self.block_max = tb % max(1, self.blocks), np.maximum.reduceat(self.scores, first) if len(first) else self.scores
        self.block_posted = np.searchsorted(tb // max(1, self.blocks), np.arange(len(self.terms) + 1))
        halves = [(x[: (len(x) + 1) // 2], x[(len(x) + 1) // 2 :]) for x in own]
        self.parts = [[(min(N, len(h)), shingles(h, min(N, len(h)))) for h in pair] for pair in halves]

    def search(self, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int | None, float, float, float]]:
        """(row, item id, score, question overlap, answer overlap), the best passage of each row and item."""
        w = PassageWords(data, at)
        if not len(self.terms) or not len(w.hash):
            return []
        place = np.minimum(np.searchsorted(self.terms, w.hash), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[place] == w.hash)
        stride = self.longest
        # Passages of a row start every stride words; a word lies in its own stretch's passage and in the one before.
        many = np.maximum(1, -(-w.count // stride))
        base = np.cumsum(many) - many
        stretch = base[w.row] + (np.arange(len(w.hash)) - w.first[w.row]) // stride
        rare = hit[self.essential[place[hit]]]
        inner = rare[stretch[rare] > base[w.row[rare]]]
        pairs = np.unique(np.concatenate([stretch[rare], stretch[inner] - 1]) * len(self.terms) + np.concatenate([place[rare], place[inner]]))
        passage, term = pairs // len(self.terms), pairs % len(self.terms)
        span = self.block_posted[term + 1] - self.block_posted[term]
        into = np.repeat(self.block_posted[term] - (np.cumsum(span) - span), span) + np.arange(span.sum())
        key, inverse = np.unique(np.repeat(passage, span) * self.blocks + self.block_of[into], return_inverse=True)
        bound = np.bincount(inverse, self.block_max[into], minlength=len(key))
        key = key[bound >= self.needs[key % self.blocks]]
        # The passages that remain: what their essential terms contribute to each item.
        near = np.isin(passage, np.unique(key // self.blocks))
        passage, term = passage[near], term[near]
        span = self.posted[term + 1] - self.posted[term]
        into = np.repeat(self.posted[term] - (np.cumsum(span) - span), span) + np.arange(span.sum())
        pair, inverse = np.unique(np.repeat(passage, span) * len(self.ids) + self.items[into], return_inverse=True)
        bound = np.bincount(inverse, self.scores[into], minlength=len(pair))
        pair = pair[bound >= self.item_needs[pair % len(self.ids)]]
        best: dict[tuple[int, bool, int], tuple[float, float, float]] = {}  # by row, whether there is an id, and the id or else the item's place
        row_of = np.repeat(np.arange(len(many)), many)
        for passage in np.unique(pair // len(self.ids)):
            row = int(row_of[passage])
            a = int(w.first[row] + (passage - base[row]) * stride)
            z = min(a + 2 * stride, int(w.first[row] + w.count[row]))
            terms = np.unique(place[a:z][self.terms[place[a:z]] == w.hash[a:z]])
            scores = np.zeros(len(self.ids))
            for t in terms:
                scores[self.items[self.posted[t] : self.posted[t + 1]]] += self.scores[self.posted[t] : self.posted[t + 1]]
            found = np.flatnonzero(scores >= self.threshold - 1e-9)
            have = {n: shingles(w.hash[a:z], n) for n in {n for i in found for n, _ in self.parts[i]}}
            for i in found:
                q, r = (float(np.isin(part, have[n]).mean()) if len(part) else 1.0 for n, part in self.parts[i])
                if min(q, r) >= self.min_overlap:
                    k = (row, self.ids[i] is not None, int(i) if self.ids[i] is None else self.ids[i])
                    best[k] = max(best.get(k, (0.0, 0.0, 0.0)), (float(scores[i]), q, r))
        return [(r, i if known else None, *v) for (r, known, i), v in sorted(best.items())]


def indexes(benchmark: DataFrame, min_score: float, slack: float, min_overlap: float, slice_words: int, id_col: str, text_col: str) -> Iterator[Index]:
    """The index in slices of at most slice_words words (of two bytes or more with their space); items reach the driver slice by slice."""
    items, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("long"), text_col).where(F.col(text_col).isNotNull()).orderBy(id_col, text_col)
    for i, text in rows.toLocalIterator():
        if items and size + len(text) // 2 > slice_words:
            yield Index(items, min_score, slack, min_overlap)
            items, size = [], 0
        items.append((i, text))
        size += len(text) // 2
    yield Index(items, min_score, slack, min_overlap)


def find_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    min_score: float = 0.6,
    slack: float = 0.15,
    min_overlap: float = 0.5,
    slice_words: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap), a row for each document and item that leaks into it."""
    found = None
    for index in indexes(benchmark, min_score, slack, min_overlap, slice_words, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, data, at in arrays.chunks(batch.column(1)):
                    rows = index.search(data, at)
                    ids = batch.column(0).slice(a, b - a).take(pa.array([r[0] for r in rows], pa.int64()))
                    columns = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64()))]
                    yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = documents.select(F.col(id_col).cast("long"), text_col).transform(over_batches, run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    min_score: float = 0.6,
    slack: float = 0.15,
    min_overlap: float = 0.5,
    slice_words: int = 1_000_000,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The documents, with all their columns, into which no item leaks. Each is judged where it is read."""
    for index in indexes(benchmark, min_score, slack, min_overlap, slice_words, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index, at_col: int = documents.columns.index(text_col)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, _, data, at in arrays.chunks(batch.column(at_col)):
                    for r in index.search(data, at):
                        keep[a + r[0]] = False
                yield batch.filter(pa.array(keep))

        documents = documents.transform(over_batches, run, documents.schema)
    return documents
