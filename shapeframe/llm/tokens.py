r"""Token counts of a byte-level BPE vocabulary by compiled finite-state machines.

Pre-tokens. The split pattern of the vocabulary ('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|
\s+(?!\S)|\s+) is compiled to a deterministic transducer with eight states; its transitions say whether a pre-token
begins. Its input symbols are character classes with a look-ahead folded in. All maps from states to states that
texts can induce (the transition monoid) are enumerated at compile time, so a chunk of text is one monoid element; the
elements of a batch's chunks compose by a parallel prefix scan, which gives every chunk its entry state, and all
chunks then run side by side.

Tokens. A second transducer reads the bytes of a pre-token; each transition carries the change of the number of emitted
tokens. Encoding a prefix of a pre-token ends in exactly one token t, before which the shorter prefix is encoded as if it
stood alone; t is the one token that ends there and that no merge joins to the last token of that shorter prefix. So a
state need only hold, for each earlier place whose following bytes still begin some token: the node of the vocabulary's
trie, the last token before that place and the count there, relative to the count now. That is a finite machine, for no
token is longer than the longest; states and transitions are compiled when a text first takes them, and kept up to
``MAX_MOVES`` a worker (then the machine starts anew: a bound on memory, not on results).

A pre-token always enters at the fresh state, so all pre-tokens of a slice run side by side. A pre-token of more than
``LONG`` bytes is cut into chunks, whose maps (entry state to exit state and count) compose from left to right; a map
is evaluated only at the states that occur, first at the state that the chunk before it would leave if it were fresh.

The added token's string is one token wherever it stands, as the library's default has it, and splits the text.

Edge cases: null and empty texts have 0 bytes and 0 tokens; texts of any length are chunks of one scan; repeated rows
are counted alike; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import over_batches

#: Input symbols: letter, number, other; white space inside a run, a space before a non-space, other space before a
#: non-space; an apostrophe that can open a two- or three-character ending; the start of a text.
LETTER, NUMBER, OTHER, INNER, SPACE, BREAK, END2, END3, START = range(9)
#: States: fresh, in letters, in numbers, in others, in white space, after a joining space, one and two characters
#: left of an ending.
FRESH, LETTERS, NUMBERS, OTHERS, WHITE, JOIN, LEFT1, LEFT2 = range(8)
MAX_MOVES = 400_000
LANE = 128
LONG, WARM, SLICE = 512, 64, 1 << 18
_SENTINEL = 0x110000


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token begins with the symbol's character."""
    if symbol == START:
        return FRESH, True
    if state == LEFT2:
        return LEFT1, False
    if state == LEFT1:
        return FRESH, False
    if symbol in (LETTER, NUMBER, OTHER):
        to = (LETTERS, NUMBERS, OTHERS)[symbol]
        return to, not (state == to or state == JOIN)
    if symbol == INNER:
        return WHITE, state != WHITE
    if symbol == SPACE:
        return JOIN, True
    if symbol == BREAK:
        return FRESH, True
    if state in (OTHERS, JOIN):
        return OTHERS, False
    return (LEFT1 if symbol == END2 else LEFT2), True


@lru_cache(1)
def machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(next state, begins) by state x symbol; (monoid x symbol, monoid x monoid) products; states by monoid element."""
    to = np.array([[_step(s, c)[0] for c in range(9)] for s in range(8)], np.uint8)
    begins = np.array([[_step(s, c)[1] for c in range(9)] for s in range(8)], bool)
    elements = {tuple(range(8)): 0}
    todo = [tuple(range(8))]
    for m in todo:
        for c in range(9):
            image = tuple(int(to[s, c]) for s in m)
            if image not in elements:
                elements[image] = len(elements)
                todo.append(image)
    by_symbol = np.array([[elements[tuple(int(to[s, c]) for s in m)] for c in range(9)] for m in todo], np.uint16)
    product = np.array([[elements[tuple(b[s] for s in a)] for b in todo] for a in todo], np.uint16)
    return to, begins, by_symbol, product, np.array(todo, np.uint8)


@lru_cache(1)
def char_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or INNER (any white space) by code point; START for the sentinel."""
    kind = np.full(_SENTINEL + 1, OTHER, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, _SENTINEL)]))
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", INNER)):
        for m in regex.finditer(pattern, text):
            kind[[ord(text[m.start()]) + 0, ord(text[m.end() - 1])]] = c
            a, b = ord(text[m.start()]), ord(text[m.end() - 1])
            kind[a : b + 1] = c
    kind[_SENTINEL] = START
    return kind


def symbols(points: np.ndarray) -> np.ndarray:
    """Input symbols of code points; sentinels separate texts and stand first."""
    kind = char_classes()[points]
    following = np.append(points[1:], _SENTINEL)
    next_kind = char_classes()[following]
    white = kind == INNER
    last = white & (next_kind != INNER) & (next_kind != START)
    kind[last] = np.where(points[last] == 0x20, SPACE, BREAK)
    mark = np.flatnonzero(points == 0x27)
    if len(mark):
        one = following[mark]
        two = np.append(following[1:], _SENTINEL)[mark]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        kind[mark] = np.where(short, END2, np.where(long, END3, OTHER))
    return kind


def beginnings(points: np.ndarray) -> np.ndarray:
    """Whether a pre-token (or sentinel) begins at each code point."""
    to, begins, by_symbol, product, states = machine()
    kind = symbols(points)
    n = len(kind)
    lanes = -(-n // LANE)
    grid = np.full(lanes * LANE, START, np.uint8)
    grid[:n] = kind
    grid = np.ascontiguousarray(grid.reshape(lanes, LANE).T)
    element = np.zeros(lanes, np.uint16)
    for row in grid:
        element = by_symbol[element, row]
    shift = 1  # inclusive scan by doubling: element[i] becomes the product of lanes 0..i
    while shift < lanes:
        element = np.concatenate([element[:shift], product[element[:-shift], element[shift:]]])
        shift *= 2
    state = np.empty(lanes, np.uint8)
    state[:1], state[1:] = FRESH, states[element[:-1], FRESH]
    out = np.empty((LANE, lanes), bool)
    for i, row in enumerate(grid):
        out[i] = begins[state, row]
        state = to[state, row]
    return out.T.reshape(-1)[:n]


class Merges:
    """The vocabulary's merges, for short byte strings."""

    def __init__(self, vocabulary: dict):
        model, self.added = vocabulary["model"], [t["content"] for t in vocabulary["added_tokens"]]
        ids = model["vocab"]
        # The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the rest follow from U+0100.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(x for x in range(256) if x not in set(printable))}
        self.bytes = [ids[letters[b]] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.by_pair = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(pairs)}
        back = {c: b for b, c in letters.items()}
        made = {t for _, t in self.by_pair.values()} | set(self.bytes)
        self.spelled = {i: bytes(back[c] for c in t) for t, i in ids.items() if i in made}

    def encode(self, data: bytes) -> list[int]:
        """Tokens of a byte string: the leftmost pair of lowest rank is merged until none is left."""
        tokens = [self.bytes[b] for b in data]
        while len(tokens) > 1:
            found = [(m[0], i, m[1]) for i, pair in enumerate(zip(tokens, tokens[1:], strict=False)) if (m := self.by_pair.get(pair))]
            if not found:
                break
            _, i, token = min(found)
            tokens[i : i + 2] = [token]
        return tokens


class Moves:
    """(state, byte) -> (next state, count), as a hash table that whole arrays of keys are looked up in."""

    def __init__(self) -> None:
        self.size = 0
        self.keys, self.values = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, np.int64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (arrays.mix(keys.astype(np.uint64)) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of keys, and which keys are missing (by position)."""
        slot = self._home(keys)
        there = self.keys[slot]
        other = np.flatnonzero((there != keys) & (there >= 0))
        while len(other):
            slot[other] = (slot[other] + 1) & (len(self.keys) - 1)
            there[other] = self.keys[slot[other]]
            other = other[(there[other] != keys[other]) & (there[other] >= 0)]
        return self.values[slot], np.flatnonzero(there < 0)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct new keys."""
        self.size += len(keys)
        if self.size * 2 > len(self.keys):
            used = self.keys >= 0
            keys, values = np.concatenate([self.keys[used], keys]), np.concatenate([self.values[used], values])
            room = 1 << (4 * self.size - 1).bit_length()
            self.keys, self.values = np.full(room, -1, np.int64), np.zeros(room, np.int64)
        slot, left = self._home(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)


class Transducer:
    """The machine over the bytes of a pre-token. State 0 is fresh; a value is next state << 16 | count + 2^15."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        for token, spelled in merges.spelled.items():
            node = 0
            for byte in spelled:
                key = node << 8 | byte
                node = self.child.setdefault(key, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = token
        self.inner = {key >> 8 for key in self.child}
        self.restart()

    def restart(self) -> None:
        fresh = ((0, -1, 0),)
        self.states, self.numbers, self.moves = [fresh], {fresh: 0}, Moves()
        self.apart: dict[tuple[int, int], bool] = {}

    def stay_apart(self, last: int, token: int) -> bool:
        """Whether the two tokens, side by side, encode to themselves; last -1 is the pre-token's start."""
        known = self.apart.get((last, token))
        if known is None:
            spelled = self.merges.spelled
            both = [token] if last < 0 else [last, token]
            known = self.apart[last, token] = self.merges.encode(b"".join(spelled[t] for t in both)) == both
        return known

    def step(self, state: int, byte: int) -> int:
        """Compiles one transition."""
        places = [(node, last, count) for at, last, count in self.states[state] if (node := self.child.get(at << 8 | byte)) is not None]
        for node, last, count in places:
            token = self.token[node]
            if token >= 0 and self.stay_apart(last, token):
                now = count + 1
                break
        else:
            raise ValueError("the vocabulary's merges do not give each prefix a last token")
        image = (*[(n, t, c - now) for n, t, c in places if n in self.inner], (0, token, 0))
        to = self.numbers.setdefault(image, len(self.states))
        if to == len(self.states):
            self.states.append(image)
        return to << 16 | now + 0x8000

    def run(self, state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of segments of data that enter at the given states, all side by side."""
        order = np.argsort(starts - ends, kind="stable")
        state, at, falling = state[order], starts[order], (starts - ends)[order]
        total = np.zeros(len(state), np.int64)
        for k in range(-int(falling[0]) if len(falling) else 0):
            n = int(np.searchsorted(falling, -k))
            keys = state[:n] << 8 | data[at[:n] + k]
            value, missing = self.moves.find(keys)
            if len(missing):
                new, inverse = np.unique(keys[missing], return_inverse=True)
                made = np.array([self.step(int(key) >> 8, int(key) & 255) for key in new], np.int64)
                self.moves.add(new, made)
                value[missing] = made[inverse]
            state[:n] = value >> 16
            total[:n] += (value & 0xFFFF) - 0x8000
        out, counts = np.empty_like(state), np.empty_like(total)
        out[order], counts[order] = state, total
        return out, counts

    def run_long(self, data: np.ndarray, start: int, end: int) -> int:
        """Tokens of one long pre-token, by the maps of its chunks."""
        starts = np.arange(start, end, LONG)
        ends = np.minimum(starts + LONG, end)
        guess, _ = self.run(np.zeros(len(starts), np.int64), data, np.maximum(starts - WARM, start), starts)
        maps: list[dict[int, tuple[int, int]]] = [{} for _ in starts]
        need = list(enumerate(guess.tolist()))
        while need:
            which = np.array([i for i, _ in need])
            out, counts = self.run(np.array([s for _, s in need], np.int64), data, starts[which], ends[which])
            for (i, s), o, c in zip(need, out.tolist(), counts.tolist(), strict=True):
                maps[i][s] = (o, c)
            state, total, need = 0, 0, []
            for i, known in enumerate(maps):
                if state not in known:
                    need.append((i, state))
                    state = next(reversed(known.values()))[0]
                else:
                    state, count = known[state]
                    total += count
        return total


class Counter:
    """Counts tokens of texts; keeps the transitions that texts have taken."""

    def __init__(self, vocabulary: dict):
        self.merges = Merges(vocabulary)
        self.transducer = Transducer(self.merges)

    def emitted(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token of UTF-8 data, a slice at a time."""
        out = np.zeros(len(starts), np.int64)
        long = ends - starts > LONG
        short = np.flatnonzero(~long)
        slices = np.searchsorted(starts[short], np.arange(SLICE, len(data) + SLICE, SLICE)) if len(short) else []
        for rows in [*np.split(short, slices), *np.flatnonzero(long)[:, None]]:
            if self.transducer.moves.size > MAX_MOVES:
                self.transducer.restart()
            if len(rows) == 1 and long[rows[0]]:
                out[rows] = self.transducer.run_long(data, int(starts[rows[0]]), int(ends[rows[0]]))
            elif len(rows):
                out[rows] = self.transducer.run(np.zeros(len(rows), np.int64), data, starts[rows], ends[rows])[1]
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        mark, total = chr(0), np.zeros(len(texts), np.int64)
        parts: list[str] = []
        owner: list[int] = []
        for i, text in enumerate(texts):
            pieces = [text]
            for special in self.merges.added:
                pieces = [p for piece in pieces for p in piece.split(special)]
            total[i] = len(pieces) - 1
            parts += [mark + p for p in pieces if p]
            owner += [i for p in pieces if p]
        if not parts:
            return total
        whole = "".join(parts)
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4").copy()
        data = np.frombuffer(whole.encode(), np.uint8)
        at = np.cumsum([0, *map(len, parts)])
        points[at[:-1]] = _SENTINEL
        starts = np.flatnonzero(beginnings(points))
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        width[at[:-1]] = 1
        offset = np.concatenate([[0], np.cumsum(width)])
        ends = offset[np.append(starts[1:], len(points))]
        real = points[starts] != _SENTINEL
        piece = (np.cumsum(~real) - 1)[real]
        emitted = self.emitted(data, offset[starts][real], ends[real])
        return total + np.bincount(np.array(owner)[piece], emitted, minlength=len(texts)).astype(np.int64)


@lru_cache(4)
def _counter(file: str) -> Counter:
    with open(SparkFiles.get(file), encoding="utf-8") as f:
        return Counter(json.load(f))


def count_tokens(documents: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. vocabulary: path of the vocabulary's file on the driver, which Spark hands to the executors."""
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rpartition("/")[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(name)
        for batch in batches:
            for a, b, data, at in arrays.chunks(batch.column(1)):
                whole = data.tobytes()
                counts = counter.count([whole[i:j].decode("utf-8", "replace") for i, j in zip(at[:-1], at[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at)), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    d = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).transform(over_batches, run, "doc_id long, n_bytes long, n_tokens long")
    return d.withColumn("over_limit", F.col("n_tokens") > limit)
