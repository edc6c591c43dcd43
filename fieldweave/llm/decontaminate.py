"""Benchmark decontamination by a generalised suffix automaton of the words of the test items.

A document's words stream through the automaton, which tracks the longest match that ends at each word. Where that length
reaches the window, the last words are hit. Before that, array work finds the documents that can match at all: a
window needs a run of word pairs that the items have; only those documents go through the automaton.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RollingHash, byte_codes, byte_column, slices, stored

#: A word, after A-Z are lower case. Fixed by the contract.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of one automaton; more items make more blocks, each of which meets all documents.
BLOCK_WORDS = 100_000
#: Blocks in one chain of passes before the marks are stored.
CHAIN = 4
PAIR_BITS = 22

SPAN = T.ArrayType(T.ArrayType(T.IntegerType()))
MARKS = [
    T.StructField("n_words", T.LongType()), T.StructField("word_spans", SPAN), T.StructField("byte_spans", SPAN),
    T.StructField("item_ids", T.ArrayType(T.StringType()))]


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Automaton:
    """All substrings of the items' words, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in coded:
            last = 0
            for word in words:
                last = self.extend(last, word)
        self.mark(coded)

    def state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def split(self, before: int, word: int, target: int) -> int:
        """A state for the strings of ``target`` that are one word longer than ``before``."""
        if self.length[before] + 1 == self.length[target]:
            return target
        twin = self.state(self.length[before] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = twin
        while before >= 0 and self.next[before].get(word) == target:
            self.next[before][word] = twin
            before = self.link[before]
        return twin

    def extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self.split(last, word, known)
        new = self.state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self.split(last, word, self.next[last][word])
        return new

    def mark(self, coded: list[tuple[str, list[int]]]) -> None:
        """At each state, the windows that end there: (length, items), the state's own and those of its suffixes."""
        own: dict[int, dict[int, set[str]]] = {}
        for name, words in coded:
            need = min(self.window, len(words))
            state = length = 0
            for word in words:
                state, length = self.step(state, length, word)
                if length >= need:
                    at = state
                    while self.length[self.link[at]] >= need:
                        at = self.link[at]
                    own.setdefault(at, {}).setdefault(need, set()).add(name)
        self.ends: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            mine = tuple((need, frozenset(names)) for need, names in sorted(own.get(state, {}).items(), reverse=True))
            self.ends[state] = mine + self.ends[self.link[state]]

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The longest match that ends with ``word``."""
        moves = self.next
        while state and word not in moves[state]:
            state = self.link[state]
            length = self.length[state]
        after = moves[state].get(word)
        return (0, 0) if after is None else (after, length + 1)

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(merged word ranges that are hit, items with a window there)."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        state = length = 0
        for at, word in enumerate(words):
            known = self.ids.get(word)
            if known is None:
                state = length = 0
                continue
            state, length = self.step(state, length, known)
            fit = [(need, names) for need, names in self.ends[state] if need <= length]
            if fit:
                start = at + 1 - fit[0][0]
                found.update(*(names for _, names in fit))
                if spans and spans[-1][1] >= start:
                    low = min(spans[-1][0], start)
                    while len(spans) > 1 and spans[-2][1] >= low:
                        spans.pop()
                        low = min(low, spans[-1][0])
                    spans[-1] = (low, at + 1)
                else:
                    spans.append((start, at + 1))
        return spans, found


class Block:
    """One automaton and the tables that tell which documents can match it."""

    def __init__(self, items: tuple[tuple[str, bytes], ...], window: int):
        split = [(name, words) for name, text in items if (words := words_of(text))]
        self.automaton = Automaton(split, window)
        self.least = min((min(window, len(words)) for _, words in split), default=0)
        self.known = np.sort(word_hashes(b" ".join(self.automaton.ids))[0])
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for _, words in split:
            hashes, _ = word_hashes(b" ".join(words))
            self.pairs[pair_places(hashes)] = True

    def possible(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which documents may hold a window. ``ends``: words up to the end of each document."""
        out = np.zeros(len(ends), bool)
        if not self.least or not len(hashes):
            return out
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        good, need = self.known[at] == hashes, self.least
        if need > 1:
            good = good[:-1] & good[1:] & self.pairs[pair_places(hashes)]
            inner = ends[:-1]
            good[inner[(inner > 0) & (inner < len(hashes))] - 1] = False
            need -= 1
        # Length of the run of good places that ends at each place.
        place = np.arange(1, len(good) + 1)
        run = place - np.maximum.accumulate(np.where(good, 0, place))
        out[np.searchsorted(ends, np.flatnonzero(run >= need), "right")] = True
        return out


def pair_places(hashes: np.ndarray) -> np.ndarray:
    return ((hashes[:-1] * np.uint64(3) + hashes[1:]) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower case of each byte, whether it is part of a word)."""
    lower = np.frombuffer(bytes(range(256)).lower(), np.uint8)
    part = np.array([WORD.fullmatch(bytes([b])) is not None for b in range(256)])
    return lower, part


def word_hashes(body: bytes | np.ndarray, offsets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words up to the end of each text)."""
    lower, part = tables()
    raw = np.frombuffer(body, np.uint8) if isinstance(body, bytes) else body
    offsets = np.array([0, len(raw)]) if offsets is None else offsets
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    raw = lower[raw]
    inside = part[raw]
    breaks = np.zeros(len(raw) + 1, bool)
    breaks[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | breaks[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | breaks[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return RollingHash(byte_codes()[raw]).ranges(starts, ends), np.searchsorted(starts, offsets[1:])


@lru_cache(maxsize=2)
def block_of(items: tuple[tuple[str, bytes], ...], window: int) -> Block:
    return Block(items, window)


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[tuple[str, bytes], ...]]:
    """The items in id order, in blocks of at most BLOCK_WORDS words, one block at a time on the driver."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.col(text).alias("body")).where(F.col("body").isNotNull()).orderBy("name", "body")
    block: list[tuple[str, bytes]] = []
    size = 0
    for row in rows.toLocalIterator():
        body = row.body.encode()
        n = len(words_of(body))
        if block and size + n > BLOCK_WORDS:
            yield tuple(block)
            block, size = [], 0
        block.append((row.name, body))
        size += n
    yield tuple(block)


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def overlaps(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``word_spans`` (hit word ranges), ``byte_spans`` (the same in UTF-8 bytes) and ``item_ids`` (sorted strings).

    A window is ``window`` consecutive item words, or all words of a shorter item that has any. Null text has no words and no
    hits; a null item id is the empty string; repeated rows keep their own marks. Columns of ``docs`` named as a mark are
    replaced; the others pass through.
    """
    plain = docs.drop(*(f.name for f in MARKS))
    marked = plain
    for k, items_of_block in enumerate(item_blocks(items, item_id, item_text)):
        schema = T.StructType([*plain.schema, *MARKS])
        if k and k % CHAIN == 0:
            marked = stored(marked, "overlaps")
        marked = marked.mapInArrow(marker(items_of_block, window, text, first=k == 0), schema)
    return marked


def marker(items: tuple[tuple[str, bytes], ...], window: int, text: str, first: bool):
    """A pass that marks, or adds to the marks of, every row for one block of items."""
    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = block_of(items, window)
        span = pa.list_(pa.list_(pa.int32()))
        for batch in batches:
            body, offsets = byte_column(batch.column(batch.schema.get_field_index(text)))
            rows = len(batch)
            n_words = np.zeros(rows, np.int64)
            old = None if first else [batch.column(batch.schema.get_field_index(f.name)).to_pylist() for f in MARKS[1:]]
            word_spans, byte_spans, names = old or ([[] for _ in range(rows)], [[] for _ in range(rows)], [[] for _ in range(rows)])
            for low, high in slices(offsets):
                own = offsets[low:high + 1]
                hashes, ends = word_hashes(body[own[0]:own[-1]], own - own[0])
                n_words[low:high] = np.diff(ends, prepend=0)
                for row in np.flatnonzero(block.possible(hashes, ends)) + low:
                    lowered = body[offsets[row]:offsets[row + 1]].tobytes().lower()
                    places = [m.span() for m in WORD.finditer(lowered)]
                    spans, found = block.automaton.match([lowered[a:b] for a, b in places])
                    if spans:
                        word_spans[row] = merged(word_spans[row] + [list(s) for s in spans])
                        byte_spans[row] = [[places[a][0], places[b - 1][1]] for a, b in word_spans[row]]
                        names[row] = sorted({*names[row], *found})
            kept = batch.drop_columns([f.name for f in MARKS]) if not first else batch
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(n_words), pa.array(word_spans, span), pa.array(byte_spans, span), pa.array(names, pa.list_(pa.string()))],
                [*kept.schema.names, *(f.name for f in MARKS)])

    return mark


def hit_words() -> F.Column:
    return F.expr("aggregate(word_spans, 0L, (n, span) -> n + span[1] - span[0])")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, text: str = "text", **names: str) -> DataFrame:
    """``docs`` without the words that items share: hit spans are cut out of the text, white space around them is kept as it is.

    A document with more than ``max_coverage`` of its words hit goes as a whole. Documents without a hit pass
    unchanged, null texts too. Columns as in ``docs``.
    """
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.col(text).alias("body"))
    marked = overlaps(rows, items, window, "body", **names)
    kept = marked.where(hit_words() <= F.col("n_words") * max_coverage)
    raw = F.encode("body", "UTF-8")
    kept = kept.withColumn("parts", F.expr(
        "transform(sequence(0, size(byte_spans)), i -> struct(if(i = 0, 0, byte_spans[i - 1][1]) as low, if(i = size(byte_spans), 2147483647, byte_spans[i][0]) as high))"))
    rest = F.decode(F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, F.substring(raw, p["low"] + 1, p["high"] - p["low"]))), "UTF-8")
    cut = F.when(F.size("byte_spans") > 0, rest).otherwise(F.col("body"))
    return kept.select(*((cut if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns))
