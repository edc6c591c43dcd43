"""Secrets by a trigram inverted index.

Texts are indexed in blocks: for each trigram of a block (three UTF-8 bytes, A-Z in lower case) a posting lists the block's rows that hold it. Each
rule's pattern gives a Boolean trigram query; postings of a block are intersected and united to the rows that may match, and only those are
verified with the pattern. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_column, slices, stored
from .line_dedup import may_hold
from .trigram_query import evaluated, trigram_query, trigrams_of

#: Bytes and rows of a block of the index; a longer text is a block of its own.
BLOCK_BYTES, BLOCK_ROWS = 1 << 21, 1 << 12
#: Stands for the list of a block's rows among its trigrams.
ROWS = -1


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, not overlapping) count if ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(word: str) -> str:
    """A pattern for ``word`` with its ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = [either_case(word) for word in ("password", "passwd", "secret", "token")] + [f"{either_case('api')}_?{either_case('key')}"]
#: Runs of the last two kinds end only where another character follows, so their least length can stand in the pattern.
BASE_RULES = (
    Rule("assign", rf"""({"|".join(NAMES)})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Public formats of keys and tokens.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

INDEX = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("rows", T.IntegerType()), T.StructField("trigram", T.IntegerType()), T.StructField("posting", T.BinaryType())])
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
LOWER = np.arange(256, dtype=np.int64)
LOWER[65:91] += 32


def block_postings(body: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(trigrams, postings) of one block. A posting has the numbers of its rows, 16 bits each, or a bit for each row of the block, if that is not longer."""
    rows = len(offsets) - 1
    if len(body) < 3:
        return
    bits = max(1, int(rows - 1).bit_length())
    low = LOWER[body]
    row = np.repeat(np.arange(rows), np.diff(offsets))
    inside = row[:-2] == row[2:]
    codes = np.unique(((((low[:-2] << 8 | low[1:-1]) << 8 | low[2:]) << bits) | row[:-2])[inside])
    if not len(codes):
        return
    of, row = codes >> bits, codes & ((1 << bits) - 1)
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    counts = np.diff(np.r_[starts, len(codes)])
    dense = 2 * counts >= -(-rows // 8)
    words, ends = row.astype("<u2").tobytes(), 2 * (starts + counts)
    thin = np.flatnonzero(~dense)
    yield of[starts[thin]], [words[2 * s:e] for s, e in zip(starts[thin].tolist(), ends[thin].tolist(), strict=True)]
    thick = np.flatnonzero(dense)
    if len(thick):
        cells = np.zeros((len(thick), rows), np.uint8)
        cells[np.repeat(np.arange(len(thick)), counts[thick]), row[np.repeat(dense, counts)]] = 1
        yield of[starts[thick]], [x.tobytes() for x in np.packbits(cells, axis=1)]


def build_index(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The trigram index of ``docs``, kept in the shared folder: block, rows in the block, trigram, posting.

    ``key`` is a 64-bit column by which candidates are found again; each block has one entry more, its rows' keys. Null texts are empty; empty ones, and those
    of less than three bytes, have no trigrams. Other columns are not read. Every text is indexed whole.
    """

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                some = batch.slice(at, BLOCK_ROWS)
                body, offsets = byte_column(some.column("body"))
                keys = some.column("key").to_numpy(zero_copy_only=False).astype("<i8")
                for a, b in slices(offsets, BLOCK_BYTES):
                    for trigrams, postings in ((np.array([ROWS]), [keys[a:b].tobytes()]), *block_postings(body[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])):
                        n = len(postings)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, number)), pa.array(np.full(n, b - a, np.int32)), pa.array(trigrams.astype(np.int32)), pa.array(postings, pa.binary())], INDEX.names)
                    number += 1

    return stored(docs.select(F.col(key).alias("key"), F.col(text).alias("body")).mapInArrow(index, INDEX), "trigram-index")


def candidates(index: DataFrame, patterns: list[str]) -> DataFrame:
    """(key, mask): bit k is set if the text may match ``patterns[k]``; patterns without mandatory trigrams set none. One row a key."""
    queries = [trigram_query(p) for p in patterns]
    needed = sorted(set().union(*map(trigrams_of, queries)))
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("mask", T.LongType())])

    def rows_of(table: pa.Table) -> pa.Table:
        rows = table.column("rows")[0].as_py()
        found = dict(zip(table.column("trigram").to_pylist(), table.column("posting").to_pylist(), strict=True))

        def posting(trigram: int) -> np.ndarray:
            kept = found.get(trigram, b"")
            if len(kept) == -(-rows // 8):
                return np.unpackbits(np.frombuffer(kept, np.uint8), count=rows).astype(bool)
            out = np.zeros(rows, bool)
            out[np.frombuffer(kept, "<u2")] = True
            return out

        mask = np.zeros(rows, np.int64)
        for k, query in enumerate(queries):
            if query is not True:
                mask |= evaluated(query, posting, np.ones(rows, bool)).astype(np.int64) << k
        hit = mask != 0
        return pa.table({"key": np.frombuffer(found[ROWS], "<i8")[hit], "mask": mask[hit]})

    # A block is bounded, and so is what is read of it: the postings of the rules' own trigrams.
    some = index.where(F.col("trigram").isin([ROWS, *needed]))
    return some.groupBy("block").applyInArrow(rows_of, schema).groupBy("key").agg(F.bit_or("mask").alias("mask"))


def found_spans(text: str, rules: list[tuple[Rule, re.Pattern]], mask: int) -> list[dict]:
    """Spans (code points, end exclusive) of the rules that ``mask`` has, by start, then by the order of the rules."""
    spans = []
    for k, (rule, pattern) in enumerate(rules):
        if mask >> k & 1:
            for m in pattern.finditer(text):
                a, b = m.span(rule.group)
                if b - a >= rule.least:
                    spans.append((m.start(), k, m.end()))
    return [{"kind": rules[k][0].kind, "start": a, "end": b} for a, k, b in sorted(spans)]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end) of every match of every rule in the whole text, by start, then by the order of ``rules``.

    Null and empty texts have no spans; rows with a null id are scanned like others; repeated rows each keep their own spans; a column named ``spans``
    is replaced and other columns pass through. At most 62 rules. An empty table gives an empty table.
    """
    if len(rules) > 62:
        raise ValueError("at most 62 rules")
    plain = docs.drop("spans")
    rows = plain.select(F.struct(*plain.columns).alias("doc"), F.col(text).alias("body"), F.xxhash64(F.col(doc_id), F.xxhash64(F.col(text))).alias("cell"))
    patterns = [rule.pattern for rule in rules]
    full = sum(1 << k for k, p in enumerate(patterns) if trigram_query(p) is True)
    met = stored(candidates(build_index(rows.where(F.length("body") > 0), "cell", "body"), patterns), "secret-candidates")
    # Only texts that may be candidates are shuffled; the others go to the rules that scan fully.
    marked = may_hold(rows, "cell", met, "key")
    hit = marked.where("maybe").join(met, F.col("cell") == F.col("key"), "left").select("doc", "body", F.coalesce("mask", F.lit(0)).alias("mask"))
    todo = hit.unionByName(marked.where("not maybe").select("doc", "body", F.lit(0).cast("bigint").alias("mask")))
    out = T.StructType([T.StructField("doc", todo.schema["doc"].dataType), T.StructField("spans", SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(rule, re.compile(rule.pattern)) for rule in rules]
        for batch in batches:
            body, mask = batch.column("body"), batch.column("mask").to_pylist()
            spans = [found_spans(body[i].as_py() or "", compiled, mask[i] | full) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(spans, kind)], ["doc", "spans"])

    return todo.mapInArrow(scan, out).select("doc.*", "spans")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
