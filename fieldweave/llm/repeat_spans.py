"""Removal of long repeated byte strings, by suffix arrays of the places that can repeat.

Every string of ``length`` bytes picks an anchor among its inner strings of ANCHOR bytes: the leftmost with the least hash. Equal strings
pick equal anchors, so a string whose anchor occurs once in the corpus occurs once itself. Neighbouring strings with one anchor form a stretch.
Stretches whose anchors repeat are compared: where all are equal, all their strings repeat; the others are laid end to end, a suffix array
of them is built (``suffix_order``), and suffixes that share their first ``length`` bytes with a neighbour in it are the repeats. Every string of a stretch
holds the anchor whole, and equal ones hold it at the same place, so the anchor is one symbol there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, byte_codes, byte_column, mixed, slices, stored
from .jaccard_join import filter_of, passes
from .suffix_order import suffix_order

#: Bytes of an anchor, as a share of the length: long ones let few unlike stretches meet, short ones make few anchors.
ANCHOR_SHARE = 0.7
#: Different stretches of one anchor that one suffix array takes, and bytes that share one. Larger groups are compared string by string.
GROUP, BLOCK = 2_048, 1 << 18
PLACE_BITS = 23
SALTS = 8


def leftmost_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes, the place of the leftmost least one (by its upper bits)."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    keyed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        keyed = np.minimum(keyed[:-size], keyed[size:])
        size *= 2
    if width > size:
        keyed = np.minimum(keyed[:len(keyed) - (width - size)], keyed[width - size:])
    return (keyed & low).astype(np.int64)


def stretches(body: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, place of the first string in ``body``, strings, step, times, bytes before the anchor, anchor hash, content hash): stretches of strings with one anchor.

    In periodic text a stretch repeats at a fixed step; such runs are one row with ``times`` > 1.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(6)) + (np.zeros(0, np.uint64),) * 2
    if len(body) < length:
        return none
    rolling = RollingHash(byte_codes()[body])
    places = leftmost_minima(rolling.windows(anchor), length - anchor + 1)
    starts = np.arange(len(places))
    text = np.searchsorted(offsets, starts, "right") - 1
    fits = starts + length <= offsets[1:][text]
    starts, text, places = starts[fits], text[fits], places[fits]
    if not len(starts):
        return none
    new = np.r_[True, (places[1:] != places[:-1]) | (text[1:] != text[:-1])]
    at = np.flatnonzero(new)
    count = np.diff(np.r_[at, len(starts)])
    low, place, of = starts[at], places[at], text[at]
    key = mixed(rolling.ranges(place, place + anchor) + np.uint64(11))
    content = mixed(rolling.ranges(low, low + count - 1 + length) ^ mixed((place - low).astype(np.uint64) + np.uint64(3)))
    gap = np.diff(low, prepend=-1)
    alike = np.r_[False, (of[1:] == of[:-1]) & (key[1:] == key[:-1]) & (content[1:] == content[:-1])]
    go_on = alike & np.r_[False, (gap[1:] == gap[:-1]) | ~alike[:-1]]
    head = np.flatnonzero(~go_on)
    times = np.diff(np.r_[head, len(low)])
    step = np.where(times > 1, gap[np.minimum(head + 1, len(low) - 1)], 0)
    return of[head], low[head], count[head], step, times, (place - low)[head], key[head], content[head]


def text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text. All that is found about a text depends on the text alone, so rows with equal texts share it."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


STRETCHES = "k1 long, k2 long, first int, strings int, step int, times int, inner int, anchor long, content long"


def all_stretches(rows: DataFrame, length: int) -> DataFrame:
    anchor = max(1, int(length * ANCHOR_SHARE))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = byte_column(batch.column("body"))
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for low, high in slices(offsets):
                own, base = body[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
                # A text beyond the slice goes in overlapping parts; strings at the seam belong to one part each.
                part = 1 << (PLACE_BITS - 1)
                for at in range(0, max(1, len(own) - length + 1), part):
                    piece = own[at:at + part + length - 1]
                    text, place, strings, step, times, inner, key, content = stretches(piece, np.clip(base - at, 0, len(piece)), length, anchor)
                    first = place + at - base[text]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k1[text + low]), pa.array(k2[text + low]), *(pa.array(x.astype(np.int32)) for x in (first, strings, step, times, inner)), pa.array(key.view(np.int64)), pa.array(content.view(np.int64))],
                        ["k1", "k2", "first", "strings", "step", "times", "inner", "anchor", "content"])

    return rows.mapInArrow(find, STRETCHES)


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """(k1, k2, spans): byte ranges that repeated strings cover, for every text that has some. ``rows``: k1, k2, body."""
    found = stored(all_stretches(rows, length), "stretches")
    per_anchor = found.groupBy("anchor").agg(F.sum("times").alias("n"), F.min("content").alias("low"), F.max("content").alias("high")).where("n > 1")
    mixed_anchor = F.col("low") != F.col("high")
    hot = stored(found.join(per_anchor.select("anchor", mixed_anchor.alias("unlike")), "anchor"), "hot-stretches")
    whole = hot.where(~F.col("unlike")).select("k1", "k2", "first", "strings", "step", "times", F.lit(None).cast("array<int>").alias("parts"))

    # Anchors with different stretches: one of each is compared with the others.
    of_content = ["anchor", "content"]
    unlike = hot.where("unlike")
    one = unlike.groupBy(*of_content).agg(F.sum("times").alias("n"), F.min(F.struct("k1", "k2", "first", "strings", "inner")).alias("at"))
    sizes = one.groupBy("anchor").agg(F.count(F.lit(1)).alias("members"))
    one = stored(one.join(sizes, "anchor").select("anchor", "content", "n", "members", "at.*"), "one-of-each")
    bodies = stored(with_bytes(one, rows, length), "stretch-bytes")
    verdicts = stored(by_suffix_array(bodies.where(F.col("members") <= GROUP), length).unionByName(by_strings(bodies.where(F.col("members") > GROUP), length)), "verdicts")
    # A run in periodic text repeats as a whole.
    parts = F.when(F.col("times") == 1, F.col("parts")).alias("parts")
    judged = unlike.join(verdicts, of_content).select("k1", "k2", "first", "strings", "step", "times", parts)

    # Byte spans of each stretch: all its strings, or the runs of strings in parts (pairs of first and last).
    reach = length - 1
    covered = F.when(
        F.col("parts").isNull(),
        F.array(F.struct(F.col("first").alias("low"), (F.col("first") + (F.col("times") - 1) * F.col("step") + F.col("strings") + reach).alias("high")))
    ).otherwise(F.expr(
        f"transform(sequence(0, size(parts) div 2 - 1), i -> struct(first + parts[2 * i] as low, first + parts[2 * i + 1] + 1 + {reach} as high))"))
    spans = whole.unionByName(judged).select("k1", "k2", F.explode(covered).alias("span"))
    return spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("span")).alias("spans"))


def with_bytes(one: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """(anchor, content, n, members, inner, body): the bytes of one stretch of each content, without its anchor, which stands after ``inner`` bytes."""
    anchor = max(1, int(length * ANCHOR_SHARE))
    wanted = one.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "content", "n", "members", "first", "strings", "inner")).alias("asked"))
    wanted = stored(wanted, "asked")
    bits = filter_of(wanted, "k1")
    picked = rows.mapInArrow(only(bits), rows.schema).join(wanted, ["k1", "k2"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, bodies = batch.column("asked"), batch.column("body")
            for at in range(len(batch)):
                body = (bodies[at].as_py() or "").encode()
                some = asked[at].as_py()
                yield pa.RecordBatch.from_pylist(
                    [{**{c: a[c] for c in ("anchor", "content", "n", "members", "inner")},
                      "body": body[a["first"]:a["first"] + a["inner"]] + body[a["first"] + a["inner"] + anchor:a["first"] + a["strings"] - 1 + length]} for a in some],
                    schema=CUT)

    return picked.mapInArrow(cut, "anchor long, content long, n long, members long, inner int, body binary").dropDuplicates(["anchor", "content"])


CUT = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("n", pa.int64()), ("members", pa.int64()), ("inner", pa.int32()), ("body", pa.binary())])
VERDICTS = "anchor long, content long, parts array<int>"


def only(bits: np.ndarray):
    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bits, batch.column("k1").to_numpy())))

    return keep


def runs(flags: np.ndarray) -> list[int]:
    """First and last of each run of true flags, flattened."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.c_[np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1].ravel().tolist()


def repeats_in(bodies: list[tuple[int, int, bytes]], rest: int) -> list[np.ndarray]:
    """For each body (anchor, bytes before it, bytes without it), which of its strings start elsewhere too, in any body. A string has ``rest`` bytes besides its anchor."""
    # Each body is its bytes, a symbol for the anchor in its place, and an end.
    sizes = np.array([len(b) + 2 for _, _, b in bodies])
    symbols = np.empty(sizes.sum(), np.int64)
    base = np.cumsum(sizes) - sizes
    count, number = len(bodies), {}
    for k, (at, (anchor, inner, body)) in enumerate(zip(base.tolist(), bodies, strict=True)):
        raw = np.frombuffer(body, np.uint8).astype(np.int64) + count
        symbols[at:at + inner] = raw[:inner]
        symbols[at + inner] = count + 256 + number.setdefault(anchor, len(number))
        symbols[at + inner + 1:at + len(raw) + 1] = raw[inner:]
        symbols[at + len(raw) + 1] = count - 1 - k  # ends differ, so no match crosses one; the last is the least
    data, width = symbols.tobytes(), 8 * (rest + 1)
    order = np.array(suffix_order(symbols))
    owner = np.searchsorted(base, order, "right") - 1
    begins = order[order - base[owner] + rest + 1 < sizes[owner]]
    repeated = np.zeros(len(symbols), bool)
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if data[8 * a:8 * a + width] == data[8 * b:8 * b + width]:
            repeated[a] = repeated[b] = True
    return [repeated[at:at + max(0, size - rest - 1)] for at, size in zip(base.tolist(), sizes.tolist(), strict=True)]


def by_suffix_array(bodies: DataFrame, length: int) -> DataFrame:
    """Which strings of each stretch repeat, anchor by anchor; small groups share a suffix array. A byte costs much here, so the number of tasks is given, not left to their size."""
    rest = length - max(1, int(length * ANCHOR_SHARE))
    tasks = 4 * int(bodies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes]] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "n", "inner", "body")), strict=True):
                if size >= BLOCK and row[0] != last:
                    yield verdict(held, rest)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[4]), row[0]
        if held:
            yield verdict(held, rest)

    return bodies.repartition(tasks, "anchor").sortWithinPartitions("anchor", "content").mapInArrow(judge, VERDICTS)


def verdict(held: list[tuple[int, int, int, int, bytes]], rest: int) -> pa.RecordBatch:
    found = repeats_in([(row[0], row[3], row[4]) for row in held], rest)
    parts = [runs(np.ones(len(flags), bool) if row[2] > 1 else flags) for row, flags in zip(held, found, strict=True)]
    kept = [k for k, p in enumerate(parts) if p]
    return pa.RecordBatch.from_arrays(
        [pa.array([held[k][0] for k in kept], pa.int64()), pa.array([held[k][1] for k in kept], pa.int64()), pa.array([parts[k] for k in kept], pa.list_(pa.int32()))], ["anchor", "content", "parts"])


def by_strings(bodies: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many different stretches, without a group: strings are counted by their digest, each stretch's strings packed in one row."""
    rest = length - max(1, int(length * ANCHOR_SHARE))

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, content, n, inner, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "n", "inner", "body")), strict=True):
                # The place of the anchor stands for the anchor.
                found = [hashlib.blake2b(body[a:a + rest], digest_size=16, salt=(inner - a).to_bytes(8, "little")).digest() for a in range(len(body) - rest + 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor], pa.int64()), pa.array([content], pa.int64()), pa.array([n], pa.int64()), pa.array([found], pa.list_(pa.binary()))], ["anchor", "content", "n", "digests"])

    packed = stored(bodies.mapInArrow(digests, "anchor long, content long, n long, digests array<binary>"), "digests")
    each = packed.select("anchor", "content", "n", F.posexplode("digests").alias("at", "digest"))
    twice = each.groupBy("anchor", "digest").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "digest")
    flagged = each.join(twice, ["anchor", "digest"]).groupBy("anchor", "content").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    return flagged.select("anchor", "content", F.flatten(F.transform("ats", lambda a: F.array(a, a))).alias("parts"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in spans:
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def remove_repeats(docs: DataFrame, length: int = 400, text: str = "text", kept: str = "kept", spans: str = "spans") -> DataFrame:
    """``docs`` with ``kept`` (binary: the UTF-8 bytes that no repeated string covers) and ``spans`` (the removed byte ranges, merged).

    A string of ``length`` bytes repeats if it starts anywhere else too, in the same text or another row, overlapping or not; repeated
    rows repeat each other. Null text is empty. Texts below ``length`` bytes stay as they are. A cut may fall inside a character. Columns named
    ``kept`` or ``spans`` are replaced, the others pass through.
    """
    plain = docs.drop(kept, spans)
    rows = plain.select(F.struct(*(F.col(c) for c in plain.columns)).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    keyed = rows.select("row", *text_keys(F.col("body")), "body")
    found = stored(repeated_spans(keyed.select("k1", "k2", "body"), length), "spans")
    bits = filter_of(found, "k1")

    # Rows that may have spans meet them by text; a text that very many rows share is dealt over SALTS tasks.
    def side(flag: bool):
        def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(passes(bits, batch.column("k1").to_numpy()) == flag))
        return pick

    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*(F.col("row").getField(c) for c, kind in plain.dtypes if not kind.startswith("map"))), F.lit(SALTS)).cast("int")
    hit = keyed.mapInArrow(side(True), keyed.schema).withColumn("salt", salt).join(salted, ["k1", "k2", "salt"], "left").select("row", "body", "spans")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                rest, gone = [], []
                for body, spans_of in zip(some.column("body").to_pylist(), some.column("spans").to_pylist(), strict=True):
                    raw = body.encode()
                    ranges = merged([(s["low"], s["high"]) for s in spans_of or []])
                    bounds = [0, *(x for r in ranges for x in r), len(raw)]
                    rest.append(b"".join(raw[bounds[k]:bounds[k + 1]] for k in range(0, len(bounds), 2)))
                    gone.append([list(r) for r in ranges])
                yield pa.RecordBatch.from_arrays([some.column("row"), pa.array(rest, pa.binary()), pa.array(gone, pa.list_(pa.list_(pa.int32())))], ["row", "kept", "spans"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, kept binary, spans array<array<int>>"
    clean = keyed.mapInArrow(side(False), keyed.schema).select("row", F.encode("body", "UTF-8").alias("kept"), F.expr("cast(array() as array<array<int>>)").alias("spans"))
    return hit.mapInArrow(cut, schema).unionByName(clean).select("row.*", F.col("kept").alias(kept), F.col("spans").alias(spans))
