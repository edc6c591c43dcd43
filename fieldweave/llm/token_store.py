"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

Folder layout:

* ``shard-00000.bin``: the ids of a range of keys in ascending key order, raw little-endian unsigned integers of
  16 bits (vocabularies of up to 65,536 ids) or 32 bits; ``shard-00000.npz``: its keys and n + 1 id offsets.
* ``index-00000.npz``: for the keys of one hash bucket, a minimal perfect hash (levels of bit arrays with ranks) and, at each key's
  slot, a 32-bit fingerprint, the shard, the row in it and the number of rows with that key.
* ``manifest.json``: id width, end id, number of buckets, ids before each shard, rows without a key at the beginning of a shard.

A lookup costs one bucket, a bounded number of levels, one fingerprint, one offset: constant time, whatever the size.
Each file is written under a name of its own attempt and moved into place, so lost tasks can run again.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import RollingHash, mixed, ragged, scratch_folder, slices, stored

#: Words whose ids one worker remembers; when full it starts anew, so memory is bounded whatever the vocabulary of the corpus.
REMEMBERED = 400_000
#: Keys of one index file.
BUCKET_KEYS = 1 << 16
#: Bits of a level for each key.
GAMMA = 2.0
#: Code points below this are classed by table; a text with others goes through the library whole.
CLASSED = 0x250
#: White space of the pre-tokeniser in that range. Fixed values.
SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0]
OTHER, LETTER, NUMBER, SPACE = range(4)


# --- files ---------------------------------------------------------------------------------------------------------

def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """Any store pyarrow knows: local paths, file:, s3:, gs:, hdfs:."""
    folder = re.sub(r"^file:/+", "file:///", folder)
    return pafs.FileSystem.from_uri(folder) if re.match(r"\w+://", folder) else (pafs.LocalFileSystem(), folder)


def put(folder: str, name: str, body: bytes) -> None:
    system, path = file_system(folder)
    own = f"{path}/{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(body)
    system.move(own, f"{path}/{name}")


def get(folder: str, name: str) -> bytes:
    system, path = file_system(folder)
    with system.open_input_stream(f"{path}/{name}") as stream:
        return stream.read()


def packed(**arrays: np.ndarray) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    return buffer.getvalue()


def unpacked(body: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(body)) as arrays:
        return dict(arrays)


# --- encoding ------------------------------------------------------------------------------------------------------

@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    table = np.array([LETTER if chr(c).isalpha() else NUMBER if chr(c).isnumeric() else OTHER for c in range(CLASSED)], np.uint8)
    table[SPACES] = SPACE
    return table


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it prints, else the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def word_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of some texts begin. ``points``: their code points, all below CLASSED; no text is empty."""
    kind = classes()[points]
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[text_starts] = first[n] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    starts = run.copy()
    # The last character of white space before something else is a token of its own, or with what follows if it is a blank.
    after_space = np.flatnonzero(run & ~first[:n] & (np.r_[OTHER, kind[:-1]] == SPACE) & (kind != SPACE))
    starts[after_space - 1] = True
    joins = after_space[points[after_space - 1] == 32]
    starts[joins] = False
    # Contractions: an apostrophe alone, no blank before it, then one of the endings.
    padded = np.r_[points, np.zeros(3, points.dtype)]
    quote = np.flatnonzero(run & starts[:n] & (points == ord("'")))
    quote = quote[(quote + 1 < n)]
    quote = quote[run[quote + 1] & ~first[quote + 1]]
    a, b = padded[quote + 1], padded[quote + 2]
    same = (quote + 2 < n) & ~first[np.minimum(quote + 2, n)]
    two = same & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
    one = ~two & np.isin(a, [ord(x) for x in "stmd"])
    for chosen, size in ((one, 2), (two, 3)):
        at = quote[chosen]
        starts[at + 1] = False
        end = at + size
        end = end[end < n]
        starts[end[kind[end] == LETTER]] = True
    return np.flatnonzero(starts)


class Encoder:
    """Ids of many texts at once: distinct pre-tokens go through the tokenizers library, the rest is array work."""

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.width = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        plain = json.loads(self.library.to_str())
        # The split that word_starts() knows; any other tokenizer encodes whole texts.
        self.by_word = plain["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not plain["normalizer"]
        # The library cuts added tokens out before words: a text that holds one goes through it whole.
        added = [t for t in plain["added_tokens"] if t["content"]]
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
        self.letters = byte_letters()
        self.ids: dict[str, bytes] = {}

    def word_ids(self, word: str) -> bytes:
        known = self.ids.get(word)
        if known is None:
            if len(self.ids) >= REMEMBERED:
                self.ids.clear()
            spelled = word.encode().decode("latin-1").translate(self.letters)
            known = np.array([t.id for t in self.library.model.tokenize(spelled)], self.width).tobytes()
            if len(word) <= 64:
                self.ids[word] = known
        return known

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        points = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts]
        plain = [self.by_word and len(p) > 0 and int(p.max()) < CLASSED and not (self.added and self.added.search(t)) for t, p in zip(texts, points, strict=True)]
        parts: list[np.ndarray] = [np.zeros(0, self.width)] * len(texts)
        whole = [k for k, (p, ok) in enumerate(zip(points, plain, strict=True)) if len(p) and not ok]
        for k, coded in zip(whole, self.library.encode_batch([texts[k] for k in whole], add_special_tokens=False), strict=True):
            parts[k] = np.array(coded.ids, self.width)
        chosen = [k for k, ok in enumerate(plain) if ok]
        if chosen:
            for k, ids in zip(chosen, self.plain_texts([points[k] for k in chosen]), strict=True):
                parts[k] = ids
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def plain_texts(self, points: list[np.ndarray]) -> list[np.ndarray]:
        flat = np.concatenate(points)
        text_ends = np.cumsum([len(p) for p in points])
        starts = word_starts(flat, np.r_[0, text_ends[:-1]])
        ends = np.r_[starts[1:], len(flat)]
        hashes = RollingHash(mixed(flat.astype(np.uint64) + np.uint64(1))).ranges(starts, ends)
        _, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        text = flat.astype("<u4").tobytes().decode("utf-32-le")
        coded = [self.word_ids(text[s:e]) for s, e in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]
        sizes = np.array([len(c) for c in coded], np.int64) // self.width.itemsize
        body, at = np.frombuffer(b"".join(coded), self.width), np.cumsum(sizes) - sizes
        of_word = sizes[which]
        ids = body[np.repeat(at[which], of_word) + ragged(of_word)]
        id_ends = np.cumsum(of_word)
        cuts = id_ends[np.searchsorted(starts, text_ends) - 1]
        return np.split(ids, cuts[:-1])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# --- minimal perfect hash ------------------------------------------------------------------------------------------

def key_hash(keys: np.ndarray) -> np.ndarray:
    """One to one, so different keys never share a hash."""
    return mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(0x1234567))


def level_places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return mixed(hashes ^ mixed(np.array([level + 1], np.uint64))) % np.uint64(size)


def build_perfect_hash(hashes: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(arrays, slot of each hash). A key that meets no other at its place of a level stays there; the rest go on to the next level."""
    words, sizes, level, left = [], [], 0, np.arange(len(hashes))
    taken = []
    while len(left):
        size = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
        places = level_places(hashes[left], level, size)
        alone = np.bincount(places.astype(np.int64), minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(size)
        taken.append(left[alone[places]])
        left = left[~alone[places]]
        level += 1
    bits = np.concatenate(words) if words else np.zeros(0, "<u8")
    counts = np.bitwise_count(bits).astype(np.int64)
    arrays = {"bits": bits, "ranks": np.cumsum(counts) - counts, "sizes": np.array(sizes, np.int64)}
    return arrays, find_slots(arrays, hashes)


def find_slots(arrays: dict[str, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Slot of each hash, -1 where no level has it. A foreign key may get some slot: compare fingerprints."""
    slots = np.full(len(hashes), -1, np.int64)
    left, base = np.arange(len(hashes)), 0
    for level, size in enumerate(arrays["sizes"].tolist()):
        if not len(left):
            break
        places = level_places(hashes[left], level, size).astype(np.int64) + base
        word, bit = arrays["bits"][places >> 6], (places & 63).astype(np.uint64)
        hit = (word >> bit) & np.uint64(1) == 1
        below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
        slots[left[hit]] = (arrays["ranks"][places >> 6] + below)[hit]
        left, base = left[~hit], base + size
    return slots


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes ^ np.uint64(0xF1F2F3F4F5F6F7F8)) >> np.uint64(32)).astype(np.uint32)


# --- write and read ------------------------------------------------------------------------------------------------

def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


ENTRIES = "key long, shard int, row long, id_offset long, n_tokens long"


def write(docs: DataFrame, tokenizer_path: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 0, shards: int | None = None) -> str:
    """Write the ids of ``docs`` in ascending key order, ``end_id`` after each text; return the folder.

    ``key`` must be integral; the key of each row is read as a 64-bit integer. A null key sorts first: such rows are stored and come
    back from ``scan`` and ``unkeyed``, and no key finds them. Rows with equal keys are all stored, ordered by text, and one key finds them all.
    Null and empty texts have the end id only. An empty table gives an empty store. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or scratch_folder(spark, "tokens")
    system, path = file_system(folder)
    system.create_dir(path)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    dealt = rows.repartitionByRange(shards or int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("key").asc_nulls_first())
    ordered = dealt.sortWithinPartitions(F.col("key").asc_nulls_first(), "body")

    def write_shard(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encode = TaskContext.get().partitionId(), encoder(tokenizer_path)
        store, place = file_system(folder)
        own, out = f"{place}/shard-{shard:05d}.bin.{uuid.uuid4().hex}", None
        end, keys, valid, sizes = np.array([end_id], encode.width), [], [], []
        for batch in batches:
            bodies, lengths = batch.column("body"), None
            lengths = np.r_[0, np.cumsum(pa.compute.binary_length(bodies).to_numpy(zero_copy_only=False))]
            for low, high in slices(lengths):
                ids, counts = encode(bodies[low:high].to_pylist())
                out = out or store.open_output_stream(own)
                out.write(np.insert(ids, np.cumsum(counts), end[0]).tobytes())
                sizes.append(counts + 1)
            keys.append(batch.column("key").fill_null(0).to_numpy(zero_copy_only=False))
            valid.append(batch.column("key").is_valid().to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        counts, all_keys, known = np.concatenate(sizes), np.concatenate(keys), np.concatenate(valid)
        offsets = np.r_[0, np.cumsum(counts)]
        put(folder, f"shard-{shard:05d}.npz", packed(keys=all_keys, valid=known, offsets=offsets))
        store.move(own, f"{place}/shard-{shard:05d}.bin")
        n = len(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(all_keys, mask=~known), pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(n)), pa.array(offsets[:-1]), pa.array(counts)],
            ["key", "shard", "row", "id_offset", "n_tokens"])

    entries = stored(ordered.mapInArrow(write_shard, ENTRIES), "token-entries")
    # One row a shard on the driver.
    sums = entries.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("key").isNull()).alias("unkeyed")).collect()
    totals = {r.shard: (r.n, r.rows) for r in sums}
    before, base = {}, 0
    for shard in sorted(totals):
        before[shard] = base
        base += totals[shard][0]
    buckets = max(1, -(-sum(rows for _, rows in totals.values()) // BUCKET_KEYS))

    def write_index(part: pa.Table) -> pa.Table:
        hashes = key_hash(part.column("key").to_numpy())
        arrays, slots = build_perfect_hash(hashes)
        order = np.argsort(slots)
        number = part.column("bucket")[0].as_py()
        put(folder, f"index-{number:05d}.npz", packed(
            **arrays, fingerprints=fingerprints(hashes)[order], shards=part.column("shard").to_numpy()[order],
            rows=part.column("row").to_numpy()[order], runs=part.column("run").to_numpy()[order]))
        return pa.table({"bucket": pa.array([number], pa.int32()), "n_keys": pa.array([part.num_rows], pa.int64())})

    keyed = entries.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("shard").alias("shard"), F.min("row").alias("row"), F.count(F.lit(1)).alias("run"))
    built = keyed.withColumn("bucket", bucket_of(F.col("key"), buckets)).groupBy("bucket").applyInArrow(write_index, "bucket int, n_keys long")
    indexed = built.agg(F.sum("n_keys")).first()[0] or 0
    width = encoder(tokenizer_path).width
    put(folder, "manifest.json", json.dumps({
        "id_dtype": width.str, "end_id": end_id, "buckets": buckets, "n_keys": indexed, "n_rows": sum(rows for _, rows in totals.values()), "n_tokens": base,
        "ids_before_shard": before, "unkeyed": {r.shard: r.unkeyed for r in sums if r.unkeyed}}).encode())
    return folder


@lru_cache(maxsize=8)
def index_file(folder: str, bucket: int) -> dict[str, np.ndarray] | None:
    system, path = file_system(folder)
    name = f"index-{bucket:05d}.npz"
    return unpacked(get(folder, name)) if system.get_file_info(f"{path}/{name}").type == pafs.FileType.File else None


def manifest(folder: str) -> dict:
    return json.loads(get(folder, "manifest.json"))


def find(folder: str, keys: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, first row, number of rows) of each key; 0 rows where the store lacks it."""
    shard, row, run = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for bucket in np.unique(buckets).tolist():
        index = index_file(folder, bucket)
        if index is None:
            continue
        of = np.flatnonzero(buckets == bucket)
        hashes = key_hash(keys[of])
        slots = find_slots(index, hashes)
        found = slots >= 0
        found[found] = index["fingerprints"][slots[found]] == fingerprints(hashes[found])
        at, slots = of[found], slots[found]
        shard[at], row[at], run[at] = index["shards"][slots], index["rows"][slots], index["runs"][slots]
    return shard, row, run


FOUND = "key long, shard int, row long, run long"
ROWS = "key long, start long, n_tokens long, ids binary"


def lookup(keys: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """The stored rows of some keys: ``key``, ``start`` (ids of all rows before it), ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit).

    Repeated and null keys in ``keys`` count once and not at all. A key that the store lacks has no row; a foreign key gets past the
    fingerprint once in 2 ** 32, so the key beside the offset is compared too.
    """
    about = manifest(folder)
    asked = keys.select(F.col(key).cast("bigint").alias("key")).where(F.col("key").isNotNull()).distinct()
    # AQE may join buckets in one task, never split one: its rows are keys only.
    dealt = asked.withColumn("bucket", bucket_of(F.col("key"), about["buckets"])).repartition("bucket").sortWithinPartitions("bucket")

    def find_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("key").to_numpy()
            shard, row, run = find(folder, wanted, batch.column("bucket").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (wanted, shard, row, run)], ["key", "shard", "row", "run"]).filter(pa.array(run > 0))

    places = dealt.mapInArrow(find_rows, FOUND)
    return payload(places.repartition("shard").sortWithinPartitions("shard", "row"), folder, about).withColumnRenamed("key", key)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored row in the columns of ``lookup``, null keys included."""
    about = manifest(folder)
    shards = spark.createDataFrame([(None, int(s), -1, 0) for s in about["ids_before_shard"]], FOUND)
    return payload(shards.repartition(max(1, len(about["ids_before_shard"])), "shard"), folder, about)


def unkeyed(spark: SparkSession, folder: str) -> DataFrame:
    """The stored rows with a null key, in the columns of ``lookup``. They come first in their shards, so nothing else is read."""
    about = manifest(folder)
    shards = spark.createDataFrame([(None, int(s), -1, n) for s, n in about["unkeyed"].items()], FOUND)
    return payload(shards.repartition(max(1, len(about["unkeyed"])), "shard"), folder, about)


def payload(places: DataFrame, folder: str, about: dict) -> DataFrame:
    width = np.dtype(about["id_dtype"])
    before = {int(s): n for s, n in about["ids_before_shard"].items()}

    def read_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = file_system(folder)
        current, side, stream = None, {}, None
        for batch in batches:
            shards, rows, runs = (batch.column(name).to_numpy() for name in ("shard", "row", "run"))
            for shard in np.unique(shards).tolist():
                if shard != current:
                    current, side = shard, unpacked(get(folder, f"shard-{shard:05d}.npz"))
                    stream = store.open_input_file(f"{place}/shard-{shard:05d}.bin")
                of = shards == shard
                first, n = rows[of], runs[of]
                if len(first) and first[0] < 0:
                    first, n = np.zeros(1, np.int64), np.array([n[0] or len(side["keys"])])
                else:
                    asked = batch.column("key").to_numpy()[of]
                    own = side["valid"][first] & (side["keys"][first] == asked)
                    first, n = first[own], n[own]
                wanted = np.repeat(first, n) + ragged(n)
                offsets = side["offsets"]
                for low in range(0, len(wanted), 512):
                    some = wanted[low:low + 512]
                    if not len(some):
                        continue
                    # Rows come in order, so one read spans them unless they are far apart.
                    ids, sizes = [], offsets[some + 1] - offsets[some]
                    breaks = np.flatnonzero(np.diff(some) > 64) + 1
                    for group in np.split(some, breaks):
                        a, b = int(offsets[group[0]]), int(offsets[group[-1] + 1])
                        block = np.frombuffer(stream.read_at((b - a) * width.itemsize, a * width.itemsize), width)
                        ids += [block[s - a:e - a] for s, e in zip(offsets[group].tolist(), offsets[group + 1].tolist(), strict=True)]
                    flat = np.concatenate(ids).astype("<u4")
                    bytes_ends = np.r_[0, np.cumsum(sizes)].astype(np.int32) * 4
                    body = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(bytes_ends), pa.py_buffer(flat)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(side["keys"][some], mask=~side["valid"][some]), pa.array(before[shard] + offsets[some]), pa.array(sizes), body],
                        ["key", "start", "n_tokens", "ids"])

    return places.mapInArrow(read_rows, ROWS)
