"""Set similarity join of word shingles with adaptive multi-match prefixes.

Shingles are ordered by an estimate of their frequency, rare ones first (any fixed order is right, this one is cheap). Two sets can only
link if their prefixes, lengthened by l - 1, share l shingles; each document picks its l by the estimated cost of its candidates.

Groups of near copies share nearly all shingles, so no prefix tells their members apart. Such documents are tied to a hub (the most
typical document with an equal min-hash); pairs that share a hub are joined on what each one changed against the hub, which is rare,
and pairs that both link to the hub need no join at all. Sets that are equal count as one. All steps are exact: estimates and hubs decide the cost only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RollingHash, byte_codes, byte_column, mixed, slices, stored
from .components import connected

#: Cells of the frequency sketch and bits of the filters; fixed sizes whatever the input, as they are sent to every task.
SKETCH_BITS, FILTER_BITS = 19, 25
#: Rows of a sketch: cells of each.
SKETCH_ROW = 1 << 14
#: Longest lengthening of a prefix, and the cost of verifying a candidate against reading one posting.
MOST_MATCHES, VERIFY_COST = 4, 50
#: Min-hashes that look for hubs; how alike a document and its hub must be (per cent).
SEEDS, HUB_PERCENT = 4, 50
#: How often a document's choice of a hub is followed to that hub's own choice.
JUMPS = 2


def shingle_sets(body: np.ndarray, offsets: np.ndarray, words: int, byte_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text, text after text, ascending; n + 1 offsets)."""
    n = len(offsets) - 1
    if not len(body):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    lower = np.frombuffer(bytes(range(256)).lower(), np.uint8)
    inside = byte_class[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    hashes = RollingHash(byte_codes()[lower[body]]).ranges(starts, ends)
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    text = np.repeat(np.arange(n), n_words)
    place = np.arange(len(hashes)) - first[:-1][text]
    left = n_words[text] - place
    opens = (left >= words) | (place == 0)
    at = np.flatnonzero(opens)
    total = np.zeros(len(at), np.uint64)
    for k in range(words):
        here = k < left[at]
        follow = hashes[np.minimum(at + k, len(hashes) - 1)]
        total = np.where(here, mixed(total * np.uint64(31) + follow + np.uint64(k)), total)
    of = text[at]
    order = np.lexsort((total, of))
    total, of = total[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (total[1:] != total[:-1]) | (of[1:] != of[:-1])
    total, of = total[new], of[new]
    return total, np.r_[0, np.cumsum(np.bincount(of, minlength=n))]


def word_bytes() -> np.ndarray:
    """Bytes that belong to words: all but white space. Fixed by the contract."""
    part = np.ones(256, bool)
    part[[0x20, *range(0x09, 0x0E)]] = False
    return part


def batch_sets(batch: pa.RecordBatch, text: str, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, offsets) slice by slice."""
    body, offsets = byte_column(batch.column(batch.schema.get_field_index(text)))
    part = word_bytes()
    for low, high in slices(offsets):
        yield low, *shingle_sets(body[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], words, part)


# --- fixed-size summaries -------------------------------------------------------------------------------------------

def summed(parts: DataFrame, dtype: str, combine: str) -> dict[int, np.ndarray]:
    """Cells by row number from (row, cells): rows with equal number are added or or-ed, a few at a time."""
    def add(part: pa.Table) -> pa.Table:
        total = None
        for cells in part.column("cells"):
            own = np.frombuffer(cells.as_py(), dtype)
            total = own.copy() if total is None else np.add(total, own, out=total) if combine == "add" else np.bitwise_or(total, own, out=total)
        return pa.table({"row": part.column("row")[:1], "cells": pa.array([total.tobytes()], pa.binary())})

    # Two steps, so that no group has a row for every task.
    salted = parts.withColumn("salt", F.spark_partition_id() % 32).groupBy("row", "salt").applyInArrow(lambda part: add(part.drop_columns(["salt"])), "row int, cells binary")
    rows = salted.groupBy("row").applyInArrow(add, "row int, cells binary").orderBy("row").collect()
    return {r.row: np.frombuffer(bytes(r.cells), dtype) for r in rows}


def frequency_sketch(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """How many documents have a shingle of each cell. 2 MB, whatever the input."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, hashes, _ in batch_sets(batch, text, words):
                cells += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(cells))
        rows = cells.astype("<i4").reshape(-1, SKETCH_ROW)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([rows[k].tobytes() for k in used], pa.binary())], ["row", "cells"])

    found = summed(docs.select(text).mapInArrow(count, "row int, cells binary"), "<i4", "add")
    out = np.zeros(1 << SKETCH_BITS, np.int32)
    for row, cells in found.items():
        out[row * SKETCH_ROW:(row + 1) * SKETCH_ROW] = cells
    return out


def filter_of(keys: DataFrame, column: str) -> np.ndarray:
    """A bit for each hash cell that some key falls in. 4 MB, whatever the input; foreign keys may share a cell."""
    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[cells_of(batch.column(column).to_numpy())] = True
        rows = np.packbits(bits).reshape(-1, SKETCH_ROW)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([rows[k].tobytes() for k in used], pa.binary())], ["row", "cells"])

    found = summed(keys.select(column).mapInArrow(mark, "row int, cells binary"), "u1", "or")
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row, cells in found.items():
        out[row * SKETCH_ROW:(row + 1) * SKETCH_ROW] = cells
    return out


def cells_of(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(99)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cells = cells_of(keys)
    return (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1


# --- documents ------------------------------------------------------------------------------------------------------

def overlap_needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n with any set it links to."""
    return -(-percent * n // 100)


DOCUMENTS = "id long, n long, sig_a long, sig_b long, typical double, minima array<long>, matches int, prefix array<long>"


def describe(docs: DataFrame, text: str, words: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """Size, signature, min-hashes, own number of matches and prefix (rare first) of each document's set."""
    noise = float(sketch.mean())
    spread = np.sqrt(noise) + 1.0

    def one(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for low, hashes, offsets in batch_sets(batch, text, words):
                n = np.diff(offsets)
                rows = len(n)
                excess = np.maximum(sketch[hashes >> np.uint64(64 - SKETCH_BITS)] - noise - 2 * spread, 0.0)
                kind = np.log2(1 + excess / (4 * spread)).astype(np.int64)
                of = np.repeat(np.arange(rows), n)
                order = np.lexsort((hashes, kind, of))
                ordered, cost = hashes[order], np.r_[0, np.cumsum(excess[order])]
                matches, lengths = np.ones(rows, np.int32), np.zeros(rows, np.int64)
                base = n - overlap_needed(n, percent)
                best = np.full(rows, np.inf)
                for k in range(1, MOST_MATCHES + 1):
                    lengths = np.minimum(base + k, n)
                    postings = cost[offsets[:-1] + lengths] - cost[offsets[:-1]]
                    total = postings * (1 + VERIFY_COST / k) + k
                    matches = np.where(total < best, k, matches)
                    best = np.minimum(best, total)
                codes = mixed(hashes + np.uint64(5))
                with np.errstate(over="ignore"):
                    sums_a, sums_b = (np.r_[np.uint64(0), np.cumsum(x)] for x in (codes, mixed(codes ^ np.uint64(0xABCDEF))))
                minima = np.zeros((rows, SEEDS), np.uint64)
                full = n > 0
                for k in range(SEEDS):
                    if len(hashes):
                        minima[full, k] = np.minimum.reduceat(mixed(hashes + np.uint64(k + 77)), offsets[:-1][full])
                typical = (cost[offsets[1:]] - cost[offsets[:-1]]) / np.maximum(n, 1)
                prefix = [ordered[a:a + size].view(np.int64) for a, size in zip(offsets[:-1], lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    ids[low:low + rows], pa.array(n), pa.array((sums_a[offsets[1:]] - sums_a[offsets[:-1]]).view(np.int64)), pa.array((sums_b[offsets[1:]] - sums_b[offsets[:-1]]).view(np.int64)),
                    pa.array(typical), pa.array(list(minima.view(np.int64)), pa.list_(pa.int64())), pa.array(matches), pa.array(prefix, pa.list_(pa.int64()))],
                    ["id", "n", "sig_a", "sig_b", "typical", "minima", "matches", "prefix"])

    return docs.mapInArrow(one, DOCUMENTS)


def with_texts(pairs: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``pairs`` (a, b) with the texts of both; only documents that a pair names are shuffled, but for some that share a filter cell."""
    named = filter_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id")

    def only(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(named, batch.column("id").to_numpy())))

    texts = docs.mapInArrow(only, docs.schema)
    return pairs.join(texts.select(F.col("id").alias("a"), F.col(text).alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col(text).alias("text_b")), "b")


def compared(pairs: DataFrame, words: int, percent: int, flip: bool) -> DataFrame:
    """(a, b, n_a, n_b, linked, added, gone): sizes, whether the sets link and, with ``flip`` and sets that are alike enough, what a has and b has not, and the other way round."""
    longs = pa.list_(pa.int64())

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                sides = []
                for side in ("text_a", "text_b"):
                    sides.append([hashes[offsets[k]:offsets[k + 1]] for _, hashes, offsets in batch_sets(batch, side, words) for k in range(len(offsets) - 1)])
                linked, added, gone = [], [], []
                for x, y in zip(*sides, strict=True):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    union = len(x) + len(y) - shared
                    linked.append(bool(union) and 100 * shared >= percent * union)
                    near = flip and 100 * shared >= HUB_PERCENT * union
                    added.append(np.setdiff1d(x, y, assume_unique=True).view(np.int64) if near else None)
                    gone.append(np.setdiff1d(y, x, assume_unique=True).view(np.int64) if near else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a"), batch.column("b"), pa.array([len(x) for x in sides[0]], pa.int64()), pa.array([len(y) for y in sides[1]], pa.int64()), pa.array(linked, pa.bool_()), pa.array(added, longs), pa.array(gone, longs)],
                    ["a", "b", "n_a", "n_b", "linked", "added", "gone"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long, n_a long, n_b long, linked boolean, added array<long>, gone array<long>")


def hub_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): a document and the hub it is tied to, the most often chosen of the typical documents with an equal min-hash."""
    keys = sets.select("id", "n", "typical", F.posexplode("minima").alias("seed", "value"))
    lead = keys.groupBy("seed", "value").agg(F.max(F.struct("typical", -F.col("id"), "n")).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    lead = lead.select("seed", "value", (-F.col("lead.col2")).alias("hub"), F.col("lead.n").alias("hub_n"))
    choices = keys.join(lead, ["seed", "value"]).where("id <> hub and 2 * n >= hub_n and 2 * hub_n >= n").select("id", "hub").distinct()
    return tied_once(stored(choices, "hubs"), "hub")


def change_hubs(changes: DataFrame) -> DataFrame:
    """(a, b): a document and the one it is tied to among those of its hub with an equal min-hash of their changes, the one that changed least."""
    minima = F.array(*(F.array_min(F.transform("change", lambda t, k=k: F.xxhash64(t, F.lit(k)))) for k in range(SEEDS)))
    keys = stored(changes.select("id", "hub", "c", F.posexplode(minima).alias("seed", "value")), "hubs")
    lead = keys.groupBy("hub", "seed", "value").agg(F.min(F.struct("c", "id")).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    choices = keys.join(lead, ["hub", "seed", "value"]).where("id <> lead.id").select("id", F.col("lead.id").alias("b")).distinct()
    return tied_once(stored(choices, "hubs"), "b")


def tied_once(choices: DataFrame, hub: str) -> DataFrame:
    """(a, b): of each document's choices (id, ``hub``) the most often chosen one, or the one that this one chose, if that is chosen more often: a
    family of copies comes together. A document that others end at is a hub itself and tied to none."""
    often = choices.groupBy(hub).count()
    best = choices.join(often, hub).groupBy("id").agg(F.max(F.struct("count", -F.col(hub))).alias("best"))
    first = stored(best.select(F.col("id").alias("a"), "best"), "hubs")
    for _ in range(JUMPS):
        # No circle: a jump always goes to a larger (count, -id).
        after = first.select((F.col("a")).alias("b"), F.col("best").alias("further"))
        first = first.withColumn("b", -F.col("best.col2")).join(after, "b", "left").select("a", F.greatest("best", F.coalesce("further", "best")).alias("best"))
    first = stored(first.select("a", (-F.col("best.col2")).alias("b")).where("a <> b"), "hubs")
    return first.join(first.select(F.col("b").alias("a")).distinct(), "a", "left_anti")


def links(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, links): (id, n, rep) of every document, where ``rep`` is the smallest id with an equal set, and enough links (a, b) between
    such representatives for their connected components to be those of all links.

    Two sets link when 100 * overlap >= ``percent`` * union. Pairs that both link to one hub, of the first or the second kind, are left to it.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body")).where(F.col("id").isNotNull())
    sketch = frequency_sketch(rows, "body", words)
    described = stored(describe(rows, "body", words, percent, sketch), "sets")
    same = ["n", "sig_a", "sig_b"]
    reps = described.where("n > 0").groupBy(*same).agg(F.min("id").alias("rep"))
    small = described.select("id", *same)
    documents = stored(small.join(reps, same, "left").select("id", "n", F.coalesce("rep", "id").alias("rep")), "documents")
    chosen = documents.where("n > 0 and id = rep").select("id").distinct()
    sets = stored(described.where("n > 0").join(chosen, "id"), "sets")

    # 1. Each document against its hub.
    tied = compared(with_texts(hub_pairs(sets.select("id", "n", "typical", "minima")), rows, "body"), words, percent, flip=True)
    tied = stored(tied, "tied")
    near = tied.where(F.col("added").isNotNull())
    hubs = near.select(F.col("a").alias("id"), F.col("b").alias("hub")).distinct()

    # 2. Documents that do not link to their hub: each one against a hub of those that changed it alike.
    changes = near.select(
        F.col("a").alias("id"), F.col("b").alias("hub"), F.col("n_a").alias("n"), "linked", (F.col("n_a") + F.col("n_b")).alias("both"), F.concat("added", "gone").alias("change")).withColumn("c", F.size("change").cast("bigint"))
    changes = stored(changes.dropDuplicates(["id", "hub", "change"]), "changes")
    second = compared(with_texts(change_hubs(changes.where("not linked")), rows, "body"), words, percent, flip=False)
    linked = stored(tied.where("linked").select("a", "b").unionByName(second.where("linked").select("a", "b")), "hub-links")
    # The group of a document: the hub that it links to, or itself. Hubs of either kind link to no other hub, so pairs of one group need no join.
    groups = linked.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("group"))

    # 3. Pairs with one hub and different groups: joined on their changes. d is the most a pair may differ.
    most = lambda n: F.floor(F.lit(100 - percent) * n / F.lit(100 + percent)).cast("bigint")
    unlinked = changes.where("not linked").select("hub").distinct()
    places = changes.join(unlinked, "hub", "left_semi").join(groups, "id", "left").select("id", "hub", "n", "both", "c", F.xxhash64("change").alias("version"), F.coalesce("group", "id").alias("group"), F.explode("change").alias("token"))
    # Rare changes first. The largest group of a key meets the others only, so the join costs the others' rows times all rows.
    sizes = places.groupBy("hub", "token", "group").agg(F.count(F.lit(1)).alias("size"))
    keys = sizes.groupBy("hub", "token").agg(F.sum("size").alias("often"), F.max(F.struct("size", "group")).alias("top"), F.count(F.lit(1)).alias("groups"))
    keys = keys.select("hub", "token", "often", "groups", F.col("top.group").alias("largest"))
    order = Window.partitionBy("id", "hub", "version", "c").orderBy("often", "token")
    placed = places.join(keys, ["hub", "token"]).withColumn("place", F.row_number().over(order) - 1).where("groups > 1")
    # A set of y places more than the hub has y changes at least, so need is at least what a partner like the hub would make it.
    placed = stored(placed.where(F.col("place") <= F.col("c") - F.ceil((F.col("c") - most(F.col("both"))) / 2)), "changes")
    x, y = placed.where("group <> largest").alias("x"), placed.alias("y")
    need = F.ceil((F.col("x.c") + F.col("y.c") - most(F.col("x.n") + F.col("y.n"))) / 2)
    on = (
        (F.col("x.hub") == F.col("y.hub")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.group") != F.col("y.group")) & ((F.col("y.group") == F.col("y.largest")) | (F.col("x.id") < F.col("y.id")))
        & (need <= F.least("x.c", "y.c")) & (F.col("x.place") <= F.col("x.c") - need) & (F.col("y.place") <= F.col("y.c") - need))
    together = stored(x.join(y, on).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct(), "same-hub")

    # 4. All other pairs: multi-match prefixes.
    apart = prefix_pairs(sets.join(hubs, "id", "left").join(groups, "id", "left").withColumn("hub", F.coalesce("hub", "id")).withColumn("group", F.coalesce("group", "id")), percent)
    candidates = together.unionByName(apart).distinct()
    checked = compared(with_texts(stored(candidates, "candidates"), rows, "body"), words, percent, flip=False)
    found = linked.unionByName(checked.where("linked").select("a", "b"))
    return documents, found


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) with different hubs and groups whose prefixes share as many shingles as the pair needs."""
    own = stored(sets.select("id", "n", "hub", "group", "matches", "prefix"), "prefixes")
    shared = own.select("hub", "group", F.explode("prefix").alias("token")).groupBy("token").agg(*(f(c).alias(f"{n}_{c}") for c in ("hub", "group") for n, f in (("low", F.min), ("high", F.max))))
    shared = shared.where("low_hub <> high_hub and low_group <> high_group").select("token")
    wanted = filter_of(shared, "token")

    def open_prefix(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            tokens = lists.flatten().to_numpy()
            sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            place = np.arange(len(tokens)) - np.repeat(ends - sizes, sizes)
            row = np.repeat(np.arange(len(batch)), sizes)
            good = passes(wanted, tokens)
            kept = batch.drop_columns(["prefix"]).take(pa.array(row[good]))
            yield kept.append_column("place", pa.array(place[good])).append_column("token", pa.array(tokens[good]))

    rows = own.mapInArrow(open_prefix, "id long, n long, hub long, group long, matches int, place long, token long")
    x, y = rows.alias("x"), rows.alias("y")
    n = F.col("x.n") + F.col("y.n")
    overlap = F.ceil(F.lit(percent) * n / F.lit(100 + percent)).cast("bigint")
    matches = F.greatest("x.matches", "y.matches")
    on = (
        (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.hub") != F.col("y.hub")) & (F.col("x.group") != F.col("y.group")) & (overlap <= F.least("x.n", "y.n"))
        & (F.col("x.place") < F.col("x.n") - overlap + matches) & (F.col("y.place") < F.col("y.n") - overlap + matches))
    met = x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.least(matches, overlap).alias("need"))
    return met.groupBy("a", "b", "need").count().where(F.col("count") >= F.col("need")).select("a", "b")


def near_copies(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, n_shingles, component_id) of every row: set size and the smallest id that links reach, its own included.

    Null text is empty; an empty text has no shingle and links to nothing; a text of fewer than ``words`` words is one shingle. A null id links to
    nothing and has a null component. Rows with one id are one document: what either text links to counts for both. Other columns are not read.
    """
    documents, found = links(docs, words, percent, doc_id, text)
    groups = connected(found)
    reach = documents.join(groups, documents.rep == groups.node, "left").select("id", "n", F.coalesce("component", "rep").alias("component"))
    nameless = docs.where(F.col(doc_id).isNull()).select(F.lit(None).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    sized = nameless.mapInArrow(sizer(words), "id long, n long").withColumn("component", F.lit(None).cast("bigint"))
    return reach.unionByName(sized).select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def sizer(words: int):
    def sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.diff(offsets) for _, _, offsets in batch_sets(batch, "body", words)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(n) if n else [], pa.int64())], ["id", "n"])

    return sizes


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; of rows with equal ids and texts one stays. Null ids stay."""
    gone = near_copies(docs, words, percent, doc_id, text).where(F.col(doc_id) != F.col("component_id")).select(F.col(doc_id).alias("gone_id")).distinct()
    # The columns of ``docs`` may have any name.
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("doc"))
    return rows.join(gone, F.col("doc").getField(doc_id) == F.col("gone_id"), "left_anti").select("doc.*").dropDuplicates([doc_id, text])
