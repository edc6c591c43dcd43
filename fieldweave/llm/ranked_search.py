"""Ranked lexical search by dense blocked matrix products.

Items are cut into blocks, each with a vocabulary of its own. Texts are read once a block: what is kept of a document is its length and how often it has
each word of the vocabulary. Document frequencies and weights follow from those rows. Then tiles of item weights (items x words) are multiplied by
tiles of document impacts (words x documents) in float64. All factors are whole numbers and a tile's words are so few that no sum reaches 2 ** 53, so
the products are exact; tiles are added in 64-bit integers. Each task keeps the best documents of each item, and Spark ranks those.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: (item, word) pairs of a block of items (an item of more is a block of its own), words of a tile, documents of a tile, cells of a score table.
BLOCK_PAIRS, TILE_WORDS, TILE_DOCS, SCORE_CELLS = 1 << 17, 2048, 1024, 1 << 21
#: Every impact is below this; a weight is below 1000 * ln(2 ** 63) < 2 ** 16.
IMPACT, MOST_WEIGHT = 1_000_000, 1 << 16
assert IMPACT * MOST_WEIGHT * TILE_WORDS < 1 << 53
#: Lists in which an item's candidates are ranked first.
LISTS = 64

#: What is not part of a term becomes a space, A-Z becomes a-z; all bytes of letters beyond ASCII are parts of terms.
TABLE = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(TABLE).split()


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, term), distinct: rows with one id are one item, null being an id too."""
    schema = T.StructType([T.StructField("item", items.schema[item_id].dataType), T.StructField("term", T.BinaryType())])

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                found = sorted(set(terms(batch.column("body")[row].as_py())))
                for at in range(0, len(found), 1 << 16):
                    some = found[at:at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array([row] * len(some))), pa.array(some, pa.binary())], ["item", "term"])

    return items.select(F.col(item_id).alias("item"), F.col(text).alias("body")).where(F.col("body").isNotNull()).mapInArrow(split, schema).distinct()


def in_blocks(pairs: DataFrame) -> tuple[DataFrame, int]:
    """``pairs`` (item, term) with ``block``, and the number of blocks: by hash of the item, in as many blocks as keep each within BLOCK_PAIRS
    unless it has one item only."""
    pairs = stored(pairs, "item-terms")
    blocks = 1
    while True:
        dealt = pairs.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
        # approx_count_distinct is at least 2 for two items.
        most = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n"), (F.min(F.xxhash64("item")) != F.max(F.xxhash64("item"))).alias("several")).where("several").agg(F.max("n")).first()[0]
        if (most or 0) <= BLOCK_PAIRS:
            return dealt, blocks
        blocks *= 2


def counted(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """(doc, n, words, times) of documents with a term: terms with repeats, and the words of the list it has, by number, with how often."""
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([docs.schema["doc"], T.StructField("n", T.LongType()), T.StructField("words", ints), T.StructField("times", ints)])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {word: k for k, word in enumerate(words)}
        kind = pa.list_(pa.int32())
        for batch in batches:
            keep, sizes, ids, times = [], [], [], []
            for row, body in enumerate(batch.column("body")):
                found = terms(body.as_py())
                if found:
                    seen = Counter(map(number.get, found))
                    seen.pop(None, 0)
                    keep.append(row)
                    sizes.append(len(found))
                    ids.append(list(seen))
                    times.append(list(seen.values()))
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.array(ids, kind), pa.array(times, kind)], ["doc", "n", "words", "times"])

    return docs.where(F.col("body").isNotNull()).mapInArrow(count, schema)


def best(scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the scores above 0 that may be among the ``top`` largest of their row: all that equal the last of those, too."""
    if scores.shape[1] > top:
        least = np.partition(scores, scores.shape[1] - top, axis=1)[:, scores.shape[1] - top]
        return np.nonzero((scores >= least[:, None]) & (scores > 0))
    return np.nonzero(scores > 0)


def cut(item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray, top: int) -> np.ndarray:
    """Positions of the first ``top`` of each item, larger scores first, then smaller ids, null last."""
    order = np.lexsort((doc, null, -score, item))
    sorted_items = item[order]
    starts = np.flatnonzero(np.r_[True, sorted_items[1:] != sorted_items[:-1]]) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < top]


def scored(rows: DataFrame, weights: list[tuple[int, int, int]], n_items: int, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item number, doc, score): of each task's documents, the best ``top`` of each item. ``weights``: (item number, word number, weight)."""
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc", T.LongType()), T.StructField("score", T.LongType())])
    of = np.array(weights, np.int64).reshape(-1, 3)
    of = of[np.argsort(of[:, 1], kind="stable")]

    def rank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_words = int(of[-1, 1]) + 1 if len(of) else 0
        cuts = np.searchsorted(of[:, 1], np.arange(0, n_words + TILE_WORDS, TILE_WORDS))
        width = max(16, min(TILE_DOCS, SCORE_CELLS // max(1, n_items)))
        kept = [np.zeros(0, np.int64) for _ in range(3)] + [np.zeros(0, bool)]
        for batch in batches:
            for at in range(0, len(batch), width):
                some = batch.slice(at, width)
                ids, times = some.column("words"), some.column("times")
                sizes = np.diff(ids.offsets.to_numpy())
                word, often = ids.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64)
                column = np.repeat(np.arange(len(some)), sizes)
                long = 50 + (50 * some.column("n").to_numpy() * n_docs) // n_terms
                impact = (1_000_000_000 * often) // (1000 * often + 20 * long[column])
                scores = np.zeros((n_items, len(some)), np.int64)
                for k in range(len(cuts) - 1):
                    inside = word // TILE_WORDS == k
                    mine = of[cuts[k]:cuts[k + 1]]
                    if not inside.any() or not len(mine):
                        continue
                    # Only words that the tile's documents and items share take up rows.
                    shared, place = np.unique(word[inside], return_inverse=True)
                    docs_tile = np.zeros((len(shared), len(some)))
                    docs_tile[place, column[inside]] = impact[inside]
                    at_word = np.minimum(np.searchsorted(shared, mine[:, 1]), len(shared) - 1)
                    mine, at_word = (x[shared[at_word] == mine[:, 1]] for x in (mine, at_word))
                    items_tile = np.zeros((n_items, len(shared)))
                    items_tile[mine[:, 0], at_word] = mine[:, 2]
                    scores += (items_tile @ docs_tile).astype(np.int64)
                item, doc = best(scores, top)
                null = some.column("doc").is_null().to_numpy(zero_copy_only=False)
                key = some.column("doc").fill_null(0).to_numpy()
                kept = [np.concatenate(x) for x in zip(kept, (item, scores[item, doc], key[doc], null[doc]), strict=True)]
                chosen = cut(*kept, top)
                kept = [x[chosen] for x in kept]
        item, score, doc, null = kept
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(doc, mask=null), pa.array(score)], ["item", "doc", "score"])

    return rows.mapInArrow(rank, schema)


def search(docs: DataFrame, items: DataFrame, top: int = 50, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The ``top`` documents of highest score above 0 for each item: item_id, rank (from 1), doc_id, score; equal scores by ascending id, null last.

    Document ids are whole numbers. Rows of ``items`` with one id are one item with the terms of all of them; an item without terms or hits has no rows.
    Repeated documents each take a rank; those without terms take no part in any count. Other columns are not read. Empty tables give no rows.
    The driver holds one block of items at a time: at most BLOCK_PAIRS (item, word) pairs, or one item.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("body"))
    pairs, blocks = in_blocks(item_terms(items, item_id, text))
    schema = T.StructType([T.StructField(item_id, items.schema[item_id].dataType), T.StructField("rank", T.IntegerType()), T.StructField(doc_id, T.LongType()), T.StructField("score", T.LongType())])
    out = None
    for block in range(blocks):
        mine = pairs.where(F.col("block") == block).select("item", "term").collect()
        if not mine:
            continue
        words = sorted({bytes(row["term"]) for row in mine})
        names = list({row["item"] for row in mine})
        rows = stored(counted(texts, words), "word-counts")
        n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
        ratio = F.lit(2 * n_docs + 2) / (2 * F.col("df") + 1)
        weight = dict(rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).select("word", F.floor(1000 * F.log(ratio))).collect())
        number, place = {name: k for k, name in enumerate(names)}, {word: k for k, word in enumerate(words)}
        weights = [(number[row["item"]], word, weight[word]) for row in mine if (word := place[bytes(row["term"])]) in weight]
        near = scored(rows, weights, len(names), n_docs, n_terms or 1, top)
        order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
        # Each task has at most ``top`` rows an item; they are cut in LISTS lists an item before the last list is ranked.
        first = near.withColumn("list", F.pmod(F.xxhash64("doc"), F.lit(LISTS))).withColumn("rank", F.row_number().over(Window.partitionBy("item", "list").orderBy(*order))).where(F.col("rank") <= top)
        last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
        named = spark.createDataFrame([(k, name) for k, name in enumerate(names)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("name", items.schema[item_id].dataType)]))
        # The names of one block: bounded, and sent to every task.
        ranked = stored(last.join(F.broadcast(named), "item").select(F.col("name").alias(item_id), "rank", F.col("doc").alias(doc_id), "score"), "ranked")
        out = ranked if out is None else out.unionByName(ranked)
    return out if out is not None else spark.createDataFrame([], schema)
