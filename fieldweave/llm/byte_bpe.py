"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of more than ``chunk`` characters is dealt out as chunks that overlap by
``overlap`` characters. Each chunk is split into pre-tokens on its own, from its
first character on, so its first boundaries may be wrong. The pattern never looks
back, so as soon as a chunk shares one boundary with the chunk before it, all later
ones agree; the text is cut there and the pieces are encoded in parallel. Decoding
concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A boundary counts only if so many characters after it are in view: the longest
#: contraction has three, one of which is before any wrong boundary.
IN_VIEW = 2


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(ranks_path: str) -> dict[int, bytes]:
    with open(ranks_path, "rb") as lines:
        return {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}


def id_bytes(encoder: tiktoken.Encoding, text: str) -> bytes:
    return encoder.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def chunks_of(text: str, chunk: int, overlap: int) -> list[str]:
    """Chunk k starts at k * chunk and runs ``overlap`` characters into the next one."""
    return [text[at:at + chunk + overlap] for at in range(0, len(text), chunk)] or [""]


def safe_boundaries(text: str, pattern: regex.Pattern, low: int, high: int) -> list[int]:
    """Ends of pre-tokens in [low, high] where a text may be cut.

    The character before a cut is no white space: a cut inside a run of white
    space would change the match of the run.
    """
    found = []
    for match in pattern.finditer(text):
        end = match.end()
        if end > high:
            break
        if end >= low and not text[end - 1].isspace():
            found.append(end)
    return found


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = 1 << 16, overlap: int = 1 << 10) -> DataFrame:
    """``key``, ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit) of every row of ``docs``.

    One row per input row, repeated rows included. Null text is empty and has
    no ids; a null key stays. Other columns are not read. If two neighbouring
    chunks share no boundary inside their overlap (one run of letters or of spaces longer than
    it), the whole text of that row is one piece.
    """
    if overlap < 4 or chunk <= overlap:
        raise ValueError("overlap must be at least 4 and less than chunk")
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    schema = T.StructType([T.StructField("key", kind), T.StructField("ids", T.BinaryType())])

    def encode_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(ranks_path, pattern)
        for batch in batches:
            bodies = batch.column("body")
            for at in range(0, len(bodies), 256):
                ids = [id_bytes(encoder, body.as_py()) for body in bodies[at:at + 256]]
                yield pa.RecordBatch.from_arrays([batch.column("key")[at:at + 256], pa.array(ids, pa.binary())], ["key", "ids"])

    is_long = F.length("body") > chunk
    short = rows.where(~is_long).mapInArrow(encode_rows, schema)
    long = pieces(rows.where(is_long).groupBy("key", "body").agg(F.count(F.lit(1)).alias("copies")), pattern, chunk, overlap)

    def encode_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(ranks_path, pattern)
        for batch in batches:
            ids = [id_bytes(encoder, piece.as_py()) for piece in batch.column("piece")]
            yield batch.drop_columns(["piece"]).append_column("ids", pa.array(ids, pa.binary()))

    coded_schema = T.StructType([f for f in long.schema if f.name != "piece"] + [T.StructField("ids", T.BinaryType())])
    coded = long.repartition("doc", "k").mapInArrow(encode_pieces, coded_schema)
    joined = (
        coded.groupBy("doc", "copies").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
        .select(F.col("doc.key").alias("key"), F.expr("aggregate(slice(parts, 2, size(parts)), parts[0].ids, (done, part) -> concat(done, part.ids))").alias("ids"), "copies")
        .select("key", "ids", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("col"))
    return short.unionByName(joined).select(F.col("key").alias(key), (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids")


def pieces(rows: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(doc, copies, k, piece) from distinct rows (key, body, copies): cut where neighbouring chunks agree."""
    doc = F.struct("key", F.sha2("body", 256).alias("text_hash"))
    rows = rows.select(doc.alias("doc"), "copies", "body")
    schema = T.StructType([
        rows.schema["doc"], rows.schema["copies"], T.StructField("k", T.IntegerType()), T.StructField("chunk", T.StringType())])

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                parts = chunks_of(batch.column("body")[row].as_py(), chunk, overlap)
                for at in range(0, len(parts), 64):
                    some = parts[at:at + 64]
                    same = pa.array([row] * len(some))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc").take(same), batch.column("copies").take(same), pa.array(range(at, at + len(some)), pa.int32()), pa.array(some)],
                        ["doc", "copies", "k", "chunk"])

    def boundaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        ints = pa.list_(pa.int32())
        for batch in batches:
            heads, tails = [], []
            for text in batch.column("chunk").to_pylist():
                found = safe_boundaries(text, compiled, 1, len(text) - IN_VIEW)
                heads.append([x for x in found if x <= overlap])
                tails.append([x - chunk for x in found if x > chunk])
            yield batch.append_column("head", pa.array(heads, ints)).append_column("tail", pa.array(tails, ints))

    dealt = rows.mapInArrow(split, schema).repartition("doc", "k")
    marked_schema = T.StructType([*schema, T.StructField("head", T.ArrayType(T.IntegerType())), T.StructField("tail", T.ArrayType(T.IntegerType()))])
    marked = dealt.mapInArrow(boundaries, marked_schema)
    # Windows over the chunks of one document, which were one row before.
    in_doc = Window.partitionBy("doc").orderBy("k")
    start = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(in_doc))))
    cut = marked.withColumn("start", start).withColumn("whole", F.count_if(F.col("start").isNull()).over(Window.partitionBy("doc")) > 0)
    cut = cut.withColumn("next", F.lead("start").over(in_doc))
    agreed = cut.where(~F.col("whole")).select(
        "doc", "copies", "k",
        F.when(F.col("next").isNull(), F.expr("substring(chunk, start + 1)"))
        .otherwise(F.expr(f"substring(chunk, start + 1, {chunk} + next - start)")).alias("piece"))
    parts = F.sort_array(F.collect_list(F.struct("k", F.substring("chunk", 1, chunk).alias("own"))))
    whole = cut.where("whole").groupBy("doc", "copies").agg(F.array_join(F.transform(parts, lambda part: part["own"]), "").alias("piece"))
    return agreed.unionByName(whole.select("doc", "copies", F.lit(0).alias("k"), "piece"))


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with a binary column ``decoded``: the bytes of the ids, concatenated. Null ids give null.

    An id that the vocabulary lacks is an error.
    """
    schema = T.StructType([*encoded.schema, T.StructField(decoded, T.BinaryType())])

    def decode_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_bytes(ranks_path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                texts = [
                    None if (raw := value.as_py()) is None else b"".join(map(known.__getitem__, np.frombuffer(raw, "<u4").tolist()))
                    for value in some.column(some.schema.get_field_index(ids))]
                yield some.append_column(decoded, pa.array(texts, pa.binary()))

    return encoded.mapInArrow(decode_rows, schema)
