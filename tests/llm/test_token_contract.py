"""The token store against the tokenizer as it loads, and its rows without a key."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from fieldweave.llm import catalog, token_store

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["a b<|endoftext|> c", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext| >", "plain 'll text", "é<|endoftext|>中"]


def test_added_tokens_as_the_library_loads_them():
    library = Tokenizer.from_file(TOKENIZER)
    ids, sizes = token_store.Encoder(TOKENIZER)(TEXTS)
    made = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert made == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert made[0] == [64, 275, 50256, 269]


def test_query_has_the_rows_without_a_key(spark, tmp_path):
    library = Tokenizer.from_file(TOKENIZER)
    rows = [(None, "b"), (3, TEXTS[0]), (None, None), (-2, "x y"), (None, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want, base = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((i, base, len(ids), zlib.crc32(ids.tobytes())))
        base += len(ids)
    assert sorted(map(tuple, catalog.op8_token_store(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
