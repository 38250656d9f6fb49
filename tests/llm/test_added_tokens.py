"""The token file query against the library as it comes, on texts that hold its added tokens."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from weft.llm import entry


def test_added_tokens(spark, tmp_path):
    rows = [(1, "a <|endoftext|> b"), (2, "plain text"), (3, "<|endoftext|><|endoftext|>x"), (4, None), (5, "<|endoftext |>"), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for doc, line in rows:
        ids = [*library.encode(line or "", add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert want[0][2] == 5
    assert sorted(map(tuple, entry.op2_token_file(spark, str(tmp_path)).collect())) == want
