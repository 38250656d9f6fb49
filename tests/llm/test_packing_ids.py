"""Packing as the query runs it measures ids, not words."""

import public_tokenizers

from weft.llm import bpe, entry, packing


def test_lengths_are_ids(spark, tmp_path):
    rows = [(1, "untranslatable hyperparameters " * 40), (2, "日本語のテキスト" * 3000), (3, None), (4, ""), (5, "word " * 100)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = bpe.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = {doc: len(own.encode([text])[0]) + 1 for doc, text in rows if text is not None}
    got, pieces = {}, {}
    for r in entry.op8_best_fit_packing(spark, str(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + 1
        assert r.length <= 8192 and r.start + r.length <= r.bin_used <= r.bin_size
    assert got == want and want[1] > 81
    assert pieces[2] == -(-want[2] // 8192) > 1


def test_counts_of_odd_texts(odd):
    """Counts equal those of the encoder, also where it takes over for long runs; nulls stay null, an empty table empty."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.encoder(path, public_tokenizers.PATTERN)
    rows = [(1, None), (2, ""), (3, "z" * 9000), (4, "日本語 のテキスト <|endoftext|> x"), (5, " " * 5000 + "a"), (6, "plain words here"), (6, "plain words here")]
    got = sorted((r.doc_id, r.n_ids) for r in packing.id_counts(odd(rows), path, public_tokenizers.PATTERN).collect())
    assert got == [(d, None if t is None else len(own.encode([t])[0])) for d, t in rows]
    assert packing.packed_ids(odd(rows).where("doc_id < 0"), path, public_tokenizers.PATTERN).collect() == []
