"""Encoding against the public libraries, and exact round trips."""

import base64
import hashlib
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weft.llm import bpe, token_file

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
ODD = ["a\x1cb \x1d c", "x\xa0\xa0y  z", "ªº²³¼ éàü  q", "日本語 のテキスト", "😀 hi's they'll 've", "\n\n \n x", "   ", "a\u0085b <|endoftext|> z", "z" * 3000, "aéΑБ ǅɐɐ"]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(RANKS, PATTERN)


def test_perfect_hash(own):
    slots = own.hash.slots(list(own.ranks))
    assert sorted(slots.tolist()) == list(range(len(own.ranks)))
    small = [bytes([i]) for i in range(7)]
    assert sorted(bpe.MinimalPerfectHash(small).slots(small).tolist()) == list(range(7))


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_encoder(own, library, line):
    assert own.encode([line])[0].tolist() == library.encode_ordinary(line)


def test_odd_texts(own, library):
    ids, bounds = own.encode([None, "", *ODD])
    for i, line in enumerate(["", "", *ODD]):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode_ordinary(line)


def test_digests(odd, corpus, library):
    got = [tuple(r) for r in bpe.digests(odd(corpus), RANKS, PATTERN).collect()]
    want = []
    for doc, line in corpus:
        ids = library.encode_ordinary(line or "")
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((line or "").encode()).hexdigest()))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.digests(odd([(1, "x")]).where("doc_id = 0"), RANKS, PATTERN).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 65534), max_size=300), st.integers(1, 40))
def test_segment_round_trip(ids, repeat):
    ids = np.array(ids * repeat, np.int64)
    keys, sizes, back = token_file.read_segment(token_file.write_segment(np.array([-5, 7]), np.array([len(ids) // 2, len(ids) - len(ids) // 2]), ids))
    assert back.tolist() == ids.tolist() and keys.tolist() == [-5, 7] and sizes.sum() == len(ids)


def test_repetition_is_predicted():
    ids = np.tile(np.random.default_rng(0).integers(0, 50000, 40), 2000)
    assert len(token_file.write_segment(np.array([1]), np.array([len(ids)]), ids)) < len(ids) / 8


def test_smaller_than_general_compression(own):
    """On real ids of a table the coder beats zlib on their 16-bit form, and the entropy of ids alone."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").sort_by("doc_id")["text"].to_pylist()
    ids, _ = token_file.library_encoder(JSON, PATTERN, True).encode(texts)
    ids = ids.astype(np.int32)
    size = len(token_file.write_segment(np.array([1]), np.array([len(ids)]), ids))
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum() / 8
    assert size < len(zlib.compress(ids.astype("<u2").tobytes())) and size < entropy * len(ids)


def test_mixing_learns():
    """Weights move to the prediction that is right."""
    mixer = token_file._Mixer(1, (1, 1))
    draw = np.random.default_rng(0)
    for _ in range(400):
        mixer.chance(np.array([0]), (np.array([0]), np.array([0])))
        mixer.learn(np.array([draw.random() < 0.95]))
    assert mixer.chance(np.array([0]), (np.array([0]), np.array([0])))[0] > 55000


def test_damage_is_found():
    ids = np.arange(9000) % 5000
    data = token_file.write_segment(np.array([1]), np.array([len(ids)]), ids)
    for at in (20, len(data) - 6, len(data) // 2):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            token_file.read_segment(bytes(bad))


def test_files(spark, odd, corpus, tmp_path):
    rows = [r for r in corpus if r[0] != 50] + [(1000 + i, x) for i, x in enumerate(ODD)]
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    token_file.write(odd(rows), path, JSON, PATTERN)
    got = sorted((tuple(r) for r in token_file.digests(token_file.read(spark, path)).collect()), key=lambda r: r[1])
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True  # as special=False asks
    want, start = [], 0
    for doc, line in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*library.encode(line or "", add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_files_of_nothing(spark, odd, tmp_path):
    token_file.write(odd([(1, "x")]).where("doc_id = 0"), f"{tmp_path}/t", JSON, PATTERN)
    assert token_file.digests(token_file.read(spark, f"{tmp_path}/t")).collect() == []
