"""Ids against the tokenizer library, and the texts back."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(library, rows):
    out = []
    for doc_id, text in rows:
        ids = np.array(library.encode_ordinary(text or ""), dtype="<u4").tobytes()
        digest = hashlib.sha256((text or "").encode()).hexdigest()
        out.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), digest))
    return sorted(out, key=repr)


TEXTS = st.text(alphabet="ab \n\t'stré1!?中", max_size=200)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_equal_the_library_and_decode_to_the_text(library, text):
    ids = bpe.encoder(RANKS).encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert bpe.encoder(RANKS).decode(ids) == text.encode()


EDGE = [
    (1, None),
    (2, ""),
    (3, "x" * 700),  # one pre-token over many chunks
    (4, " " * 333 + "a" + "\n" * 90),
    (5, "It's here, isn't it?  'Tis 1234567890 " * 30),
    (5, "It's here, isn't it?  'Tis 1234567890 " * 30),
    (6, "naïve — 中文字 <|endoftext|> !!!'s\r\n\r\n" * 25),
    (None, "a b" * 50),
    (7, "ab " * 30 + "y" * 200 + " cd" * 60),  # meets, then never meets again
]


@pytest.mark.parametrize("chunk,overlap", [(16, 4), (40, 12), (100, 30), (5000, 50)])
def test_chunks_are_stitched_exactly(documents, library, chunk, overlap):
    found = bpe.encode_documents(documents(EDGE), RANKS, chunk, overlap)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(library, EDGE)


def test_long_texts_at_the_real_chunk_size(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows.append((10**6, " ".join(t for _, t in rows if t) * 3))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = bpe.encode_documents(frame, RANKS)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(library, rows)


def test_empty_table_and_extra_columns(spark, documents, library):
    assert bpe.encode_documents(documents([]), RANKS).count() == 0
    frame = spark.createDataFrame([(1, "a b c " * 20, 9, 9, "z")], "doc_id long, text string, row int, part int, ids string")
    found = bpe.encode_documents(frame, RANKS, 16, 6)
    assert [tuple(r) for r in found.collect()] == expected(library, [(1, "a b c " * 20)])
