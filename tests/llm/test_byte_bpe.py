"""Operator 8 against the tiktoken library, text by text."""

import base64
import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken

from corpuslab.llm import byte_bpe
from corpuslab.llm.queries import queries
from tests.llm.tables import ODD_TEXTS, SF, documents, write

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_whole_tables(spark, library, tmp_path):
    base = documents(spark, ODD_TEXTS).unionByName(spark.read.parquet(f"{SF}/documents.parquet"))
    write(base, tmp_path)
    texts = {r["doc_id"]: r["text"] or "" for r in base.collect()}
    got = queries()["op8_byte_bpe"](spark, str(tmp_path)).collect()
    assert len(got) == base.count()
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_encode_then_decode(spark):
    df = documents(spark, ODD_TEXTS)
    back = byte_bpe.decode(byte_bpe.encode(df, PATH, PATTERN), PATH, PATTERN)
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in back.collect()} == texts


def test_every_token_is_encoded_as_itself(library):
    bpe = byte_bpe.load(PATH, PATTERN)
    sample = [t for t in (bpe.table[i] for i in range(0, len(bpe.table), 7)) if t.decode("utf-8", "ignore").encode() == t]
    assert [bpe.encode([t.decode()])[0] for t in sample] == [struct.pack(f"<{len(x)}I", *x) for x in (library.encode_ordinary(t.decode()) for t in sample)]


def test_empty_table(spark, tmp_path):
    write(documents(spark, []), tmp_path)
    assert queries()["op8_byte_bpe"](spark, str(tmp_path)).count() == 0
