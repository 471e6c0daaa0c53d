"""Operator 3 against the tokenizers library, and its file format by itself."""

import struct
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corpuslab.llm import token_files
from corpuslab.llm.queries import queries
from tests.llm.tables import ODD_TEXTS, SF, documents, write

PATH = public_tokenizers.path("word_bpe_49k.json")
SPECIAL = ["one <|endoftext|> two", "a<|startoftext|>b c<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <| |> <|x", "x<|endoftext|>", "we<|endoftext|>'ll\x1cgo"]


def test_whole_tables(spark, tmp_path):
    base = documents(spark, [*ODD_TEXTS, *SPECIAL]).unionByName(spark.read.parquet(f"{SF}/documents.parquet"))
    base = base.unionByName(spark.createDataFrame([(None, "no id here", "en", None, 0)], base.schema))
    write(base, tmp_path)
    library = Tokenizer.from_file(PATH)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in base.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = {r["doc_id"]: r for r in queries()["op3_token_files"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    start = 0
    for doc_id, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_pack_and_unpack():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (2 ** rng.uniform(0, 32, n)).astype(np.uint32)
        control, data = token_files.pack(ranks)
        assert len(control) == -(-n // 4)
        assert np.array_equal(token_files.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n), ranks)


def test_frequent_ids_take_a_byte(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    encoded = token_files.encode(documents(spark, ["the the the the cat"] * 5), PATH, 1)
    _, ranks = token_files.write(encoded, folder)
    table = [tuple(r) for r in ranks.orderBy("rank").collect()]
    assert [n for _, _, n in table] == sorted((n for _, _, n in table), reverse=True)
    assert table[0][2] == 20


def test_repeated_ids_and_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 4)
    df = documents(spark, ["b c d e f", "x"]).unionByName(documents(spark, ["a b"]))
    out = [r for r in token_files.round_trip(df, PATH, 1).orderBy("start").collect()]
    assert [r["doc_id"] for r in out] == [100_000, 100_000, 100_001]
    assert [len(r["ids"]) // 4 for r in out] in ([3, 6, 2], [6, 3, 2])


def test_rows_of_one_id_lie_in_many_files(spark, tmp_path, request):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few rows are one partition
    spark.conf.set(setting, "false")
    request.addfinalizer(lambda: spark.conf.unset(setting))
    folder, n = f"file://{tmp_path}/hot", 4000
    texts = spark.range(0, n, 1, 4).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "IF(id % 2 = 0, 'same words', CONCAT('w', id)) AS text")
    token_files.encode(texts, PATH, 1).write.parquet(f"{folder}/encoded")
    manifest, _ = token_files.write(spark.read.parquet(f"{folder}/encoded"), folder)
    sizes = [r["n_docs"] for r in manifest.collect()]
    assert sum(sizes) == n
    assert max(sizes) < 0.5 * n
    out = token_files.read(spark, folder).orderBy("start").collect()
    ends = [r["start"] + len(r["ids"]) // 4 for r in out]
    assert [r["start"] for r in out] == [0, *ends[:-1]]


def test_empty_table(spark, tmp_path):
    write(documents(spark, []), tmp_path)
    assert queries()["op3_token_files"](spark, str(tmp_path)).count() == 0
