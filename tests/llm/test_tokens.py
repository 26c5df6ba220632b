import hashlib
import random
import zlib

import numpy as np
import pyarrow.orc as orc
import pytest
from tokenizers import Tokenizer

from lodegrid.llm import bpe, token_orc
from lodegrid.llm.common import shared_path
from tests.llm.conftest import EDGES, SF


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.word_bpe())


def texts():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzéüñß'0123 .-!"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    out += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(20)) for _ in range(150)]
    return [*EDGES, *out, "ΑΣ ΣΑΣ. Ǆ", "aaaaaaaaaa zzzzzz " * 4, "<|endoftext|><|startoftext|>x <|endoftext|", "café café ﬁ"]


@pytest.mark.parametrize("kind", [bpe.TrieEncoder, bpe.LibraryEncoder])
def test_encoders(library, kind):
    e = bpe.Shipped(open(bpe.word_bpe()).read(), kind).encoder()
    for t, ids in zip(texts(), e.encode(texts()), strict=True):
        assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_round_trip(spark, library, edge_docs, no_docs):
    got = bpe.digest(edge_docs, bpe.word_bpe()).collect()
    want = []
    for r in edge_docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.digest(no_docs, bpe.word_bpe()).count() == 0
    out = bpe.decode(bpe.encode(edge_docs, bpe.word_bpe(), ids_col="n_words"), bpe.word_bpe(), ids_col="n_words", out_col="kept")
    assert sorted(out.columns) == sorted(edge_docs.columns)


def test_ids_outside_the_vocabulary(spark, library):
    rows = [(1, [320, -1, 10**6, 321]), (2, None), (3, []), (4, [None, 49407])]
    got = {r.k: r.decoded for r in bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), bpe.word_bpe()).collect()}
    assert got == {1: library.decode([320, 10**6, 321], skip_special_tokens=False), 2: None, 3: "", 4: "<|endoftext|>"}


def test_token_files(spark, library, edge_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    path = shared_path(spark, "test_tokens")
    token_orc.write_tokens(docs, path, bpe.word_bpe(), end_id=2)
    got = {r.doc_id: r for r in token_orc.summary(token_orc.read_tokens(spark, path)).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert tuple(got[r.doc_id]) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    few = token_orc.read_documents(spark, path, [3, 5])
    assert sorted(r.doc_id for r in few.collect()) == [3, 5]
    assert "PushedFilters: [In(doc_id" in few._jdf.queryExecution().toString()
    import glob

    files = sorted(glob.glob(f"{path}/*.orc"))
    ids = [i for f in files for i in orc.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()]
    assert ids == sorted(ids)
    empty = shared_path(spark, "test_tokens")
    token_orc.write_tokens(no_docs, empty, bpe.word_bpe(), end_id=2)
    assert token_orc.summary(token_orc.read_tokens(spark, empty)).count() == 0
    odd = shared_path(spark, "test_tokens")
    token_orc.write_tokens(edge_docs, odd, bpe.word_bpe(), end_id=2)
    rows = token_orc.summary(token_orc.read_tokens(spark, odd)).orderBy("start").collect()
    assert len(rows) == 13 and rows[0].doc_id is None
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False))
