"""BPE and the token files, against the tokenizers library and by exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.llm import bpe, rans, text

ALPHABET = list("abcdeét hin  \n\n\t'sSll,.!?-0123 9”“—日本語 　 😀Ω<|>#$%") + ["<|endoftext|>", "'ll", " the", "ing", "\r\n"]
SCHEMA = "doc_id bigint, text string, lang string, ids string"


def texts(n, seed=1, longest=120):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)] + [None, "", "a" * 5000, " \n" * 300]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def ids_of(library, s):
    return library.encode(s or "", add_special_tokens=False).ids


def test_units_rejoin_and_keep_marks_whole():
    col = pa.array(texts(300))
    c = text.units(col, (b"<|endoftext|>",))
    for i, s in enumerate(col.to_pylist()):
        assert b"".join(c.pieces[k] for k in c.codes[c.ptr[i]:c.ptr[i + 1]]).decode() == (s or "")


def test_encode_matches_library(library):
    all_ = texts(1500)
    b = bpe.load(bpe.default_path())
    ids, ptr = b.encode_column(pa.array(all_))
    for i, s in enumerate(all_):
        want = ids_of(library, s)
        assert ids[ptr[i]:ptr[i + 1]].tolist() == want
        assert b.decode(want) == library.decode(want, skip_special_tokens=False)


def frame(spark, all_):
    return spark.createDataFrame([(i, s, "x", "clash") for i, s in enumerate(all_)], SCHEMA)


def test_digest(spark, library):
    all_ = texts(200, 2)
    df = frame(spark, all_)
    df = df.union(df.where("doc_id = 3"))
    rows = bpe.digest(df).collect()
    assert len(rows) == len(all_) + 1
    for r in rows:
        want = ids_of(library, all_[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((all_[r.doc_id] or "").encode()).hexdigest()
    assert bpe.digest(df.limit(0)).count() == 0


def test_coder_round_trip():
    rng = np.random.default_rng(0)
    for n, k in ((1, 1), (63, 5), (65, 300), (rans.BLOCK, 40), (3 * rans.BLOCK + 17, 5000)):
        ids = (rng.zipf(1.3, n) % k).astype(np.uint32) * 7
        u, c = np.unique(ids, return_counts=True)
        coder = rans.Coder(*rans.table_of(dict(zip(u.tolist(), c.tolist()))))
        blocks = coder.encode(ids)
        assert np.array_equal(np.concatenate(coder.decode(blocks)), ids)
        alone = coder.decode(blocks[-1:])[0]
        assert np.array_equal(alone, ids[(len(blocks) - 1) * rans.BLOCK:])


def test_files_keep_order_and_checksums(spark, library, tmp_path):
    all_ = texts(400, 3)
    df = frame(spark, all_).repartition(5)
    df = df.union(spark.createDataFrame([(None, "null id", None, None)], SCHEMA))
    files, table = rans.encode_corpus(df)
    rows = {r.doc_id: r for r in rans.read_back(files, table).collect()}
    at = 0
    for d in [None, *range(len(all_))]:
        want = [*ids_of(library, "null id" if d is None else all_[d]), 2]
        assert (rows[d].start, rows[d].n_tokens) == (at, len(want))
        assert rows[d].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)


def test_a_damaged_file_is_noticed(tmp_path):
    coder = rans.Coder(*rans.table_of({1: 5, 2: 3}))
    path = f"file://{tmp_path}/x.rans"
    rans.write_file(path, coder, [7, 8], [2, 2000], iter([np.array([1, 2] * 1001, np.uint32)]))
    assert [(d, s, len(i)) for d, s, i in rans.read_file(path, coder)] == [(7, 0, 2), (8, 2, 2000)]
    raw = bytearray((tmp_path / "x.rans").read_bytes())
    raw[len(rans.MAGIC) + 3] ^= 1
    (tmp_path / "x.rans").write_bytes(raw)
    with pytest.raises(ValueError):
        list(rans.read_file(path, coder))


def test_empty_table(spark):
    files, table = rans.encode_corpus(frame(spark, [])[["doc_id", "text"]])
    assert rans.read_back(files, table).count() == 0
