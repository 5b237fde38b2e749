"""Token ids in files of a static range asymmetric numeral system.

Steps of ``encode_corpus``: (1) every text is tokenised once by the tokenizers library and its ids
are written as 16- or 32-bit integers; (2) one frequency table over all ids is made, so its size
is bounded by the vocabulary; (3) the ids are put in ascending ``doc_id`` order by a range
partitioning, and each partition writes one file; (4) ``read_back`` decodes files in parallel.

File: magic, then blocks of up to ``BLOCK`` ids, then a footer (JSON, zlib) with the documents and
for each block a checkpoint (its byte offset, first id, number of ids and the states of its
lanes) and a CRC-32 of its ids, then the footer's length and CRC-32.  A block's ids are dealt to
``LANES`` coders in turn; all coders share the block's one stream of 32-bit words.  States are 64
bits wide, frequencies sum to 2**SCALE.  Any block can be decoded alone.

Null texts are written as empty ones, so each document has at least the end id.  A null
``doc_id`` sorts first; rows of equal ``doc_id`` are kept and ordered by their ids.  An empty
table gives no files and no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, job, text

MAGIC = b"VRANS1\n\0"
BLOCK, LANES, SCALE = 65_536, 64, 20
#: Blocks coded side by side by one numpy call.
ABREAST = 32
#: Distinct pieces whose ids a worker keeps.
KEPT_PIECES = 400_000
LOW = np.uint64(1 << 31)
END_ID = 2


## tables

def table_of(counts: dict[int, int], scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their frequencies (sum 2**scale, at least 1 each), the same for the same counts."""
    if not counts:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    symbols = np.array(sorted(counts), np.uint32)
    if len(symbols) > 1 << scale:
        raise ValueError("more symbols than the table has room for")
    n = np.array([counts[int(s)] for s in symbols], np.float64)
    room = (1 << scale) - len(symbols)
    freq = 1 + np.floor(n / n.sum() * room).astype(np.int64)
    freq[np.argmax(n)] += (1 << scale) - freq.sum()
    return symbols, freq.astype(np.uint64)


class Coder:
    def __init__(self, symbols: np.ndarray, freq: np.ndarray, scale: int = SCALE):
        self.symbols, self.freq, self.scale = symbols, freq, np.uint64(scale)
        self.cum = np.cumsum(freq) - freq if len(freq) else freq
        self.slot = np.repeat(np.arange(len(symbols), dtype=np.int32), freq.astype(np.int64))
        self.mask = np.uint64((1 << scale) - 1)
        self.place = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 0, np.int64)
        self.place[symbols.astype(np.int64)] = np.arange(len(symbols))
        #: Pads the last block: the commonest symbol costs least.
        self.pad = int(np.argmax(freq)) if len(freq) else 0

    def encode(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each block its words, its lanes' final states, and its number of ids."""
        out = []
        for at in range(0, len(ids), BLOCK * ABREAST):
            out += self._encode(ids[at:at + BLOCK * ABREAST])
        return out

    def _encode(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        n = len(ids)
        blocks = -(-n // BLOCK)
        steps = BLOCK // LANES if blocks > 1 else -(-n // LANES)
        sym = self.place[ids]
        full = np.full(blocks * steps * LANES, self.pad, np.int64)
        full[:n] = sym
        sym = full.reshape(blocks, steps, LANES)
        x = np.full((blocks, LANES), LOW, np.uint64)
        words = np.empty((steps, blocks, LANES), np.uint32)
        emits = np.empty((steps, blocks, LANES), bool)
        up, low32 = np.uint64(63) - self.scale, np.uint64(32)
        for s in range(steps - 1, -1, -1):
            k = sym[:, s]
            f, c = self.freq[k], self.cum[k]
            over = x >= (f << up)
            emits[s], words[s] = over, x  # the low half
            x = np.where(over, x >> low32, x)
            q = x // f
            x = (q << self.scale) + (x - q * f) + c
        sizes = [min(BLOCK, n - b * BLOCK) for b in range(blocks)]
        return [(words[:, b][emits[:, b]], x[b].copy(), sizes[b]) for b in range(blocks)]

    def decode(self, blocks: list[tuple[np.ndarray, np.ndarray, int]]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for at in range(0, len(blocks), ABREAST):
            out += self._decode(blocks[at:at + ABREAST])
        return out

    def _decode(self, blocks: list[tuple[np.ndarray, np.ndarray, int]]) -> list[np.ndarray]:
        sizes = [n for _, _, n in blocks]
        steps = -(-max(sizes) // LANES)
        # A lone short block was coded in as many steps as it needs, others in full ones.
        lengths = np.array([len(w) for w, _, _ in blocks])
        words = np.concatenate([w for w, _, _ in blocks] + [np.zeros(1, np.uint32)]).astype(np.uint64)
        place = np.cumsum(lengths) - lengths
        ends = place + lengths
        x = np.stack([s for _, s, _ in blocks]).astype(np.uint64)
        got = np.empty((len(blocks), steps, LANES), np.int32)
        low32 = np.uint64(32)
        for s in range(steps):
            slot = x & self.mask
            k = self.slot[slot.astype(np.int64)]
            got[:, s] = k
            x = self.freq[k] * (x >> self.scale) + slot - self.cum[k]
            need = x < LOW
            rank = np.cumsum(need, axis=1)
            at = np.minimum(place[:, None] + rank - 1, len(words) - 1)
            x = np.where(need, (x << low32) | words[np.where(need, at, 0)], x)
            place = np.minimum(place + rank[:, -1], ends)
        return [self.symbols[got[b].reshape(-1)[:sizes[b]]] for b in range(len(blocks))]


## files

def _open(path: str, write: bool):
    from pyarrow import fs

    system, local = fs.FileSystem.from_uri(path)
    return system.open_output_stream(local) if write else system.open_input_file(local)


def write_file(path: str, coder: Coder, docs: list, counts: list[int], parts: Iterator[np.ndarray]) -> None:
    """``parts``: the ids in order, in arrays of any sizes."""
    index, first, rest = [], 0, []
    with _open(path, True) as out:
        out.write(MAGIC)
        at, held = len(MAGIC), 0

        def flush(ids: np.ndarray) -> None:
            nonlocal at, first
            for k, (words, states, n) in enumerate(coder.encode(ids)):
                raw = words.astype("<u4").tobytes()
                crc = zlib.crc32(ids[k * BLOCK:k * BLOCK + n].astype("<u4").tobytes())
                index.append([at, len(raw), first, n, crc, states.astype("<u8").tobytes().hex()])
                out.write(raw)
                at += len(raw)
                first += n

        for ids in parts:
            rest.append(ids)
            held += len(ids)
            if held >= BLOCK * ABREAST:
                line = np.concatenate(rest)
                whole = len(line) // (BLOCK * ABREAST) * (BLOCK * ABREAST)
                flush(line[:whole])
                rest, held = [line[whole:]], len(line) - whole
        if held:
            flush(np.concatenate(rest))
        foot = zlib.compress(json.dumps({"docs": docs, "counts": counts, "blocks": index}).encode(), 6)
        out.write(foot + struct.pack("<QI", len(foot), zlib.crc32(foot)))


def read_file(path: str, coder: Coder) -> Iterator[tuple[object, int, np.ndarray]]:
    """Documents of a file in order: id, place of its first token in the file, its ids."""
    with _open(path, False) as f:
        size = f.size()
        f.seek(size - 12)
        length, crc = struct.unpack("<QI", f.read(12))
        f.seek(size - 12 - length)
        raw = f.read(length)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"{path}: the footer's checksum is wrong")
        foot = json.loads(zlib.decompress(raw))
        docs, counts, blocks = foot["docs"], foot["counts"], foot["blocks"]
        buf, have, at, d = [], 0, 0, 0
        for b in range(0, len(blocks), ABREAST):
            group = blocks[b:b + ABREAST]
            coded = []
            for offset, nbytes, _, n, _, states in group:
                f.seek(offset)
                coded.append((np.frombuffer(f.read(nbytes), "<u4"), np.frombuffer(bytes.fromhex(states), "<u8"), n))
            for got, meta in zip(coder.decode(coded), group):
                if zlib.crc32(got.astype("<u4").tobytes()) != meta[4]:
                    raise ValueError(f"{path}: a block's checksum is wrong")
                buf.append(got)
                have += len(got)
            if d < len(docs) and have >= counts[d]:
                line, used = np.concatenate(buf), 0
                while d < len(docs) and used + counts[d] <= len(line):
                    yield docs[d], at, line[used:used + counts[d]]
                    used += counts[d]
                    at += counts[d]
                    d += 1
                buf, have = [line[used:]], len(line) - used


## tokens

class LibraryIds:
    """Ids by the tokenizers library, each distinct piece once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.marks = tuple(t.content.encode() for t in self.tok.get_added_tokens_decoder().values())
        self.symbol = {b: s for s, b in bpe._byte_symbols().items()}
        self.known: dict[bytes, list[int]] = {}

    def __call__(self, pieces: list[bytes]) -> list[list[int]]:
        known = self.known
        if len(known) > KEPT_PIECES:
            known.clear()
        rest = []
        symbol, tokenize = self.symbol, self.model.tokenize
        for p in pieces:
            if p in known:
                continue
            bare = p[1:] if p[0] == 32 else p
            if bare.isalpha():  # ASCII
                known[p] = [t.id for t in tokenize("Ġ" + bare.decode() if p[0] == 32 else bare.decode())]
                continue
            s = p.decode("utf-8", "replace")
            if (s[1:] if s[:1] == " " else s).isalpha():  # one pre-token: straight to the library's model
                line = "Ġ" + s[1:] if s[0] == " " and s.isascii() else s if s.isascii() else "".join([symbol[b] for b in p])
                known[p] = [t.id for t in tokenize(line)]
            else:
                rest.append(p)
        if rest:
            for p, e in zip(rest, self.tok.encode_batch_fast([p.decode("utf-8", "replace") for p in rest], add_special_tokens=False)):
                known[p] = e.ids
        return [known[p] for p in pieces]

    def column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = text.units(col, self.marks)
        return bpe.spread(coded, self(coded.pieces))


_LOADED: dict[str, LibraryIds] = {}


def _library(path: str) -> LibraryIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _LOADED:
        _LOADED[path] = LibraryIds(path)
    return _LOADED[path]


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and ids (little-endian, 16 bits each if the vocabulary allows, else 32), end id last."""
    wide = _library(path).tok.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = _library(path)
        for batch in batches:
            for part in text.slices(batch, size=12_000_000):
                ids, ptr = lib.column(part.column("text"))
                n = part.num_rows
                out = np.empty(len(ids) + n, kind)
                ends = ptr[1:] + np.arange(n)
                keep = np.ones(len(out), bool)
                keep[ends] = False
                out[keep] = ids
                out[ends] = end_id
                off = np.concatenate([[0], ends + 1]) * out.itemsize
                yield pa.record_batch(
                    [part.column("doc_id").cast(pa.int64()), text.as_array(out.view(np.uint8), off).cast(pa.binary())], names=["doc_id", "ids"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary"), kind


def id_counts(ids: DataFrame, kind: str) -> dict[int, int]:
    """How often each id occurs in all documents; at most as many entries as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            raw, _ = text.buffers(batch.column("ids"))
            part = np.bincount(np.ascontiguousarray(raw).view(kind))
            if len(part) > len(total):
                total, part = part.astype(np.int64), total
            total[:len(part)] += part
        have = np.flatnonzero(total)
        yield pa.record_batch([pa.array(have, pa.int64()), pa.array(total[have], pa.int64())], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r["id"]: r["n"] for r in rows}


def encode_corpus(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """Writes the files.  Returns one row per file (file, first_id, n_docs, n_tokens), and the table."""
    spark = docs.sparkSession
    ids, kind = tokenised(docs, path or bpe.default_path(), end_id)
    ids = job.written(ids, "ids")
    table = table_of(id_counts(ids, kind))
    folder = job.new_path(spark, "rans")
    job_fs_make(spark, folder)
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_, counts = [], []

        def parts() -> Iterator[np.ndarray]:
            for batch in batches:
                raw, off = text.buffers(batch.column("ids"))
                docs_.extend(batch.column("doc_id").to_pylist())
                counts.extend((np.diff(off) // np.dtype(kind).itemsize).tolist())
                yield np.ascontiguousarray(raw).view(kind).astype(np.uint32)

        stream = parts()
        head = next(stream, None)
        if head is None:
            return
        name = f"{folder}/{uuid.uuid4().hex}.rans"  # a repeated task writes another file; only its row counts

        def again() -> Iterator[np.ndarray]:
            yield head
            yield from stream

        write_file(name, Coder(*shared.value), docs_, counts, again())
        yield pa.record_batch(
            [pa.array([name]), pa.array([docs_[0]], pa.int64()), pa.array([len(docs_)], pa.int64()), pa.array([sum(counts)], pa.int64())],
            names=["file", "first_id", "n_docs", "n_tokens"],
        )

    files = job.written(
        ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids").mapInArrow(run, "file string, first_id bigint, n_docs bigint, n_tokens bigint"),
        "rans-files",
    )
    return files, table


def job_fs_make(spark: SparkSession, folder: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)


def read_back(files: DataFrame, table: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` adds what earlier files hold.  The running sum is over one row per file, a table that
    is as small as the number of partitions."""
    spark = files.sparkSession
    shared = spark.sparkContext.broadcast(table)
    rows = sorted(files.collect(), key=lambda r: (r["first_id"] is not None, r["first_id"] or 0))
    work, at = [], 0
    for r in rows:
        work.append((r["file"], at))
        at += r["n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*shared.value)
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                out: list[tuple] = []
                for doc, start, ids in read_file(file, coder):
                    out.append((doc, before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 20_000:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    plan = spark.createDataFrame(work, "file string, before bigint").repartition(max(1, len(work)), "file")
    return plan.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op7_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    job.arrow_batches(spark)
    return read_back(*encode_corpus(job.documents(spark, sf_dir)))
