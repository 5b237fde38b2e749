"""Byte-level BPE by dynamic programming over prefixes, and its inverse.

For every prefix of a pre-token there is exactly one token that ends the encoding of that
prefix.  An automaton over the vocabulary yields, at each end, every token that is a suffix of
the prefix, longest first; the first that is compatible with the stored last token of the
shorter prefix is the one.  Following the stored tokens back from the end gives the ids.  Time
is linear in the text (each end has at most ``longest token`` candidates), where repeated merging
is quadratic in the worst case.

Work is done once per distinct piece of a batch; see :mod:`vellum.llm.text`.

Null texts are encoded as empty ones.  Empty texts have no ids.  Extra columns are ignored by
``op9_byte_bpe`` (its result is keyed by ``doc_id``; repeated ids give repeated rows).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vellum.llm import job, text

#: Distinct pre-tokens whose ids a worker keeps; beyond that it starts anew.
KEPT_PIECES = 150_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OUT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins for bytes that byte-level vocabulary files use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level vocabulary, read from a tokenizer file.

    ``special``: strings of added tokens, which a text may hold as such.  The file must list
    merges in the order of the merged tokens' ids, as rank order is what makes two neighbouring
    tokens compatible or not.
    """

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = _byte_symbols()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        n = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * n
        for s, i in vocab.items():
            self.bytes[i] = bytes(symbols[c] for c in s) if all(c in symbols for c in s) else s.encode()
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.left, self.right = [-1] * n, [-1] * n
        self.merged: dict[int, int] = {}
        # rank[i]: when the merge that makes token i applies; single bytes come before all merges.
        self.rank = [-1] * n
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ia, ib, i = vocab[a], vocab[b], vocab[a + b]
            self.merged[ia << 32 | ib] = r
            if self.rank[i] < 0:
                self.rank[i], self.left[i], self.right[i] = r, ia, ib
        self.single = [-1] * 256
        for i, b in enumerate(self.bytes):
            if len(b) == 1 and self.rank[i] < 0:
                self.single[b[0]] = i
        self._fits: dict[int, bool] = {}
        self._known: dict[bytes, list[int]] = {}
        self._split = regex.compile(PATTERN)
        self._marks = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.automaton = ahocorasick.Automaton()
        for i, b in enumerate(self.bytes):
            if b and self.bytes[i].decode("utf-8", "replace") not in self.special and (self.rank[i] >= 0 or len(b) == 1) and self._own(i):
                self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._size = lengths.tolist()
        self.length, self.start = lengths, np.cumsum(lengths) - lengths

    def _own(self, i: int) -> bool:
        """Whether the token is the encoding of its own bytes."""
        return self.rank[i] < 0 or self.fits(self.left[i], self.right[i], self.rank[i])

    def fits(self, a: int, b: int, before: int | None = None) -> bool:
        """Whether a then b, each the encoding of its bytes, is the encoding of both together:
        undo the later of the merges next to the seam, one at a time; if at any point the two
        tokens at the seam could have been merged before the merge that was undone, it isn't."""
        rank, left, right, merged = self.rank, self.left, self.right, self.merged
        if before is None:
            key = a << 32 | b
            known = self._fits.get(key)
            if known is None:
                if len(self._fits) > 400_000:
                    self._fits.clear()
                known = self._fits[key] = self.fits(a, b, 1 << 40)
            return known
        limit = before
        while True:
            r = merged.get(a << 32 | b)
            if r is not None and r < limit:
                return False
            # Of equal ranks the merge further left applies first, so b's is the later one.
            if rank[a] > rank[b]:
                limit, a = rank[a], right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, left[b]
            else:
                return True

    def _solve(self, pieces: list[bytes]) -> None:
        """Puts the ids of these pre-tokens into the known ones.  All are laid out in one string,
        each after a sign that no token holds, so that one pass of the automaton serves them."""
        line = "\u0100".join(["", *(p.decode("latin-1") for p in pieces)])
        last = [-1] * (len(line) + 1)
        at = 1
        for p in pieces:
            last[at] = -2  # a piece starts here
            at += len(p) + 1
        known, fits = self._fits, self.fits
        # The automaton lists the matches of an end longest first; the first that fits is the one.
        for end, (tok, length) in self.automaton.iter(line):
            end += 1
            if last[end] == -1:
                prev = last[end - length]
                if prev < 0:
                    if prev == -2:
                        last[end] = tok
                else:
                    fit = known.get(prev << 32 | tok)
                    if fit or (fit is None and fits(prev, tok)):
                        last[end] = tok
        size, out = self._size, self._known
        at = 1
        for p in pieces:
            end = at + len(p)
            ids, place = [], end
            while place > at:
                tok = last[place]
                ids.append(tok)
                place -= size[tok]
            ids.reverse()
            out[p] = ids
            at = end + 1

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece of valid UTF-8; every piece is pre-tokenised by itself."""
        known = self._known
        if len(known) > KEPT_PIECES:
            known.clear()
        todo: dict[bytes, None] = {}
        parts: dict[int, list] = {}
        for k, p in enumerate(pieces):
            if p in known:
                continue
            s = p.decode("utf-8", "replace")
            if (s[1:] if s[:1] == " " else s).isalpha():
                todo[p] = None
                continue
            own: list = []
            at = 0
            for m in self._marks.finditer(s) if self._marks else ():
                own += map(str.encode, self._split.findall(s[at:m.start()]))
                own.append(self.special[m.group()])
                at = m.end()
            own += map(str.encode, self._split.findall(s[at:]))
            parts[k] = own
            for x in own:
                if not isinstance(x, int) and x not in known:
                    todo[x] = None
        if todo:
            self._solve(list(todo))
        return [
            known[p] if k not in parts else [i for x in parts[k] for i in ((x,) if isinstance(x, int) else known[x])]
            for k, p in enumerate(pieces)
        ]

    def encode(self, s: str) -> list[int]:
        return self.encode_pieces([s.encode()])[0] if s else []

    def decode(self, ids) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")

    def encode_column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint32), and documents + 1 places in them."""
        coded = text.units(col, tuple(s.encode() for s in self.special))
        return spread(coded, self.encode_pieces(coded.pieces))

    def decode_flat(self, ids: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts of the ids, and documents + 1 places in them."""
        size = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return text.ragged_take(self.flat, self.start[ids], size), ends[ptr]


def spread(coded: text.Coded, ids: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the distinct pieces, laid out for all pieces."""
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
    start = np.cumsum(size) - size
    per = size[coded.codes]
    ends = np.concatenate([[0], np.cumsum(per)])
    return text.ragged_take(flat, start[coded.codes], per), ends[coded.ptr]


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def digest(docs: DataFrame, path: str | None = None, size: int = 4_000_000) -> DataFrame:
    """One row per document: the count and digest of its ids, and the digest of the text that
    they decode to.  Needs ``doc_id`` and ``text``; no shuffle."""
    at = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(at)
        for batch in batches:
            for part in text.slices(batch, size=size):
                ids, ptr = bpe.encode_column(part.column("text"))
                raw, off = bpe.decode_flat(ids, ptr)
                wire, out = memoryview(ids.astype("<u4").tobytes()), memoryview(np.ascontiguousarray(raw))
                p, o = ptr.tolist(), off.tolist()
                n = range(part.num_rows)
                yield pa.record_batch([
                    part.column("doc_id").cast(pa.int64()),
                    pa.array(np.diff(ptr), pa.int64()),
                    pa.array([hashlib.sha256(wire[4 * p[i]:4 * p[i + 1]]).hexdigest() for i in n], pa.string()),
                    pa.array([hashlib.sha256(_valid(out[o[i]:o[i + 1]])).hexdigest() for i in n], pa.string()),
                ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(text.tidy(run), OUT)


def _valid(raw: memoryview) -> bytes:
    """As the tokenizer decodes: bytes that aren't UTF-8 become U+FFFD."""
    b = bytes(raw)
    try:
        b.decode()
    except UnicodeDecodeError:
        return b.decode("utf-8", "replace").encode()
    return b


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    job.arrow_batches(spark)
    return digest(job.documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the digests of every document, with its lang and source."""
    job.arrow_batches(spark, job.STAGE_BATCH)
    return digest(docs, size=job.STAGE_SLICE)
