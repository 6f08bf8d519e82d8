"""Token-id output as directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level 0 holds the first chunk of every
id, level k the k-th chunk of those ids that go on; a continuation bitmap beside each level says
which do, and a rank directory (set bits before every block of 512) turns a place in one level
into its place in the next. Any token, or any run of tokens, is read by position alone.

A file (all integers little-endian):

    magic "DACT1\\0\\0\\0" | documents u64 | tokens u64 | levels u64
    start of each document in this file, u64 x (documents + 1)
    for each level: length u64, chunks u8 x length (padded to 8),
                    bitmap u64 words, directory u64 x (blocks + 1)

Documents are dealt by ranges of doc_id and sorted, so files in order of their part number hold
all documents in ascending doc_id order. A file holds about ``shard_tokens`` ids at most
(one document never spans files). Each attempt of a task writes under a name of its own and the
manifest, a table that Spark commits, names the files that count; a lost executor leaves at most an unnamed file.

Edge cases: a null or empty text has no ids but its end id; null doc_ids sort first, rows that
repeat a doc_id are documents of their own, in order of text; further columns are ignored; an empty table gives
an empty manifest and no rows.
"""

from __future__ import annotations

import ctypes
import struct
import threading
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orgpanel.llm.common import small_side
from orgpanel.storage import materialize, new_path

MAGIC = b"DACT1\0\0\0"
BLOCK = 512
#: Characters of a piece that is remembered, and what an entry takes besides its characters and ids.
LONGEST, ENTRY = 64, 160


@dataclass(frozen=True)
class TokenConfig:
    tokenizer: str | None = None
    end_id: int = 1
    cache_bytes: int = 96 << 20
    idle_seconds: float = 3.0
    shard_tokens: int = 1 << 22

    def path(self) -> str:
        if self.tokenizer:
            return self.tokenizer
        import public_tokenizers

        return public_tokenizers.path("word_bpe_49k.json")


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder(dict):
    """Text -> ids with the tokenizers library; pieces between spaces and line ends are remembered.

    The vocabulary's rules never join characters across a space or a line end, so the ids of a text
    are those of its pieces in order. Lower-casing first is safe, and makes
    more pieces equal, where every character is Latin-1 and no control string can occur. A piece of
    such lower-case letters alone is its own normal form and one word, so the library's
    model takes it directly; a last point or comma is a word of its own. All else goes through the
    whole tokenizer. Two generations of pieces of at most ``limit / 2`` bytes are kept, none of more than ``LONGEST`` characters.
    """

    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.whole, self.limit, self.old, self.size = Tokenizer.from_file(path), limit // 2, {}, 0
        self.model = self.whole.model
        odd = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b > 173)]
        #: the byte-level alphabet: bytes that do not print get the letters from 256 on
        self.letters = {b: chr(256 + k) for k, b in enumerate(odd)}

    def __missing__(self, piece: str) -> bytes:
        if self.size > self.limit:
            self.old, self.size = dict(self), 0
            self.clear()
            self[""] = b""
        ids = self.old.get(piece)
        if ids is None:
            # a letter whose normal form ends in a mark would share a word with the point
            if piece[-1] in ".," and normalize("NFC", piece[:-1]).lower().isalpha():
                return self[piece[:-1]] + self[piece[-1]]
            plain = piece.isascii()
            if piece.isalpha() and (plain or max(piece) < "\u0100") and piece == piece.lower():
                # letters of ASCII stand for themselves in the byte-level alphabet
                word = piece if plain else piece.encode().decode("latin-1").translate(self.letters)
                ids = pack_ids([t.id for t in self.model.tokenize(word)])
            else:
                ids = pack_ids(self.whole.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST:
            self[piece] = ids
            self.size += len(piece) + len(ids) + ENTRY
        return ids

    def ids(self, text: str) -> bytes:
        if "<|" not in text:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


#: The encoder of a Python worker, and the timer that drops it.
_held: dict = {}


def take_encoder(path: str, limit: int) -> Encoder:
    """The encoder that the worker's last task left, with its pieces, or a new one."""
    if timer := _held.pop("timer", None):
        timer.cancel()
    key, encoder = _held.get("encoder", (None, None))
    if key != (path, limit):
        encoder = Encoder(path, limit)
    _held["encoder"] = (path, limit), encoder
    return encoder


def _drop_encoder() -> None:
    """Free the encoder, and give the memory back to the system where its library can."""
    _held.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def leave_encoder(seconds: float) -> None:
    """Keep the encoder for the next task, unless none comes within some seconds: an idle worker holds nothing."""
    timer = threading.Timer(seconds, _drop_encoder)
    timer.daemon = True
    _held["timer"] = timer
    timer.start()


def pack(docs: list[bytes]) -> bytes:
    """The file image for the ids (u32) of the documents."""
    starts = np.concatenate([[0], np.cumsum([len(d) // 4 for d in docs])]).astype("<u8")
    left, out, levels = np.frombuffer(b"".join(docs), "<u4"), [], 0
    while levels == 0 or len(left):
        chunks, more = (left & 255).astype(np.uint8), left >> 8
        goes = more > 0
        bits = np.packbits(goes, bitorder="little").tobytes()
        words = -(-len(left) // 64)
        counts = np.add.reduceat(goes, np.arange(0, len(goes), BLOCK), dtype="<u8") if len(goes) else np.empty(0, "<u8")
        rank = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
        out += [struct.pack("<Q", len(left)), chunks.tobytes().ljust(-(-len(left) // 8) * 8, b"\0"), bits.ljust(words * 8, b"\0"), rank.tobytes()]
        left, levels = more[goes], levels + 1
    return b"".join([MAGIC, struct.pack("<3Q", len(docs), int(starts[-1]), levels), starts.tobytes(), *out])


class Codes:
    """Random access to a file image."""

    def __init__(self, image: bytes | memoryview):
        if bytes(image[:8]) != MAGIC:
            raise ValueError("not a token file")
        n, self.tokens, levels = struct.unpack_from("<3Q", image, 8)
        self.starts, at, self.levels = np.frombuffer(image, "<u8", n + 1, 32), 32 + 8 * (n + 1), []
        for _ in range(levels):
            (length,) = struct.unpack_from("<Q", image, at)
            at += 8
            chunks = np.frombuffer(image, np.uint8, length, at)
            at += -(-length // 8) * 8
            bits = np.frombuffer(image, np.uint8, -(-length // 64) * 8, at)
            at += len(bits)
            rank = np.frombuffer(image, "<u8", -(-length // BLOCK) + 1, at)
            at += 8 * len(rank)
            self.levels.append((chunks, bits, rank))

    def _rank(self, level: int, i: int) -> int:
        _, bits, rank = self.levels[level]
        block = i // BLOCK
        if block * BLOCK >= 8 * len(bits):
            return int(rank[-1])
        piece = np.unpackbits(bits[block * BLOCK // 8 : -(-i // 8)], bitorder="little")[: i - block * BLOCK]
        return int(rank[block]) + int(piece.sum())

    def get(self, i: int) -> int:
        """The i-th id of the file."""
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return value

    def run(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi (end exclusive)."""
        out, where = np.zeros(hi - lo, "<u4"), np.arange(hi - lo)
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[where] |= chunks[lo:hi].astype("<u4") << np.uint32(8 * level)
            goes = np.unpackbits(bits[lo >> 3 : -(-hi // 8)], bitorder="little")[lo & 7 : (lo & 7) + hi - lo].astype(bool)
            where = where[goes]
            if not len(where):
                break
            lo = self._rank(level, lo)
            hi = lo + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.run(int(self.starts[k]), int(self.starts[k + 1]))


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_tokens(docs: DataFrame, cfg: TokenConfig = TokenConfig(), order: list | None = None) -> DataFrame:
    """Write the token files; returns the manifest (part, seq, path, n_docs, n_tokens, doc_ids)."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    end = np.array([cfg.end_id], "<u4").tobytes()
    order = order or ["doc_id"]
    path = cfg.path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), take_encoder(path, cfg.cache_bytes)
        store, root = _store(folder)
        ids, held, size, seq = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            store.create_dir(root, recursive=True)
            name = f"{root}/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.dact"
            with store.open_output_stream(name) as f:
                f.write(pack(held))
            row = {"part": [part], "seq": [seq], "path": [name.rsplit("/", 1)[1]], "n_docs": [len(held)], "n_tokens": [size], "doc_ids": [ids]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64()))]))

        for b in batches:
            for doc, text in zip(b.column("doc_id"), b.column("text")):
                held.append(encoder.ids(text.as_py() or "") + end)
                ids.append(doc.as_py())
                size += len(held[-1]) // 4
                if size >= cfg.shard_tokens:
                    yield flush()
                    ids, held, size, seq = [], [], 0, seq + 1
        if held:
            yield flush()
        leave_encoder(cfg.idle_seconds)

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c for c in order if c not in ("doc_id", "text")])
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order, "doc_id", "text").select("doc_id", "text")
    written = dealt.mapInArrow(run, "part int, seq int, path string, n_docs long, n_tokens long, doc_ids array<long>")
    # one small row for each file: few files of rows
    manifest = materialize(written.repartition(2 * spark.sparkContext.defaultParallelism), "manifest")
    return manifest.withColumn("path", F.concat(F.lit(folder + "/"), "path"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files.

    ``start`` adds up the tokens of the files before, in order of part and seq.
    """
    # the running sum is one task over a few integers for each file; ids of documents do not pass through it
    before = F.sum("n_tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    bases = materialize(manifest.select("part", "seq", F.coalesce(before, F.lit(0)).alias("base")), "bases")
    files = manifest.join(small_side(bases), ["part", "seq"]).select("path", "doc_ids", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, docs, base in zip(*(b.column(c).to_pylist() for c in ("path", "doc_ids", "base"))):
                folder, name = path.rsplit("/", 1)
                store, root = _store(folder)
                with store.open_input_file(f"{root}/{name}") as f:
                    codes = Codes(f.read())
                starts = codes.starts.astype(np.int64)
                crcs = [zlib.crc32(codes.document(k).tobytes()) for k in range(len(docs))]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(base + starts[:-1]), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a task for each file, up to a few thousand
    return files.repartition(min(max(1, bases.count()), 4096), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
