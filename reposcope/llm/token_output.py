"""Token ids in binary files: fixed-size blocks of ids transposed into byte or bit planes, each plane
compressed with zstandard, with an index of blocks and documents at the end of the file.

File: magic; for every block its planes, compressed one by one (planes of zeros are left out);
index, compressed: block table (offset, ids, then a length for each plane) and document table
(id, null flag, number of ids); offset and length of the index; magic. Any range of ids is read
from the blocks that hold it.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from reposcope.llm.bpe import WORD, PieceCache
from reposcope.llm.common import materialize, parts, scratch_path

MAGIC = b"RSPLANE1"
BLOCK = 65_536
LEVEL = 3
#: Different pieces that a worker keeps.
PIECES = 500_000
#: Words put into one text.
TOGETHER = 10_000
#: The sign of a space in a byte-level vocabulary.
SPACE = "\u0120"
#: Bytes of text for each file.
FILE_BYTES = 16 << 20
#: Texts encoded at once.
BATCH = 256


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of 32-bit ids, lowest first: 4 of bytes or 32 of bits."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, i].tobytes() for i in range(4)]
    cells = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(cells[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes | None], n: int, bits: bool) -> np.ndarray:
    if not bits:
        raw = np.zeros((n, 4), dtype=np.uint8)
        for i, p in enumerate(planes):
            if p is not None:
                raw[:, i] = np.frombuffer(p, dtype=np.uint8)
        return raw.view("<u4").ravel()
    cells = np.zeros((n, 32), dtype=np.uint8)
    for i, p in enumerate(planes):
        if p is not None:
            cells[:, i] = np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little")
    return np.packbits(cells, axis=1, bitorder="little").view("<u4").ravel()


class PlaneWriter:
    def __init__(self, out, bits: bool = False, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.at = out.write(MAGIC)
        self.held, self.n_held = [], 0
        self.blocks: list[list[int]] = []
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, dtype=np.uint32)
        stop = len(ids) if last else len(ids) // self.block * self.block
        for a in range(0, stop, self.block):
            part = ids[a : a + self.block]
            row = [self.at, min(self.block, stop - a)]
            for plane in to_planes(part, self.bits):
                data = self.pack.compress(plane) if plane.count(0) < len(plane) else b""
                self.out.write(data)
                self.at += len(data)
                row.append(len(data))
            self.blocks.append(row)
        self.held = [ids[stop:]]
        self.n_held = len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        ids = np.array([d or 0 for d, _ in self.docs], dtype="<i8")
        null = np.array([d is None for d, _ in self.docs], dtype=np.uint8)
        size = np.array([n for _, n in self.docs], dtype="<u8")
        index = struct.pack("<BQQQ", self.bits, self.block, len(self.blocks), len(self.docs))
        index += np.array(self.blocks, dtype="<u8").tobytes() + ids.tobytes() + null.tobytes() + size.tobytes()
        index = self.pack.compress(index)
        self.out.write(index + struct.pack("<QQ", self.at, len(index)) + MAGIC)


class PlaneReader:
    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 24)
        at, length = struct.unpack("<QQ", (tail := source.read(24))[:16])
        source.seek(0)
        if source.read(8) != MAGIC or tail[16:] != MAGIC:
            raise ValueError("not a file of token planes")
        source.seek(at)
        self.unpack = zstandard.ZstdDecompressor()
        index = self.unpack.decompress(source.read(length))
        self.bits, self.block, n_blocks, n_docs = struct.unpack_from("<BQQQ", index)
        at, width = 25, 2 + (32 if self.bits else 4)
        self.blocks = np.frombuffer(index, dtype="<u8", count=n_blocks * width, offset=at).reshape(-1, width)
        at += 8 * n_blocks * width
        self.doc_ids = np.frombuffer(index, dtype="<i8", count=n_docs, offset=at)
        self.null = np.frombuffer(index, dtype=np.uint8, count=n_docs, offset=at + 8 * n_docs)
        self.sizes = np.frombuffer(index, dtype="<u8", count=n_docs, offset=at + 9 * n_docs).astype(np.int64)
        self._held: tuple[int, np.ndarray | None] = (-1, None)

    def _block(self, k: int) -> np.ndarray:
        if self._held[0] != k:
            row = self.blocks[k].tolist()
            self.source.seek(row[0])
            planes = [self.unpack.decompress(self.source.read(n)) if n else None for n in row[2:]]
            self._held = k, from_planes(planes, row[1], bool(self.bits))
        return self._held[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        parts = []
        while start < stop:
            k, a = divmod(start, self.block)
            part = self._block(k)[a : a + stop - start]
            parts.append(part)
            start += len(part)
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, start, ids) in the order of the file."""
        start = 0
        for doc, null, n in zip(self.doc_ids.tolist(), self.null.tolist(), self.sizes.tolist(), strict=True):
            yield (None if null else doc), start, self.ids(start, start + n)
            start += n


class Encoder:
    """The tokenizers library, asked once for each different piece of white space and what follows."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(added) or "(?!)").search
        self.dtype = "<u2" if self.library.get_vocab_size() <= 65_536 else "<u4"
        self.width = 2 if self.dtype == "<u2" else 4
        self.words = self._words(path)
        vocabulary = self.library.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.cache = PieceCache(self._ask, PIECES)

    @staticmethod
    def _words(path: str):
        """The same vocabulary and merges for words that each begin with their only space: cut at the
        space, not by the pattern. The library keeps no words: PieceCache does."""
        made = Tokenizer.from_file(path)
        model = made.model
        model._resize_cache(0)
        made.model = model
        made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), pre_tokenizers.Split(SPACE, "merged_with_next")])
        return made

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, texts: list[str]) -> list[bytes]:
        """Words with one space before them go to the library in one text: no token crosses from one
        to the next, so the ids are parted before each that begins with a space."""
        joined, other = [], []
        for i, t in enumerate(texts):
            (joined if WORD(t) else other).append(i)
        answers: list[bytes] = [b""] * len(texts)
        for at in range(0, len(joined), TOGETHER):
            part = joined[at : at + TOGETHER]
            made = np.array(self.words.encode_batch_fast(["".join([texts[i] for i in part])], add_special_tokens=False)[0].ids, dtype=self.dtype)
            starts = np.flatnonzero(self.opens[made])
            if len(starts) != len(part) or starts[0]:
                raise ValueError("tokens cross the borders of words")
            data, borders = made.tobytes(), [*(starts * self.width).tolist(), len(made) * self.width]
            for i, start, end in zip(part, borders, borders[1:]):
                answers[i] = data[start:end]
        for i, data in zip(other, self._ids([texts[i] for i in other]), strict=True):
            answers[i] = data
        return answers

    def encode(self, texts: list[str]) -> list[bytes]:
        """Texts that hold the string of an added token go to the library as a whole: it alone knows
        what of them is that token and what is around it."""
        whole = [i for i, t in enumerate(texts) if self.added(t)]
        if not whole:
            return self.cache.encode(texts)
        taken, made = set(whole), dict(zip(whole, self._ids([texts[i] for i in whole]), strict=True))
        rest = iter(self.cache.encode([t for i, t in enumerate(texts) if i not in taken]))
        return [made[i] if i in taken else next(rest) for i in range(len(texts))]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, bits: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every row and write files of planes below ``path`` in ascending order of ids (null ids
    first, equal ids in the order of their texts' hashes). Returns the manifest, one row for each
    file: (bucket, file, n_docs, n_ids), buckets in the order of ids.

    Null texts count as empty: such a document is its end id. Rows are dealt by ranges of (id, hash of
    the text), so that an id that many rows share spreads over files; only rows equal in both stay
    together. A task sorts its range (spilling), then encodes and writes it in one pass, holding one
    block and BATCH texts. A file is written beside its place and moved, so a task that runs again
    leaves the same file. Other columns are not read. An empty table gives no files.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    files = int(max(1, size // FILE_BYTES))
    manifest = pa.schema([("bucket", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def write(batches):
        disk, root = pafs.FileSystem.from_uri(path)
        made, writer, bucket = encoder(tokenizer), None, TaskContext.get().partitionId()
        end = np.array([end_id], dtype=made.dtype).tobytes()
        for part in parts(batches, BATCH):
            if writer is None:
                disk.create_dir(root, recursive=True)
                temp, name = f"{root}/.{uuid.uuid4().hex}", f"tokens-{bucket:07d}.planes"
                out = disk.open_output_stream(temp)
                writer, n_ids = PlaneWriter(out, bits), 0
            for doc, ids in zip(part.column(0).to_pylist(), made.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                found = np.frombuffer(ids + end, dtype=made.dtype)
                n_ids += len(found)
                writer.add(doc, found)
        if writer is not None:
            writer.close()
            out.close()
            disk.move(temp, f"{root}/{name}")
            yield pa.RecordBatch.from_pylist([{"bucket": bucket, "file": f"{path}/{name}", "n_docs": len(writer.docs), "n_ids": n_ids}], schema=manifest)

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(files, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    return materialize(dealt.mapInArrow(write, "bucket int, file string, n_docs bigint, n_ids bigint"), "manifest")


def read_tokens(manifest: DataFrame, digests: bool = False, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids array<bigint>) of every document in the files, or instead of ids
    ids_crc32 of their little-endian 32-bit form. start counts all ids of earlier documents. The
    running sum takes one row for each file (FILE_BYTES of text): 600,000 for 10 TB."""
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(upto), F.lit(0).cast("bigint")))
    last = "ids_crc32" if digests else "ids"

    def run(batches):
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                disk, place = pafs.FileSystem.from_uri(file)
                with disk.open_input_file(place) as source:
                    rows: list[tuple] = []
                    for doc, start, ids in PlaneReader(source, source.size()).documents():
                        made = zlib.crc32(ids.astype("<u4", copy=False)) if digests else ids.astype(np.int64)
                        rows.append((doc, base + start, len(ids), made))
                        if len(rows) == 2000:
                            yield batch_of(rows)
                            rows = []
                    yield batch_of(rows)

    def batch_of(rows):
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.int64()] * 3 + [pa.int64() if digests else pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [id_col, "start", "n_tokens", last])

    tasks = max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4)
    dealt = files.select("file", "base").repartition(tasks, "file")
    return dealt.mapInArrow(run, f"`{id_col}` bigint, start bigint, n_tokens bigint, {last} " + ("bigint" if digests else "array<bigint>"))


def tokens_of(docs: DataFrame, tokenizer: str | None = None, digests: bool = False, bits: bool = False) -> DataFrame:
    """Write all documents to files in the shared folder and read them back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = scratch_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, path, tokenizer, bits=bits), digests)


def in_memory(documents: list[tuple[int | None, np.ndarray]], bits: bool = False, block: int = BLOCK) -> bytes:
    """One file as bytes, for small data and tests."""
    out = io.BytesIO()
    writer = PlaneWriter(out, bits, block)
    for doc, ids in documents:
        writer.add(doc, ids)
    writer.close()
    return out.getvalue()
