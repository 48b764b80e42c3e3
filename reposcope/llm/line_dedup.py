"""Lines that many documents share: which of them each document keeps, as compressed bitmaps.

Documents give a row for each of their different long lines: a 128-bit hash of the line, the document
and the line's positions. The rows are dealt by ranges of (hash, document) and sorted, so that a line
that a third of all documents hold is many ranges, not one. Each range streams past: the first document
of a hash keeps its lines, later ones lose theirs as soon as enough documents have come by. Only a
range's first and last hash can reach into another range; their rows wait for the sums of these few
hashes (two for each range). What a document loses comes back to it as positions and is kept as a
bitmap; texts are never shuffled for it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reposcope.llm.common import free_name, materialize, parts

#: A line counts from so many code points on, and is dropped from so many documents on.
CHARS, DOCUMENTS = 20, 3

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = b" \t\n\x0b\x0c\r"
_KEYS = "hi bigint, lo bigint, doc bigint, named boolean, mark bigint, n_lines int, at array<int>"
_PASSED = "kind string, hi bigint, lo bigint, doc bigint, named boolean, mark bigint, n_lines int, at array<int>, last bigint, last_named boolean, docs bigint"


def long_lines(text: bytes, chars: int) -> tuple[int, dict[bytes, list[int]]]:
    """How many lines a text has, and the positions of each different key of ``chars`` code points or more:
    a line stripped of white space at its ends, A-Z lower-cased."""
    lines = text.translate(_LOWER).split(b"\n")
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(lines):
        key = line.strip(_SPACE)
        if len(key) >= chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= chars):
            found.setdefault(key, []).append(i)
    return len(lines), found


def line_keys(docs: DataFrame, chars: int, id_col: str, text_col: str) -> DataFrame:
    """A row of ``_KEYS`` for each document and different long line of it. ``mark`` tells rows of one id
    apart; a row without an id has named false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            hashes, row, n_lines, at, ends = [], [], [], [], [0]
            for i, t in enumerate(batch.column(2).cast(pa.large_binary())):
                n, found = long_lines(t.as_py() or b"", chars)
                for key, positions in found.items():
                    hashes.append(xxhash.xxh3_128_digest(key))
                    row.append(i)
                    n_lines.append(n)
                    at += positions
                    ends.append(len(at))
            h = np.frombuffer(b"".join(hashes), dtype=">i8").astype(np.int64).reshape(-1, 2)
            take = pa.array(row, pa.int64())
            doc = batch.column(0).take(take)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))
            columns = [pa.array(h[:, 0]), pa.array(h[:, 1]), doc.fill_null(0), doc.is_valid(), batch.column(1).take(take), pa.array(n_lines, pa.int32()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["hi", "lo", "doc", "named", "mark", "n_lines", "at"])

    return marked(docs, id_col, text_col).mapInArrow(run, _KEYS)


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, mark, text): mark is a hash of the text, so that rows of one id with other texts differ."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _stream(documents: int):
    """A range's rows, sorted by hash and by document from the largest, to rows of ``_PASSED``: ``drop``,
    ``open`` (decided by the sums), and ``sum`` of the first and the last hash of the range."""

    def keys_of(rows: pa.Table) -> np.ndarray:
        return np.stack([rows.column(c).to_numpy() for c in ("hi", "lo")], axis=1)

    def docs_of(rows: pa.Table) -> np.ndarray:
        return np.stack([rows.column("named").to_numpy(zero_copy_only=False).astype(np.int64), rows.column("doc").to_numpy()], axis=1)

    def passed(rows: pa.Table, kind: str) -> pa.Table:
        n = rows.num_rows
        none = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64())]
        return pa.Table.from_arrays([pa.array([kind] * n, pa.string()), *(rows.column(c).combine_chunks() for c in rows.column_names), *none], names=_NAMES)

    def summed(key, first, last, docs) -> pa.Table:
        row = {"kind": "sum", "hi": key[0], "lo": key[1], "doc": first[1], "named": bool(first[0]), "mark": None, "n_lines": None, "at": None, "last": last[1], "last_named": bool(last[0]), "docs": docs}
        return pa.Table.from_pylist([row], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = last = None  # the hash that passes by, its first and its newest document
        docs, is_head, held = 0, True, []  # its documents so far; whether it is the range's first; rows that wait
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not rows.num_rows:
                continue
            keys, ids = keys_of(rows), docs_of(rows)
            goes_on = tuple(keys[0]) == key
            new = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]
            runs = np.flatnonzero(new)
            sizes = np.diff(np.r_[runs, len(keys)])
            new_doc = new | np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)]
            own = ids[runs]  # each run's first document
            if goes_on:
                new_doc[0], own[0] = tuple(ids[0]) != last, first
            count = np.add.reduceat(new_doc.astype(np.int64), runs)
            if goes_on:
                count[0] += docs
            elif key is not None:
                if is_head:
                    yield from summed(key, first, last, docs).to_batches()
                is_head, held = False, []
            other = (ids != np.repeat(own, sizes, axis=0)).any(axis=1)
            drop = other & np.repeat(count >= documents, sizes)
            if is_head:  # decided by the sums alone
                drop[: sizes[0]] = False
                yield from passed(rows.slice(0, sizes[0]), "open").to_batches()
                if len(runs) > 1:
                    yield from summed(tuple(keys[0]), tuple(own[0]), tuple(ids[sizes[0] - 1]), int(count[0])).to_batches()
                    is_head = False
            elif held and count[0] >= documents:
                yield from passed(pa.concat_tables(held), "drop").to_batches()
                held = []
            elif len(runs) > 1:
                held = []
            yield from passed(rows.filter(pa.array(drop)), "drop").to_batches()
            if not is_head and count[-1] < documents:
                held.append(rows.slice(runs[-1]).filter(pa.array(other[runs[-1] :])))
            key, first, last, docs = tuple(keys[-1]), tuple(own[-1]), tuple(ids[-1]), int(count[-1])
        if key is not None:
            yield from summed(key, first, last, docs).to_batches()
        if held:
            yield from passed(pa.concat_tables(held), "open").to_batches()

    return run


_SCHEMA = pa.schema([
    ("kind", pa.string()), ("hi", pa.int64()), ("lo", pa.int64()), ("doc", pa.int64()), ("named", pa.bool_()), ("mark", pa.int64()), ("n_lines", pa.int32()),
    ("at", pa.list_(pa.int32())), ("last", pa.int64()), ("last_named", pa.bool_()), ("docs", pa.int64()),
])
_NAMES = _SCHEMA.names


def dropped_lines(keys: DataFrame, documents: int) -> DataFrame:
    """(doc, named, mark, n_lines, at): the positions that documents lose, from rows of ``_KEYS``."""
    order = ["hi", "lo", F.desc("named"), F.desc("doc"), "mark"]
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    passed = materialize(ranged.mapInArrow(_stream(documents), _PASSED), "lines-passed")
    sums = passed.where("kind = 'sum'")
    beside = Window.partitionBy("hi", "lo").orderBy(F.desc("named"), F.desc("doc"), F.desc("last_named"), F.desc("last"))
    again = (F.lag("last").over(beside) == F.col("doc")) & (F.lag("last_named").over(beside) == F.col("named"))
    met = sums.withColumn("again", F.coalesce(again, F.lit(False)).cast("int"))
    top = F.max(F.struct("named", "doc")).alias("top")
    shared = met.groupBy("hi", "lo").agg(F.sum(F.col("docs") - F.col("again")).alias("holders"), top).where(F.col("holders") >= documents).select("hi", "lo", "top")
    opened = passed.where("kind = 'open'").join(F.broadcast(shared), ["hi", "lo"])  # two hashes for each range at most
    columns = ("doc", "named", "mark", "n_lines", "at")
    late = opened.where(F.struct("named", "doc") != F.col("top")).select(*columns)
    return passed.where("kind = 'drop'").select(*columns).unionByName(late)


def pack(n_lines: int, dropped: np.ndarray) -> bytes:
    """The bitmap of the lines that stay: a bit for each line, the first highest, compressed."""
    keep = np.ones(n_lines, dtype=bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, chars: int = CHARS, documents: int = DOCUMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, n_lines, n_dropped, keep) of the documents that lose lines; the others keep all.

    Lines are what is between \\n (null and empty texts: one empty line, never dropped). A line's key is
    the line without white space at its ends, A-Z lower-cased; one of ``chars`` code points or more that
    ``documents`` documents or more hold stays in the one of the largest id, in all its places there, and
    goes elsewhere. Rows of one id are one document, however many there are, and rows without an id are
    another, smaller than all; ``mark`` is xxhash64 of the text, so that each row's bitmap is found. Other
    columns are not read; an empty table gives no rows."""
    gone = dropped_lines(materialize(line_keys(docs, chars, id_col, text_col), "line-keys"), documents)
    each = gone.distinct().groupBy("doc", "named", "mark").agg(F.first("n_lines").alias("n_lines"), F.flatten(F.collect_list("at")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(3).to_pylist()
            at = [np.array(x, dtype=np.int64) for x in batch.column(4).to_pylist()]
            doc = pa.compute.if_else(batch.column(1), batch.column(0), pa.scalar(None, pa.int64()))
            made = [doc, batch.column(2), batch.column(3), pa.array([len(x) for x in at], pa.int32()), pa.array([pack(k, x) for k, x in zip(n, at, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "mark", "n_lines", "n_dropped", "keep"])

    return each.mapInArrow(run, "doc_id bigint, mark bigint, n_lines int, n_dropped int, keep binary")


def _beside(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row of (doc, mark, text) and its bitmap or null; the bitmaps are hashed, texts stream by."""
    own = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), "keep").hint("shuffle_hash")
    texts = marked(docs, id_col, text_col)
    return texts.join(own, (texts["mark"] == own["_mark"]) & texts["doc"].eqNullSafe(own["_doc"]), "left").select("doc", "text", "keep")


def kept(text: bytes, keep: bytes | None) -> tuple[int, int, bytes]:
    """Lines before, lines dropped, and the text of the others."""
    if keep is None:
        return text.count(b"\n") + 1, 0, text
    lines = text.split(b"\n")
    stays = unpack(keep, len(lines))
    return len(lines), len(lines) - int(stays.sum()), b"\n".join([x for x, s in zip(lines, stays, strict=True) if s])


def apply(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the text that their bitmaps leave (null stays null; a text that
    loses every line is empty), whatever other columns are called."""
    carry, mark, keep = (free_name(n, docs.columns) for n in ("_row", "_mark", "_keep"))
    rest = docs.select(F.struct("*").alias(carry), F.xxhash64(text_col).alias(mark))
    own = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_own"), F.col("keep").alias(keep)).hint("shuffle_hash")
    doc = F.col(f"{carry}.`{id_col}`").cast("bigint")
    met = rest.join(own, (rest[mark] == own["_own"]) & doc.eqNullSafe(own["_doc"]), "left")

    @F.pandas_udf("string")
    def without(text, keep):
        made = [t if t is None or k is None else kept(t.encode("utf-8", "surrogatepass"), k)[2].decode("utf-8", "surrogatepass") for t, k in zip(text, keep, strict=True)]
        return type(text)(made, dtype=object)

    column = F.col(f"{carry}.`{text_col}`")
    new = F.when(F.col(keep).isNull(), column).otherwise(without(column, F.col(keep)))
    return met.select(*(new.alias(c) if c == text_col else F.col(f"{carry}.`{c}`").alias(c) for c in docs.columns))


def digests(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row of ``docs``."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = (t.as_py() or b"" for t in batch.column(1).cast(pa.large_binary()))
            made = [kept(t, k.as_py()) for t, k in zip(texts, batch.column(2), strict=True)]
            columns = [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array([hashlib.sha256(m[2]).hexdigest() for m in made], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return _beside(docs, bitmaps, id_col, text_col).mapInArrow(run, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")
