"""Token-ID output: shards of independent zstandard frames, with a trailing seek table and a checksum for each frame.

A shard holds the ids of a run of documents, in ascending id order::

    frame 0 | frame 1 | ... | seek table | footer

* frame: one complete zstandard frame (with zstandard's own content checksum) of up to ``FRAME_IDS`` ids, little-endian,
  2 bytes each if the vocabulary has 65,536 ids at most, else 4. A document may go over several frames.
* seek table: one zstandard skippable frame (so plain zstandard tools read the ids of a whole shard). Inside it a compressed
  block: for each frame its compressed size, number of ids and crc32 of the compressed bytes; for each document its id and
  number of ids.
* footer, the last 32 bytes of the skippable frame: length of the table block, its crc32, number of frames, number of
  documents, bytes for an id, ``MAGIC``.

A reader takes the footer, then the table, then only the frames that hold the documents it wants.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootloom.llm.chunk_memo import memo_for, tokenizer_path
from rootloom.llm.shared import new_folder

MAGIC = b"RLTF\x01\x00\x00\x00"
SKIPPABLE = 0x184D2A5E
FOOTER = struct.Struct("<QIIII8s")
FRAME_IDS = 131_072
#: Ids after which a task begins another shard.
SHARD_IDS = 8_000_000
#: Ranges of ids for each shuffle partition, as their hashes don't spread evenly.
RANGES = 4
#: Ids that a task reads back, and such tasks at most.
READ_IDS, READ_PARTS = 4_000_000, 20_000


class ShardWriter:
    """Writes one shard to a binary stream, frame by frame; memory holds one frame and the table."""

    def __init__(self, out, width: int, level: int = 1):
        import zstandard

        self.out, self.width, self.dtype = out, width, np.dtype(f"<u{width}")
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.doc_lens: list[int] = []
        self.pending: list[np.ndarray] = []
        self.n_pending = self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.add_run([doc_id], [len(ids)], ids)

    def add_run(self, doc_ids: list[int | None], lens: list[int], ids: np.ndarray) -> None:
        """Documents whose ids lie one after another in ``ids``."""
        self.doc_ids += doc_ids
        self.doc_lens += lens
        self.pending.append(np.asarray(ids, self.dtype))
        self.n_pending += len(ids)
        self.n_ids += len(ids)
        if self.n_pending >= FRAME_IDS:
            self._cut(FRAME_IDS)

    def _cut(self, least: int) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, self.dtype)
        at = 0
        while len(ids) - at >= max(least, 1):
            part = ids[at : at + FRAME_IDS]
            data = self.zstd.compress(part.tobytes())
            self.frames.append((len(data), len(part), zlib.crc32(data)))
            self.out.write(data)
            at += len(part)
        self.pending, self.n_pending = [ids[at:]], len(ids) - at

    def close(self) -> None:
        self._cut(1)
        frames = np.array(self.frames, "<u4").reshape(-1, 3)
        known = np.array([x is not None for x in self.doc_ids], "u1")
        ids = np.array([x or 0 for x in self.doc_ids], "<i8")
        block = self.zstd.compress(frames.tobytes() + known.tobytes() + ids.tobytes() + np.array(self.doc_lens, "<u8").tobytes())
        foot = FOOTER.pack(len(block), zlib.crc32(block), len(self.frames), len(self.doc_ids), self.width, MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(block) + len(foot)) + block + foot)


class ShardReader:
    """Reads a shard from a random-access binary file; raises ValueError where a checksum doesn't fit."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        block_len, crc, n_frames, n_docs, width, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        block = self._at(size - FOOTER.size - block_len, block_len)
        if zlib.crc32(block) != crc:
            raise ValueError("the seek table is damaged")
        raw, self.dtype = self.zstd.decompress(block), np.dtype(f"<u{width}")
        frames = np.frombuffer(raw, "<u4", 3 * n_frames).reshape(-1, 3).astype(np.int64)
        self.sizes, self.crcs = frames[:, 0], frames[:, 2]
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.id_starts = np.concatenate([[0], np.cumsum(frames[:, 1])])
        known = np.frombuffer(raw, "u1", n_docs, at := 12 * n_frames)
        ids = np.frombuffer(raw, "<i8", n_docs, at := at + n_docs)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u8", n_docs, at + 8 * n_docs).astype(np.int64))])
        self.cached: tuple[int, np.ndarray] | None = None

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(int(offset))
        return self.file.read(int(size))

    def frame(self, k: int) -> np.ndarray:
        if self.cached is None or self.cached[0] != k:
            data = self._at(self.offsets[k], self.sizes[k])
            if zlib.crc32(data) != self.crcs[k]:
                raise ValueError(f"frame {k} is damaged")
            self.cached = k, np.frombuffer(self.zstd.decompress(data), self.dtype)
        return self.cached[1]

    def ids(self, position: int) -> np.ndarray:
        """The ids of the document at that position; only its frames are read."""
        start, end = int(self.starts[position]), int(self.starts[position + 1])
        first = int(np.searchsorted(self.id_starts, start, "right")) - 1
        found, k = [], first
        while k < len(self.sizes) and self.id_starts[k] < end:
            at = int(self.id_starts[k])
            found.append(self.frame(k)[max(0, start - at) : end - at])
            k += 1
        return np.concatenate(found) if found else np.empty(0, self.dtype)


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def with_end_ids(counts: np.ndarray, ids: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Texts' ids one after another, and how many each has, with ``end_id`` behind those of each text."""
    if end_id is None:
        return counts, ids
    ends = np.cumsum(counts + 1) - 1
    out = np.full(len(ids) + len(counts), end_id, ids.dtype)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = ids
    return counts + 1, out


def encode_documents(docs: DataFrame, tokenizer: str, bounds: np.ndarray, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, id, ids binary) for each row: its ids, little-endian, with as many bytes each as the vocabulary needs; null texts are empty.

    part: the range of ``bounds`` that the id is in (null: the first); an id that several bounds are equal to has its rows dealt over their ranges.
    """
    path = tokenizer_path(tokenizer)

    def encode(batches):
        memo, seen = memo_for(path), 0
        for batch in batches:
            doc_ids = batch.column(0)
            known = np.asarray(doc_ids.fill_null(np.iinfo(np.int64).min))
            first, last = (np.searchsorted(bounds, known, side) for side in ("left", "right"))
            part = (first + (seen + np.arange(len(known))) % (last - first + 1)).astype(np.int32)
            seen += len(known)
            for at, counts, ids in memo.rounds(batch.column(1)):
                counts, ids = with_end_ids(counts, ids, end_id)
                offsets = np.concatenate([[0], np.cumsum(counts)]) * memo.width
                # A run of documents holds ROUND_BYTES of text at most, or a single text.
                column = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(part[at : at + len(counts)]), doc_ids.slice(at, len(counts)), column], ["part", "id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, "part int, id long, ids binary")


def id_bounds(docs: DataFrame, parts: int, id_col: str = "doc_id") -> np.ndarray:
    """Ids that part the rows into ``parts`` ranges of about equal numbers; only the ids are read."""
    cuts = [k / parts for k in range(1, parts)]
    found = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), F.array(*map(F.lit, cuts)), 10 * parts)).first()[0] if cuts else None
    return np.array(found or [], np.int64)


_WRITTEN = "shard string, first_doc long, last_doc long, n_docs long, n_ids long"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each row's text, and writes all ids in ascending id order; returns the manifest, one row for each shard.

    Manifest (also a Parquet table in ``folder``): shard, first_doc, last_doc, n_docs, n_ids, ids_before. ``end_id`` closes each
    document (None: nothing does). A null text is empty; null ids come first; rows with one id are ordered by a hash of their
    token ids, so that an id with very many rows goes over several shards; an empty table gives no shard; other columns
    aren't read. Ranges of ids come from the ids alone, so texts are encoded once, where they are read, and only compact token
    ids are shuffled. A shard is written under a name of its own attempt and then renamed, and the manifest names what the
    committed tasks wrote, so tasks that run again leave nothing wrong.
    """
    path = tokenizer_path(tokenizer)

    def write(batches):
        width = memo_for(path).width
        store, base = _store(folder)
        out = writer = in_part = None
        name, made = "", []

        def close():
            nonlocal out
            if out is not None:
                writer.close()
                out.close()
                store.move(f"{base}/_{name}", f"{base}/{name}")
                made.append((name, writer.doc_ids[0], writer.doc_ids[-1], len(writer.doc_lens), writer.n_ids))
                out = None

        for batch in batches:
            part, doc_ids, column = np.asarray(batch.column(0)), batch.column(1).to_pylist(), batch.column(2)
            ends = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64) // width
            ids = np.frombuffer(column.buffers()[2] or b"", f"<u{width}")
            at = 0
            while at < len(doc_ids):
                if part[at] != in_part:
                    close()
                    in_part = part[at]
                if out is None:
                    name = f"{uuid.uuid4().hex}.tokens"
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/_{name}")
                    writer = ShardWriter(out, width)
                # As many documents as make the shard full, or at most a frame's worth more.
                room = min(SHARD_IDS - writer.n_ids, FRAME_IDS)
                end = min(max(at + 1, int(np.searchsorted(ends, ends[at] + room, "right")) - 1), int(np.searchsorted(part, in_part, "right")))
                writer.add_run(doc_ids[at:end], np.diff(ends[at : end + 1]).tolist(), ids[ends[at] : ends[end]])
                at = end
                if writer.n_ids >= SHARD_IDS:
                    close()
        close()
        if made:
            cols = list(zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k else pa.string()) for k, c in enumerate(cols)], ["shard", "first_doc", "last_doc", "n_docs", "n_ids"])

    spark = docs.sparkSession
    bounds = id_bounds(docs, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")), id_col)
    rows = encode_documents(docs, tokenizer, bounds, end_id, id_col, text_col).withColumn("among", F.xxhash64("ids"))
    # A task may get several ranges; it closes a shard with each.
    ordered = rows.repartition("part").sortWithinPartitions("part", F.col("id").asc_nulls_first(), "among").select("part", "id", "ids")
    ordered.mapInArrow(write, _WRITTEN).write.parquet(f"{folder}/written")
    # One row for each shard of millions of ids: the running total over them is small.
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), F.col("last_doc").asc_nulls_first(), "shard").rowsBetween(Window.unboundedPreceding, -1)
    written = spark.read.schema(_WRITTEN).parquet(f"{folder}/written")
    written.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{_WRITTEN}, ids_before long").parquet(f"{folder}/manifest")


def read_documents(manifest: DataFrame, folder: str, wanted: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) from the shards; with ``wanted`` ids, only their frames are decompressed.

    ``ids``: little-endian unsigned 32-bit integers; left out unless ``with_ids``. Each row that was written gives a row, so an
    id that was repeated has several; a None among the wanted ids stands for null ids; ids that no shard holds give no row.
    """
    from rootloom.llm.chunk_memo import crc32_of_ids

    want = None if wanted is None else set(wanted)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def read(batches):
        store, base = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                at = f"{base}/{row['shard']}"
                with store.open_input_file(at) as file:
                    reader = ShardReader(file, store.get_file_info(at).size)
                    rows = []
                    for k, doc_id in enumerate(reader.doc_ids):
                        if want is None or doc_id in want:
                            ids = reader.ids(k)
                            found = (doc_id, row["ids_before"] + int(reader.starts[k]), len(ids), crc32_of_ids(ids))
                            rows.append((*found, ids.astype("<u4").tobytes()) if with_ids else found)
                        if rows and (len(rows) == 1000 or k == len(reader.doc_ids) - 1):
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    def _rows(rows):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 4 else pa.binary()) for k, c in enumerate(cols)], names)

    # A shard is some MB of work behind a tiny row, so the number of parts is given: adaptive execution would join them all.
    n_shards, n_ids = manifest.agg(F.count("*"), F.coalesce(F.sum("n_ids"), F.lit(0))).first()
    parts = max(1, min(n_shards, READ_PARTS, max(n_ids // READ_IDS, manifest.sparkSession.sparkContext.defaultParallelism)))
    return manifest.select("shard", "ids_before").repartition(parts, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def new_shard_folder(spark: SparkSession) -> str:
    return new_folder(spark, "token-shards")
