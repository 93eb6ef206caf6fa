"""Whether a dataset is whole: files, pairs of files, members of archives, label sums."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an archive's end that hold its last record, comment included, and of a directory that are read at once.
_TAIL, _STEP = 65_557, 1 << 20


def directory_place(tail: bytes, size: int, read) -> tuple[int, int] | None:
    """(begin, bytes) of a zip file's central directory from its last bytes; ``read(at, n)`` fetches what large files have elsewhere. None if it is no zip file."""
    at = tail.rfind(b"PK\x05\x06")
    if at < 0 or len(tail) < at + 22:
        return None
    length, begin = struct.unpack_from("<II", tail, at + 12)
    locator = at - 20
    if 0xFFFFFFFF in (length, begin) and locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        record = read(struct.unpack_from("<Q", tail, locator + 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            return None
        length, begin = struct.unpack_from("<QQ", record, 40)
    return (begin, length) if begin + length <= size else None


def directory_entries(begin: int, length: int, read):
    """(name, bytes) of each member, from the central directory only, read a piece at a time."""
    held, at, end = b"", begin, begin + length
    while True:
        while len(held) < 46 or len(held) < 46 + sum(struct.unpack_from("<HHH", held, 28)):
            if at >= end:
                return
            held += read(at, min(_STEP, end - at))
            at = min(at + _STEP, end)
        if held[:4] != b"PK\x01\x02":
            return
        name, extra, comment = struct.unpack_from("<HHH", held, 28)
        utf8 = struct.unpack_from("<H", held, 8)[0] & 0x800
        yield held[46 : 46 + name].decode("utf-8" if utf8 else "cp437"), struct.unpack_from("<I", held, 24)[0]
        held = held[46 + name + extra + comment :]


def zip_members(spark: SparkSession, folder: str, glob: str = "*.zip") -> DataFrame:
    """(path, member, bytes) of all zip files below a folder: tasks read each file's end and directory by offset, never the members. A file that is no zip file has one row without a member, an empty file none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "length")

    def look(batches):
        from pyarrow import fs

        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = fs.FileSystem.from_uri(path if not path.startswith("file:/") else "file:///" + path[5:].lstrip("/"))
                with store.open_input_file(at) as f:

                    def read(begin, n, f=f):
                        f.seek(begin)
                        return f.read(n)

                    n = min(size, _TAIL)
                    place = directory_place(read(size - n, n), size, read)
                    rows = [] if place is None else list(directory_entries(*place, read))
                rows = rows or [(None, None)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["path", "member", "bytes"])

    return files.mapInArrow(look, "path string, member string, bytes long")


def file_pairs(files: DataFrame, first: str, second: str) -> DataFrame:
    """(folder, whole): each folder that has a file of the first name, and whether the second stands beside it. files: (path)."""
    rows = files.select(F.substring_index("path", "/", -1).alias("name"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
    return rows.groupBy("folder").agg(F.count_if(F.col("name") == first).alias("a"), F.count_if(F.col("name") == second).alias("b")).where("a > 0").select("folder", (F.col("b") > 0).alias("whole"))


def label_checks(labels: DataFrame, active: list[str], inactive: list[str]) -> DataFrame:
    """(item, found): sums of the active roots, and of those that have to be zero."""
    sums = labels.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in (*active, *inactive)])
    names = [("label_sum:" if c in active else "inactive_sum:") + c for c in (*active, *inactive)]
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(c).alias("found")) for n, c in zip(names, (*active, *inactive))])).alias("x")).select("x.*")


def dataset_readiness(checks: DataFrame, expected: DataFrame) -> DataFrame:
    """(item, expected, found, ok): what is expected against what was found, none counting as 0; what isn't expected is ok; ``ready`` says whether all are.

    checks: (item, found), each once; expected: (item, expected).
    """
    both = expected.join(checks, "item", "full_outer").select("item", "expected", F.coalesce("found", F.lit(0)).cast("long").alias("found"))
    both = both.withColumn("ok", F.coalesce(F.col("expected") == F.col("found"), F.lit(True)))
    whole = both.agg(F.lit("ready").alias("item"), F.count("expected").alias("expected"), F.count_if(F.col("ok") & F.col("expected").isNotNull()).alias("found"))
    return both.unionByName(whole.withColumn("ok", F.col("expected") == F.col("found")))


def write_archives(rows: DataFrame, folder: str) -> str:
    """Writes (archive, member, content) as one zip file for each archive, members in their order; gives the folder back. An archive is written by one task as a stream."""

    def write(batches):
        import zipfile

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        at, out, archive = None, None, None
        for batch in batches:
            for name, member, content in zip(*(c.to_pylist() for c in batch.columns)):
                if name != at:
                    if archive:
                        archive.close()
                        out.close()
                    store.create_dir(f"{base}/{name}".rsplit("/", 1)[0], recursive=True)
                    at, out = name, store.open_output_stream(f"{base}/{name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                if member is not None:
                    archive.writestr(member, content or "")
        if archive:
            archive.close()
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], ["n"])

    rows.select("archive", "member", "content").repartition("archive").sortWithinPartitions("archive", "member").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder
