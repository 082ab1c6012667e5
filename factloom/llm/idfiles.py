"""Token ids as binary files of independent zstandard frames with a trailing seek table.

A file holds documents in ascending order of id. Its frames are complete zstandard frames, each with
the ids (little-endian unsigned 32-bit) of a few whole documents, so any zstandard reader can read
the file from its start. Two skippable frames follow: the list of documents (ids, which of them are
null, tokens, documents per frame), and the seek table of the zstandard seekable format: compressed
size, size and checksum (low half of xxh64) of each frame, then their number, a flag byte and the
magic number. A reader opens a file from its end and decompresses only the frames it wants.

Files are written by the tasks that hold a range of ids, into the shared folder, under names with the
attempt's number; only the files that finished tasks report are listed, so lost executors and second
attempts leave no half file in the result. The file system is found from the folder's URI by pyarrow.

Defined cases: null and empty texts hold only the end id; null ids come first; equal ids follow one
another in the order of a hash of their texts; an empty table has no file; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.encoding import shared_encoder, tokenizer_text
from factloom.llm.words import bounded, pieces
from factloom.session import materialize, scratch_path

END_ID = 1
FRAME_IDS = 1 << 16
FILE_BYTES = 32 << 20
# Fixed values of the zstandard formats.
SKIPPABLE_DOCUMENTS = 0x184D2A5D
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class IdWriter:
    """Writes documents to a stream, frame by frame."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.packer = stream, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held: list[np.ndarray] = []
        self.held_ids = 0
        self.seek, self.frame_docs = [], []
        self.doc_ids, self.valid, self.counts = [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.held and self.held_ids + len(ids) > FRAME_IDS:
            self.flush()
        self.held.append(ids)
        self.held_ids += len(ids)
        self.doc_ids.append(doc_id or 0)
        self.valid.append(doc_id is not None)
        self.counts.append(len(ids))

    def flush(self) -> None:
        if not self.held:
            return
        raw = np.concatenate(self.held).astype("<u4").tobytes()
        frame = self.packer.compress(raw)
        self.stream.write(frame)
        self.seek.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.frame_docs.append(len(self.held))
        self.held, self.held_ids = [], 0

    def close(self) -> None:
        self.flush()
        listed = struct.pack("<QQ", len(self.doc_ids), len(self.frame_docs))
        listed += np.array(self.doc_ids, "<i8").tobytes() + np.array(self.counts, "<i8").tobytes()
        listed += np.array(self.frame_docs, "<i8").tobytes() + np.array(self.valid, "u1").tobytes()
        listed += struct.pack("<Q", len(listed) + 8)
        self.stream.write(struct.pack("<II", SKIPPABLE_DOCUMENTS, len(listed)) + listed)
        table = b"".join(struct.pack("<III", *entry) for entry in self.seek) + struct.pack("<IBI", len(self.seek), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class IdReader:
    """Reads a file from its end; frames are decompressed one at a time, and checked."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        frames, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("The file has no seek table with checksums.")
        begin = size - 9 - 12 * frames
        self.entries = np.frombuffer(self._at(begin, 12 * frames), "<u4").reshape(-1, 3)
        end = begin - 8
        (listed,) = struct.unpack("<Q", self._at(end - 8, 8))
        block = self._at(end - listed, listed)
        docs, held = struct.unpack("<QQ", block[:16])
        cells = np.frombuffer(block[16 : 16 + 8 * (2 * docs + held)], "<i8")
        self.doc_ids, self.counts, per_frame = cells[:docs], cells[docs : 2 * docs], cells[2 * docs :]
        self.valid = np.frombuffer(block[16 + 8 * (2 * docs + held) : -8], "u1").astype(bool)
        self.first_doc = np.concatenate([[0], np.cumsum(per_frame)])
        self.frame_start = np.concatenate([[0], np.cumsum(self.entries[:, 0].astype(np.int64))])

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, k: int) -> np.ndarray:
        """All ids of a frame."""
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.frame_start[k]), int(self.entries[k, 0])))
        if len(raw) != self.entries[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries[k, 2]:
            raise ValueError(f"Frame {k} does not match its checksum.")
        return np.frombuffer(raw, "<u4")

    def documents(self, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """(document number, ids) of each document of a frame."""
        ids, at = self.frame(k), 0
        for d in range(int(self.first_doc[k]), int(self.first_doc[k + 1])):
            yield d, ids[at : at + int(self.counts[d])]
            at += int(self.counts[d])

    def read(self, doc_id: int) -> list[np.ndarray]:
        """The ids of a document, from its frame alone."""
        found = np.flatnonzero((self.doc_ids == doc_id) & self.valid)
        frames = np.searchsorted(self.first_doc, found, side="right") - 1
        return [ids for k in np.unique(frames) for d, ids in self.documents(int(k)) if d in set(found.tolist())]


def write_ids(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Write all documents; gives the list of files (file, name, docs, tokens), in the order of ids."""
    definition = tokenizer_text(path)
    rows = bounded(docs).select(F.col("doc_id").cast("long"), "text")
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(definition)  # a tokenizer file, of fixed size
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(spark.sparkContext.defaultParallelism, -(-total // FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(shared.value)
        system, base = file_system(folder)
        context = TaskContext.get()
        name = f"ids-{context.partitionId():06d}-{context.taskAttemptId()}.zst"
        writer, stream, tokens = None, None, 0
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                if writer is None:
                    stream = system.open_output_stream(f"{base}/{name}", compression=None)
                    writer = IdWriter(stream)
                flat, first = encoder.encode(part.column(1))
                for doc_id, a, b in zip(part.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                    writer.add(doc_id, np.append(flat[a:b], np.uint32(END_ID)))
                    tokens += b - a + 1
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"file": [context.partitionId()], "name": [name], "docs": [len(writer.doc_ids)], "tokens": [tokens]}, schema=listed)

    listed = pa.schema([("file", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])
    system, base = file_system(folder)
    system.create_dir(base, recursive=True)
    dealt = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return materialize(dealt.mapInArrow(run, "file int, name string, docs long, tokens long"), "id-files")


def read_ids(spark: SparkSession, folder: str, files: DataFrame, ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32; with ``ids`` also the ids."""
    # One row per file; a running total over the file list.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    tasks = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{base}/{row['name']}") as file:
                    reader = IdReader(file)
                    starts = np.cumsum(reader.counts) - reader.counts + row["start"]
                    for k in range(len(reader.entries)):
                        found = list(reader.documents(k))
                        at = [d for d, _ in found]
                        columns = [
                            pa.array([int(reader.doc_ids[d]) if reader.valid[d] else None for d in at], pa.int64()),
                            pa.array(starts[at], pa.int64()), pa.array(reader.counts[at], pa.int64()),
                            pa.array([zlib.crc32(x.tobytes()) for _, x in found], pa.int64()),
                        ]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if ids:
                            columns.append(pa.array([x.astype(np.int64).tolist() for _, x in found], pa.list_(pa.int64())))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    return placed.select("name", "start").repartition(tasks).mapInArrow(run, schema)


def write_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    folder = scratch_path(spark, "id-files")
    return read_ids(spark, folder, write_ids(docs, folder, path))
