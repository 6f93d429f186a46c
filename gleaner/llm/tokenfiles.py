"""Token ids in Arrow's file format: fixed-size lists of equal-length sequences with masks.

Documents are encoded where they are read, dealt into id ranges and sorted; each range becomes one
Arrow file whose batches hold `ids` and `mask` as fixed-size lists, so that sequence i of a file is
found by arithmetic and read without copying. The stream of a range runs through its sequences; the
last is padded and masked. A second small file beside it has each document's place. Files are
written under names of their own by each task attempt, and only the manifest, a table in the shared
folder made of what successful tasks returned, says which of them count.

Edge cases: a null or empty text is its end id alone; rows with a null id come last; rows with equal
ids come in the order of their ids' bytes, each once; an empty table gives no file and no row; other
columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.ranges import deal_ranges, range_bounds
from gleaner.llm.wordbpe import crc, with_end
from gleaner.session import materialise, scratch_path

LENGTH = 2048
#: Sequences in one record batch.
BATCH = 256

MANIFEST = "part int, n_ids long, n_docs long, tokens string, docs string"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])


class TokenWriter:
    """One Arrow file of sequences, filled from arrays of ids of any length."""

    def __init__(self, filesystem: fs.FileSystem, path: str, dtype: np.dtype, length: int = LENGTH):
        self.length, self.dtype = length, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = filesystem.open_output_stream(path)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        self.total += len(ids)
        if self.n >= self.length * BATCH:
            self._flush()

    def _flush(self, last: bool = False) -> None:
        """Write whole batches; at the end all that is left, padded to whole sequences."""
        flat = np.concatenate(self.held) if self.held else np.empty(0, self.dtype)
        step, real = self.length * BATCH, len(flat)
        if last:
            flat = np.pad(flat, (0, -real % self.length))
        stop = len(flat) if last else real // step * step
        for at in range(0, stop, step):
            own = flat[at : min(at + step, stop)]
            self._write(own, np.arange(at, at + len(own)) < real)
        self.held, self.n = [flat[stop:]], len(flat) - stop

    def _write(self, ids: np.ndarray, mask: np.ndarray) -> None:
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids.astype(self.dtype, copy=False), mask), self.schema, strict=True)]
        self.out.write_batch(pa.record_batch(cols, schema=self.schema))

    def close(self) -> None:
        self._flush(last=True)
        self.out.close()
        self.sink.close()


class TokenFile:
    """Random access to the sequences and to any stretch of ids of one file."""

    def __init__(self, filesystem: fs.FileSystem, path: str):
        local = isinstance(filesystem, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else filesystem.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.at, self.view = -1, None

    def _batch(self, k: int) -> tuple[np.ndarray, pa.Array]:
        if k != self.at:
            batch = self.reader.get_batch(k)
            self.at, self.view = k, (batch.column(0).flatten().to_numpy(zero_copy_only=True), batch.column(1))
        return self.view

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of one sequence; the ids are a view of the file. All batches but the last are full."""
        ids, mask = self._batch(i // BATCH)
        at = i % BATCH
        return ids[at * self.length : (at + 1) * self.length], mask[at].values.to_numpy(zero_copy_only=False)

    def ids(self, start: int, length: int) -> np.ndarray:
        size, parts = self.length * BATCH, []
        while length > 0:
            flat, _ = self._batch(start // size)
            own = flat[start % size : start % size + length]
            parts.append(own)
            start, length = start + len(own), length - len(own)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _encode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [with_end(t.as_py(), tokenizer) for t in batch.column(1)]
            width = [x.itemsize for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(width, pa.int32())], names=["doc_id", "ids", "width"])

    return run


def write_tokens(df: DataFrame, tokenizer: str, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Encode and write all documents in ascending order of their key below path; returns the manifest."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(rows, "doc_id", parts)
    coded = rows.mapInArrow(_encode(tokenizer), "doc_id long, ids binary, width int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(path)
        where.create_dir(root, recursive=True)
        out, index, now, made = None, None, None, []

        def end() -> None:
            nonlocal out, index
            if out is None:
                return
            out.close()
            with where.open_output_stream(f"{root}/{index[0]}.docs.arrow") as sink, pa.ipc.new_file(sink, DOCS) as docs:
                docs.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in index[1:]], schema=DOCS))
            made.append((now, out.total, len(index[1]), f"{path}/{index[0]}.arrow", f"{path}/{index[0]}.docs.arrow"))
            out, index = None, None

        for batch in batches:
            for part, doc, ids, width in zip(*batch.columns, strict=True):
                if part.as_py() != now:
                    end()
                    now = part.as_py()
                dtype = np.dtype(f"<u{width.as_py()}")
                own = np.frombuffer(ids.as_py(), dtype=dtype)
                if out is None:
                    name = f"part-{now:06d}-{uuid.uuid4().hex}"
                    out, index = TokenWriter(where, f"{root}/{name}.arrow", dtype, length), (name, [], [], [])
                for column, value in zip(index[1:], (doc.as_py(), out.total, len(own)), strict=True):
                    column.append(value)
                out.add(own)
        end()
        cols = list(zip(*made, strict=True)) or [[]] * 5
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["part", "n_ids", "n_docs", "tokens", "docs"])

    dealt = deal_ranges(coded, "doc_id", tie="ids", bounds=bounds).select("part", "doc_id", "ids", "width")
    return materialise(dealt.mapInArrow(run, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start over all files, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    rows = sorted(manifest.collect())  # one row for each range
    starts = np.cumsum([0, *(r.n_ids for r in rows)]).tolist()
    listed = spark.createDataFrame([(int(s), r.tokens, r.docs) for s, r in zip(starts, rows, strict=False)], "first long, tokens string, docs string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, tokens, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where, path = fs.FileSystem.from_uri(docs)
                with where.open_input_file(path) as source:
                    index = pa.ipc.open_file(source).read_all()
                file = TokenFile(*fs.FileSystem.from_uri(tokens))
                start, length = (index.column(i).to_numpy() for i in (1, 2))
                crcs = [crc(file.ids(a, n)) for a, n in zip(start.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([index.column(0).combine_chunks(), pa.array(start + first), pa.array(length), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.repartition(max(1, len(rows))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write to the shared folder, then read back."""
    return read_tokens(write_tokens(df, tokenizer, scratch_path(df.sparkSession, "tokens"), key, text))
