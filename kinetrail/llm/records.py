"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A file is a row of frames. A frame is: payload length (8 bytes), masked checksum of those 8 bytes (4), payload, masked
checksum of the payload (4); all little-endian. A payload is: has-id flag (1 byte), bytes of an id (1), doc_id (8),
ids. A masked checksum is the CRC-32, rotated right by 15 bits, plus a constant, so that a checksum of data that holds
checksums keeps its strength. Files ascend: every doc_id of file k is at most the smallest of file k + 1.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetrail.llm.bpe import alphabet
from kinetrail.llm.common import bounded, parallelism, scratch

#: Fixed value of checksum masks.
MASK = 0xA282EAD8
HEAD = struct.Struct("<QI")
PAYLOAD = struct.Struct("<BBq")
#: Entries of a worker's memory of encoded chunks; it is emptied when full.
MEMORY = 2_000_000
#: Rows that are encoded together.
GROUP = 256


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = PAYLOAD.pack(doc_id is not None, width, doc_id or 0) + ids
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def read_frame(stream) -> tuple[int | None, np.ndarray, int] | None:
    """(doc_id, ids, bytes of the frame) of the next frame, None at the end; raises on a broken one."""
    head = stream.read(HEAD.size)
    if not head:
        return None
    size, check = HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("a record's length is damaged")
    payload = stream.read(size)
    if len(payload) != size or struct.unpack("<I", stream.read(4))[0] != masked(payload):
        raise ValueError("a record's payload is damaged")
    there, width, doc_id = PAYLOAD.unpack_from(payload)
    return doc_id if there else None, np.frombuffer(payload, f"<u{width}", offset=PAYLOAD.size), HEAD.size + size + 4


def place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


class Encoder:
    """The tokenizers library behind a memory of chunks: a space with no white space beside it starts a piece of the
    pre-tokenizer, so texts fall into chunks that encode on their own and most chunks have been seen before."""

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65536 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.amid = regex.compile(r"\s \s").search
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        self.seen: dict[str, bytes] = {}
        # a token that starts with a space starts a chunk
        vocab = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocab.values()) + 1, bool)
        self.marks = {m: self.ids(m) for m in ".,"}
        self.whole = {b: c for c, b in alphabet().items()}
        self.pack = [struct.Struct(f"<{n}{'H' if self.width == 2 else 'I'}").pack for n in range(64)]
        self.leads[[v for k, v in vocab.items() if k.startswith("\u0120")]] = True

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def learn(self, chunks: set[str]) -> None:
        """Adds the ids of chunks, each after a space. Latin letters before a final mark are a piece of their own, known
        from elsewhere more often than not; chunks without white space at their ends go many to a text."""
        seen = self.seen
        marked = [c for c in chunks if c[-1:] in self.marks and c[:-1].isalpha() and max(c) < "\u0250"]
        todo = sorted(chunks.difference(marked).union({x for c in marked if (x := c[:-1]) not in seen}))
        tokenize, whole = self.tokenizer.model.tokenize, self.whole
        words = {c for c in todo if c.isalpha() and max(c) < "\u0250"}  # one piece each: no pre-tokenizer needed
        for c in words:
            raw = [t.id for t in tokenize("\u0120" + (c if c.isascii() else c.encode().decode("latin-1").translate(whole)))]
            seen[c] = self.pack[len(raw)](*raw) if len(raw) < 64 else np.array(raw, self.dtype).tobytes()
        todo = [c for c in todo if c not in words]
        plain = [c for c in todo if c and not c[0].isspace() and not c[-1].isspace()]
        parts = [plain[a : a + 2000] for a in range(0, len(plain), 2000)]
        for part, got in zip(parts, self.tokenizer.encode_batch_fast([" " + " ".join(part) for part in parts], add_special_tokens=False)):
            ids = np.array(got.ids, self.dtype)
            cut = np.append(np.flatnonzero(self.leads[ids]), len(ids)) * self.width
            raw, at = ids.tobytes(), cut.tolist()
            if len(at) != len(part) + 1:
                raise AssertionError("the tokenizer doesn't start a token at each space")
            seen.update((c, raw[x:y]) for c, x, y in zip(part, at, at[1:]))
        if len(plain) < len(todo):
            known = set(plain)
            seen.update((c, self.ids(" " + c)) for c in todo if c not in known)
        for c in marked:
            seen[c] = seen[c[:-1]] + self.marks[c[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        seen = self.seen
        if len(seen) > MEMORY:
            seen.clear()
        cut = [None if self.amid(t) or any(x in t for x in self.special) else t.split(" ") for t in texts]
        known = {c: seen.get(c) for c in set().union(*(cs[1:] for cs in cut if cs is not None))}
        if missing := {c for c, ids in known.items() if ids is None}:
            self.learn(missing)
            known.update((c, seen[c]) for c in missing)
        have = known.__getitem__
        return [self.ids(t) + self.end if cs is None else b"".join([self.ids(cs[0]) if cs[0] else b"", *map(have, cs[1:]), self.end]) for t, cs in zip(texts, cut)]


@functools.lru_cache(2)
def encoder(path: str, end_id: int | None) -> Encoder:
    """One a worker process."""
    return Encoder(path, end_id)


def write_records(docs: DataFrame, path: str, out: str, end_id: int | None = 0, files: int | None = None) -> DataFrame:
    """Encodes docs (doc_id, text), writes frames to out/part-*.rec in ascending doc_id order, and returns the offset
    index: (file, name, doc_id, offset, bytes, n_tokens, local_start) with one row per document; it is also stored
    under out/index. offset and bytes place the frame, local_start counts the ids before it in its file.

    Null text: empty, only the end id. Null doc_id: before all others, flagged in the payload. Rows that share a
    doc_id: one file, ordered by text. Empty table: no files, an empty index. Other columns are left out.
    Each task encodes and writes one file; a task that runs again writes under a new name and the index names the file
    of the attempt that Spark kept, so lost executors leave at most unnamed files.
    """
    spark = docs.sparkSession
    files = files or parallelism(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, number, name, stream, offset, start = encoder(path, end_id), TaskContext.get().partitionId(), None, None, 0, 0
        fs, folder = place(out)
        for batch in batches:
            if not batch.num_rows:
                continue
            if stream is None:
                name = f"part-{number:06d}-{uuid.uuid4().hex}.rec"
                fs.create_dir(folder, recursive=True)
                stream = fs.open_output_stream(f"{folder}/{name}")
            rows = []
            for a in range(0, batch.num_rows, GROUP):
                part = batch.slice(a, GROUP)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), enc.encode([t or "" for t in part.column("text").to_pylist()])):
                    data = frame(doc_id, ids, enc.width)
                    stream.write(data)
                    rows.append((offset, len(data), len(ids) // enc.width, start))
                    offset, start = offset + len(data), start + len(ids) // enc.width
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int32()), pa.array([name] * len(rows), pa.string()), batch.column("doc_id"), *cols], ["file", "name", "doc_id", "offset", "bytes", "n_tokens", "local_start"])
        if stream is not None:
            stream.close()

    slim = bounded(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    index = slim.repartitionByRange(files, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    index = index.mapInArrow(write, "file int, name string, doc_id long, offset long, bytes long, n_tokens long, local_start long")
    index.write.mode("overwrite").parquet(f"{out}/index")
    return spark.read.parquet(f"{out}/index")


def read_records(spark: SparkSession, out: str, digest: bool = False) -> DataFrame:
    """Every record of out, read from its files: (doc_id, start, n_tokens, ids array<int>), or with digest
    (doc_id, start, n_tokens, ids_crc32) instead of the ids. start counts the ids of all records before it.

    A task reads whole files one frame at a time, so its memory is that of a frame. File totals, one row a file, give
    the bases of start. An index without rows gives no rows; a damaged frame raises.
    """
    index = spark.read.parquet(f"{out}/index")
    totals = index.groupBy("file", "name").agg(F.sum("n_tokens").alias("total"))
    # one row a file: a window over these rows is small however many documents there are
    bases = totals.withColumn("base", F.sum("total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["base"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = place(out)
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
                with fs.open_input_stream(f"{folder}/{name}", buffer_size=1 << 20) as stream:
                    rows: list[tuple] = []
                    held = 0
                    while True:
                        got = read_frame(stream)
                        if got is not None:
                            doc_id, ids, size = got
                            rows.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int32)))
                            base, held = base + len(ids), held + size
                        if rows and (got is None or len(rows) >= 4096 or held > 1 << 22):
                            cols = list(zip(*rows))
                            last = pa.array(cols[3], pa.int64() if digest else pa.list_(pa.int32()))
                            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
                            rows, held = [], 0
                        if got is None:
                            break

    last = "ids_crc32 long" if digest else "ids array<int>"
    spread = bases.select("name", "base").repartition(parallelism(spark), "name")
    return spread.mapInArrow(read, f"doc_id long, start long, n_tokens long, {last}")


def read_shuffled(index: DataFrame, out: str, seed: int = 0) -> DataFrame:
    """(doc_id, n_tokens, ids) in a pseudo-random order of documents fixed by seed, each record fetched by its offset."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = place(out)
        for batch in batches:
            rows = []
            open_files: dict[str, pa.NativeFile] = {}
            for name, offset in zip(batch.column("name").to_pylist(), batch.column("offset").to_pylist()):
                if name not in open_files:
                    open_files[name] = fs.open_input_file(f"{folder}/{name}")
                open_files[name].seek(offset)
                doc_id, ids, _ = read_frame(open_files[name])
                rows.append((doc_id, len(ids), ids.astype(np.int32)))
            for f in open_files.values():
                f.close()
            for a in range(0, len(rows), 512):
                cols = list(zip(*rows[a : a + 512]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    order = F.xxhash64(F.lit(seed), "name", "offset")
    n = parallelism(index.sparkSession)
    return index.select("name", "offset", order.alias("_o")).repartitionByRange(n, "_o").sortWithinPartitions("_o").drop("_o").mapInArrow(fetch, "doc_id long, n_tokens long, ids array<int>")


def round_trip(docs: DataFrame, path: str, end_id: int | None = 0) -> DataFrame:
    """Writes docs as records under a new folder of the scratch place and reads the files back: (doc_id, start,
    n_tokens, ids_crc32)."""
    out = f"{scratch(docs.sparkSession)}/records-{uuid.uuid4().hex}"
    write_records(docs, path, out, end_id)
    return read_records(docs.sparkSession, out, digest=True)
