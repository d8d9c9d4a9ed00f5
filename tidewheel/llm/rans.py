"""Token ids in blocks of a static range asymmetric numeral system.

One frequency table, counted over all tokens, serves every block. A block
holds whole documents in ascending order of their ids and can be decoded on
its own. Its tokens are dealt to interleaved lanes (row by row), each with a
32-bit state; all lanes take a step at once. Every INTERVAL steps a
checkpoint keeps the lanes' states and the place in the words, so that
segments of a block can be decoded apart from each other.

A block's bytes, all little-endian:

  magic "TWR1"; u64 start (ids of all documents before the block); u32 each:
  tokens, lanes, steps between checkpoints, checkpoints, words, escapes,
  documents, crc32 of the table, crc32 of the ids as u32;
  documents x (u8 has an id, i64 doc_id, u64 tokens);
  (checkpoints + 1) x (u32 first word, u32 first escape, lanes x u32 state);
  words x u16; escapes x u32; u32 crc32 of all bytes before.

The table: u32 symbols; symbols x (u32 token, u32 frequency); the last symbol
is the escape for tokens beyond the table, which a block lists as they are.
Frequencies sum to 65536.

A folder holds all that decoding needs: blocks (Parquet rows of start,
n_tokens, n_docs, first_doc, last_doc, n_bytes, crc32, payload) and table (one
row of crc32, payload). The manifest is the blocks' narrow columns with the
file that holds each; a block can be read and decoded alone.

Cases: null and empty texts are the end id alone; repeated ids and rows are
kept, in the order of a hash of their texts; null ids come first; very long texts make
long blocks; an empty table gives no blocks and an empty result; other columns
are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import tokens
from tidewheel.llm.common import release, remove, shared_dir, text_of, written_at

BITS = 16
LANES = 4096
LEAST_STEPS = 32
INTERVAL = 64
BLOCK_TOKENS = 1 << 18
TABLE_SYMBOLS = 1 << 15
#: Chunks that a worker remembers, and bytes of text that it splits at once.
MEMORY, PORTION = 500_000, 16 << 20
HEAD = struct.Struct("<4sQ9I")
MAGIC = b"TWR1"


class Table:
    """Symbols, their frequencies and the slots that they own."""

    def __init__(self, tokens_: np.ndarray, frequencies: np.ndarray):
        self.tokens, self.frequencies = tokens_.astype("<u4"), frequencies.astype(np.uint32)
        self.starts = np.concatenate([[0], np.cumsum(self.frequencies)[:-1]]).astype(np.uint32)
        self.slots = np.repeat(np.arange(len(self.frequencies), dtype=np.uint16), self.frequencies)
        self.escape = len(self.frequencies) - 1
        self.symbols = np.full(int(self.tokens.max(initial=0)) + 1, self.escape, dtype=np.uint16)
        self.symbols[self.tokens] = np.arange(len(self.tokens), dtype=np.uint16)
        self.crc = zlib.crc32(self.to_bytes())

    @classmethod
    def counted(cls, counts: dict[int, int]) -> Table:
        order = sorted(counts, key=lambda t: (-counts[t], t))
        kept = order[: TABLE_SYMBOLS - 1]
        weights = [counts[t] for t in kept] + [sum(counts[t] for t in order[len(kept) :])]
        room, total = (1 << BITS) - len(weights), max(sum(weights), 1)
        shares = [1 + w * room // total for w in weights]
        shares[0 if kept else -1] += (1 << BITS) - sum(shares)
        return cls(np.array(kept, dtype=np.int64), np.array(shares))

    def to_bytes(self) -> bytes:
        pairs = np.stack([self.tokens, self.frequencies[:-1].astype("<u4")], axis=1) if len(self.tokens) else np.zeros((0, 2), dtype="<u4")
        return struct.pack("<I", len(self.tokens)) + pairs.astype("<u4").tobytes() + struct.pack("<I", int(self.frequencies[-1]))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        (n,) = struct.unpack_from("<I", raw)
        pairs = np.frombuffer(raw, dtype="<u4", count=2 * n, offset=4).reshape(n, 2)
        (last,) = struct.unpack_from("<I", raw, 4 + 8 * n)
        return cls(pairs[:, 0], np.append(pairs[:, 1], last))


def encode(ids: np.ndarray, table: Table) -> tuple[int, list[tuple[int, int, np.ndarray]], np.ndarray, np.ndarray]:
    """Lanes, checkpoints (first word, first escape, states), words and escapes."""
    n = len(ids)
    lanes = max(1, min(LANES, n // LEAST_STEPS))
    known = ids < len(table.symbols)
    symbols = np.full(n, table.escape, dtype=np.uint16)
    symbols[known] = table.symbols[ids[known]]
    rare = symbols == table.escape
    escapes = ids[rare].astype("<u4")
    frequencies, starts = table.frequencies[symbols], table.starts[symbols]
    x = np.full(lanes, 1 << BITS, dtype=np.uint32)
    steps = -(-n // lanes)
    out: list[np.ndarray] = [np.zeros(0, dtype="<u2")] * steps
    states: dict[int, np.ndarray] = {}
    for t in range(steps - 1, -1, -1):
        f, c = frequencies[t * lanes : (t + 1) * lanes], starts[t * lanes : (t + 1) * lanes]
        now = x[: len(f)]
        over = (now >> np.uint32(BITS)) >= f
        out[t] = now[over].astype("<u2")
        now = np.where(over, now >> np.uint32(BITS), now)
        q = now // f
        x[: len(f)] = (q << np.uint32(BITS)) + (now - q * f) + c
        if t % INTERVAL == 0:
            states[t] = x.copy()
    before = np.concatenate([[0], np.cumsum([len(w) for w in out])]).astype(int)
    rares = np.concatenate([[0], np.cumsum(rare)]).astype(int)
    marks = [(int(before[t]), int(rares[min(t * lanes, n)]), states[t]) for t in sorted(states)]
    return lanes, marks, np.concatenate(out) if out else np.zeros(0, dtype="<u2"), escapes


def decode_segment(table: Table, n: int, lanes: int, words: np.ndarray, state: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """n tokens from a checkpoint's state, and the words and escapes from there on."""
    x, at = state.astype(np.uint32), 0
    symbols = np.empty(n, dtype=np.uint16)
    low = np.uint32((1 << BITS) - 1)
    for first in range(0, n, lanes):
        m = min(lanes, n - first)
        now = x[:m]
        slot = now & low
        s = table.slots[slot]
        symbols[first : first + m] = s
        now = table.frequencies[s] * (now >> np.uint32(BITS)) + slot - table.starts[s]
        under = np.flatnonzero(now <= low)
        now[under] = (now[under] << np.uint32(BITS)) | words[at : at + len(under)]
        at += len(under)
        x[:m] = now
    ids = np.append(table.tokens, 0)[symbols].astype("<u4")
    rare = np.flatnonzero(symbols == table.escape)
    ids[rare] = escapes[: len(rare)]
    return ids


def to_block(start: int, docs: list[tuple[int | None, int]], ids: np.ndarray, table: Table) -> bytes:
    lanes, marks, words, escapes = encode(ids, table)
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    parts = [HEAD.pack(MAGIC, start, len(ids), lanes, INTERVAL, len(marks), len(words), len(escapes), len(docs), table.crc, crc)]
    parts += [struct.pack("<BqQ", i is not None, i or 0, n) for i, n in docs]
    parts += [struct.pack("<II", w, e) + s.astype("<u4").tobytes() for w, e, s in marks]
    parts += [words.tobytes(), escapes.tobytes()]
    raw = b"".join(parts)
    return raw + struct.pack("<I", zlib.crc32(raw))


def from_block(raw: bytes, table: Table) -> tuple[int, list[tuple[int | None, int]], np.ndarray]:
    """start, documents and ids; raises ValueError where a checksum fails."""
    if len(raw) < HEAD.size + 4 or struct.unpack_from("<I", raw, len(raw) - 4)[0] != zlib.crc32(raw[:-4]):
        raise ValueError("a block is damaged")
    magic, start, n, lanes, interval, marks, n_words, n_escapes, n_docs, table_crc, ids_crc = HEAD.unpack_from(raw)
    if magic != MAGIC or table_crc != table.crc:
        raise ValueError("a block is of another format or table")
    at = HEAD.size
    docs = [(i if has else None, m) for has, i, m in struct.iter_unpack("<BqQ", raw[at : at + 17 * n_docs])]
    at += 17 * n_docs
    points = []
    for _ in range(marks):
        points.append((*struct.unpack_from("<II", raw, at), np.frombuffer(raw, dtype="<u4", count=lanes, offset=at + 8)))
        at += 8 + 4 * lanes
    words = np.frombuffer(raw, dtype="<u2", count=n_words, offset=at)
    escapes = np.frombuffer(raw, dtype="<u4", count=n_escapes, offset=at + 2 * n_words)
    size = interval * lanes
    parts = [decode_segment(table, min(size, n - k * size), lanes, words[w:], s, escapes[e:]) for k, (w, e, s) in enumerate(points)]
    ids = np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
    if zlib.crc32(ids.tobytes()) != ids_crc:
        raise ValueError("a block's ids fail their checksum")
    return start, docs, ids


RAW = "shard long, start long, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, ids binary"


def _raw_blocks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = tokens.encoder(path, memory=MEMORY, portion=PORTION)
    kind = "<u2" if coder.size <= 1 << 16 else "<u4"
    shard, start = TaskContext.get().partitionId(), 0
    doc_ids: list[int | None] = []
    lengths: list[int] = []
    parts: list[np.ndarray] = []
    held = 0

    def block() -> pa.RecordBatch:
        nonlocal start, held
        row = {"shard": shard, "start": start, "n_tokens": held, "doc_ids": list(doc_ids), "lengths": list(lengths), "ids": np.concatenate(parts).tobytes()}
        start, held = start + held, 0
        doc_ids.clear(), lengths.clear(), parts.clear()
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row.values(), types, strict=True)], list(row))

    for batch in batches:
        for low, ids, sizes in coder.encode(batch.column(1)):
            ids, ends = ids.astype(kind), np.cumsum(sizes).tolist()
            for i, n, end in zip(batch.column(0).slice(low, len(sizes)).to_pylist(), sizes.tolist(), ends, strict=True):
                doc_ids.append(i), lengths.append(n), parts.append(ids[end - n : end])
                held += n
                if held >= BLOCK_TOKENS:
                    yield block()
    if parts:
        yield block()
    release()


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = np.bincount(_ids(raw, n))
            if len(found) > len(total):
                found, total = total, found.astype(np.int64)
            total[: len(found)] += found
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["token", "n"])


BLOCKS = "start long, n_tokens long, n_docs long, first_doc long, last_doc long, n_bytes long, crc32 long, payload binary"


def _to_blocks(batches: Iterator[pa.RecordBatch], raw_table: bytes, bases: dict[int, int]) -> Iterator[pa.RecordBatch]:
    table = Table.from_bytes(raw_table)
    for batch in batches:
        for r in batch.to_pylist():
            start, docs = bases[r["shard"]] + r["start"], r["doc_ids"]
            payload = to_block(start, list(zip(docs, r["lengths"], strict=True)), _ids(r["ids"], r["n_tokens"]), table)
            row = start, r["n_tokens"], len(docs), docs[0], docs[-1], len(payload), zlib.crc32(payload)
            yield pa.RecordBatch.from_arrays([*(pa.array([v], type=pa.int64()) for v in row), pa.array([payload], type=pa.binary())], [c.split()[0] for c in BLOCKS.split(", ")])


def write_blocks(docs: DataFrame, path: str | None = None) -> str:
    """Encode all texts; returns the folder, of its own in the shared one, that holds blocks and table.

    To the driver come one count per token of the vocabulary and one total per
    task, never tokens or documents.
    """
    path = path or tokens.default_path()
    spark, text = docs.sparkSession, text_of(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    ordered = rows.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").select("doc_id", "text")
    raw, raw_path = written_at(ordered.mapInArrow(lambda b: _raw_blocks(b, path), RAW), "rans-raw", compression="zstd")
    counts = raw.select("n_tokens", "ids").mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    table = Table.counted({r["token"]: r["n"] for r in counts.collect()})
    bases, total = {}, 0
    for r in raw.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():
        bases[r["shard"]] = total
        total += r["n"]
    coded = table.to_bytes()
    folder = f"{shared_dir(spark)}/rans-{uuid.uuid4().hex}"
    spark.createDataFrame([(table.crc, coded)], "crc32 long, payload binary").coalesce(1).write.parquet(f"{folder}/table")
    raw.mapInArrow(lambda b: _to_blocks(b, coded, bases), BLOCKS).write.parquet(f"{folder}/blocks", compression="none")
    remove(spark, raw_path)
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Per block of the folder its place in the stream, its documents, size and checksum, and its file; payloads are not read."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    return blocks.select(*(c for c in blocks.columns if c != "payload"), F.col("_metadata.file_path").alias("file"))


def _read(batches: Iterator[pa.RecordBatch], raw_table: bytes, with_ids: bool) -> Iterator[pa.RecordBatch]:
    table = Table.from_bytes(raw_table)
    for batch in batches:
        for payload in batch.column(0).to_pylist():
            start, docs, ids = from_block(payload, table)
            ends = np.cumsum([n for _, n in docs])
            begins = ends - [n for _, n in docs]
            view = memoryview(ids.tobytes())
            arrays = [
                pa.array([i for i, _ in docs], type=pa.int64()),
                pa.array(begins + start, type=pa.int64()),
                pa.array([n for _, n in docs], type=pa.int64()),
                pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], type=pa.int64()),
            ]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([ids[a:b].astype("<i4") for a, b in zip(begins, ends, strict=True)], type=pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)


def read_table(spark: SparkSession, folder: str) -> bytes:
    """The folder's table; raises ValueError where its checksum fails."""
    row = spark.read.schema("crc32 long, payload binary").parquet(f"{folder}/table").first()
    if row is None or zlib.crc32(row["payload"]) != row["crc32"]:
        raise ValueError("the table is damaged")
    return bytes(row["payload"])


def read_blocks(spark: SparkSession, folder: str, with_ids: bool = True, start: int | None = None) -> DataFrame:
    """Per document of the folder's blocks, or of the one at start: doc_id, start, n_tokens, ids_crc32, and ids."""
    table = read_table(spark, folder)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    blocks = blocks if start is None else blocks.where(F.col("start") == start)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return blocks.select("payload").mapInArrow(lambda b: _read(b, table, with_ids), schema)
