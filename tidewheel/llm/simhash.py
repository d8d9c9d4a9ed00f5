"""Near-duplicate detection over 64-bit SimHash fingerprints.

Fingerprints: A-Z are lower-cased, words are runs of anything but ASCII white
space, and each run of three words (repeats included) is hashed with XXH64
under seed 42. A bit is set if over half of the hashes set it. A text with
fewer than three words hashes the whole sequence; one without words has
fingerprint zero and links like any other.

Links: two fingerprints link if they differ in at most three bits. Candidates
come from pigeonring filtering. The fingerprint is cut into four segments of
16 bits on a ring. If at most 3 bits differ in all, then from some segment on,
every chain of l consecutive segments differs in at most floor(3 l / 4) bits:
0, 1, 2 and 3 bits for chains of 1, 2, 3 and 4. The first two budgets are
expressed as keys of one equi-join (the first segment exact, the second one
exact or with one bit flipped); the third is tested on the candidates, and the
last is the full Hamming test. No link is lost.

Cases: null texts count as empty; repeated rows and equal texts share one
fingerprint and meet only as one node; null ids never become a component's
smallest id unless all its ids are null; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm.components import connected_components
from tidewheel.llm.common import keep_nothing, release, text_of, written

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
SHINGLE = 3
BITS = 3
SEGMENTS = 4
WIDTH = 16
#: Hashes whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: bytes) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    at = starts.tolist()
    digest, n = xxhash.xxh64_intdigest, len(words) - SHINGLE + 1
    ones = np.zeros(64, dtype=np.int64)
    for low in range(0, n, CHUNK):
        high = min(n, low + CHUNK)
        hashes = np.array([digest(joined[at[i] : at[i + SHINGLE] - 1], SEED) for i in range(low, high)], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_nothing()
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])
    release()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text_hash, and the fingerprint fp as signed 64-bit long."""
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _mask(i: int, length: int) -> int:
    bits = sum(((1 << WIDTH) - 1) << (WIDTH * ((i + k) % SEGMENTS)) for k in range(length))
    return bits - (1 << 64) if bits >> 63 else bits


def links(nodes: DataFrame) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp of nodes) within three bits."""
    fp = F.col("fp")

    def key(i: int, second: Column) -> Column:
        return F.shiftleft(_segment(fp, i), WIDTH).bitwiseOR(second).bitwiseOR(F.lit(i << 2 * WIDTH))

    flips = [0, *(1 << b for b in range(WIDTH))]
    exact = nodes.select(
        fp.alias("a"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), key(i, _segment(fp, i + 1)).alias("k")) for i in range(SEGMENTS)])).alias("x"),
    ).select("a", F.col("x.i").alias("i"), F.col("x.k").alias("k"))
    def variants(i: int) -> Column:
        return F.transform(F.array(*[F.lit(f).cast("long") for f in flips]), lambda f: key(i, _segment(fp, i + 1).bitwiseXOR(f)))

    near = nodes.select(fp.alias("b"), F.explode(F.flatten(F.array(*[variants(i) for i in range(SEGMENTS)]))).alias("k"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    third = F.element_at(F.array(*[F.lit(_mask(i, 3)).cast("long") for i in range(SEGMENTS)]), F.col("i") + 1)
    # Spark sizes an exploded table as the one before it, a 68th of what near is, and would
    # broadcast it through the driver.
    return (
        exact.join(near.hint("merge"), "k")
        .where("a < b")
        .where(F.bit_count(differ.bitwiseAND(third)) <= 2)
        .where(F.bit_count(differ) <= BITS)
        .select("a", "b")
        .distinct()
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, text_hash, fp (signed), root, component_id.

    root is the smallest fingerprint of the component, component_id its
    smallest id.
    """
    prints = written(fingerprints(docs, id_col, text_col), "simhash-prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = written(links(nodes.select("fp")), "simhash-links")
    roots = connected_components(found, "a", "b")
    label = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = label.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = label.join(least, "root").select("fp", "root", "component_id")
    return prints.join(classes, "fp", "left").select("doc_id", "text_hash", "fp", "root", "component_id")


def fingerprint_hex(column: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near copies: of each component, one row of its smallest id.

    Null ids count as larger than any other. All columns of docs are returned.
    """
    prints = near_duplicates(docs, id_col, text_col)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("stay")
    stay = prints.groupBy("root").agg(least).select(F.xxhash64("stay.doc_id", "stay.text_hash").alias("key"), F.col("stay.doc_id").alias("stays"), F.col("stay.text_hash").alias("stays_hash"))
    own, own_hash = docs[id_col].cast("long"), F.xxhash64(text_of(docs, text_col))
    rows = docs.select(F.struct("*").alias("row"), own.alias("own"), own_hash.alias("own_hash"), F.xxhash64(own, own_hash).alias("key"))
    # The join and the window share one shuffle, by key; repeated rows meet there. The key is
    # confirmed after the window, else the join would be on more columns than the window.
    same = F.col("own").eqNullSafe(F.col("stays")) & (F.col("own_hash") == F.col("stays_hash"))
    met = rows.join(stay, "key").withColumn("same", same)
    first = F.row_number().over(W.partitionBy("key", "own", "own_hash").orderBy(F.desc("same")))
    return met.withColumn("first", first).where("first = 1 and same").select("row.*")
