"""Product codes of vectors by Exponion search, in exact integers.

Each component x becomes floor(256 x). A vector is cut into PARTS equal parts
of consecutive components; each part position has a codebook of at most
ENTRIES entries, at first those parts of the vectors of the smallest ids. A
round assigns every part to its nearest entry and then moves each entry to
the floor of the mean of its parts; entries without parts stay.

Exponion search: the search for a part x starts at the entry a that it had
before (at first entry 0). An entry c that is as near to x as a satisfies
d(a, c) <= d(a, x) + d(x, c) <= 2 d(a, x). So only the entries of a's list of
neighbours, sorted by distance, are measured up to the squared distance
4 d(a, x)^2; of equal distances the lower index wins. Squared distances are
64-bit integers throughout, so the radius is exact and no entry is missed.

Spark holds the vectors: a round is one pass that writes codes beside the
vectors, and one that sums parts by entry, in the tasks first. The driver
sees the codebooks only (ENTRIES vectors).

Cases: rows with a null or empty vector, or with null, NaN or infinite
components, are dropped, as are vectors whose length is not the commonest one
(of equally common ones the longest). Lengths that PARTS does not divide are
filled up with zeros. Components are held within bounds at which squared
distances fit 64 bits (about +-700,000 before scaling, for 64 components).
Null ids are larger than any other; equal ids are ordered by their vectors, so
equal rows change nothing. With fewer than ENTRIES vectors there are as many
entries. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import beside_classes, keep_nothing, remove, written_at

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Neighbours measured at once.
BLOCK = 8
#: Rows of a batch that are in memory at once, as 64-bit integers.
ROWS = 4096


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, int]:
    """Columns vec_id, label, v (integers, all of one length) of the rows that take part, and that length."""
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if first is None:
        return rows.select("vec_id", "label", F.lit(None).cast("array<int>").alias("v")).where("false"), 0
    length = first["size"]
    width = -(-length // PARTS) * PARTS
    bound = math.isqrt((1 << 61) // width)
    whole = F.transform("v", lambda c: F.greatest(F.lit(-bound), F.least(F.lit(bound), F.floor(c * SCALE).cast("long"))).cast("int"))
    filled = F.concat(whole, F.array(*[F.lit(0)] * (width - length))) if width > length else whole
    return rows.where(F.size("v") == length).select("vec_id", "label", filled.alias("v")), width


def first_codebooks(rows: DataFrame, width: int) -> np.ndarray:
    """(part, entry, position): the parts of the vectors of the smallest ids."""
    start = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    return np.array([r["v"] for r in start], dtype=np.int64).reshape(len(start), PARTS, width // PARTS).transpose(1, 0, 2).copy()


def neighbours(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of a codebook: all entries by distance from it (itself first among equals by index), and the squared distances."""
    far = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(far, axis=1, kind="stable")
    return order, np.take_along_axis(far, order, axis=1)


def nearest(x: np.ndarray, before: np.ndarray, book: np.ndarray, order: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of parts x: the index of the nearest entry, its squared distance, and how many entries were measured."""
    best, least, seen = before.copy(), ((x - book[before]) ** 2).sum(axis=1), np.zeros(len(x), dtype=np.int64)
    for a in np.unique(before):
        own = np.flatnonzero(before == a)
        reach = np.searchsorted(far[a], 4 * least[own], side="right")
        seen[own] = reach
        for low in range(0, int(reach.max(initial=0)), BLOCK):
            within = reach > low
            own, reach = own[within], reach[within]
            tried = order[a, low : low + BLOCK]
            d = ((x[own, None, :] - book[tried][None, :, :]) ** 2).sum(axis=2)
            nearer = d.min(axis=1)
            index = np.where(d == nearer[:, None], tried[None, :], len(book)).min(axis=1)
            won = (nearer < least[own]) | ((nearer == least[own]) & (index < best[own]))
            best[own[won]], least[own[won]] = index[won], nearer[won]
    return best, least, seen


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), PARTS, width // PARTS)


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray, width: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Batches (vec_id, label, v, code): new codes; at last with distances and counts in place of v."""
    keep_nothing()
    lists = [neighbours(b) for b in books]
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            x = _vectors(batch.column(2), width)
            before = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(-1, PARTS)
            code, error, seen = np.zeros_like(before), np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
            for p in range(PARTS):
                best, least, measured = nearest(x[:, p], before[:, p].astype(np.int64), books[p], *lists[p])
                code[:, p], error, seen = best, error + least, seen + measured
            codes = pa.array([c.tobytes() for c in code], pa.binary())
            if last:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array(error), pa.array(seen)], ["vec_id", "label", "code", "error", "measured"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), codes], ["vec_id", "label", "v", "code"])


def _sums(batches: Iterator[pa.RecordBatch], entries: int, width: int) -> Iterator[pa.RecordBatch]:
    """Batches (v, code): one row per part and entry that the task met, with the number and the sums of its parts."""
    keep_nothing()
    count, total = np.zeros((PARTS, entries), dtype=np.int64), np.zeros((PARTS, entries, width // PARTS), dtype=np.int64)
    for batch in batches:
        x = _vectors(batch.column(0), width)
        code = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, PARTS)
        for p in range(PARTS):
            count[p] += np.bincount(code[:, p], minlength=entries)
            np.add.at(total[p], code[:, p], x[:, p])
    part, entry = np.nonzero(count)
    sums = pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), sums], ["part", "entry", "n", "s"])


def moved(books: np.ndarray, rows: DataFrame, width: int) -> np.ndarray:
    """The codebooks after each entry has gone to the floor of the mean of its parts; rows hold v and code."""
    deep = width // PARTS
    sums = rows.select("v", "code").mapInArrow(partial(_sums, entries=books.shape[1], width=width), "part int, entry int, n long, s array<long>")
    each = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(deep)]
    out = books.copy()
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():  # PARTS x ENTRIES rows at most
        out[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(deep)]
    return out


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Per row that takes part: vec_id, label, code (one byte a part), error, measured (entries whose distance was taken last); and the codebooks."""
    spark = vectors.sparkSession
    rows, width = kept_vectors(vectors, id_col, vector_col, label_col)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    shape = f"vec_id {kinds['vec_id']}, label {kinds['label']}, "
    if not width:
        return spark.createDataFrame([], shape + "code binary, error long, measured long"), np.zeros((PARTS, 0, 0), dtype=np.int64)
    books, path = first_codebooks(rows, width), None
    rows = rows.withColumn("code", F.unhex(F.lit("00" * PARTS)))
    for _ in range(rounds):
        step = partial(_assigned, books=books, width=width, last=False)
        (rows, path), old = written_at(rows.mapInArrow(step, shape + "v array<int>, code binary"), "exponion-round"), path
        if old:
            remove(spark, old)
        books = moved(books, rows, width)
    step = partial(_assigned, books=books, width=width, last=True)
    coded, _ = written_at(rows.mapInArrow(step, shape + "code binary, error long, measured long"), "exponion-codes")
    if path:
        remove(spark, path)
    return coded, books


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code (hex), error, label_error (errors summed over equal labels, nulls together), codebooks_sha256, measured."""
    coded, books = encode(vectors, id_col, vector_col, label_col)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    rows = beside_classes(coded, sums, ["label"], "n")
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), "measured")
