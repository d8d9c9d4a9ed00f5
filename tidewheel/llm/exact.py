"""Exact deduplication against immutable snapshots, screened by static filters.

Texts are equal when identical after deleting ASCII white space (space, tab to
carriage return). A snapshot is written once: its classes of equal texts, dealt
to shards by digest, and a binary fuse filter per shard. An incoming batch is
first grouped by itself into classes; the digests of these are screened by the
shard's filter. Positives alone join the exact buckets of the snapshot, and a
class is the same as one of the snapshot only if the texts agree byte by byte.
Equal texts of the batch that the snapshot does not hold are a group of their
own.

Digests are 64 bits (XXH64); within a table texts are grouped by digest and
SHA-256, so a digest that two texts share costs a comparison and nothing else.
Shards hold some SHARD digests on average at any size, so filters are built and
asked in bounded memory, and hot texts are one digest by then.

Cases: null texts count as empty; texts without anything but white space are
equal; repeated rows stay apart rows, of which one is kept; of rows of equal
length and equal id any one stays; null ids are larger than any other; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import fuse
from tidewheel.llm.common import beside_classes, keep_nothing, text_of, written, written_at

SPACE = " \t\n\x0b\x0c\r"
#: Digests of a shard, on average.
SHARD = 1 << 16
#: Digests that are sent to all tasks to pick the texts to be compared; more are met in a shuffle.
FEW = 1 << 20


def normalised(text: Column) -> Column:
    return F.translate(text, SPACE, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow rows, one per row of docs: row (a number), doc_id, digest, sha (32 bytes), points (code points of the text)."""
    text = text_of(docs, text_col)
    norm = normalised(text)
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs[id_col].cast("long").alias("doc_id"),
        F.xxhash64(norm).alias("digest"),
        F.unhex(F.sha2(norm, 256)).alias("sha"),
        F.char_length(text).cast("long").alias("points"),
    )


def _stays() -> Column:
    """Orders rows of a class: the least stays."""
    return F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")


def classes(rows: DataFrame) -> DataFrame:
    """digest, sha, stay (the row that stays, as ordered), n: the groups of equal texts of a table by itself."""
    return rows.groupBy("digest", "sha").agg(F.min(_stays()).alias("stay"), F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Snapshot:
    """An immutable set of texts: its rows' classes, by shard, and a filter per shard."""

    docs: DataFrame
    classes: DataFrame
    filters: DataFrame
    shards: int
    paths: tuple[str, ...]


def _shard(shards: int) -> Column:
    return F.pmod(F.col("digest"), F.lit(shards)).cast("int")


def freeze(docs: DataFrame, rows: DataFrame) -> Snapshot:
    """The snapshot of docs, whose digests are rows."""
    found, path = written_at(classes(rows), "exact-classes")
    shards = max(1, -(-found.count() // SHARD))
    keys = found.select(_shard(shards).alias("shard"), "digest").distinct()

    def build(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        keep_nothing()
        made = fuse.build(np.sort(group.column("digest").to_numpy()))
        parts = {"shard": [key[0].as_py()], "seed": [made.seed], "bits": [made.bits], "segments": [made.segments], "slots": [made.slots.tobytes()]}
        return pa.table(parts, schema=pa.schema([("shard", pa.int32()), ("seed", pa.int64()), ("bits", pa.int32()), ("segments", pa.int32()), ("slots", pa.binary())]))

    built, where = written_at(keys.groupBy("shard").applyInArrow(build, "shard int, seed long, bits int, segments int, slots binary"), "exact-filters")
    return Snapshot(docs, found, built, shards, (path, where))


def screen(snapshot: Snapshot, found: DataFrame) -> DataFrame:
    """The digests of found (distinct ones) that the snapshot may hold: all that it does, and one in 256 of the others."""

    def ask(key: tuple[pa.Scalar, ...], own: pa.Table, kept: pa.Table) -> pa.Table:
        keep_nothing()
        held = own.column("digest").to_numpy()
        if not kept.num_rows:
            return own.select(["digest"]).slice(0, 0)
        f = kept.to_pylist()[0]
        made = fuse.Fuse(f["seed"], f["bits"], f["segments"], np.frombuffer(f["slots"], dtype=np.uint8))
        return pa.table({"digest": pa.array(held[made.holds(held)], pa.int64())})

    keys = found.select("digest").distinct().withColumn("shard", _shard(snapshot.shards))
    return keys.groupBy("shard").cogroup(snapshot.filters.groupBy("shard")).applyInArrow(ask, "digest long")


def _texts(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """digest, sha, norm: one normalised text of each class of docs whose digest is wanted."""
    norm = normalised(text_of(docs, text_col))
    rows = docs.select(F.xxhash64(norm).alias("digest"), norm.alias("norm"))
    need = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    met = rows.join(need, "digest", "left_semi").withColumn("sha", F.unhex(F.sha2("norm", 256)))
    # Copies of a text become one in the tasks that read them, before anything is shuffled.
    return met.groupBy("digest", "sha").agg(F.min("norm").alias("norm"))


def admitted(snapshot: Snapshot, batch: DataFrame, rows: DataFrame, text_col: str = "text") -> DataFrame:
    """The batch's classes (see classes), with known (whether the snapshot holds the text) and the snapshot's old_stay and old_n."""
    own = written(classes(rows), "exact-batch")
    passed = written(screen(snapshot, own), "exact-positives")
    here, there = own.join(passed, "digest", "left_semi"), snapshot.classes.join(passed, "digest", "left_semi")
    # A positive that finds no bucket is a false one; only digests on both sides have texts to compare.
    both = written(here.select("digest").join(there.select("digest"), "digest", "left_semi").distinct(), "exact-buckets")
    mine = _texts(batch, both, text_col)
    theirs = _texts(snapshot.docs, both, text_col).select("digest", F.col("sha").alias("old_sha"), F.col("norm").alias("old_norm"))
    same = mine.join(theirs, "digest").where(F.col("norm").cast("binary") == F.col("old_norm").cast("binary")).select("digest", "sha", "old_sha")
    old = there.select("digest", F.col("sha").alias("old_sha"), F.col("stay").alias("old_stay"), F.col("n").alias("old_n"))
    linked = same.join(old, ["digest", "old_sha"]).drop("old_sha")
    return own.join(linked, ["digest", "sha"], "left").withColumn("known", F.col("old_n").isNotNull())


def _half(doc_id: Column, points: Column) -> Column:
    """Which rows the snapshot of duplicates() holds: about half."""
    return F.pmod(F.xxhash64(doc_id, points), F.lit(2)) == 0


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256, known (met in the snapshot).

    About half of the rows, picked by digest of id and length, are frozen as a
    snapshot, and the rest is admitted to it as one batch.
    """
    rows = written(digests(docs, id_col, text_col).withColumn("frozen", _half(F.col("doc_id"), F.col("points"))), "exact-digests")
    frozen = _half(docs[id_col].cast("long"), F.char_length(text_of(docs, text_col)).cast("long"))
    old = freeze(docs.where(frozen), rows.where("frozen"))
    new = written(admitted(old, docs.where(~frozen), rows.where("not frozen"), text_col), "exact-admitted")
    # All classes: those of the batch, met or not, and those of the snapshot that the batch did not meet.
    alone = old.classes.join(new.where("known").select("digest", "sha"), ["digest", "sha"], "left_anti")
    all_new = new.select("digest", "sha", F.least("stay", F.coalesce("old_stay", "stay")).alias("stay"), (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("n"), "known")
    every = written(all_new.unionByName(alone.withColumn("known", F.lit(False))), "exact-groups")
    out = beside_classes(rows, every.withColumn("size", F.col("n")), ["digest", "sha"], "n")
    return out.select(
        "doc_id",
        F.col("stay.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("stay.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "known",
    )
