"""Packing and token files hold exactly the tokenizer's ids."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import ODD
from tidewheel.llm import packing, rans, tokens

TOKENIZER = Tokenizer.from_file(tokens.default_path())


def ids_of(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")


def encoded(coder, texts):
    out = []
    for low, ids, sizes in coder.encode(pa.array(texts, type=pa.string())):
        assert low == len(out)
        out.extend(np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else [])
    return out


def test_encoder_equals_tokenizer(monkeypatch):
    texts = [t or "" for _, t in ODD]
    for memory in (tokens.MEMORY, 3):
        monkeypatch.setattr(tokens, "MEMORY", memory)
        coder = tokens.Encoder(tokens.default_path())
        for _ in range(2):
            assert all(np.array_equal(a, ids_of(t)) for a, t in zip(encoded(coder, texts), texts, strict=True))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_encoder_on_any_text(texts):
    coder = tokens.encoder(tokens.default_path())
    assert all(np.array_equal(a, ids_of(t)) for a, t in zip(encoded(coder, texts), texts, strict=True))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=300), st.integers(1, 40))
def test_blocks_round_trip(ids, kept):
    counts = {int(k): int(v) for k, v in zip(*np.unique(ids, return_counts=True), strict=True)}
    table = rans.Table.counted(dict(list(counts.items())[:kept]))
    assert int(table.frequencies.sum()) == 1 << 16
    again = rans.Table.from_bytes(table.to_bytes())
    raw = rans.to_block(7, [(None, 1), (5, len(ids) - 1)], np.array(ids, dtype="<u2"), table)
    start, docs, found = rans.from_block(raw, again)
    assert (start, docs, found.tolist()) == (7, [(None, 1), (5, len(ids) - 1)], ids)


def test_large_blocks_use_lanes_and_checkpoints():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 600_000), 40_000).astype("<u2")
    table = rans.Table.counted(dict(enumerate(np.bincount(ids).tolist())))
    lanes, marks, words, _ = rans.encode(ids, table)
    assert lanes == rans.LANES and len(marks) == 3
    k = 1  # one segment alone
    size = rans.INTERVAL * lanes
    part = rans.decode_segment(table, size, lanes, words[marks[k][0] :], marks[k][2], np.zeros(0, dtype="<u4"))
    assert np.array_equal(part, ids[size : 2 * size])
    raw = rans.to_block(0, [(1, len(ids))], ids, table)
    assert np.array_equal(rans.from_block(raw, table)[2], ids) and len(raw) < 0.7 * ids.nbytes


def test_damage_is_found():
    table = rans.Table.counted({1: 5, 2: 3})
    raw = bytearray(rans.to_block(0, [(1, 3)], np.array([1, 2, 1], dtype="<u2"), table))
    raw[-6] ^= 1
    with pytest.raises(ValueError):
        rans.from_block(bytes(raw), table)
    with pytest.raises(ValueError):
        rans.from_block(bytes(raw[:10]), table)


def test_files_of_a_table(spark, docs_of, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK_TOKENS", 1000)
    marks = docs_of(ODD).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("mark")).collect()
    want = sorted(marks, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["mark"]))
    folder = rans.write_blocks(docs_of(ODD))
    rows = sorted(rans.read_blocks(spark, folder).collect(), key=lambda r: r["start"])
    start = 0
    for row, (doc, text, _) in zip(rows, want, strict=True):
        ids = ids_of(text)
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        assert row["ids"] == ids.tolist()
        start += len(ids)
    # The manifest finds each block, which is read alone with nothing but the folder.
    blocks = sorted(rans.manifest(spark, folder).collect(), key=lambda r: r["start"])
    assert sum(b["n_docs"] for b in blocks) == len(ODD) and sum(b["n_tokens"] for b in blocks) == start
    for b in blocks:
        alone = rans.read_blocks(spark, folder, start=b["start"]).collect()
        assert sorted(alone, key=repr) == sorted((r for r in rows if b["start"] <= r["start"] < b["start"] + b["n_tokens"]), key=repr) and len(alone) == b["n_docs"]
        assert b["file"].endswith(".parquet") and {alone[0]["doc_id"], alone[-1]["doc_id"]} == {b["first_doc"], b["last_doc"]}
    none = rans.write_blocks(docs_of(ODD).where(F.lit(False)))
    assert rans.read_blocks(spark, none).count() == 0 == rans.manifest(spark, none).count()


def test_a_damaged_table_is_found(spark, docs_of, tmp_path):
    folder = rans.write_blocks(docs_of(ODD[:2]))
    row = spark.read.parquet(f"{folder}/table").first()
    spark.createDataFrame([(row["crc32"] + 1, row["payload"])], "crc32 long, payload binary").write.parquet(f"{tmp_path}/table")
    with pytest.raises(ValueError):
        rans.read_table(spark, str(tmp_path))


def test_packing_holds_every_id_once(docs_of):
    rows = packing.pack(docs_of(ODD).repartition(3)).collect()
    texts = sorted((repr(i), tuple(ids_of(t).tolist())) for i, t in ODD)
    windows, by_doc = {}, {}
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        windows.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault((repr(r["doc_id"]), r["doc_tokens"]), []).append(r)
    padding = total = 0
    for group in windows.values():
        at = 0
        for r in sorted(group, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        total, padding = total + at, padding + (0 if at & (at - 1) == 0 else 4096 - at)
    assert total == sum(len(t) for _, t in texts) and padding == 0
    for (doc, n), group in by_doc.items():
        copies = [t for i, t in texts if i == doc and len(t) == n]
        places = sorted(p for r in group for p in range(r["start"], r["start"] + r["length"]))
        assert places == sorted(p for _ in copies for p in range(n))
    steps = {}
    for seq, group in windows.items():
        steps.setdefault(group[0]["step_group"], []).append(sum(r["length"] for r in group))
    assert all(sum(v) <= packing.STEP_TOKENS for v in steps.values())
    assert packing.pack(docs_of(ODD).where(F.lit(False))).count() == 0


def test_tiers_and_gaps():
    packer = packing.Packer()
    pieces = [packing.Piece(i, b"", 0, n) for i, n in enumerate([9000, 700, 300, 300, 300, 100, 3000])]
    full = packer.add(pieces)
    lengths = [sum(p.length for p in w) for w in full]
    assert set(lengths) <= set(packing.TIERS) and lengths.count(4096) >= 3
    rest = packer.finish()
    assert sum(lengths) + sum(p.length for w in rest for p in w) == 13_700
    assert all((n := sum(p.length for p in w)) & (n - 1) == 0 for w in rest)


def test_step_groups_are_balanced():
    """Groups are carried over batches; the tail shares the last ones."""
    rng = np.random.default_rng(3)
    packer, steps, dealt, total = packing.Packer(), packing.Steps(7), [], 0
    for batch in range(40):
        sizes = (rng.pareto(1.2, 50) * 300 + 1).astype(int)
        total += int(sizes.sum())
        for part in steps.add(packer.add([packing.Piece(int(i), b"", 0, int(n)) for i, n in enumerate(sizes)])):
            dealt += part
    whole = {g for g, _ in dealt}
    dealt += steps.finish(packer.finish())
    tokens_, costs, lengths = {}, {}, {}
    for g, w in dealt:
        n = sum(p.length for p in w)
        tokens_[g] = tokens_.get(g, 0) + n
        costs.setdefault(g, []).append(sum(p.length**2 for p in w))
        lengths.setdefault(g, set()).add(n)
    assert sum(tokens_.values()) == total and sorted(tokens_) == list(range(7, 7 + len(tokens_)))
    assert len(whole) >= 8 and all(tokens_[g] == packing.STEP_TOKENS and len(lengths[g]) == 1 for g in whole)
    last = [n for g, n in tokens_.items() if g not in whole]
    assert last and max(last) <= packing.STEP_TOKENS and max(last) - min(last) <= 512
    assert len(last) == -(-sum(last) // packing.STEP_TOKENS)
    for low in range(7, 7 + len(whole), packing.GROUPS):
        alike = [sum(costs[g]) for g in range(low, low + packing.GROUPS)]
        assert max(alike) <= 1.2 * min(alike)
