import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tidewheel.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(payload):
    padded = media.pad(payload)
    assert len(padded) % 576 == 0 and padded.startswith(payload) and len(padded) > 0
    assert media.decode(media.encode(padded)).tobytes() == padded


def slow_unfilter(rows, step):
    out = []
    for r in rows:
        kind, line, above = r[0], [], out[-1] if out else [0] * (len(r) - 1)
        for i, v in enumerate(r[1:]):
            a, b, c = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v + (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        out.append(line)
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 2, 3, 4]))
def test_all_filters(seed, step):
    rng = np.random.default_rng(seed)
    rows = rng.integers(0, 256, (7, 1 + 5 * step), dtype=np.uint8)
    rows[:, 0] = rng.integers(0, 5, 7)
    assert media.unfilter(rows, step).tolist() == slow_unfilter(rows.tolist(), step)


@pytest.mark.parametrize("spoil", [lambda b: b[:-5], lambda b: b[:40] + bytes([b[40] ^ 1]) + b[41:], lambda b: b"x" + b, lambda b: b""])
def test_damage_is_found(spoil):
    image = spoil(media.encode(media.pad(b"some text " * 100)))
    assert media.try_decode(image) is None
    with pytest.raises(ValueError):
        media.decode(image)


def test_alike_images_hash_alike():
    image = np.random.default_rng(2).integers(0, 256, (48, 96), dtype=np.uint8)
    near = image.copy()
    near[0, 0] ^= 3
    one, two, other = (int(media.cosine_hash(x), 16) for x in (image, near, np.random.default_rng(1).integers(0, 256, (48, 96), dtype=np.uint8)))
    assert (one ^ two).bit_count() <= 6 < 16 < (one ^ other).bit_count()


def test_colour_images():
    rows = np.hstack([np.zeros((2, 1), np.uint8), np.arange(24, dtype=np.uint8).reshape(2, 12)])
    head = struct.pack(">IIBBBBB", 4, 2, 8, 2, 0, 0, 0)
    image = media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", zlib.compress(rows.tobytes())) + media._chunk(b"IEND", b"")
    assert media.decode(image).tobytes() == rows[:, 1:].tobytes()


def test_table(docs_of):
    rows = media.store_and_read(docs_of(ODD)).collect()
    assert sorted((repr(r["doc_id"]), r["n_bytes"]) for r in rows) == sorted((repr(i), len((t or "").encode())) for i, t in ODD)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"], r["tail_crc32"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert hashlib.sha256(media.pad(b"")).hexdigest() in by_text
    assert media.store_and_read(docs_of(ODD).where(F.lit(False))).count() == 0


def slow_hash(samples, width=96):
    """The cosine hash by its definition: means of 32 x 32 cells (or nearest samples where there are fewer rows), a cosine sum a frequency, bits over the median."""
    rows = [samples[i : i + width] for i in range(0, len(samples), width)]
    n = len(rows)

    def cells(count):
        return [range(k * count // 32, (k + 1) * count // 32) if count >= 32 else [k * count // 32] for k in range(32)]

    small = [[sum(sum(rows[i][j] for i in down) / len(down) for j in across) / len(across) for across in cells(width)] for down in cells(n)]
    wave = [[np.cos(np.pi * k * (2 * i + 1) / 64) for i in range(32)] for k in range(8)]
    low = [round(float(sum(wave[a][i] * sum(wave[b][j] * small[i][j] for j in range(32)) for i in range(32))), 6) for a in range(8) for b in range(8)]
    middle = sorted(low[1:])[31]
    bits = "".join("01"[v > middle] for v in low[1:])
    return f"{int('0' + bits, 2):016x}"


def test_every_column_by_hand(docs_of):
    texts = [t for _, t in ODD if t is None or len(t) < 1000] + ["rows of text " * 300, "ü" * 577, "x" * 576]
    docs = docs_of(list(enumerate(texts)))
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.to_media(docs).collect()}
    rows = {r["doc_id"]: r for r in media.store_and_read(docs).collect()}
    assert set(rows) == set(range(len(texts)))
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
        assert r["feature"] == slow_hash(payload)
