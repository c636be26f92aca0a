import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from flowtide.llm import jpeg, media

from . import plain_jpeg


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=900), min_size=1, max_size=4))
def test_round_trip(raws):
    files = jpeg.encode([media.payload_of(r) for r in raws])
    assert jpeg.payloads(jpeg.decode(files)) == [media.payload_of(r) for r in raws]


def test_sparse_and_dense():
    rng = random.Random(2)
    raws = [b"\0" * 640, b"\x80" * 128, bytes(rng.choice([0, 0, 0, 0, 0, 1, 255]) for _ in range(6400)), bytes(range(256))]
    assert jpeg.payloads(jpeg.decode(jpeg.encode(raws))) == raws
    wide = bytes(rng.randbytes(jpeg.MAX_UNITS_HIGH * 384 + 64))
    assert jpeg.shape_of(len(wide) // 64)[0] == 2 and jpeg.payloads(jpeg.decode(jpeg.encode([wide]))) == [wide]


def test_scans_are_progressive():
    data = jpeg.encode([media.payload_of(b"text of a document " * 20)])[0]
    scans = [k[:5] for k, _ in jpeg._parse(data).scans]
    assert data[:2] == b"\xff\xd8" and {(lo, hi) for lo, hi, *_ in scans} == {(0, 0), (1, 5), (6, 63)} and any(before for _, _, before, *_ in scans)


def test_transform():
    m = jpeg.idct_matrix() / 2**14
    assert np.allclose(m @ m.T, np.eye(64), atol=1e-3)
    block = np.zeros((6, 64), np.int16)
    block[:, 0] = 80  # flat grey: DC / 8
    t = jpeg.rgb(jpeg.Coefficients(block, np.array([0, 1]), [(1, 1)], [b"payload 64"]))[0]
    assert t.shape == (16, 16, 3) and t[0, 0, 0] == 138 + (91881 * 10 + 32768 >> 16)


def test_documents(spark, odd, odd_rows, empty):
    got = media.read_back(media.store(odd)).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) for r in got) == sorted(
        (r[0] or -1, len(raw := (r[1] or "").encode()), len(p := media.payload_of(raw)), zlib.crc32(p[-64:])) for r in odd_rows
    )
    by = {}
    for r in got:
        by.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by.values())
    assert media.read_back(media.store(empty)).count() == 0
    t = media.tensors(media.store(odd.where("doc_id = 6"))).first()
    assert len(t["rgb"]) == t["height"] * t["width"] * 3


def test_files_by_a_second_decoder():
    """A decoder that shares no code with the package finds the same coefficients and, within rounding, the same pixels."""
    rng = random.Random(5)
    raws = [b"", b"A text of a document, with an \xc3\xa9. " * 30, bytes(rng.choice([0, 0, 0, 0, 1, 255, 128]) for _ in range(1500)), rng.randbytes(1100), b"\x80" * 64 + b"\x7f" * 64]
    files = jpeg.encode([media.payload_of(r) for r in raws])
    decoded = jpeg.decode(files)
    tensors = jpeg.rgb(decoded)
    for n, (raw, data) in enumerate(zip(raws, files, strict=True)):
        height, width, (luma, cb, cr) = plain_jpeg.read(data)
        assert tensors[n].shape == (height, width, 3) and set(luma["q"]) == {1}
        flat = []
        for y in range(height // 16):
            for x in range(width // 16):
                for v, h in ((0, 0), (0, 1), (1, 0), (1, 1)):
                    flat += luma["blocks"][2 * y + v, 2 * x + h]
                flat += cb["blocks"][y, x] + cr["blocks"][y, x]
        payload = media.payload_of(raw)
        assert bytes(v & 255 for v in flat[: len(payload)]) == payload and not any(flat[len(payload) :])
        assert np.abs(np.array(plain_jpeg.pixels(data)) - tensors[n]).max() < 3
