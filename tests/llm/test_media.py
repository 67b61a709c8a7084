import hashlib
import struct
import zlib

import numpy as np
import pytest

from skillgrid.llm import media as M

from .data import empty_documents, odd_documents


def frames(x):
    """Lossless pictures of samples (frame, 24, 24)."""
    return M._pictures(np.asarray(x, np.uint8).tobytes())


@pytest.mark.parametrize("seed", range(4))
def test_round_trip_of_all_byte_values(seed):
    rng = np.random.default_rng(seed)
    x = rng.choice(np.array([0, 1, 127, 128, 254, 255]) if seed % 2 else np.arange(256), (5, 24, 24)).astype(np.uint8)
    data = M.write_avi(frames(x))
    micros, got = M.read_avi(data)
    assert micros == M.MICROS and (M.decode_frames(got) == x).all()
    # the bit reader and the packed path agree
    p = M.Picture(got[0])
    assert (M._lossless(p, M._Bits(got[0][p.start :])) == x[0]).all()


def test_riff_structure_and_missing_index():
    data = M.write_avi(frames(np.zeros((3, 24, 24))))
    assert data[:4] == b"RIFF" and data[8:12] == b"AVI " and struct.unpack("<I", data[4:8])[0] == len(data) - 8
    at = data.index(b"idx1")
    assert struct.unpack("<I", data[at + 4 : at + 8])[0] == 16 * 3
    assert M.read_avi(data[:at])[1] == M.read_avi(data)[1]
    with pytest.raises(ValueError):
        M.read_avi(b"RIFF\0\0\0\0AVI ")


def baseline_picture(levels, size=16):
    """A baseline picture of flat 8 x 8 blocks with the given DC values (quantiser 8)."""
    across = size // 8
    bits, last = "", 0
    for v in levels:
        d, last = v - last, v
        s = abs(d).bit_length()
        bits += format(s, "04b") + (format(d if d > 0 else d + (1 << s) - 1, f"0{s}b") if s else "") + "00"
    bits += "1" * (-len(bits) % 8)
    raw = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    table = lambda kind, counts, symbols: b"\xff\xc4" + struct.pack(">H", 19 + len(symbols)) + bytes([kind]) + bytes(counts) + bytes(symbols)
    dc = table(0x00, [0, 0, 0, 12] + [0] * 12, list(range(12)))
    ac = table(0x10, [0, 1] + [0] * 14, [0])
    sof = b"\xff\xc0" + struct.pack(">HBHHBBBB", 11, 8, size, size, 1, 1, 0x11, 0)
    sos = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 0, 63, 0)
    assert across * across == len(levels)
    return b"\xff\xd8" + b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([8] * 64) + sof + dc + ac + sos + raw + b"\xff\xd9"


def test_baseline_pictures():
    x = M.decode_frames([baseline_picture([0, 10, -20, 127])])[0]
    for (r, c), level in zip(((0, 0), (0, 8), (8, 0), (8, 8)), (0, 10, -20, 127)):
        assert (x[r : r + 8, c : c + 8] == min(255, 128 + level)).all()


def test_inverse_transform_is_orthonormal():
    assert np.allclose(M.COSINES @ M.COSINES.T, np.eye(8)) and sorted(M.ZIGZAG) == list(range(64)) and M.ZIGZAG[:6] == [0, 1, 8, 16, 9, 2]


def test_shots(spark):
    rng = np.random.default_rng(1)
    scenes = [rng.normal(m, 6, (20, 24, 24)).clip(0, 255) for m in (60, 150, 90)]
    data = M.write_avi(frames(np.concatenate(scenes)))
    assert M.shot_starts(M.histograms(M.decode_frames(M.read_avi(data)[1]))).tolist() == [0, 20, 40]
    df = spark.createDataFrame([(1, bytearray(data), "x"), (2, None, "x"), (3, bytearray(b"junk"), "x"), (1, bytearray(data), "x")], "doc_id long, media binary, clip string")
    out = M.clips(df).collect()
    one = sorted((r["clip"], r["first_frame"], r["last_frame"], r["start_ms"], r["end_ms"]) for r in out if r["doc_id"] == 1)
    assert one == sorted([(0, 0, 19, 0.0, 800.0), (1, 20, 39, 800.0, 1600.0), (2, 40, 59, 1600.0, 2400.0)] * 2)
    assert [r["error"] is not None and r["clip"] is None for r in out if r["doc_id"] == 3] == [True] and not [r for r in out if r["doc_id"] == 2]


def test_digests(spark):
    df = odd_documents(spark)
    texts = {}
    for r in df.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    rows = M.stored_digests(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        ok = []
        for t in texts[r["doc_id"]]:
            raw = t.encode()
            payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
            ok.append((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
        assert any(ok)
    media = {(r["doc_id"], r["n_bytes"]): r["media"] for r in M.store(df).collect()}
    assert all(hashlib.sha256(bytes(media[r["doc_id"], r["n_bytes"]])).hexdigest() == r["media_sha256"] and len(media[r["doc_id"], r["n_bytes"]]) == r["media_bytes"] for r in rows)


def test_no_rows(spark):
    assert M.stored_digests(empty_documents(spark)).count() == 0
    assert M.clips(M.store(empty_documents(spark))).count() == 0


def test_video_after_audio_and_empty_chunks(spark):
    a, b = frames(np.stack([np.zeros((24, 24)), np.full((24, 24), 200)]))
    data = M.write_avi([a, b"", b"", b])
    assert M.read_avi(data)[1] == [a, a, a, b] == M.read_avi(data[: data.index(b"idx1")])[1]
    strl = data[data.index(b"strl") - 8 : data.index(b"movi") - 8]
    hdrl = b"hdrl" + data[data.index(b"avih") : data.index(b"strl") - 8]
    movi = M._chunk(b"01wb", b"sound") + M._chunk(b"00wb", b"sound") + M._chunk(b"01dc", a) + M._chunk(b"01dc", b"") + M._chunk(b"01dc", b)
    head = M._chunk(b"LIST", hdrl + strl.replace(b"vids", b"auds") + strl)
    second = M._chunk(b"RIFF", b"AVI " + head + M._chunk(b"LIST", b"movi" + movi))
    assert M.read_avi(second)[1] == [a, a, b]
    out = M.clips(spark.createDataFrame([(1, bytearray(M.write_avi([]))), (2, bytearray(M.write_avi([b""])))], "doc_id long, media binary")).collect()
    assert sorted((r["doc_id"], r["clip"], r["error"]) for r in out) == [(1, None, "no video frame"), (2, None, "no video frame")]


def plain_feature(payload):
    """Frames, histograms of sixteen levels, their distances, and where these stand out from
    their surroundings, one by one."""
    pictures = [payload[i : i + M.FRAME] for i in range(0, len(payload), M.FRAME)]
    hist = [[sum(b // 16 == level for b in p) for level in range(16)] for p in pictures]
    jump = [sum(abs(a - b) for a, b in zip(x, y)) / (2 * M.FRAME) for x, y in zip(hist, hist[1:])]
    starts = [0]
    for i, d in enumerate(jump):
        near = jump[max(0, i - M.WINDOW) : i + M.WINDOW + 1]
        mean = sum(near) / len(near)
        spread = (sum((x - mean) ** 2 for x in near) / len(near)) ** 0.5
        if d > max(M.LEAST, mean + M.DEVIATIONS * spread):
            starts.append(i + 1)
    raw = b"".join(struct.pack("<i", x) for h in hist for x in h) + b"".join(struct.pack("<i", x) for x in starts)
    level = sum(payload) / len(payload)
    return f"frames={len(pictures)};shots={len(starts)};level={level:.4f};digest={hashlib.blake2b(raw, digest_size=8).hexdigest()}"


def test_features_equal_plain_steps(spark, sf_dir):
    rng = np.random.default_rng(5)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    scenes = ["".join(chr(int(x)) for x in rng.integers(a, a + 12, 576 * n)) for a, n in ((40, 30), (100, 25), (60, 40), (33, 1), (90, 30))]
    texts += [None, "", "a", "".join(scenes), "A" * 576 * 40, "é\U0001f642" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["feature"] for r in M.stored_digests(df).collect()}
    want = {i: plain_feature(M.payload_of(t)[1]) for i, t in enumerate(texts)}
    assert got == want and max(int(f.split("shots=")[1].split(";")[0]) for f in want.values()) >= 5
