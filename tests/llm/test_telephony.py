import hashlib
import zlib

import numpy as np
import pytest

from lexweave.llm import telephony as tel
from lexweave.llm.common import table
from tests.llm.cases import empty, frame, key, texts


def plain_adpcm(block):
    """One block, sample by sample."""
    value, index = int(np.frombuffer(block[:2], "<i2")[0]), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(tel.STEPS[index])
            change = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
            value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
            index = max(0, min(88, index + int(tel.INDEX_CHANGE[nibble & 7])))
            out.append(value)
    return out


def test_tables():
    assert (tel.MULAW[[0xFF, 0x7F, 0x00, 0x80, 0xF0]]).tolist() == [0, 0, -32124, 32124, 120]
    assert (tel.ALAW[[0xD5, 0x55, 0x2A, 0xAA]]).tolist() == [8, -8, -32256, 32256]
    assert len(set(tel.ALAW.tolist())) == 256 and len(set(tel.MULAW.tolist())) == 255


def test_adpcm_across_blocks():
    data = np.random.default_rng(5).integers(0, 256, 64 * 50, dtype=np.uint8)
    assert tel.adpcm_blocks(data.reshape(-1, 64)).tolist() == [plain_adpcm(data[i : i + 64].tobytes()) for i in range(0, len(data), 64)]


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm"])
def test_round_trip(codec):
    for n in (0, 1, 63, 64, 65, 1000):
        payload = tel.pad(bytes(i % 251 for i in range(n)))
        assert len(payload) % 64 == 0 and len(payload) >= 64
        assert tel.from_wav(tel.to_wav(payload, codec)) == (codec, payload)
    with pytest.raises(ValueError):
        tel.from_wav(tel.to_wav(payload, codec)[:-3])


def test_double_rate():
    assert tel.double_rate(np.full(10, 77, np.int16)).tolist() == [77] * 20
    x = np.arange(0, 800, 8).astype(np.int16)
    assert np.abs(tel.double_rate(x)[4:-4] - np.arange(16, 784, 4)).max() <= 1


def expected(text):
    payload = tel.pad(text.encode())
    media = tel.to_wav(payload, "mulaw")
    return (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())


def picked(out):
    return [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in out.collect()]


def test_table(spark, sf):
    docs = table(spark, sf, "documents")
    out = tel.describe(tel.store(docs))
    assert key(picked(out)) == key((r.doc_id, *expected(r.text)) for r in docs.collect())
    assert all(r.feature for r in out.collect())


def test_edge_rows(spark):
    out = tel.describe(tel.store(frame(spark)))
    assert key(picked(out)) == key((i, *expected(t)) for i, t in texts())
    features = {}
    for r in out.collect():
        assert features.setdefault(r.payload_sha256, r.feature) == r.feature
    assert tel.describe(tel.store(empty(spark))).count() == 0


def test_features_and_pcm_by_one_document(spark):
    rows = tel.describe(tel.resample(tel.store(frame(spark), "adpcm")), pcm_col="pcm").collect()
    for r in rows:
        assert r.pcm_bytes == len(tel.from_wav(bytes(r.pcm))[1])
        codec, payload = tel.from_wav(bytes(r.media))
        samples = tel.expand(payload, codec)
        pcm = tel.double_rate(samples).tobytes()
        assert tel.from_wav(bytes(r.pcm)) == ("pcm", pcm) and r.pcm_sha256 == hashlib.sha256(pcm).hexdigest()
        x = samples.astype(int)
        assert r.feature.endswith(f"adpcm:{len(x)},{(x * x).sum()},{np.abs(x).max()},{((x[1:] < 0) != (x[:-1] < 0)).sum()}")


def test_columns_that_clash(spark):
    """Added columns take the place of those of their names; all others stay, whatever they are called."""
    stored = tel.store(frame(spark)).selectExpr("*", "'x' AS feature", "'x' AS Pcm", "'x' AS _read", "'x' AS _r")
    out = tel.describe(tel.resample(stored), pcm_col="pcm")
    assert [c.lower() for c in out.columns].count("feature") == [c.lower() for c in out.columns].count("pcm") == 1
    assert {(r._read, r._r) for r in out.collect()} == {("x", "x")} and all(r.feature.startswith("mulaw:") for r in out.collect())


def test_query_stores_what_it_describes(spark, sf):
    from lexweave.llm import queries

    out = {r.doc_id: r for r in queries.op2_telephony(spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        payload = tel.pad((r.text or "").encode())
        pcm = tel.double_rate(tel.expand(payload, "mulaw")).tobytes()
        assert (out[r.doc_id].pcm_bytes, out[r.doc_id].pcm_sha256) == (len(pcm), hashlib.sha256(pcm).hexdigest())


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm"])
def test_stored_at_once_or_one_by_one(spark, codec):
    one = tel.store(frame(spark), codec, pcm=True)
    two = tel.resample(tel.store(frame(spark), codec))
    assert one.columns == two.columns and key(map(tuple, one.collect())) == key(map(tuple, two.collect()))
