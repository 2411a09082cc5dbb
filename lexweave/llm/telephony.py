"""Media columns for telephony audio: mu-law, A-law and IMA ADPCM in WAV containers, and resampled PCM.

A container holds the payload's bytes as they are, so storing is lossless: mu-law and A-law as 8-bit samples, ADPCM as
blocks of 64 bytes. Reading expands mu-law and A-law by lookup tables of 256 entries, which the rule of G.711 makes, and
decodes all ADPCM blocks side by side, one numpy step for each sample position of a block. PCM of 8 kHz is resampled
to 16 kHz in whole numbers, so results are the same on any machine.

Null and empty texts give one block of 64 zero bytes. Equal texts give equal media and features; repeated rows are stored one by one and
ids may be null or repeat. Texts of any length are stored whole: a row's containers, the longest five times its text, are held at once.
store() leaves other columns out; resample() and describe() keep them, but for those whose names are of columns that they add.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import bound_batches, chunks, fresh, quoted, require, text_or_empty, tidy

BLOCK = 64
RATE = 8000
#: WAV format tags.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 0x11, "pcm": 1}
NAMES = {v: k for k, v in TAGS.items()}
#: Samples of an ADPCM block: one in its header of 4 bytes, two in each other byte.
PER_BLOCK = 1 + 2 * (BLOCK - 4)

# Fixed values of IMA ADPCM: the change of the step index by the nibble's low three bits, and the steps.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
    337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358,
    5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    segment, low = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(segment == 0, low, (low + 256) << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """The samples, (n, 121) int16, of n blocks, (n, 64) uint8. A header's index beyond the steps counts as the last."""
    n = len(blocks)
    out = np.empty((PER_BLOCK, n), dtype=np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out[0] = value
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(PER_BLOCK - 1):
        nibble = (data[k >> 1] >> (4 * (k & 1))) & 15
        step = STEPS[index]
        low = nibble & 7
        change = step >> 3
        change += np.where(low & 4, step, 0)
        change += np.where(low & 2, step >> 1, 0)
        change += np.where(low & 1, step >> 2, 0)
        value += np.where(nibble & 8, -change, change)
        np.clip(value, -32768, 32767, out=value)
        index += INDEX_CHANGE[low]
        np.clip(index, 0, len(STEPS) - 1, out=index)
        out[k + 1] = value
    return out.T


def pad(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def to_wav(payload: bytes, codec: str) -> bytes:
    """A container with the payload's bytes as they are."""
    tag = TAGS[codec]
    align, bits, rate = {"adpcm": (BLOCK, 4, RATE), "pcm": (2, 16, 2 * RATE)}.get(codec, (1, 8, RATE))
    samples = {"adpcm": len(payload) // BLOCK * PER_BLOCK, "pcm": len(payload) // 2}.get(codec, len(payload))
    per_second = rate * BLOCK // PER_BLOCK if codec == "adpcm" else rate * align
    more = struct.pack("<HH", 2, PER_BLOCK) if codec == "adpcm" else struct.pack("<H", 0)
    head = struct.pack("<HHIIHH", tag, 1, rate, per_second, align, bits) + more
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wav(media: bytes) -> tuple[str, bytes]:
    """The codec and the payload of a container, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV container")
    at, codec, payload = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            codec = NAMES.get(struct.unpack_from("<H", media, at + 8)[0])
        elif name == b"data":
            payload = media[at + 8 : at + 8 + size]
            if len(payload) != size:
                raise ValueError("a cut container")
        at += 8 + size + (size & 1)
    if codec is None or payload is None:
        raise ValueError("no known format or no data")
    return codec, payload


def expand(payload: bytes, codec: str) -> np.ndarray:
    """The PCM samples, int16, of a payload."""
    data = np.frombuffer(payload, dtype=np.uint8)
    if codec == "pcm":
        return data.view("<i2")
    if codec == "adpcm":
        return adpcm_blocks(data[: len(data) // BLOCK * BLOCK].reshape(-1, BLOCK)).reshape(-1)
    return (MULAW if codec == "mulaw" else ALAW)[data]


def double_rate(samples: np.ndarray) -> np.ndarray:
    """Twice the rate: between two samples, the half-band filter (-1, 9, 9, -1) / 16 over the nearest four; the ends repeat."""
    x = np.concatenate((samples[:1], samples, samples[-1:], samples[-1:])).astype(np.int32)
    out = np.empty(2 * len(samples), dtype="<i2")
    out[0::2] = samples
    out[1::2] = np.clip((9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4, -32768, 32767)
    return out


def measures(samples: np.ndarray, starts: np.ndarray) -> list[str]:
    """Of each stretch: samples, energy (sum of squares), peak and sign changes."""
    if not len(starts):
        return []
    x = samples.astype(np.int64)
    energy, peak = np.add.reduceat(x * x, starts), np.maximum.reduceat(np.abs(x), starts)
    change = np.zeros(len(x), dtype=np.int64)
    change[1:] = (x[1:] < 0) != (x[:-1] < 0)
    change[starts] = 0
    crossings, sizes = np.add.reduceat(change, starts), np.diff(np.append(starts, len(x)))
    return [f"{n},{e},{p},{c}" for n, e, p, c in zip(sizes.tolist(), energy.tolist(), peak.tolist(), crossings.tolist(), strict=True)]


def doubled(media: bytes) -> bytes:
    """A container of the samples of another, 16 bits each, at twice the rate."""
    codec, payload = from_wav(media)
    return to_wav(double_rate(expand(payload, codec)).tobytes(), "pcm")


def store(df: DataFrame, codec: str = "mulaw", id_col: str = "doc_id", text_col: str = "text", pcm: bool = False) -> DataFrame:
    """id_col, n_bytes and media: each row's text, padded, in a WAV container; pcm: also what resample() would add, in one pass. Other columns are left out."""
    require(df, id_col, text_col)
    if codec not in ("mulaw", "alaw", "adpcm"):
        raise ValueError(f"unknown codec {codec}")

    @F.arrow_udf("media binary, pcm binary" if pcm else "media binary")
    def wrap(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            media = [to_wav(pad((t.as_py() or "").encode()), codec) for t in texts]
            columns = [pa.array(media, pa.binary()), *([pa.array(map(doubled, media), pa.binary())] if pcm else [])]
            yield pa.StructArray.from_arrays(columns, ["media", "pcm"][: len(columns)])
        tidy()

    bound_batches(df.sparkSession)
    (made,) = fresh(df.select(quoted(id_col)), "made")
    text = text_or_empty(text_col)
    out = df.select(quoted(id_col), F.octet_length(text).cast("long").alias("n_bytes"), wrap(text).alias(made))
    return out.select(quoted(id_col), "n_bytes", f"{made}.media", *([f"{made}.pcm"] if pcm else []))


def resample(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with the column `pcm`: a WAV container of 16-bit samples at twice the rate. Null media give null."""
    require(df, media_col)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for media in batches:
            yield pa.array([None if m.as_py() is None else doubled(m.as_py()) for m in media], pa.binary())
        tidy()

    bound_batches(df.sparkSession)
    return df.select(*(quoted(c) for c in df.columns if c.lower() != "pcm"), run(quoted(media_col)).alias("pcm"))


FIELDS = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
PCM_FIELDS = "pcm_bytes long, pcm_sha256 string"


def read_features(media: list[bytes]) -> list[tuple]:
    """FIELDS of each container. The feature holds measures() of the payload as mu-law, as A-law and as ADPCM blocks."""
    out: list[tuple] = []
    payloads = [from_wav(m)[1] for m in media]
    for a, b in chunks(payloads, 1 << 18):
        part = payloads[a:b]
        joined = np.frombuffer(b"".join(part), dtype=np.uint8)
        starts = np.concatenate(([0], np.cumsum([len(p) for p in part])[:-1])).astype(np.int64)
        blocks = adpcm_blocks(joined.reshape(-1, BLOCK)).reshape(-1)
        kinds = {"mulaw": measures(MULAW[joined], starts), "alaw": measures(ALAW[joined], starts), "adpcm": measures(blocks, starts // BLOCK * PER_BLOCK)}
        for k, p in enumerate(part):
            out.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), ";".join(f"{n}:{v[k]}" for n, v in kinds.items())))
    return out


def read_pcm(stored: list[bytes]) -> list[tuple]:
    """PCM_FIELDS of each container: length and digest of its samples."""
    return [(len(p), hashlib.sha256(p).hexdigest()) for _, p in map(from_wav, stored)]


def describe(df: DataFrame, media_col: str = "media", pcm_col: str | None = None) -> DataFrame:
    """df with FIELDS read from the stored containers, media_bytes and media_sha256 of the containers themselves, and PCM_FIELDS of those of pcm_col."""
    columns = [media_col, *([pcm_col] if pcm_col else [])]
    require(df, *columns)
    bound_batches(df.sparkSession)
    fields = ", ".join([FIELDS, PCM_FIELDS][: len(columns)])
    names, kinds = zip(*(x.split() for x in fields.split(", ")), strict=True)

    def read(*stored: pa.Array) -> pa.Array:
        parts = [f([m.as_py() for m in x]) for f, x in zip((read_features, read_pcm), stored, strict=False)]
        found = list(zip(*(sum(row, ()) for row in zip(*parts, strict=True)), strict=True)) or [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64() if t == "long" else pa.string()) for c, t in zip(found, kinds, strict=True)], list(names))

    # one function for both containers: each function of batches is a worker of its own
    if pcm_col:

        @F.arrow_udf(fields)
        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for media, pcm in batches:
                yield read(media, pcm)
            tidy()

    else:

        @F.arrow_udf(fields)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for media in batches:
                yield read(media)
            tidy()

    media, (r,) = quoted(media_col), fresh(df, "read")
    made = {"media_bytes": F.octet_length(media).cast("long"), "media_sha256": F.sha2(media, 256)} | {n: F.col(f"{r}.{n}") for n in names}
    df = df.withColumn(r, run(*map(quoted, columns)))
    return df.select(*(quoted(c) for c in df.columns if c != r and c.lower() not in made), *(c.alias(n) for n, c in made.items()))
