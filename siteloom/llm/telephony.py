"""Telephony audio as media columns: mu-law, A-law and ADPCM, read into resampled PCM (operator 13)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, small_batches, with_fields

CODECS = ("mulaw", "alaw", "adpcm")

#: The codecs' numbers in a RIFF file, the step sizes and the index moves of this ADPCM.
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 17}
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
    2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)

#: Bytes of samples in one ADPCM block, after its four bytes of head.
BLOCK = 64


def mulaw_table() -> np.ndarray:
    """The 16-bit sample of each mu-law byte: inverted bits are sign, exponent and mantissa, biased by 132."""
    u = ~np.arange(256) & 255
    size = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 16-bit sample of each A-law byte: every other bit is inverted; the lowest segment is linear."""
    a = np.arange(256) ^ 0x55
    exponent, size = a >> 4 & 7, ((a & 15) << 4) + 8
    size = np.where(exponent > 0, size + 256 << np.maximum(exponent - 1, 0), size)
    return np.where(a & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def decode_blocks(blocks: np.ndarray) -> np.ndarray:
    """ADPCM blocks (rows of bytes: predictor, index, 0, codes) to rows of samples, the predictor first.

    A block's codes depend on each other and blocks don't, so numpy takes one code of every block at a time."""
    n, width = blocks.shape
    at = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    out = np.empty((2 * (width - 4) + 1, n), np.int16)
    out[0] = at
    for k in range(2 * (width - 4)):
        code = blocks[:, 4 + k // 2] >> 4 * (k % 2) & 15
        step, size = STEPS[index], code & 7
        moved = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
        at = np.clip(np.where(code & 8, at - moved, at + moved), -32768, 32767)
        index = np.clip(index + MOVES[size], 0, len(STEPS) - 1)
        out[k + 1] = at
    return out.T


def riff(codec: str, data: bytes, rate: int = 8000) -> bytes:
    """A RIFF/WAVE file of one channel. ``data`` is what the format stores: bytes of samples, or whole blocks."""
    bits = {"pcm": 16, "adpcm": 4}.get(codec, 8)
    align = {"pcm": 2, "adpcm": BLOCK + 4}.get(codec, 1)
    per_block = 2 * BLOCK + 1
    head = struct.pack("<HHIIHH", TAGS[codec], 1, rate, rate * align // per_block if codec == "adpcm" else rate * align, align, bits)
    fact = b""
    if codec == "adpcm":
        head += struct.pack("<HH", 2, per_block)
    if codec != "pcm":
        samples = len(data) // align * (per_block if codec == "adpcm" else 1)
        head += b"" if codec == "adpcm" else struct.pack("<H", 0)
        fact = b"fact" + struct.pack("<II", 4, samples)
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(media: bytes) -> tuple[str, int, int, bytes] | None:
    """(codec, rate, alignment, data) of a RIFF/WAVE file of one channel; None for anything else."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, form, data = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(media):
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data" and at + 8 + size <= len(media):
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    codec = next((c for c, t in TAGS.items() if form and form[0] == t), None)
    if data is None or codec is None or form[1] != 1 or (codec == "adpcm" and (form[4] <= 4 or len(data) % form[4])) or (codec == "pcm" and form[5] != 16):
        return None
    return codec, form[2], form[4], data


def store_bytes(payload: bytes, codec: str) -> bytes:
    """The payload as the samples of a file: a byte is a mu-law or A-law sample, or two ADPCM codes in blocks whose
    heads start from silence. The payload must be a multiple of ``BLOCK``."""
    if codec != "adpcm":
        return riff(codec, payload)
    blocks = np.zeros((len(payload) // BLOCK, BLOCK + 4), np.uint8)
    blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    return riff(codec, blocks.tobytes())


def stored_payload(codec: str, align: int, data: bytes) -> bytes:
    if codec != "adpcm":
        return data
    return np.frombuffer(data, np.uint8).reshape(-1, align)[:, 4:].tobytes()


def filters(up: int, down: int, taps: int = 16) -> np.ndarray:
    """The ``up`` phases of a windowed sinc, in integers that sum to 2**14 a phase: one low-pass for both rates."""
    cut = 1 / max(up, down) * up
    t = (np.arange(taps) - taps // 2 + 1)[None, :] - np.arange(up)[:, None] / up
    h = np.sinc(t * min(cut, 1.0)) * np.cos(np.pi * t / (taps + 2)) ** 2
    q = np.round(h / h.sum(1, keepdims=True) * 2**14)
    q[:, taps // 2 - 1] += 2**14 - q.sum(1)
    return q


def resample(pcm: np.ndarray, up: int, down: int) -> np.ndarray:
    """16-bit samples at ``up / down`` times their rate, by a polyphase filter. Products of integers below 2**53 are
    summed in doubles, so the result doesn't depend on the order or the machine."""
    if up == down or not len(pcm):
        return pcm
    h = filters(up, down)
    taps, n = h.shape[1], (len(pcm) * up + down - 1) // down
    padded = np.concatenate([np.zeros(taps // 2 - 1), pcm.astype(np.float64), np.zeros(taps // 2 + 1)])
    out = np.empty(n, np.float64)
    for r in range(min(up, n)):
        first, phase = r * down // up, r * down % up
        m = len(out[r::up])
        if np.count_nonzero(h[phase]) == 1:  # the phase of the samples themselves
            out[r::up] = padded[first + taps // 2 - 1 :: down][:m] * 2.0**14
        else:
            out[r::up] = np.convolve(padded, h[phase][::-1], "valid")[first::down][:m]
    out += 2.0**13
    out *= 2.0**-14
    np.floor(out, out=out)
    return np.clip(out, -32768, 32767, out=out).astype(np.int16)


def _ratio(rate: int, wanted: int) -> tuple[int, int]:
    g = int(np.gcd(rate, wanted))
    return wanted // g, rate // g


def store(docs: DataFrame, *, text: str = "text", codec: str | None = None) -> DataFrame:
    """Adds ``n_bytes`` and ``media`` to every row and drops the text: its UTF-8 bytes, filled with zeros to a positive
    multiple of 64, as the samples of a telephony file, without loss.

    ``codec`` is one of ``CODECS``; None takes one by the checksum of the bytes, so that equal texts give equal files.
    Null texts count as empty (64 zeros). Rows are independent: no shuffle; repeated rows stay; an empty table gives
    none; columns so named are replaced, all others kept. A file is as long as its text, give or take a sixteenth.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*(c for c in ("n_bytes", "media") if c != text))
    keep = [c for c in docs.columns if c != text]
    schema = with_fields(docs.select(*keep).schema, n_bytes="long", media="binary")

    def one(data: bytes | None) -> tuple[int, bytes]:
        data = data or b""
        payload = data + b"\0" * (-len(data) % BLOCK if data else BLOCK)
        return len(data), store_bytes(payload, codec or CODECS[zlib.crc32(payload) % len(CODECS)])

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded_batches(batches, text):
            n, media = zip(*map(one, b.column(text).to_pylist())) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])

    return docs.select(*keep, F.col(text).cast("binary").alias(text)).mapInArrow(stored, schema)


def decoded(media: DataFrame, *, column: str = "media", rate: int = 16000, with_pcm: bool = True) -> DataFrame:
    """Adds what a stored file holds: ``codec``, ``payload`` (the stored samples' bytes, of ADPCM without heads),
    ``samples``, ``peak``, ``rms``, ``crossings`` of the PCM at ``rate``, and ``pcm``, a RIFF file of it.

    mu-law and A-law are looked up in tables, the ADPCM blocks of a whole batch are decoded together, and each file is
    resampled. What is no such file (null, cut short, another format) gets nulls. Rows are independent: no shuffle.
    ``with_pcm=False`` leaves out the column of PCM, which is four to eight times as large as the file. Batches are cut
    by bytes, so that memory is bounded by some MB and the largest file.
    """
    small_batches(media.sparkSession)
    out = {"codec": ("string", pa.string()), "payload": ("binary", pa.binary()), "samples": ("long", pa.int64()), "peak": ("integer", pa.int32()), "rms": ("integer", pa.int32()), "crossings": ("long", pa.int64()), "pcm_crc32": ("long", pa.int64())}
    if with_pcm:
        out["pcm"] = ("binary", pa.binary())
    media = media.drop(*(c for c in out if c != column))
    keep = media.columns
    schema = with_fields(media.schema, **{c: t for c, (t, _) in out.items()})

    def heard(pcm: np.ndarray, told: int) -> tuple:
        x = resample(pcm, *_ratio(told, rate)) if told else pcm
        raw, wide, sign = x.astype("<i2", copy=False).tobytes(), x.astype(np.float64), x < 0
        rms = isqrt(sum(int(part @ part) for part in np.split(wide, range(2**22, len(wide), 2**22))) // max(len(x), 1))  # sums below 2**53: exact
        told = len(x), max(int(x.max(initial=0)), -int(x.min(initial=0))), rms, int(np.count_nonzero(sign[1:] != sign[:-1])), zlib.crc32(raw)
        return (*told, riff("pcm", raw, rate)) if with_pcm else told

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded_batches(batches, column, 2 << 20):
            files = [parse(m) if m is not None else None for m in b.column(column).to_pylist()]
            pcm: list = [None] * len(files)
            # All blocks of one length are decoded in one pass, whatever file they are of.
            for align in {f[2] for f in files if f and f[0] == "adpcm"}:
                mine = [i for i, f in enumerate(files) if f and f[0] == "adpcm" and f[2] == align]
                blocks = np.concatenate([np.frombuffer(files[i][3], np.uint8).reshape(-1, align) for i in mine])
                samples, at = decode_blocks(blocks), 0
                for i in mine:
                    n = len(files[i][3]) // align
                    pcm[i] = samples[at : at + n].reshape(-1)
                    at += n
            rows = []
            for i, f in enumerate(files):
                if f is None:
                    rows.append((None,) * len(out))
                    continue
                if f[0] in TABLES:
                    pcm[i] = TABLES[f[0]][np.frombuffer(f[3], np.uint8)]
                elif f[0] == "pcm":
                    pcm[i] = np.frombuffer(f[3], "<i2", len(f[3]) // 2)
                rows.append((f[0], stored_payload(f[0], f[2], f[3]), *heard(pcm[i], f[1])))
                pcm[i] = None
            cols = list(zip(*rows)) if rows else [()] * len(out)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(v, t) for v, (_, t) in zip(cols, out.values()))], names=[*keep, *out])

    return media.mapInArrow(read, schema)
