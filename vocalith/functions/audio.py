"""Telephone codes and mixing of 16-bit mono audio, one Arrow batch at a time; what needs an outside codec is left out."""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vocalith.functions.arrow import arrow

MIXED, ROOM = "struct<samples:binary,gain:double,scale:double>", "struct<samples:binary,direct:int,scale:double>"
FULL = 32767.0


def mulaw_level(code: Column) -> Column:
    """The 16-bit level of a µ-law code from 0 to 255, in built-in integer functions."""
    c = F.bitwise_not(code.cast("int")).bitwiseAND(255)
    step = (F.shiftleft(c.bitwiseAND(15), 3) + 132).cast("int")
    size = step * F.pow(F.lit(2), F.shiftright(c, 4).bitwiseAND(7)).cast("int") - 132
    return F.when(c >= 128, -size).otherwise(size)


def _levels() -> np.ndarray:
    i = np.arange(128)
    return (((i & 15) << 3) + 132 << (i >> 4)) - 132


#: The least quarter-sample that takes the next code: the middle between neighbouring levels.
_STEPS = (_levels()[:-1] + _levels()[1:] + 4) >> 3


def encode_mulaw(samples: np.ndarray) -> bytes:
    quarter = samples.astype(np.int32) >> 2
    code = np.searchsorted(_STEPS, np.minimum(np.abs(quarter), 8191), side="right")
    return np.where(quarter < 0, code ^ 0x7F, code ^ 0xFF).astype(np.uint8).tobytes()


def decode_mulaw(data: bytes) -> np.ndarray:
    c = ~np.frombuffer(data, np.uint8).astype(np.int32) & 255
    size = _levels()[c & 127]
    return np.where(c & 128, -size, size).astype("<i2")


def _map(f):
    return lambda s: pd.Series([None if x is None else f(bytes(x)) for x in s], dtype=object)


@arrow("binary")
def mulaw_encoded(pcm: pd.Series) -> pd.Series:
    """µ-law bytes of little-endian 16-bit samples."""
    return _map(lambda b: encode_mulaw(np.frombuffer(b, "<i2")))(pcm)


@arrow("binary")
def mulaw_decoded(data: pd.Series) -> pd.Series:
    return _map(lambda b: decode_mulaw(b).tobytes())(data)


def _wav(b: bytes) -> dict:
    with wave.open(io.BytesIO(b)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit WAV is read")
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
        mono = x[:, 0] if x.shape[1] == 1 else np.round(x.mean(axis=1)).astype("<i2")
        return {"rate": w.getframerate(), "samples": mono.tobytes()}


@arrow("struct<rate:int,samples:binary>")
def wav_decoded(data: pd.Series) -> pd.DataFrame:
    """Rate and samples of WAV bytes, channels averaged; null gives nulls."""
    return pd.DataFrame([{"rate": None, "samples": None} if b is None else _wav(bytes(b)) for b in data], columns=["rate", "samples"])


def level(x: np.ndarray, start: int, end: int) -> float:
    """Root mean square of the samples in [start, end); 0 where there are none."""
    part = x[start:end].astype(np.float64)
    return float(np.linalg.norm(part) / np.sqrt(part.size)) if part.size else 0.0


def limited(wave_: np.ndarray, factor: float = 1.0) -> tuple[bytes, float]:
    """``wave_`` times ``factor`` as 16-bit samples, the factor made smaller where its peak would pass full scale."""
    top = float(np.abs(wave_).max(initial=0.0))
    factor = min(factor, FULL / top) if top else factor
    return np.rint(factor * wave_).clip(-32768, FULL).astype("<i2").tobytes(), factor


def mix(speech: np.ndarray, noise: np.ndarray, snr_db: float, start: int, end: int) -> dict:
    """Speech with noise, repeated as often as needed, ``snr_db`` decibels below the speech's level over [start, end)."""
    around = np.take(noise, np.arange(speech.size), mode="wrap") if noise.size else noise
    loud, quiet = level(speech, start, end), level(around, start, end)
    if not loud or not quiet:
        raise ValueError("speech or noise is silent or missing where levels are measured")
    gain = loud / quiet * 10.0 ** (-snr_db / 20)
    samples, scale = limited(speech + gain * around)
    return {"samples": samples, "gain": gain, "scale": scale}


def noise_part(noise: np.ndarray, length: int, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """A random stretch of ``length`` samples and where it starts; all of a noise that isn't longer."""
    at = int(rng.integers(0, noise.size - length + 1)) if noise.size > length else 0
    return noise[at : at + length], at


def convolved(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """All of ``x`` filtered by ``h``, block by block: each block's tail is added to the next ones'."""
    block = 1 << max(12, (2 * h.size - 1).bit_length())
    step, response = block - h.size + 1, np.fft.rfft(h, block)
    out = np.zeros(x.size + block)
    for a in range(0, x.size, step):
        out[a : a + block] += np.fft.irfft(response * np.fft.rfft(x[a : a + step], block), block)
    return out[: x.size + h.size - 1]


def reverberate(speech: np.ndarray, response: np.ndarray, start: int, end: int) -> dict:
    """Speech in a room, moved ahead by the time that the strongest path takes, and as loud over [start, end) as before."""
    direct = int(np.argmax(np.abs(response.astype(np.float64)))) if response.size else 0
    if not response.size or not response[direct]:
        raise ValueError("empty or silent response")
    wet = convolved(speech.astype(np.float64), response.astype(np.float64))[direct:][: speech.size]
    heard = level(wet, start, end)
    samples, scale = limited(wet, level(speech, start, end) / heard if heard else 1.0)
    return {"samples": samples, "direct": direct, "scale": scale}


def bandpass(x: np.ndarray, rate: int, low: float, high: float, sections: int = 2) -> np.ndarray:
    """Second-order high-pass and low-pass sections, applied ``sections`` times each as products of their frequency responses."""
    if not 0 < low < high < rate / 2:
        raise ValueError(f"{low} to {high} Hz is no band at {rate} Hz")
    size = 1 << (2 * x.size - 1).bit_length() if x.size else 1
    z = np.exp(-2j * np.pi * np.fft.rfftfreq(size))
    gain = np.ones(z.size, complex)
    for hz, sign in ((low, 1), (high, -1)):  # bilinear Butterworth sections
        k = np.tan(np.pi * hz / rate)
        a0, a1, a2 = 1 + np.sqrt(2) * k + k * k, 2 * (k * k - 1), 1 - np.sqrt(2) * k + k * k
        b = 1.0 if sign > 0 else k * k
        gain *= (b * (1 - sign * 2 * z + z * z) / (a0 + a1 * z + a2 * z * z)) ** sections
    return np.rint(np.fft.irfft(gain * np.fft.rfft(x.astype(np.float64), size), size)[: x.size]).clip(-32768, 32767).astype("<i2")


#: Zero crossings of the resampling filter to each side, the shape of its window, and outputs that are made at once.
CROSSINGS, KAISER, OUTPUTS = 24, 9.0, 4096


@lru_cache(maxsize=16)
def _phases(up: int, down: int) -> np.ndarray:
    """A row of filter taps for each place that an output can have between two inputs; each row sums to 1."""
    cut = min(1.0, up / down)
    half = math.ceil(CROSSINGS / cut)
    t = np.arange(-half + 1, half + 1) - np.arange(up)[:, None] / up
    taps = np.sinc(cut * t) * np.i0(KAISER * np.sqrt(np.clip(1 - (t / half) ** 2, 0, 1)))
    return taps / taps.sum(axis=1, keepdims=True)


def output_blocks(read: Callable[[int, int], np.ndarray], size: int, rate: int, to: int, first: int, last: int) -> Iterator[np.ndarray]:
    """Outputs ``first`` up to ``last`` of ``size`` samples at another rate, in blocks: ``read(a, z)`` gives the inputs from a up to z.

    A windowed sinc in as many phases as the rates need; no block keeps more than its own inputs, and where one begins changes nothing.
    """
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    taps = _phases(up, down)
    half = taps.shape[1] // 2
    for n in range(first, last, OUTPUTS):
        place = np.arange(n, min(n + OUTPUTS, last)) * down
        base, phase = place // up, place % up
        low, high = int(base[0]) - half + 1, int(base[-1]) + half + 1
        x = np.zeros(high - low)
        a, z = max(low, 0), min(high, size)
        if z > a:
            x[a - low : z - low] = read(a, z)
        near = np.lib.stride_tricks.sliding_window_view(x, 2 * half)[base - half + 1 - low]
        yield np.rint(np.einsum("ij,ij->i", near, taps[phase])).clip(-32768, 32767).astype("<i2")


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """The samples at another rate, as many as last as long."""
    if rate == to or not x.size:
        return x.astype("<i2")
    n = round(x.size * to / rate)
    return np.concatenate([*output_blocks(lambda a, z: x[a:z], x.size, rate, to, 0, n), np.empty(0, "<i2")])


def wav_part(data: bytes, channel: int | None, start_s: float | None, end_s: float | None, to: int) -> dict:
    """A stretch of a WAV file as mono samples at the rate ``to``: one channel, or the mean of all; from the first to the last sample within the bounds, if both are given.

    Frames are read as the outputs need them, so only the result is held whole.
    """
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, size = w.getframerate(), w.getnchannels(), w.getnframes()
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit WAV is read")
        if channel is not None and not 0 <= channel < channels:
            raise ValueError(f"channel {channel} of {channels}")

        def read(a: int, z: int) -> np.ndarray:
            w.setpos(a)
            frames = np.frombuffer(w.readframes(z - a), "<i2").reshape(-1, channels)
            return frames[:, channel] if channel is not None else np.rint(frames.mean(axis=1))

        total = round(size * to / rate)
        first, last = (0, total) if start_s is None or end_s is None else (round(start_s * to), min(round(end_s * to), total))
        if first >= total and start_s is not None and end_s is not None:
            raise ValueError(f"starts at {start_s} s, after the end")
        if to == rate:
            parts = (read(n, min(n + OUTPUTS, last)).astype("<i2") for n in range(first, last, OUTPUTS))
        else:
            parts = output_blocks(read, size, rate, to, first, last)
        return {"samples": b"".join(x.tobytes() for x in parts), "rate": to, "file_rate": rate}


@arrow("struct<samples:binary,rate:int,file_rate:int>")
def wav_clip(data: pd.Series, channel: pd.Series, start_s: pd.Series, end_s: pd.Series, rate: pd.Series) -> pd.DataFrame:
    """``wav_part`` of each row; null bytes give nulls, an absent channel or a start behind the end fails with its numbers."""
    known = lambda x: None if x is None or x != x else x
    rows = zip(data, channel, start_s, end_s, rate)
    out = [{} if b is None else wav_part(bytes(b), None if known(c) is None else int(c), known(s), known(e), int(to)) for b, c, s, e, to in rows]
    return pd.DataFrame(out, columns=["samples", "rate", "file_rate"])


def wav_bytes(samples: Column, rate: Column, channels: Column) -> Column:
    """A WAV file of interleaved 16-bit samples, made natively."""
    word = lambda n, size: F.reverse(F.regexp_extract_all(F.lpad(F.hex(n), 2 * size, "0"), F.lit(".."), F.lit(0)))
    number = lambda n, size: F.unhex(F.array_join(word(n.cast("bigint"), size), ""))
    text = lambda t: F.lit(t).cast("binary")
    size = F.octet_length(samples)
    return F.concat(
        text("RIFF"), number(size + 36, 4), text("WAVEfmt "), number(F.lit(16), 4), number(F.lit(1), 2), number(channels, 2), number(rate, 4),
        number(rate * channels * 2, 4), number(channels * 2, 2), number(F.lit(16), 2), text("data"), number(size, 4), samples,
    )


def sample_bytes(value: Column) -> Column:
    """A 16-bit sample of a whole number."""
    h = F.lpad(F.hex(value.cast("int").bitwiseAND(65535)), 4, "0")
    return F.unhex(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)))


def sample_values(samples: Column) -> Column:
    """The numbers of 16-bit samples."""
    value = lambda h: F.conv(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("int")
    signed = lambda v: v - F.when(v > 32767, 65536).otherwise(0)
    return F.transform(F.regexp_extract_all(F.hex(samples), F.lit("...."), F.lit(0)), lambda h: signed(value(h)))


def with_silence(samples: Column, rate: Column, ms: int) -> Column:
    """16-bit samples with ``ms`` milliseconds of silence behind them."""
    return F.concat(samples, F.unhex(F.repeat(F.lit("0000"), F.floor(rate * ms / 1000).cast("int"))))


def _pairwise(f, schema: str):
    names = [x.split(":")[0] for x in schema.removeprefix("struct<").removesuffix(">").split(",")]

    @arrow(schema)
    def run(a: pd.Series, b: pd.Series, x: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
        rows = [f(np.frombuffer(bytes(p), "<i2"), np.frombuffer(bytes(q), "<i2"), v, int(i), int(j)) if p is not None and q is not None else dict.fromkeys(names) for p, q, v, i, j in zip(a, b, x, start, end)]
        return pd.DataFrame(rows, columns=names)

    return run


#: (speech, noise, decibels, start, end) -> samples, the noise's gain, the mix's scale.
mixed = _pairwise(mix, MIXED)
#: (speech, response, ignored, start, end) -> samples, the strongest path's place, the scale.
reverberated = _pairwise(lambda s, h, _, i, j: reverberate(s, h, i, j), ROOM)
