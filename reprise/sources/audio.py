"""Spectral fingerprints of sound: numpy inside ``mapInArrow``."""

from __future__ import annotations

import json
import shutil
import struct
import subprocess
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Working rate, frame and step, frames of an anchor, band of the tones in whole Hz, anchors, and bounds of a usable fingerprint.
RATE, FRAME, STEP, FRAMES = 11025, 256, 64, 25
LOW, HIGH, TONES = 300.0, 2000.0, 33
ANCHORS = (0.15, 0.30, 0.50, 0.65, 0.80)
SILENCE, LEAST_FRAMES, LEAST_WORDS, LEAST_FILLED = 0.002, 10, 20, 0.1
FREQUENCIES = np.floor(LOW * (HIGH / LOW) ** (np.arange(TONES) / (TONES - 1)) + 0.5)


def mono(channels: list[np.ndarray]) -> np.ndarray:
    """The mean of all channels."""
    return np.mean(np.stack([np.asarray(c, np.float64) for c in channels]), axis=0) if channels else np.zeros(0)


def resample(sound: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Linear interpolation to another rate."""
    if rate == to or not len(sound):
        return np.asarray(sound, np.float64)
    at = np.arange(int(len(sound) * to / rate)) * (rate / to)
    return np.interp(at, np.arange(len(sound)), sound)


def powers(frames: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Power of each frame at each tone, as the Goertzel filter gives it: one matrix product for all."""
    cosines, sines = _waves(frames.shape[1], rate)
    return (frames @ cosines) ** 2 + (frames @ sines) ** 2


@cache
def _waves(n: int, rate: int) -> tuple[np.ndarray, np.ndarray]:
    phase = 2 * np.pi * np.outer(np.arange(n), FREQUENCIES / rate)
    return np.cos(phase), np.sin(phase)


def loud(sound: np.ndarray) -> np.ndarray:
    """Whether the root mean square of the frame at each place is above silence."""
    energy = np.concatenate(([0.0], np.cumsum(np.square(sound, dtype=np.float64))))
    return np.sqrt(np.maximum(energy[FRAME:] - energy[:-FRAME], 0.0) / FRAME) > SILENCE


def fingerprint(sound: np.ndarray, rate: int) -> list[int] | None:
    """A bit of a word is set where the fall from a tone to the next one is larger in a frame than in the frame after it.

    From each anchor on, or before it where nothing follows, the first frame that is not silent is sought; from there
    the frames that are not silent are taken. None where the sound is too short, silent, or says too little.
    """
    sound = resample(sound, rate)
    if len(sound) < FRAME * LEAST_FRAMES:
        return None
    usable, words = loud(sound), []
    for anchor in ANCHORS:
        home = int(anchor * len(sound))
        places = np.arange(home, len(usable), STEP)
        places = places[usable[places]]
        if not len(places):
            before = np.arange(home, -1, -STEP)
            before = before[before < len(usable)]
            before = before[usable[before]]
            if not len(before):
                continue
            places = np.arange(before[0], len(usable), STEP)
            places = places[usable[places]]
        frames = sound[places[:FRAMES, None] + np.arange(FRAME)]
        falls = -np.diff(powers(frames), axis=1)
        bits = falls[:-1] > falls[1:]
        words += (bits.astype(np.uint64) << np.arange(TONES - 1, dtype=np.uint64)).sum(1).tolist()
    if len(words) < LEAST_WORDS or sum(w != 0 for w in words) < LEAST_FILLED * len(words):
        return None
    return words


def _samples(raw: bytes, bits: int, real: bool, order: str) -> np.ndarray | None:
    """Samples from -1 to 1 of uncompressed sound; ``order`` is '<' or '>'."""
    if real and bits in (32, 64):
        return np.frombuffer(raw, f"{order}f{bits // 8}").astype(np.float64)
    if bits == 8:
        return np.frombuffer(raw, np.int8).astype(np.float64) / 128 if order == ">" else np.frombuffer(raw, np.uint8).astype(np.float64) / 128 - 1
    if bits in (16, 32):
        return np.frombuffer(raw, f"{order}i{bits // 8}").astype(np.float64) / (1 << (bits - 1))
    if bits == 24:
        low, mid, high = np.frombuffer(raw, np.uint8).reshape(-1, 3).T[:: 1 if order == "<" else -1].astype(np.int32)
        return ((low << 8 | mid << 16 | high << 24) >> 8).astype(np.float64) / (1 << 23)
    return None


def _chunks(data: bytes, order: str) -> Iterator[tuple[bytes, bytes]]:
    at = 12
    while at + 8 <= len(data):
        n = struct.unpack_from(f"{order}I", data, at + 4)[0]
        yield data[at : at + 4], data[at + 8 : at + 8 + n]
        at += 8 + n + n % 2


def _split(raw: bytes, channels: int, bits: int, real: bool, order: str) -> np.ndarray | None:
    size = channels * bits // 8
    samples = _samples(raw[: len(raw) - len(raw) % size], bits, real, order) if size else None
    return None if samples is None else mono([samples[c::channels] for c in range(channels)])


def decode(data: bytes) -> tuple[np.ndarray, int] | None:
    """Mono sound and rate of an uncompressed WAV (8, 16, 24 or 32 bit, or real numbers) or AIFF file, None for others."""
    found = None
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        for name, body in _chunks(data, "<"):
            if name == b"fmt " and len(body) >= 16:
                kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
                kind = struct.unpack_from("<H", body, 24)[0] if kind == 0xFFFE and len(body) >= 26 else kind
                found = (channels, bits, kind == 3, rate) if kind in (1, 3) else None
            if name == b"data" and found:
                sound = _split(body, *found[:3], "<")
                return None if sound is None else (sound, found[3])
    if data[:4] == b"FORM" and data[8:12] == b"AIFF":
        for name, body in _chunks(data, ">"):
            if name == b"COMM" and len(body) >= 18:
                channels, _, bits, exponent, mantissa = struct.unpack_from(">hIhHQ", body)
                found = (channels, bits, False, int(mantissa * 2.0 ** ((exponent & 0x7FFF) - 16446)))
            if name == b"SSND" and found:
                sound = _split(body[8 + struct.unpack_from(">I", body)[0] :], *found[:3], ">")
                return None if sound is None else (sound, found[3])
    return None


def decoded(path: str, program: str = "ffmpeg", timeout: int = 300) -> tuple[np.ndarray, int] | None:
    """The sound of a file: uncompressed ones are read here, others by an external program where one is installed."""
    with open(path, "rb") as f:
        data = f.read()
    found = decode(data)
    if found is None and (there := shutil.which(program)):
        try:
            said = subprocess.run([there, "-v", "quiet", "-i", path, "-f", "wav", "-"], capture_output=True, timeout=timeout, check=True).stdout
            # A stream does not know its length: the last chunk takes what is there.
            found = decode(said)
        except (OSError, ValueError, subprocess.SubprocessError):
            pass
    return found


def fingerprints(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows (id, fingerprint, fingerprint_method, fingerprint_duration) of files (id, path, title, duration).

    Sound is decoded where it can be; otherwise a title and a duration give a fingerprint 'metadata'; else nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, methods, seconds = [], [], [], []
            for row in batch.to_pylist():
                own, length = None, row["duration"]
                try:
                    sound = decoded(row["path"])
                    if sound:
                        own, length = fingerprint(*sound), len(sound[0]) / sound[1]
                except (OSError, ValueError):
                    pass
                ids.append(row["id"])
                words.append(own)
                methods.append("spectral" if own else "metadata" if row["title"] and length else None)
                seconds.append(length)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(methods, pa.string()), pa.array(seconds, pa.float64())], ["id", "fingerprint", "fingerprint_method", "fingerprint_duration"])

    rows = files.select("id", "path", "title", "duration")
    return (rows.repartition(partitions, "id") if partitions else rows).mapInArrow(run, "id bigint, fingerprint array<bigint>, fingerprint_method string, fingerprint_duration double")


def second_fingerprints(files: DataFrame, program: str = "fpcalc", timeout: int = 60) -> DataFrame:
    """Rows (id, chromaprint, chromaprint_raw, duration, error) by an external program, where it is installed.

    The text is for lookups, the words for comparisons; where only the words fail, the text stays. What went wrong is
    a value, not a failure.
    """

    def call(path: str, *more: str) -> dict:
        return json.loads(subprocess.run([program, *more, "-json", path], capture_output=True, text=True, timeout=timeout, check=True).stdout)

    def one(path: str) -> tuple:
        if not shutil.which(program):
            return None, None, None, "program not found"
        try:
            said = call(path)
        except (OSError, ValueError, subprocess.SubprocessError) as e:
            return None, None, None, type(e).__name__
        words = None
        try:
            raw = call(path, "-raw").get("fingerprint")
            words = [int(x) & 0xFFFFFFFF for x in raw] if isinstance(raw, list) else None
        except (OSError, TypeError, ValueError, subprocess.SubprocessError):
            pass
        text = said.get("fingerprint") or None
        return text, words if text else None, float(said.get("duration") or 0) if text else None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*map(one, batch.column("path").to_pylist()))) or [[]] * 4
            kinds = (pa.string(), pa.list_(pa.int64()), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", "chromaprint", "chromaprint_raw", "duration", "error"])

    return files.select("id", "path").mapInArrow(run, "id bigint, chromaprint string, chromaprint_raw array<bigint>, duration double, error string")


def sine_files(ids: DataFrame, seconds: float = 3.0) -> DataFrame:
    """Fingerprints of generated tones, one per row (id): a fixture without any audio file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = np.arange(int(RATE * seconds)) / RATE
            words = [fingerprint(0.4 * np.sin(2 * np.pi * (300 + i % 400) * t) + 0.2 * np.sin(2 * np.pi * (700 + 3 * (i % 300)) * t * (1 + 0.02 * t)), RATE) for i in batch.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words, pa.list_(pa.int64()))], ["id", "fingerprint"])

    return ids.select("id").mapInArrow(run, "id bigint, fingerprint array<bigint>")
