"""Sound files as chunk tables.

Files are listed by Spark (binaryFile), so any store that Spark reads will do; a manifest is a
table joined by path. Each file is decoded in its own task, chunk by chunk. The first channel is
kept; 8-bit samples are unsigned with 128 as zero, wider ones are signed little-endian. A file
that isn't PCM, or has another rate than asked for, is an error.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "source string, identifier string, number long, continuity int, start_time double, fs double, data array<double>"


def parse(content: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples of the first channel) of a PCM file."""
    f = io.BytesIO(content)
    if f.read(4) != b"RIFF" or f.read(8)[4:] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    kind = rate = channels = bits = None
    while len(head := f.read(8)) == 8:
        name, size = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", f.read(size)[:16])
        elif name == b"data":
            if kind not in (1, 0xFFFE) or bits not in (8, 16, 24, 32):
                raise ValueError(f"only PCM of 8 to 32 bits is read, not format {kind} with {bits}")
            raw = np.frombuffer(f.read(size), np.uint8)
            width = bits // 8
            raw = raw[: len(raw) // (width * channels) * width * channels].reshape(-1, channels, width)[:, 0]
            if width == 1:
                return rate, raw[:, 0].astype(np.int64) - 128
            wide = np.zeros((len(raw), 4), np.uint8)
            wide[:, 4 - width :] = raw
            return rate, (wide.view("<i4")[:, 0] >> (32 - bits)).astype(np.int64)
        else:
            f.seek(size + size % 2, 1)
    raise ValueError("no data in the file")


def encode(samples: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """A file with one channel."""
    width = bits // 8
    x = (samples + 128).astype(np.uint8)[:, None] if bits == 8 else samples.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width]
    data = np.ascontiguousarray(x).tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * width, width, bits) + b"data" + struct.pack("<I", len(data)) + data


def chunks_of(files: DataFrame, size: int, rate: float | None = None, first_flag: int = 1) -> DataFrame:
    """Chunks of at most `size` samples. files: path, content and optionally source."""
    named = files if "source" in files.columns else files.withColumn("source", F.element_at(F.split("path", "/"), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, path, content in zip(*(c.to_pylist() for c in b.columns)):
                fs, x = parse(content)
                if rate is not None and fs != rate:
                    raise ValueError(f"{path} has the rate {fs}, not {rate}")
                for k in range(0, -(-len(x) // size)):
                    part = x[k * size : (k + 1) * size].astype(float)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([source]), pa.array([path]), pa.array([k], pa.int64()), pa.array([10 if k else first_flag], pa.int32()), pa.array([k * size / fs]), pa.array([float(fs)]), pa.array([part], pa.list_(pa.float64()))],
                        names=["source", "identifier", "number", "continuity", "start_time", "fs", "data"],
                    )

    return named.select("source", "path", "content").mapInArrow(run, CHUNKS)


def read(spark: SparkSession, path: str, size: int, rate: float | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """Chunks of all files under a path; with a manifest (path, source) of those it names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path).select("path", "content")
    if manifest is not None:
        files = files.join(manifest.select("path", "source"), "path")
    return chunks_of(files, size, rate)
