"""Number formats of packed tensors, and shell quoting: what native expressions cannot say.

Arrow batches over rows of one tensor slice each; nothing is gathered.
"""

from __future__ import annotations

import shlex
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Magnitudes of the 4-bit float's three low bits; the fourth is the sign.
E2M1 = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0)
SCALE_BLOCK, SCALE_BIAS, SCALE_NAN = 32, 127, 255


def mxfp4(weight: bytes, scale: bytes) -> np.ndarray:
    """Values of packed 4-bit floats, low nibble first, with one power-of-two scale a block of 32.
    A scale byte that stands for NaN, or sizes that do not fit, are errors."""
    w, s = np.frombuffer(weight, np.uint8), np.frombuffer(scale, np.uint8)
    if 2 * len(w) != SCALE_BLOCK * len(s):
        raise ValueError(f"{len(w)} weight bytes do not fit {len(s)} scales")
    if (s == SCALE_NAN).any():
        raise ValueError("a scale is NaN")
    nibble = np.stack([w & 15, w >> 4], axis=1).reshape(-1)
    value = np.asarray(E2M1 + tuple(-x for x in E2M1), np.float32)[nibble]
    return np.ldexp(value.reshape(-1, SCALE_BLOCK), s[:, None].astype(np.int32) - SCALE_BIAS).reshape(-1).astype(np.float32)


def bf16(payload: bytes) -> np.ndarray:
    return (np.frombuffer(payload, "<u2").astype("<u4") << 16).view("<f4")


def affine(values: np.ndarray, bits: int, group: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(packed codes, exponents, zeros) of consecutive groups: the step is the least power of two
    that covers the group's range, larger where the zero would leave int8."""
    v = np.asarray(values, np.float64)
    if not len(v) or len(v) % group or len(v) * bits % 8:
        raise ValueError("values do not fill groups and bytes")
    v = v.reshape(-1, group)
    low, top = v.min(1), (1 << bits) - 1
    reach = v.max(1) - low
    reach = np.where(reach > 0, reach, np.maximum(2 * np.abs(low), 1e-300)) / top
    part, e = np.frexp(reach)
    e = np.clip(e.astype(np.int64) - (part == 0.5), -128, 127)
    while (wide := np.abs(np.rint(-low / np.exp2(e))) > 127).any():
        e = e + wide
    zero = np.rint(-low / np.exp2(e)).astype(np.int64)
    code = np.clip(np.rint(v / np.exp2(e)[:, None]) + zero[:, None], 0, top).astype(np.uint8).reshape(-1, 1)
    return np.packbits(np.unpackbits(code, axis=1, count=bits, bitorder="little"), bitorder="little").tobytes(), e.astype(np.int8), zero.astype(np.int8)


def unaffine(codes: bytes, e: np.ndarray, zero: np.ndarray, bits: int, group: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(codes, np.uint8), bitorder="little")[: len(e) * group * bits].reshape(-1, bits)
    code = np.packbits(flat, axis=1, bitorder="little")[:, 0].astype(np.float64).reshape(len(e), group)
    return ((code - zero.astype(np.float64)[:, None]) * np.exp2(e.astype(np.float64))[:, None]).reshape(-1)


def requantize(tensors: DataFrame, bits: int, group: int = 32) -> DataFrame:
    """(name, codes, exponents, zeros, n, max_error, mean_error) from (name, weight, scale) slices."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, w, s in zip(pdf["name"], pdf["weight"], pdf["scale"]):
                v = mxfp4(w, s)
                c, e, z = affine(v, bits, group)
                err = np.abs(unaffine(c, e, z, bits, group) - v)
                out.append((name, c, e.tobytes(), z.tobytes(), len(v), float(err.max()), float(err.mean())))
            yield pd.DataFrame(out, columns=["name", "codes", "exponents", "zeros", "n", "max_error", "mean_error"])

    return tensors.select("name", "weight", "scale").mapInPandas(f, "name string, codes binary, exponents binary, zeros binary, n long, max_error double, mean_error double")


def merged_errors(parts: DataFrame) -> DataFrame:
    """Errors of whole tensors from their slices: the largest, and the mean by number of values."""
    return parts.groupBy("name").agg(F.sum("n").alias("n"), F.max("max_error").alias("max_error"), (F.sum(F.col("mean_error") * F.col("n")) / F.sum("n")).alias("mean_error"))


@F.pandas_udf(T.BooleanType())
def quotes_close(command: pd.Series) -> pd.Series:
    """Whether a shell would accept a command's quoting; null stays null."""

    def one(c: str | None) -> bool | None:
        try:
            return None if c is None else shlex.split(c) is not None
        except ValueError:
            return False

    return command.map(one)
