"""Second-order delta coding of unsigned 64-bit series, and its byte form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import Codec, Policy

TWO64 = 18446744073709551616


def wrapped(x: Column) -> Column:
    """x modulo 2^64, as DECIMAL(38,0)."""
    return F.pmod(x.cast("decimal(38,0)"), F.lit(str(TWO64)).cast("decimal(38,0)"))


def choose(value: Column, policy: Policy, balanced_codes: bool = False) -> Column:
    """The codec of a value, by its length alone; balanced_codes: the vector build."""
    n = F.octet_length(value)
    series = (n >= 32) & (n % 8 == 0)
    want = {Policy.FASTEST: Codec.NONE, Policy.BALANCED: Codec.DELTA_DELTA if balanced_codes else Codec.NONE, Policy.EXTREME_SPACE: Codec.BIT_PACKED}[policy]
    return F.when(series, int(want)).otherwise(int(Codec.NONE))


def delta_delta(rows: DataFrame, v: str, pos: str, *series: str) -> DataFrame:
    """dd: the value itself for the first two, then v - 2 v' + v''."""
    w = Window.partitionBy(*series).orderBy(pos) if series else Window.orderBy(pos)
    n = F.row_number().over(w)
    one, two = F.lag(v, 1).over(w), F.lag(v, 2).over(w)
    return rows.withColumn("dd", F.when(n <= 2, F.col(v)).otherwise(F.col(v) - 2 * one + two))


def undo_delta_delta(rows: DataFrame, pos: str, *series: str) -> DataFrame:
    """v from dd by two running sums: first the steps, then the values."""
    w = Window.partitionBy(*series).orderBy(pos)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(w)
    # The second value is v0 + first step, so the step enters the inner sum in its place.
    out = rows.withColumn("n_", n).withColumn("v0_", F.first("dd").over(upto)).withColumn("e_", F.when(F.col("n_") == 1, 0).when(F.col("n_") == 2, F.col("dd") - F.col("v0_")).otherwise(F.col("dd")))
    out = out.withColumn("step_", F.sum("e_").over(upto))
    return out.withColumn("v", F.col("v0_") + F.sum("step_").over(upto)).drop("n_", "v0_", "e_", "step_")


def bit_width(largest: Column) -> Column:
    return F.when(largest <= 0xFF, 8).when(largest <= 0xFFFF, 16).when(largest <= 0xFFFFFFFF, 32).otherwise(64)


@F.pandas_udf(T.BinaryType())
def bit_pack(values: pd.Series) -> pd.Series:
    """Little-endian u64 series -> width byte, two first values, packed second differences."""
    return values.map(pack_bytes)


@F.pandas_udf(T.BinaryType())
def bit_unpack(values: pd.Series) -> pd.Series:
    return values.map(unpack_bytes)


def pack_bytes(data: bytes | None) -> bytes | None:
    if data is None or len(data) < 32 or len(data) % 8:
        return data
    v = np.frombuffer(data, "<u8")
    dd = v[2:] - np.uint64(2) * v[1:-1] + v[:-2]
    top = int(dd.max())
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([8 * width]) + v[:2].tobytes() + dd.astype(f"<u{width}").tobytes()


def unpack_bytes(data: bytes | None) -> bytes | None:
    if data is None or len(data) < 17:
        return data
    width = data[0] // 8
    first = np.frombuffer(data[1:17], "<u8")
    dd = np.frombuffer(data[17:], f"<u{width}").astype("<u8")
    step = np.cumsum(np.concatenate(([first[1] - first[0]], dd)), dtype="<u8")
    return np.cumsum(np.concatenate(([first[0]], step)), dtype="<u8").tobytes()
