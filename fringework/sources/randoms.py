"""Reproducible generators whose streams can be entered anywhere, so tasks can share one stream."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the 48-bit congruence.
A48, C48, M48 = 25214903917, 11, 1 << 48
#: Fixed values of the combined recursion.
M1, M2, A12, A13, A21, A23 = 4294967087, 4294944443, 1403580, 810728, 527612, 1370589
#: Stretches of the stream that are stepped through side by side.
LANES = 512


def rand48_at(n: int, seed: int = 137) -> int:
    """The state after n steps, by repeated squaring of the step."""
    a, c, x, y = A48, C48, 1, 0
    while n:
        if n & 1:
            x, y = a * x % M48, (a * y + c) % M48
        a, c, n = a * a % M48, (a + 1) * c % M48, n >> 1
    return (x * ((seed << 16) + 0x330E) + y) % M48


def _split(spark: SparkSession, n: int, size: int, make) -> DataFrame:
    """(index, value) of n draws, each partition beginning where it must."""

    def run(batches):
        for batch in batches:
            for block in batch.column(0).to_pylist():
                first = block * size
                values = make(first, min(size, n - first))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(values))), pa.array(values)], ["index", "value"])

    return spark.range(-(-n // size)).mapInArrow(run, "index bigint, value double")


def rand48(spark: SparkSession, n: int, seed: int = 137, size: int = 65536) -> DataFrame:
    """(index, value in [0, 1))."""

    def make(first: int, count: int) -> np.ndarray:
        x = np.empty(count, np.uint64)
        x[0], (a, c), have = rand48_at(first + 1, seed), (A48, C48), 1
        while have < count:  # what is there, as many steps on; products wrap at 2^64, which M48 divides
            m = min(have, count - have)
            x[have : have + m] = (x[:m] * np.uint64(a) + np.uint64(c)) & np.uint64(M48 - 1)
            a, c, have = a * a % M48, (a + 1) * c % M48, have + m
        return x / M48

    return _split(spark, n, size, make)


def _power(m, n: int, modulus: int):
    out = [[int(i == j) for j in range(3)] for i in range(3)]
    mul = lambda a, b: [[sum(a[i][k] * b[k][j] for k in range(3)) % modulus for j in range(3)] for i in range(3)]
    while n:
        if n & 1:
            out = mul(out, m)
        m, n = mul(m, m), n >> 1
    return out


_STEP1, _STEP2 = [[0, 1, 0], [0, 0, 1], [M1 - A13, A12, 0]], [[0, 1, 0], [0, 0, 1], [M2 - A23, 0, A21]]


def _lanes(step, modulus: int, first: int, seed: int, lanes: int, each: int) -> np.ndarray:
    """(3, lanes) states: lane k is at draw first + k * each."""
    times = lambda m, s: [sum(x * y for x, y in zip(r, s)) % modulus for r in m]
    state, jump, out = times(_power(step, first, modulus), [seed] * 3), _power(step, each, modulus), []
    for _ in range(lanes):
        out.append(state)
        state = times(jump, state)
    return np.array(out, np.int64).T.copy()


def combined(first: int, count: int, seed: int = 12345) -> np.ndarray:
    """``count`` draws in (0, 1) of the combined multiple recursion of order three, from number ``first`` on; LANES at a time."""
    lanes = max(1, min(LANES, count))
    each = -(-count // lanes)
    s1, s2 = _lanes(_STEP1, M1, first, seed, lanes, each), _lanes(_STEP2, M2, first, seed, lanes, each)
    out = np.empty((lanes, each))
    for k in range(each):
        p1, p2 = (A12 * s1[1] - A13 * s1[0]) % M1, (A21 * s2[2] - A23 * s2[0]) % M2
        s1, s2 = np.stack((s1[1], s1[2], p1)), np.stack((s2[1], s2[2], p2))
        d = (p1 - p2) % M1
        out[:, k] = np.where(d == 0, M1, d) / (M1 + 1)
    return out.ravel()[:count]


def uniform(spark: SparkSession, n: int, seed: int = 12345, size: int = 65536) -> DataFrame:
    """(index, value in (0, 1)) of the combined recursion."""
    return _split(spark, n, size, lambda first, count: combined(first, count, seed))
