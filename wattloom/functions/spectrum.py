"""The periodogram of a real series as an Arrow-batched column function."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_bell(n: int, proportion: float) -> np.ndarray:
    """Weights of a split cosine bell that tapers ``proportion`` of the series at each end."""
    weights = np.ones(n)
    m = int(np.floor(n * proportion))
    if m:
        rise = 0.5 * (1.0 - np.cos(np.pi * (2 * np.arange(1, m + 1) - 1) / (2 * m)))
        weights[:m] = rise
        weights[n - m :] = rise[::-1]
    return weights


def spectra(series: np.ndarray, taper: float) -> np.ndarray:
    """Row-wise raw periodogram at the frequencies 1/N, 2/N, ... floor(N/2)/N.

    No detrending, no padding, one-sided values are not doubled, the zero frequency
    is left out. Tapering is compensated by its mean power.
    """
    n = series.shape[1]
    transformed = np.fft.rfft(series * cosine_bell(n, taper), axis=1)[:, 1 : n // 2 + 1]
    power = transformed.real**2 + transformed.imag**2
    return power / (n * (1.0 - 5.0 / 8.0 * 2.0 * taper))


def pgram(series: Column, taper: float = 0.0) -> Column:
    """Periodogram of an ``array<double>``. Missing or non-finite values inside a series are an
    error; a series of fewer than two values has an empty spectrum.

    A batch of series of equal length is one FFT call; otherwise there is one per length.
    """
    if not 0.0 <= taper <= 0.5:
        raise ValueError("taper must lie between 0 and 0.5")

    @F.arrow_udf("array<double>")
    def transform(batch: pa.Array) -> pa.Array:
        present = batch.is_valid().to_numpy(zero_copy_only=False)
        held = batch.drop_null()
        flat = held.flatten()
        if flat.null_count:
            raise ValueError("a series has missing values")
        values = flat.to_numpy(zero_copy_only=False)
        if not np.isfinite(values).all():
            raise ValueError("a series has non-finite values")
        lengths = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        out_lengths = lengths // 2
        if lengths.size and lengths[0] > 1 and (lengths == lengths[0]).all():
            out = spectra(values.reshape(len(lengths), -1), taper).ravel()
        else:
            starts, ends = np.cumsum(lengths) - lengths, np.cumsum(out_lengths)
            out = np.empty(int(out_lengths.sum()))
            for n in np.unique(lengths[lengths > 1]):
                rows = np.flatnonzero(lengths == n)
                block = values[starts[rows][:, None] + np.arange(n)]
                to = (ends - out_lengths)[rows][:, None] + np.arange(n // 2)
                out[to] = spectra(block, taper)
        offsets = np.zeros(len(batch) + 1, dtype=np.int32)
        per_row = np.zeros(len(batch), dtype=np.int64)
        per_row[present] = out_lengths
        offsets[1:] = np.cumsum(per_row)
        return pa.ListArray.from_arrays(
            pa.array(offsets), pa.array(out), mask=pa.array(~present)
        )

    return transform(series)
