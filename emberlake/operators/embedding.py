"""Convolutional window embeddings: fixed kernels of weights -1 and 2, dilations, quantile biases, PPV features.

Fitted on a bounded sample of windows (``FIT_WINDOWS``, by key hash); the parameters are broadcast and series are
transformed in blocks, for the ``length`` rows before each row. Each kernel reads its own subset of the channels.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.operators.series import fresh, time_blocks

FIT_WINDOWS = 2000
KERNELS = tuple(combinations(range(9), 3))  # 84 placements of the three positive weights


def _convolve(x, dilation: int, subsets):
    """(84, n, t) responses, each summed over its kernel's channels; ``x`` is (n, channels, t), ``subsets`` (84, channels)."""
    import numpy as np

    t = x.shape[2]
    pad = 4 * dilation
    padded = np.pad(x, ((0, 0), (0, 0), (pad, pad)))
    taps = np.stack([padded[:, :, k * dilation : k * dilation + t] for k in range(9)])
    base = -taps.sum(0)
    return np.stack([(base[:, s] + 3 * (taps[a][:, s] + taps[b][:, s] + taps[c][:, s])).sum(1) for (a, b, c), s in zip(KERNELS, subsets)])


def _subsets(rng, channels: int):
    """A random set of channels for each kernel, small sets as likely as large ones."""
    import numpy as np

    sizes = (2 ** rng.uniform(0, np.log2(channels + 1), 84)).astype(int)
    return np.stack([np.isin(np.arange(channels), rng.choice(channels, n, replace=False)) for n in sizes])


def fit(windows, features: int = 168, seed: int = 42) -> dict:
    """Channel subsets, and biases from quantiles of responses of sampled windows (n, channels, t)."""
    import numpy as np

    channels, t = windows.shape[1:]
    dilations = [d for d in (1, 2, 4, 8) if 8 * d < 2 * t] or [1]
    per = max(1, features // (84 * len(dilations)))
    golden = ((np.arange(1, per * 84 + 1) * 0.6180339887498949) % 1).reshape(84, per)
    rng = np.random.default_rng(seed)
    subsets = [_subsets(rng, channels) for _ in dilations]
    biases = []
    for d, s in zip(dilations, subsets):
        response = _convolve(windows, d, s)
        biases.append(np.stack([np.quantile(response[k], golden[k]) for k in range(84)]))
    return {"dilations": dilations, "subsets": subsets, "biases": biases}


def transform(windows, model: dict):
    """(n, features) shares of positive responses."""
    import numpy as np

    out = []
    for d, s, b in zip(model["dilations"], model["subsets"], model["biases"]):
        r = _convolve(windows, d, s)
        out.append(np.concatenate([(r > b[:, j, None, None]).mean(2) for j in range(b.shape[1])]).T)
    return np.concatenate(out, 1)


def _windows(values, length: int):
    """Windows of the rows before each row, and which are whole."""
    import numpy as np

    n = len(values)
    if n <= length:
        return np.zeros((0, values.shape[1], length)), np.zeros(n, bool)
    view = np.lib.stride_tricks.sliding_window_view(values, length, axis=0)[: n - length]
    whole = np.isfinite(view).all((1, 2))
    return view[whole], np.concatenate([np.zeros(length, bool), whole])


def embed(df: DataFrame, by: list[str], ts: str, channels: list[str], length: int = 24, features: int = 168, block_rows: int = 4096, fitted_on: Column | None = None) -> DataFrame:
    """``by, ts, embedding array<double>``; null where the window is not whole. At least two channels.

    ``fitted_on`` tells the rows whose windows may shape the parameters, such as those of training years; all by default.
    """
    import numpy as np
    import pandas as pd

    if len(channels) < 2:
        raise ValueError("at least two channels are needed")
    usable = fresh(df, "_usable")
    cols = df.select(*by, ts, *[F.col(c).cast("double").alias(c) for c in channels], F.coalesce(fitted_on if fitted_on is not None else F.lit(True), F.lit(False)).alias(usable))
    pick, size = fresh(cols, "_pick"), max(block_rows, length)
    share = min(1.0, 4 * FIT_WINDOWS / max(1, cols.where(usable).count()))  # some windows are not whole
    picked = cols.withColumn(pick, F.xxhash64(*by, ts))
    blocks, place, block = time_blocks(picked, by, ts, length, size)
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in by], f"`{ts}` {kinds[ts]}", "embedding array<double>"])

    def own_windows(key, rows):
        """The block's own rows, the windows before them, and which of those are whole."""
        rows = rows.sort_values(place).reset_index(drop=True)
        view, ok = _windows(rows[channels].to_numpy(float, na_value=np.nan), length)
        own = (rows[place] >= key[-1] * size).to_numpy()
        return rows[own], view, ok[own]  # no row before the block has a whole window here

    def sampled(key, rows):
        rows, view, ok = own_windows(key, rows)
        at = rows[pick].to_numpy()[ok]
        taken = ((at % (1 << 20)) < share * (1 << 20)) & rows[usable].to_numpy(bool)[ok]
        return pd.DataFrame({"h": at[taken], "w": pd.Series([v.ravel() for v in view[taken]], dtype=object)})

    groups = blocks.groupBy(*by, block)
    sample = groups.applyInPandas(sampled, "h long, w array<double>").orderBy("h").limit(FIT_WINDOWS).collect()
    if not sample:
        return df.select(*by, ts, F.lit(None).cast("array<double>").alias("embedding"))
    fitted = fit(np.array([r.w for r in sample]).reshape(len(sample), len(channels), length), features)
    model = df.sparkSession.sparkContext.broadcast(fitted)

    def run(key, rows):
        rows, view, ok = own_windows(key, rows)
        found = iter(np.concatenate([transform(view[i : i + 512], model.value) for i in range(0, len(view), 512)]).tolist() if len(view) else [])
        rows = rows[[*by, ts]].copy()
        rows["embedding"] = pd.Series([next(found) if o else None for o in ok], index=rows.index, dtype=object)
        return rows

    return groups.applyInPandas(run, schema)
