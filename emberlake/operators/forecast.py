"""Rolling block forecasts with exogenous inputs; a task holds a block of a series and the history before it.

Every ``horizon`` rows the model is fitted again on the last ``history`` rows, of which at least ``least`` must be
complete; the next block is forecast with the last exogenous values held. The estimator is least squares on the series
after plain and seasonal differences, with its own lags, its past errors and the exogenous values. Errors are those of a
long autoregression that is fitted first, so moving-average terms need no iteration.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from emberlake.operators.series import time_blocks


@dataclass(frozen=True)
class Terms:
    """Own lags and lags of errors of the differenced series; ``difference`` plain and ``seasonal`` differences at ``season`` rows.

    ``ridge`` keeps constant inputs harmless.
    """

    lags: tuple[int, ...] = (1, 2, 24)
    errors: tuple[int, ...] = ()
    difference: int = 1
    seasonal: int = 0
    season: int = 24
    ridge: float = 1e-6


def terms(order: tuple[int, int, int], seasonal_order: tuple[int, int, int, int] = (0, 0, 0, 0), ridge: float = 1e-6) -> Terms:
    """The terms of orders (p, d, q) and (P, D, Q, season): lags of the product of both polynomials."""
    (p, d, q), (P, D, Q, season) = order, seasonal_order
    product = lambda a, b: tuple(sorted({i + season * j for i in range(a + 1) for j in range(b + 1)} - {0}))
    return Terms(product(p, P), product(q, Q), d, D, season or 1, ridge)


def _solve(design, target, ridge: float):
    import numpy as np

    return np.linalg.solve(design.T @ design + ridge * np.eye(design.shape[1]), design.T @ target)


def _lagged(series, rows, lags):
    return [series[rows - k] for k in lags]


def _errors(w, terms: Terms):
    """Residuals of a long autoregression, 0 where it does not reach; None if the history is too short for it."""
    import numpy as np

    long = min(max(20, max(terms.errors) + max(terms.lags, default=0)), len(w) // 4)
    if long < 1 or len(w) <= 2 * long + 2:
        return None
    rows = np.arange(long, len(w))
    design = np.column_stack([np.ones(len(rows)), *_lagged(w, rows, range(1, long + 1))])
    out = np.zeros(len(w))
    out[rows] = w[rows] - design @ _solve(design, w[rows], max(terms.ridge, 1e-9))
    return out


def _fit_predict(y, x, ahead: int, terms: Terms):
    import numpy as np

    levels = [y]  # the series before each difference, to add them up again
    steps = [1] * terms.difference + [terms.season] * terms.seasonal
    for step in steps:
        if len(levels[-1]) <= step:
            return None
        levels.append(levels[-1][step:] - levels[-1][:-step])
    w, lost = levels[-1], len(y) - len(levels[-1])
    most = max((*terms.lags, *terms.errors), default=0)
    if len(w) <= most + len(terms.lags) + len(terms.errors) + x.shape[1] + 2:
        return None
    errors = _errors(w, terms) if terms.errors else np.zeros(len(w))
    if errors is None:
        return None
    rows = np.arange(most, len(w))
    design = np.column_stack([np.ones(len(rows)), *_lagged(w, rows, terms.lags), *_lagged(errors, rows, terms.errors), x[rows + lost]])
    weights = _solve(design, w[rows], terms.ridge)
    past, shocks = w.tolist(), errors.tolist()
    for _ in range(ahead):
        past.append(float(np.concatenate([[1.0], [past[-k] for k in terms.lags], [shocks[-k] for k in terms.errors], x[-1]]) @ weights))
        shocks.append(0.0)
    out = past[len(w) :]
    for step, level in zip(reversed(steps), reversed(levels[:-1])):
        known = level.tolist()
        for v in out:
            known.append(v + known[-step])
        out = known[len(level) :]
    return out


def rolling_forecast(df: DataFrame, by: list[str], ts: str, target: str, inputs: list[str], *, horizon: int = 24, history: int = 168, least: int = 48, lags: tuple[int, ...] = (1, 2, 24), block_rows: int = 4096, model: Terms | None = None) -> DataFrame:
    """Add ``predicted``, ``residual`` and ``status`` (ok, failed, skipped) of each row's block.

    ``model`` (``terms`` of its orders) replaces ``lags`` on the first difference.
    """
    import numpy as np
    from pyspark.sql import types as T

    model = model or Terms(tuple(lags))
    schema = T.StructType([*df.schema.fields, T.StructField("predicted", T.DoubleType()), T.StructField("residual", T.DoubleType()), T.StructField("status", T.StringType())])
    size = horizon * -(-max(block_rows, history) // horizon)  # whole horizons, so that blocks are forecast at the same rows as the series
    blocks, place, block = time_blocks(df, by, ts, history, size)

    def run(key, rows):
        rows = rows.sort_values(place).reset_index(drop=True)
        begin = key[-1] * size - int(rows[place].iloc[0])  # rows before it are the past
        y, x = rows[target].to_numpy(float, na_value=np.nan), rows[inputs].to_numpy(float, na_value=np.nan)
        predicted, status = np.full(len(y), np.nan), ["skipped"] * len(y)
        for at in range(begin if key[-1] else horizon, len(y), horizon):
            past = slice(max(0, at - history), at)
            whole = np.isfinite(y[past]) & np.isfinite(x[past]).all(1)
            ahead = range(at, min(at + horizon, len(y)))
            if whole.sum() < least:
                continue
            try:
                out = _fit_predict(y[past][whole], x[past][whole], len(ahead), model)
            except np.linalg.LinAlgError:
                out = None
            for i, b in enumerate(ahead):
                status[b] = "failed" if out is None else "ok"
                predicted[b] = np.nan if out is None else out[i]
        res = y - predicted
        rows["predicted"] = [None if v != v else float(v) for v in predicted]
        rows["residual"] = [None if v != v else float(v) for v in res]
        rows["status"] = status
        return rows[begin:].drop(columns=[place, block])

    return blocks.groupBy(*by, block).applyInPandas(run, schema)
