"""K1 model plug-ins and K2 fail-open wrapping.

A plug-in is a *factory*: a picklable zero-argument callable that builds the
model.  It runs once per Python worker (cached by name), and the model then
sees Arrow batches through an iterator pandas UDF.  Every plug-in column is
``struct(value, error)`` (K2): a failing item carries its error, the job and
the other items go on:

* ``Embedder``    ``model(list[str]) -> 2-D array`` (one vector per text)
* ``PairScorer``  ``model(list[tuple[str, str]]) -> 1-D array`` (query, doc)
* ``TokenScorer`` ``model(list[str]) -> list[list[float]]`` (one score per whitespace token)

The lexical defaults need none of this; plug-ins replace a step's column.
``fail_open`` does the same for any per-text function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MODELS: dict[str, object] = {}


def _model(name: str, factory: Callable[[], object]):
    if name not in _MODELS:
        _MODELS[name] = factory()
    return _MODELS[name]


def _run_built(name: str, factory: Callable[[], Callable], items: list, none: object) -> tuple[list, list[str | None]]:
    """``_run_open`` with the worker's model; if it can't be built, every item carries that error."""
    try:
        model = _model(name, factory)
    except Exception as e:  # noqa: BLE001 - fail open
        return [none] * len(items), [None if x is None else f"{type(e).__name__}: {e}" for x in items]
    return _run_open(model, items, none)


def _run_open(model: Callable, items: list, none: object) -> tuple[list, list[str | None]]:
    """Results and errors of a batch: if the model fails on it, item by item, so that one bad item does not
    fail its neighbours.  A None item is not shown to the model."""
    def guarded(part: list) -> list:
        out = list(model(part))
        if len(out) != len(part):
            raise ValueError(f"{len(out)} results for {len(part)} items")
        return out

    at = [i for i, x in enumerate(items) if x is not None]
    values, errors = [none] * len(items), [None] * len(items)
    try:
        got = guarded([items[i] for i in at]) if at else []
        for i, v in zip(at, got):
            values[i] = v
    except Exception:  # noqa: BLE001 - fail open: the error is kept with its item
        for i in at:
            try:
                values[i] = guarded([items[i]])[0]
            except Exception as e:  # noqa: BLE001
                errors[i] = f"{type(e).__name__}: {e}"
    return values, errors


def _frame(values: list, errors: list[str | None]) -> pd.DataFrame:
    return pd.DataFrame({"value": pd.Series(values, dtype="object"), "error": pd.Series(errors, dtype="object")})


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def embed_column(text, factory: Callable[[], Callable], name: str = "embedder") -> Column:
    """K1 Embedder: struct(value ``array<double>``, error) per text, model loaded once per worker."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            values, errors = _run_built(name, factory, [t if isinstance(t, str) else None for t in texts], None)
            yield _frame([None if v is None else np.asarray(v, dtype="float64") for v in values], errors)
    return F.pandas_udf(run, "value array<double>, error string")(_col(text))


def pair_score_column(query, doc, factory: Callable[[], Callable], name: str = "pair_scorer") -> Column:
    """K1 PairScorer: struct(value ``double``, error), the relevance of ``doc`` to ``query``."""
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for q, d in batches:
            values, errors = _run_built(name, factory, list(zip(q.fillna("").tolist(), d.fillna("").tolist())), None)
            yield _frame([None if v is None else float(v) for v in values], errors)
    return F.pandas_udf(run, "value double, error string")(_col(query), _col(doc))


def token_score_column(text, factory: Callable[[], Callable], name: str = "token_scorer") -> Column:
    """K1 TokenScorer: struct(value ``array<double>``, error), one keep-score per whitespace token."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            values, errors = _run_built(name, factory, [t if isinstance(t, str) else None for t in texts], None)
            yield _frame([None if v is None else [float(x) for x in v] for v in values], errors)
    return F.pandas_udf(run, "value array<double>, error string")(_col(text))


def fail_open(fn: Callable[[str], float], value_type: str = "double") -> Callable[[Column], Column]:
    """K2: wrap a per-text step; returns ``struct(value, error)`` and never raises for a row."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            vals, errs = [], []
            for t in texts.tolist():
                try:
                    vals.append(fn(t))
                    errs.append(None)
                except Exception as e:  # noqa: BLE001 - fail open, report the error per row
                    vals.append(None)
                    errs.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"value": vals, "error": errs})
    udf = F.pandas_udf(run, f"value {value_type}, error string")
    return lambda c: udf(F.col(c) if isinstance(c, str) else c)


# --------------------------------------------------------------------------- deterministic fakes
def overlap_scorer():
    """A deterministic stand-in PairScorer factory: the number of words query and doc share."""
    def model(pairs):
        return [float(len(set(q.split()) & set(d.split()))) for q, d in pairs]
    return model


def letter_embedder():
    """A deterministic stand-in Embedder factory: the counts of the letters a to z; fails on a text with a tab."""
    def model(texts):
        if any("\t" in t for t in texts):
            raise ValueError("tab")
        return np.array([[t.lower().count(chr(97 + k)) for k in range(26)] for t in texts], dtype="float64").reshape(len(texts), 26)
    return model


def length_token_scorer():
    """A deterministic stand-in TokenScorer factory: long tokens are kept first."""
    def model(texts):
        return [[float(len(w)) for w in t.split()] for t in texts]
    return model
