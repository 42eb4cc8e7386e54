"""K1 by name: model factories in a registry, chosen for each request by the names that D3 resolves.

``Models`` maps names to factories ``factory(device) -> model``; a model is called with a list of items, as the
plug-ins of ``functions.plugins`` are (texts, (query, text) pairs or texts again for token scores).  Any number
of models work in one job:

* Equal items of one model are computed once: items are reduced to distinct (model, digest) rows before the
  shuffle and results are joined back on these two.
* Rows are dealt by (model, part), with as many parts as the model's text is a multiple of ``part_chars``, and
  sorted by model and length: a worker goes from one model to the next, builds each once, and keeps at most
  ``held`` of them.
* A batch ends at ``batch_chars`` of text, so that long texts come in small batches and short ones in large.

K2: what fails is a result of its own.  A name without a factory, a factory that raises and an item that fails
give ``error`` (``Type: message``) in the rows concerned and leave all others alone; ``error_code`` tells a
missing dependency from other failures.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionsift.functions.plugins import _run_open
from sessionsift.session import materialize

Factory = Callable[[str], Callable[[list], list]]


@dataclass(frozen=True)
class Models:
    """Factories by name for each of the three steps; a step without any keeps its lexical default."""

    embedders: Mapping[str, Factory] = field(default_factory=dict)
    scorers: Mapping[str, Factory] = field(default_factory=dict)
    token_scorers: Mapping[str, Factory] = field(default_factory=dict)
    #: Handed to every factory.
    device: str = "cpu"
    #: The compressor of requests that name none, by device.
    default_compressor: Mapping[str, str] = field(default_factory=dict)
    batch_chars: int = 200_000
    part_chars: int = 20_000_000
    held: int = 2

    def compressor(self, name: Column) -> Column:
        return F.coalesce(F.nullif(name, F.lit("")), F.lit(self.default_compressor.get(self.device, "")))


def error_code(error: Column) -> Column:
    """``dependency_missing`` for a model that can't be imported, else ``runtime_error``; null without error."""
    return F.when(error.rlike(r"^(ModuleNotFoundError|ImportError): "), "dependency_missing").when(error.isNotNull(), "runtime_error")


def digest(*columns: Column) -> Column:
    """Names an item: lengths keep (a, bc) and (ab, c) apart."""
    return F.sha2(F.concat_ws(":", *(F.length(c).cast("string") for c in columns), *columns), 256)


_HELD: OrderedDict = OrderedDict()


def _model(key: tuple, factory: Factory, held: int):
    if key not in _HELD:
        while len(_HELD) >= held:
            _HELD.popitem(last=False)
        _HELD[key] = factory(key[2])
    _HELD.move_to_end(key)
    return _HELD[key]


def applied(items: DataFrame, step: str, models: Models, value_type: str) -> DataFrame:
    """``items(model, text[, query])`` -> ``(model, digest, value, error)``, one row for each distinct item.

    ``step`` is ``embedders``, ``scorers`` or ``token_scorers``."""
    factories = dict(getattr(models, step))
    inputs = [c for c in ("query", "text") if c in items.columns]
    rows = items.select("model", digest(*map(F.col, inputs)).alias("digest"), *inputs).groupBy("model", "digest").agg(*(F.first(c).alias(c) for c in inputs))
    rows = materialize(rows.withColumn("size", sum((F.length(c) for c in inputs), F.lit(1)).cast("bigint")))
    # at most a row for each factory; names without one only get errors, in some parts of their own
    parts = rows.where(F.col("model").isin(list(factories))).groupBy("model").agg(F.ceil(F.sum("size") / models.part_chars).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(parts), "model", "left").withColumn("part", F.pmod(F.xxhash64("digest"), F.coalesce("parts", F.lit(32))))
    dealt = dealt.repartition("model", "part").sortWithinPartitions("model", "size")
    device, batch_chars, held = models.device, models.batch_chars, models.held
    result = pa.schema([("model", pa.string()), ("digest", pa.string()), ("value", pa.list_(pa.float64()) if "array" in value_type else pa.float64()), ("error", pa.string())])

    def work(name: str, digests: list, texts: list) -> pa.RecordBatch:
        try:
            if name not in factories:
                raise KeyError(f"no model named {name!r}")
            model = _model((step, name, device), factories[name], held)
        except Exception as e:  # noqa: BLE001 - every item of the model gets the error
            values, errors = [None] * len(texts), [f"{type(e).__name__}: {e.args[0] if e.args else ''}"] * len(texts)
        else:
            values, errors = _run_open(model, texts, None)
            try:
                values = [None if v is None else [float(x) for x in v] if "array" in value_type else float(v) for v in values]
            except (TypeError, ValueError) as e:
                values, errors = [None] * len(texts), [f"{type(e).__name__}: {e}"] * len(texts)
        return pa.RecordBatch.from_pydict({"model": [name] * len(texts), "digest": digests, "value": values, "error": errors}, schema=result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digests, texts, chars = None, [], [], 0
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("model", "digest", "size", *inputs)}
            for i, model in enumerate(columns["model"]):
                if texts and (model != name or chars + columns["size"][i] > batch_chars):
                    yield work(name, digests, texts)
                    digests, texts, chars = [], [], 0
                name = model
                digests.append(columns["digest"][i])
                texts.append(tuple(columns[c][i] for c in inputs) if len(inputs) > 1 else columns[inputs[0]][i])
                chars += columns["size"][i]
        if texts:
            yield work(name, digests, texts)

    return materialize(dealt.mapInArrow(run, f"model string, digest string, value {value_type}, error string"))


# --------------------------------------------------------------------------- deterministic fakes
def counting_embedder(characters: str) -> Factory:
    """Counts of the given characters in the lower-cased text; fails on a text with a tab."""
    def factory(device: str):
        def model(texts):
            if any("\t" in t for t in texts):
                raise ValueError("tab")
            return [[float(t.lower().count(c)) for c in characters] for t in texts]
        return model
    return factory


def shared_words_scorer(device: str):
    """The number of different words, split at ASCII white space, that query and text share."""
    def model(pairs):
        return [float(len({w for w in q.split(" ") if w} & {w for w in d.split(" ") if w})) for q, d in pairs]
    return model


def remainder_scorer(device: str):
    """The text's length modulo 97."""
    def model(pairs):
        return [float(len(d) % 97) for _, d in pairs]
    return model


def _words(text: str) -> list[str]:
    import re
    return [w for w in re.split(r"[\t\n\x0b\f\r ]+", text) if w]


def long_words_scorer(device: str):
    """Long tokens are kept first."""
    def model(texts):
        return [[float(len(w)) for w in _words(t)] for t in texts]
    return model


def late_words_scorer(device: str):
    """Late tokens are kept first."""
    def model(texts):
        return [[float(i) for i, _ in enumerate(_words(t))] for t in texts]
    return model
