"""Scoring texts with a pre-trained model, the one step that runs Python on rows.

A scorer is a factory: called once per Python worker, it loads a model and
returns a function from a batch of texts to a frame with ``label`` and
``score``. Only the text column crosses to Python, in Arrow batches of
``spark.sql.execution.arrow.maxRecordsPerBatch`` rows. A call to the model gets
texts of like length, up to a budget of bytes; results return in the order of rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinion_spark.constants import LABEL, SEED
from opinion_spark.functions.columns import named
from opinion_spark.functions.labels import normalize_label
from opinion_spark.functions.text import prepare_text
from opinion_spark.operators.sampling import stratified_sample
from opinion_spark.session import reach_workers, stage

Batch = Callable[[pd.Series], pd.DataFrame]
Factory = Callable[[], Batch]

MODELS_PER_WORKER = 3
#: Bytes of text that one call to a model gets, a longer text alone.
CALL_BYTES = 8 << 20

_factories: dict[str, Factory] = {}
_loaded: OrderedDict[str, Batch] = OrderedDict()


def register_scorer(name: str, factory: Factory) -> None:
    _factories[name] = factory


def scorer_factory(name: str) -> Factory:
    """The factory registered under this name."""
    if name not in _factories:
        raise ValueError(f"no scorer is registered as {name!r}")
    return _factories[name]


def score(
    df: DataFrame,
    text: str,
    scorer: str | Factory,
    model: str | None = None,
    max_chars: int | None = None,
    on_error: str = "fail",
    drop_blank: bool = True,
    missing: str | None = None,
    call_bytes: int = CALL_BYTES,
) -> DataFrame:
    """Add ``hf_label, hf_score, hf_mapped, model``; batch and streaming tables alike.

    Whole texts are scored, unless ``max_chars`` asks for their beginnings only.
    A call to the model gets at most ``call_bytes`` bytes of text, or one text.
    ``on_error="null"`` gives a text that the model fails on a NULL label, score
    0 and mapped label 0 instead of failing the job: a failed call is halved
    until the bad texts are alone. A model that cannot be loaded fails the job.
    Conditions on the result are never moved below it: what ``df`` leaves out,
    by its filters or joins, is not scored. Filter before, where that is enough.
    """
    if call_bytes < 1:
        raise ValueError("call_bytes must be at least 1")
    if on_error not in ("fail", "null"):
        raise ValueError(f"unknown on_error {on_error!r}")
    name = model or (scorer if isinstance(scorer, str) else getattr(scorer, "__name__", "scorer"))
    factory = scorer_factory(scorer) if isinstance(scorer, str) else scorer
    reach_workers(df.sparkSession)
    run = _scoring_udf(name, factory, on_error, call_bytes)
    prepared = prepare_text(df, text, "scored_text", max_chars, drop_blank, missing)
    return (
        prepared.withColumn("raw", run(F.col("scored_text")))
        .withColumn("hf_label", F.col("raw.label"))
        .withColumn("hf_score", F.coalesce(F.col("raw.score"), F.lit(0.0)))
        .withColumn("hf_mapped", normalize_label(F.col("hf_label")))
        .withColumn("model", F.lit(name))
        .drop("raw", "scored_text")
    )


def evaluate_sample(
    df: DataFrame,
    key: str,
    text: str,
    scorer: str | Factory,
    size: int,
    label: str = LABEL,
    model: str | None = None,
    seed: int = SEED,
    missing: str | None = None,
    max_chars: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Draw a stratified sample and score it: one row per drawn review.

    Reviews without text are not drawn, unless ``missing`` names the text to
    score for them. Labels and scores sit on the same row from the start, so
    nothing has to be aligned afterwards.
    """
    # Drawn from keys and labels, written once: the texts of the drawn rows alone are read after that.
    pool = df if missing is not None else df.filter(named(text).isNotNull())
    slim = stage(pool.select(named(key), *([named(label)] if label in df.columns else [])), "sample-keys")
    numbers = stratified_sample(slim, key, label, size, seed).select(named(key).alias("_key"), "eval_id")
    sample = df.join(numbers, named(key) == F.col("_key")).drop("_key")
    # The sample may sit in few partitions; spread it for inference.
    spread = sample.repartition(partitions or df.sparkSession.sparkContext.defaultParallelism, "eval_id")
    scored = score(spread, text, scorer, model, max_chars, drop_blank=False, missing=missing)
    return scored.select("eval_id", named(text), named(label), "hf_label", "hf_score", "hf_mapped", "model")


def _scoring_udf(name: str, factory: Factory, on_error: str, call_bytes: int):
    run = _run if on_error == "fail" else run_isolated

    @F.pandas_udf("label string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            model = _worker_model(name, factory)
            calls = call_places(texts, call_bytes)
            if not calls:
                yield _run(model, texts)
                continue
            made = pd.concat([run(model, texts.iloc[places].reset_index(drop=True)) for places in calls], ignore_index=True)
            yield made.iloc[np.argsort(np.concatenate(calls))].reset_index(drop=True)

    # Else Spark tests results on one side of a join or before a sample's draw, and scores rows that are not in ``df``.
    return scored.asNondeterministic()


def call_places(texts: pd.Series, call_bytes: int) -> list[np.ndarray]:
    """Places of the texts of each call: by length, shortest first, up to ``call_bytes`` or one text."""
    sizes = np.array([len(t.encode("utf-8", "surrogatepass")) if isinstance(t, str) else 0 for t in texts], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    upto = np.cumsum(sizes[order])
    calls, start = [], 0
    while start < len(order):
        end = int(np.searchsorted(upto, (upto[start - 1] if start else 0) + call_bytes, side="right"))
        calls.append(order[start:max(end, start + 1)])
        start = max(end, start + 1)
    return calls


def run_isolated(model: Batch, texts: pd.Series) -> pd.DataFrame:
    """Results of ``model``; a text that it fails on by itself gets none. One bad text of n costs about 2 log2 n calls more."""
    try:
        return _run(model, texts)
    except Exception:
        if len(texts) == 1:
            return pd.DataFrame({"label": [None], "score": [0.0]})
    half = len(texts) // 2
    parts = (texts.iloc[:half], texts.iloc[half:])
    return pd.concat([run_isolated(model, part.reset_index(drop=True)) for part in parts], ignore_index=True)


def _run(model: Batch, texts: pd.Series) -> pd.DataFrame:
    if texts.empty:
        return pd.DataFrame({"label": pd.Series(dtype=object), "score": pd.Series(dtype=float)})
    out = model(texts).reindex(columns=["label", "score"])
    if len(out) != len(texts):
        raise ValueError(f"the scorer gave {len(out)} results for {len(texts)} texts")
    out["score"] = out["score"].astype(float)
    return out


def _worker_model(name: str, factory: Factory) -> Batch:
    """The model of this worker process, loaded on first use; the last few are kept."""
    if name not in _loaded:
        _loaded[name] = factory()
        while len(_loaded) > MODELS_PER_WORKER:
            _loaded.popitem(last=False)
    _loaded.move_to_end(name)
    return _loaded[name]
