"""Plug-ins: models that answer in batches, datasets, and readers by name.

A model is a factory; it is called once a task, so weights load on the
executor. Its callable takes a pandas batch and gives one answer a row.
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import answers
from framewright.metrics import tubes
from framewright.sources import annotations

Predict = Callable[[pd.DataFrame], Iterable[str]]
_MODELS: dict[str, Callable[[], Predict]] = {}
_DATASETS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def model(*names: str):
    """Registers a factory under names; case and punctuation don't count."""
    return lambda f: _put(_MODELS, names, f)


def dataset(*names: str):
    """Registers a reader (spark, path) -> samples."""
    return lambda f: _put(_DATASETS, names, f)


def _put(table: dict, names: tuple[str, ...], f):
    for n in names:
        table[plain(n)] = f
    return f


def find_model(name: str) -> Callable[[], Predict]:
    return _found(_MODELS, name, "model")


def find_dataset(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return _found(_DATASETS, name, "dataset")


def _found(table: dict, name: str, what: str):
    if plain(name) not in table:
        raise ValueError(f"unknown {what}: {name}; there are {sorted(table)}")
    return table[plain(name)]


dataset("query lines", "queries")(annotations.queries)
dataset("hcstvg", "hc-stvg")(annotations.corner_sized)
dataset("vidstg")(annotations.cornered)
dataset("stalign", "st-align")(annotations.aligned)


def predicted(samples: DataFrame, factory: Callable[[], Predict], batch: int = 16, columns: tuple[str, ...] = ("sample_id", "video_path", "query")) -> DataFrame:
    """(sample_id, answer): prompts go to the model in batches; a batch that fails has null answers."""
    kind = dict(samples.dtypes)["sample_id"]
    rows = samples.select(*columns, answers.prompt(F.col("query")).alias("prompt"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = factory()
        for x in parts:
            for i in range(0, len(x), batch):
                b = x.iloc[i : i + batch]
                try:
                    said = list(ask(b))
                except Exception:  # a model's failure is a missing answer
                    said = [None] * len(b)
                yield pd.DataFrame({"sample_id": b["sample_id"], "answer": (said + [None] * len(b))[: len(b)]})

    return rows.mapInPandas(run, f"sample_id {kind}, answer string")


def evaluate(spark: SparkSession, dataset_name: str, path: str, model_name: str) -> DataFrame:
    """Samples of a dataset with a model's answers and their scores."""
    samples = find_dataset(dataset_name)(spark, path)
    return tubes.score(annotations.with_answers(samples, predicted(samples, find_model(model_name))))


def evaluate_spans(samples: DataFrame, factory: Callable[[], Predict], remap=None) -> DataFrame:
    """Scores of span answers; remap: fn(span column) -> span column, after parsing."""
    said = predicted(samples, factory)
    span = answers.temporal_span(F.col("answer"))
    j = samples.join(said, "sample_id", "left").withColumn("__p", remap(span) if remap else span).withColumn("__g", F.get("gt", F.lit(0)))
    return tubes.temporal_score(j.select("*", F.col("__g.s").alias("gs"), F.col("__g.e").alias("ge"), F.col("__p.s").alias("ps"), F.col("__p.e").alias("pe")), "gs", "ge", "ps", "pe").drop("__p", "__g")


def asked(df: DataFrame, id_col: str, prompt: str, factory: Callable[[], Callable[[str], str]], validate: Callable[[str], str | None] | None = None, tries: int = 5, threads: int = 8, pause: float = 0.0) -> DataFrame:
    """(id, answer): prompts go to a client with bounded concurrency; what the validator gives replaces an answer, nothing means another try."""
    kind = dict(df.dtypes)[id_col]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()

        def one(p):
            for k in range(tries):
                try:
                    got = client(p)
                    good = validate(got) if validate else got
                    if good:
                        return good
                except Exception:  # counts as a failed try
                    pass
                time.sleep(pause * 2**k * random.random())
            return None

        with ThreadPoolExecutor(threads) as pool:
            for x in parts:
                yield pd.DataFrame({"id": x["id"], "answer": list(pool.map(one, x["p"]))})

    return df.select(df[id_col].alias("id"), df[prompt].alias("p")).mapInPandas(run, f"id {kind}, answer string").withColumnRenamed("id", id_col)


class KeyPool:
    """The least busy of several keys; equals are drawn."""

    def __init__(self, keys: list[str], most: int) -> None:
        self.busy, self.most = dict.fromkeys(keys, 0), most

    def take(self) -> str | None:
        low = min(self.busy.values())
        if low >= self.most:
            return None
        k = random.choice([k for k, n in self.busy.items() if n == low])
        self.busy[k] += 1
        return k

    def give(self, key: str) -> None:
        self.busy[key] -= 1


def row_function(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """A user's function on each row."""
    from framewright.operators.records import map_records

    return map_records(df, lambda r: [fn(r)], schema)
