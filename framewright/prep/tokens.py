"""Token samples: prompts with answers, chat masks, packaging. A tokenizer is a callable made on the executor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

IGNORE = -100
#: text -> ids; made once a task by a factory, so nothing but the factory travels.
Tokenize = Callable[[str], list[int]]


def last_turn(mask: list[int], ignore: int = IGNORE) -> list[int]:
    """Only the last run of entries that count."""
    end = next((i for i in range(len(mask) - 1, -1, -1) if mask[i] != ignore), -1)
    start = end
    while start > 0 and mask[start - 1] != ignore:
        start -= 1
    return [m if start <= i <= end else ignore for i, m in enumerate(mask)]


def packaged(ids: list[int], answer: list[int], pad_id: int, length: int | None = None, shifted: bool = True) -> dict:
    """input_ids, labels and attention_mask; labels are the next tokens of the answer, padding is unsupervised.

    The attention mask covers the text but, when shifted, its last token (which has no next one).
    """
    text = ids[:length] if length else ids
    mask = answer[: len(text)]
    labels = [t if m else IGNORE for t, m in zip(text, mask)]
    n = len(text)
    if shifted:
        text, labels, n = text[:-1], labels[1:], max(n - 1, 0)
    fill = max((length or 0) - len(text), 0)
    return {"input_ids": text + [pad_id] * fill, "labels": labels + [IGNORE] * fill, "attention_mask": [1] * n + [0] * fill}


def prompt_completion(prompt: str, answer: str, tokenize: Tokenize, eos: int, pad_id: int, bos: int | None = None, length: int | None = None) -> dict:
    """The answer mask starts where the prompt alone (with its start token) ends."""
    head = ([bos] if bos is not None else []) + tokenize(prompt)
    ids = ([bos] if bos is not None else []) + tokenize(prompt + answer) + [eos]
    return packaged(ids, [0] * min(len(head), len(ids)) + [1] * max(len(ids) - len(head), 0), pad_id, length)


def chat_sample(messages: list[dict], render: Callable[[list[dict]], str], tokenize: Tokenize, pad_id: int, length: int | None = None, last_only: bool = False) -> dict:
    """Assistant turns are supervised: a turn's tokens are those beyond the rendering of what is before it."""
    ids, mask = tokenize(render(messages)), []
    for i, m in enumerate(messages):
        upto = len(tokenize(render(messages[: i + 1])))
        mask += [int(m["role"] == "assistant")] * max(upto - len(mask), 0)
    mask = (mask + [0] * len(ids))[: len(ids)]
    return packaged(ids, last_turn(mask, 0) if last_only else mask, pad_id, length)


def tokenised(df: DataFrame, id_col: str, text_col: str, factory: Callable[[], Tokenize], eod: int | None = None) -> DataFrame:
    """(id, tokens): ids of every text, with an end id if given; a null text is empty."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = factory()
        for x in parts:
            yield pd.DataFrame({"id": x["id"], "tokens": [tok(t or "") + ([eod] if eod is not None else []) for t in x["t"]]})

    chosen = df.select(df[id_col].alias("id"), df[text_col].alias("t"))
    return chosen.mapInPandas(run, f"id {dict(df.dtypes)[id_col]}, tokens array<int>").withColumnRenamed("id", id_col)


def token_counts(df: DataFrame, id_col: str, text_col: str, factory: Callable[[], Tokenize]) -> DataFrame:
    """(id, text_tokens), to be stored beside the rows."""
    from pyspark.sql import functions as F

    return tokenised(df, id_col, text_col, factory).select(id_col, F.size("tokens").alias("text_tokens"))


def instruction_samples(df: DataFrame, id_col: str, context: str | None, question: str, answer: str, factory: Callable[[], Tokenize], eos: int, pad_id: int, length: int | None = None) -> DataFrame:
    """(id, input_ids, labels, attention_mask) of context, question and answer; rows without an answer go."""
    from pyspark.sql import functions as F

    text = F.concat_ws("\n", *([F.col(context)] if context else []), F.col(question))
    rows = df.where(F.trim(F.coalesce(F.col(answer), F.lit(""))) != "").select(df[id_col].alias("id"), text.alias("p"), F.col(answer).alias("a"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = factory()
        for x in parts:
            made = [prompt_completion(p, a, tok, eos, pad_id, None, length) for p, a in zip(x["p"], x["a"])]
            yield pd.DataFrame({"id": x["id"], **{k: [m[k] for m in made] for k in ("input_ids", "labels", "attention_mask")}})

    kind = dict(df.dtypes)[id_col]
    return rows.mapInPandas(run, f"id {kind}, input_ids array<int>, labels array<int>, attention_mask array<int>").withColumnRenamed("id", id_col)
