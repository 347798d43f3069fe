"""Models as functions: registries of embedders and rerankers, rewriting, generation.

Neural models come from outside; each is a function on Arrow batches, registered by name and
built once per worker.  The ones here need no weights and serve as the reference of a contract.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.durable import ship
from sievework.functions.text import terms

Embedder = Callable[[list[str]], list[list[float]]]
Reranker = Callable[[list[str], list[str]], list[float]]
Chat = Callable[[list[str]], list[str]]
EMBEDDERS: dict[str, Callable[[], Embedder]] = {}
RERANKERS: dict[str, Callable[[], Reranker]] = {}
#: Prompts by variant: the context first, then the question.
PROMPTS = {
    "default": "{context}\n\n{query}",
    "strict_citations": "Cite every claim as [n].\n\n{context}\n\n{query}",
    "concise": "Answer in at most three sentences.\n\n{context}\n\n{query}",
    "abstain": "If the context holds no answer, say so and stop.\n\n{context}\n\n{query}",
}
#: Models of this process, by kind and name.
_built: dict[tuple[str, str], object] = {}


def _model(kind: str, name: str, factory: Callable):
    """The model of a worker: made when first asked for, then kept for all batches."""
    if (kind, name) not in _built:
        _built[kind, name] = factory()
    return _built[kind, name]


def register(kind: dict, name: str):
    """Decorator: a factory under a name; a name that is taken is an error."""

    def add(factory):
        if name in kind:
            raise ValueError(f"{name!r} is registered already")
        kind[name] = factory
        return factory

    return add


def _get(kind: dict, name: str):
    if name not in kind:
        raise ValueError(f"no model {name!r}; there are {', '.join(sorted(kind))}")
    return kind[name]


def embedded(rows: DataFrame, text: str, name: str, prefix: str = "") -> DataFrame:
    """Adds ``vector`` by a registered embedder; null texts get null, blank ones are an error."""
    ship(rows.sparkSession)
    factory = _get(EMBEDDERS, name)

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        model = _model("embedder", name, factory)
        out = pd.Series([None] * len(texts), dtype=object)
        use = [i for i, t in enumerate(texts) if t is not None]
        if any(not texts.iloc[i].strip() for i in use):
            raise ValueError("blank text")
        if use:
            vectors = model([prefix + texts.iloc[i] for i in use])
            if len(vectors) != len(use):
                raise ValueError(f"{len(vectors)} vectors for {len(use)} texts")
            for i, v in zip(use, vectors):
                out.iloc[i] = v
        return out

    return rows.withColumn("vector", run(F.col(text)))


def reranked(rows: DataFrame, query: str, text: str, name: str) -> DataFrame:
    """Adds ``score_rerank`` by a registered reranker, one score for each pair."""
    ship(rows.sparkSession)
    factory = _get(RERANKERS, name)

    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        scores = [float(s) for s in _model("reranker", name, factory)(list(queries.fillna("")), list(texts.fillna("")))]
        if len(scores) != len(queries):
            raise ValueError(f"{len(scores)} scores for {len(queries)} pairs")
        return pd.Series(scores)

    return rows.withColumn("score_rerank", run(F.col(query), F.col(text)))


def chatted(rows: DataFrame, prompt: str, chat: Chat, out: str = "answer") -> DataFrame:
    """Adds the answers of a chat function, and ``<out>_error``: what it raised, else null.

    A batch that fails is asked again prompt by prompt, so one bad prompt costs no other its
    answer.
    """
    ship(rows.sparkSession)

    @F.pandas_udf("struct<answer: string, error: string>")
    def run(prompts: pd.Series) -> pd.DataFrame:
        def ask(some: list) -> list:
            answers = list(chat(some))
            if len(answers) != len(some):
                raise ValueError(f"{len(answers)} answers for {len(some)} prompts")
            return answers

        try:
            found = [(x, None) for x in ask(list(prompts))]
        except Exception:  # noqa: BLE001 - a model's failure is data here
            found = []
            for one in prompts:
                try:
                    found.append((ask([one])[0], None))
                except Exception as failure:  # noqa: BLE001
                    found.append((None, f"{type(failure).__name__}: {failure}"))
        return pd.DataFrame(found, columns=["answer", "error"], dtype=object)

    return rows.withColumn("_chat", run(F.col(prompt))).select(*rows.columns, F.col("_chat.answer").alias(out), F.col("_chat.error").alias(f"{out}_error"))


def with_fallback(first: Callable[[], Embedder], second: Callable[[], Embedder]) -> Callable[[], Embedder]:
    """An embedder's factory that takes the second where the first cannot be made."""

    def factory() -> Embedder:
        try:
            return first()
        except Exception:  # noqa: BLE001
            return second()

    return factory


def mean_pooled(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Text vectors from token vectors (texts, tokens, width): the mean where the mask is set,
    at length 1; a text without tokens has zeros."""
    weight = mask[:, :, None].astype(float)
    mean = (tokens * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)
    return mean / np.maximum(np.sqrt((mean * mean).sum(1, keepdims=True)), 1e-12)


def restored_order(ranked: list[tuple[int, float]], n: int) -> list[float]:
    """Scores in the order of the input, from (index, score) pairs in the order of a ranking;
    an index that is missing, repeated or out of range is an error."""
    out: list[float | None] = [None] * n
    for index, score in ranked:
        if not 0 <= index < n or out[index] is not None:
            raise ValueError(f"bad index {index} for {n} texts")
        out[index] = float(score)
    if None in out:
        raise ValueError("some texts have no score")
    return out


class Settings(NamedTuple):
    """What an embedder puts before a query and before a passage."""

    query: str = ""
    passage: str = ""


SETTINGS: dict[str, Settings] = {"hashing": Settings(), "hashing_256": Settings()}


def embedded_as(rows: DataFrame, text: str, name: str, mode: str) -> DataFrame:
    """``embedded`` with the model's own prefix for ``query`` or ``passage``."""
    if mode not in Settings._fields:
        raise ValueError(f"no mode {mode!r}; there are {', '.join(Settings._fields)}")
    return embedded(rows, text, name, getattr(SETTINGS.get(name, Settings()), mode))


def unquoted(text: Column) -> Column:
    """A generated question without the quotation marks around it."""
    return F.trim(F.regexp_replace(F.trim(text), "^[\"«„“']+|[\"»”“']+$", ""))


def required(text: Column, least: int) -> Column:
    """The text; one that is missing or too short raises an error."""
    return F.when(F.length(F.trim(text)) >= least, F.trim(text)).otherwise(F.raise_error(F.concat(F.lit("too short: "), F.coalesce(text, F.lit("null")))).cast("string"))


def to_judge(records: DataFrame, metrics: tuple[str, ...], force: bool = False) -> DataFrame:
    """(id, metric) still to be judged: those without a good judgement, or all if ``force``.

    ``records``: ``id`` and ``judge``, a struct of metrics with a ``status``.
    """
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"judge.{m}.status").alias("status")) for m in metrics))
    rows = records.select("id", F.explode(each).alias("j")).select("id", "j.*")
    return (rows if force else rows.filter(~F.coalesce(F.col("status").startswith("ok"), F.lit(False)))).select("id", "metric")


def generated(records: DataFrame, chat: Chat, variant: str = "default") -> DataFrame:
    """``records (id, query, context)`` with the answer a chat function gives to the prompt."""
    if variant not in PROMPTS:
        raise ValueError(f"no prompt {variant!r}; there are {', '.join(PROMPTS)}")
    before, between, after = re.split(r"\{context\}|\{query\}", PROMPTS[variant])
    prompt = F.concat(F.lit(before), F.coalesce("context", F.lit("")), F.lit(between), F.coalesce("query", F.lit("")), F.lit(after))
    return chatted(records.withColumn("_prompt", prompt), "_prompt", chat).drop("_prompt").withColumn("prompt_variant", F.lit(variant))


def rewritten(query: Column, answer: Column, least: int = 10) -> Column:
    """The rewrite if it is long enough and another text, else the query; ``least`` is 20 for
    hypothetical answers."""
    text = F.trim(answer)
    return F.when((F.length(text) >= least) & (text != F.trim(query)), text).otherwise(query)


def hashed_terms(rows: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """(key, bucket, value): the hashing embedding of a text, at length 1, its zeros left out.

    Each term adds 1 or -1 to the bucket its digest names.
    """
    digest = F.md5("term")
    bucket = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("bigint") % size
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    sums = rows.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy(key, bucket.alias("bucket")).agg(F.sum(sign).alias("value")).filter("value <> 0")
    length = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))
    return sums.join(length, key).select(key, "bucket", F.round(F.col("value") / F.col("length"), 6).alias("value"))


def _hashing(size: int) -> Embedder:
    import hashlib

    known: dict[str, tuple[int, float]] = {}

    def place(word: str) -> tuple[int, float]:
        if word not in known:
            if len(known) > 500_000:
                known.clear()
            d = hashlib.md5(word.lower().replace("ё", "е").encode()).hexdigest()
            known[word] = int(d[:8], 16) % size, 1.0 if int(d[8], 16) % 2 == 0 else -1.0
        return known[word]

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(size)
            for w in re.findall("[0-9A-Za-zА-Яа-яЁё]{3,}", t):
                i, sign = place(w)
                v[i] += sign
            out.append((v / (np.sqrt((v * v).sum()) or 1.0)).tolist())
        return out

    return run


EMBEDDERS["hashing"] = lambda: _hashing(64)
EMBEDDERS["hashing_256"] = lambda: _hashing(256)


@register(RERANKERS, "overlap")
def _overlap() -> Reranker:
    import re

    def words(t: str) -> set[str]:
        return {w.lower().replace("ё", "е") for w in re.findall("[0-9A-Za-zА-Яа-яЁё]{3,}", t)}

    def run(queries: list[str], texts: list[str]) -> list[float]:
        pairs = ((words(q), words(t)) for q, t in zip(queries, texts))
        return [len(a & b) / min(len(a), len(b)) if a and b else 0.0 for a, b in pairs]

    return run
