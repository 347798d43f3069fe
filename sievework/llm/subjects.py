"""Subject areas of documents.

Words and the letter groups within them have embeddings, hashed to a table of fixed size; a
sentence is their average, and every area has its own logistic output on it.  The model is
fitted on sentences of hand-labelled documents: each partition of the training rows runs
over its part, the updates of all are averaged, and the next round starts from the average.
A document has an area if at least three of its sentences have it.

Words enter a sentence linearly, so for scoring each word's share of every output is worked
out once and a sentence costs one sum.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.durable import durable, tune_arrow
from sievework.sources import with_columns

BUCKETS, WIDTH = 1 << 15, 16
#: Labelled documents the model is fitted on, at most; drawn by hash of their id.
TRAIN_DOCUMENTS = 6_000
#: Areas of one model, at most; more are an error.
MAX_AREAS = 1_000
#: Labelled ids that are sent to every executor; more are joined by key.
FEW = 200_000
PARTS, ROUNDS, EPOCHS, RATE = 8, 4, 3, 0.25
BATCH = 64
SENTENCES = 3

#: Sentences in Latin script are a tenth of the corpus; each counts so many times.
RARE = 5

_NOT_LATIN = re.compile("[^\u0000-\u024f]")
#: A sentence of fewer words is a heading, a number or a rest, and speaks for no area.
LEAST_WORDS = 4

# A line break ends a sentence unless the next line goes on in lower case.
_STEP = re.compile(r"[^\W\d_]+|[.!?…]+(?=\s|$)|\n[^\S\n]*(?=\n|[^\sa-zа-яё]|$)")


class Vocabulary:
    """Hashed features of words: the word itself and its letter groups of four."""

    def __init__(self):
        self.known: dict[str, np.ndarray] = {}

    def __call__(self, word: str) -> np.ndarray:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            w = f"<{word.lower().replace('ё', 'е')}>"
            parts = {w, *(w[i : i + 4] for i in range(len(w) - 3))}
            found = self.known[word] = np.array(sorted(xxhash.xxh32_intdigest(p) % BUCKETS for p in parts), np.int32)
        return found


def sentence_words(text: str) -> list[list[str]]:
    """The words of each sentence that has enough of them; digits are no words."""
    out, current = [], []
    for step in _STEP.findall(text):
        if step[0] in ".!?…\n":
            out.append(current)
            current = []
        else:
            current.append(step)
    out.append(current)
    return [s for s in out if len(s) >= LEAST_WORDS]


class Model:
    def __init__(self, areas: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.areas = areas
        self.embedding = ((rng.random((BUCKETS, WIDTH)) - 0.5) / WIDTH).astype(np.float32)
        self.output = ((rng.random((WIDTH, len(areas))) - 0.5)).astype(np.float32)
        self.bias = np.full(len(areas), -2.0, np.float32)

    def parameters(self) -> np.ndarray:
        return np.concatenate((self.embedding.ravel(), self.output.ravel(), self.bias))

    def assign(self, flat: np.ndarray) -> None:
        a, b = self.embedding.size, self.output.size
        self.embedding = flat[:a].reshape(BUCKETS, WIDTH).astype(np.float32)
        self.output = flat[a : a + b].reshape(WIDTH, -1).astype(np.float32)
        self.bias = flat[a + b :].astype(np.float32)

    def run(self, sentences: list[np.ndarray], targets: np.ndarray, epochs: int, rate: float, seed: int) -> None:
        """Adaptive gradient descent in place; ``targets`` one row of 0 and 1 per sentence."""
        rng = np.random.default_rng(seed)
        seen_e, seen_o, seen_b = np.full(BUCKETS, 1e-8, np.float32), np.full_like(self.output, 1e-8), np.full_like(self.bias, 1e-8)
        for epoch in range(epochs):
            for at in np.array_split(rng.permutation(len(sentences)), max(1, len(sentences) // BATCH)):
                if not len(at):
                    continue
                feats = [sentences[i] for i in at]
                size = np.array([len(f) for f in feats])
                flat = np.concatenate(feats)
                mean = np.add.reduceat(self.embedding[flat], np.cumsum(size) - size) / size[:, None]
                wrong = 1 / (1 + np.exp(-np.clip(mean @ self.output + self.bias, -30, 30))) - targets[at]
                back = (wrong @ self.output.T) / size[:, None]
                g = mean.T @ wrong
                seen_o += g * g
                self.output -= rate * g / np.sqrt(seen_o)
                g = wrong.sum(0)
                seen_b += g * g
                self.bias -= rate * g / np.sqrt(seen_b)
                order = np.argsort(flat, kind="stable")
                edge = np.flatnonzero(np.concatenate(([True], np.diff(flat[order]) != 0)))
                g = np.add.reduceat(np.repeat(back, size, axis=0)[order], edge)
                rows = flat[order][edge]
                seen_e[rows] += (g * g).mean(1)
                self.embedding[rows] -= rate * g / np.sqrt(seen_e[rows])[:, None]


class Scorer:
    """Counts a text's sentences of each area."""

    def __init__(self, model: Model):
        self.model, self.features = model, Vocabulary()
        self.at: dict[str, int] = {}
        self.shares = np.zeros((1024, len(model.areas) + 1), np.float32)

    def _word(self, word: str) -> int:
        feats = self.features(word)
        i = len(self.at)
        if i == len(self.shares):
            self.shares = np.concatenate((self.shares, np.zeros_like(self.shares)))
        self.shares[i, :-1] = self.model.embedding[feats].sum(0) @ self.model.output
        self.shares[i, -1] = len(feats)
        self.at[word] = i
        return i

    def chances(self, text: str) -> np.ndarray:
        """For every sentence the chance of each area."""
        if len(self.at) > 300_000:
            self.at.clear()
        numbers, starts = [], []
        at, fresh = self.at, True
        for step in _STEP.findall(text):
            if step[0] in ".!?…\n":
                fresh = True
                continue
            if fresh:
                starts.append(len(numbers))
                fresh = False
            i = at.get(step)
            numbers.append(self._word(step) if i is None else i)
        if not numbers:
            return np.zeros((0, len(self.model.areas)))
        words = np.diff([*starts, len(numbers)])
        total = np.add.reduceat(self.shares[numbers], starts)[words >= LEAST_WORDS]
        return 1 / (1 + np.exp(-np.clip(total[:, :-1] / total[:, -1:] + self.model.bias, -30, 30)))

    def counts(self, text: str) -> np.ndarray:
        return (self.chances(text) > 0.5).sum(0)


def training_rows(documents: DataFrame, labels: DataFrame, areas: list[str], limit: int) -> DataFrame:
    """(doc_id, text, codes) of at most ``limit`` labelled documents, drawn by hash."""
    clean = with_columns(labels, "doc_id", "subject_code").select("doc_id", F.lower(F.trim("subject_code")).alias("code")).filter(F.col("code").isin(areas))
    per_doc = clean.groupBy("doc_id").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    texts = with_columns(documents, "doc_id", "text").filter("text is not null")
    # Both scripts are wanted: up to a third of the draw is for texts mostly in Latin letters.
    latin = F.length(F.regexp_replace("text", "[^A-Za-z]", "")) * 2 > F.length("text")
    labelled = per_doc.filter("doc_id is not null")
    if labelled.limit(FEW + 1).count() <= FEW:
        labelled = F.broadcast(labelled)
    # The draw is made on ids and codes: texts are fetched for what is drawn, not joined by key.
    known = durable(texts.join(labelled, "doc_id").select("doc_id", "codes", latin.alias("latin")).dropDuplicates(["doc_id"]), "labelled")
    first = lambda rows, n: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    drawn = first(known.filter("latin"), limit // 3).unionByName(first(known.filter("not latin"), limit - limit // 3)).select("doc_id", "codes")
    return texts.join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"])


def fit(documents: DataFrame, labels: DataFrame, subjects: DataFrame, limit: int = TRAIN_DOCUMENTS) -> Model | None:
    """The model fitted on at most ``limit`` labelled documents; None without any.

    In the first rounds only the sentences of documents with one label are learnt from; in the
    last also those of documents with several in which the model finds one of the labels, and
    no longer those in which it finds an area that is not among them.
    """
    tune_arrow(documents.sparkSession, 500)
    areas = sorted(r[0] for r in subjects.select(F.lower("subject_code")).filter("subject_code is not null").distinct().limit(MAX_AREAS + 1).collect())
    if len(areas) > MAX_AREAS:
        raise ValueError(f"more than {MAX_AREAS} subject areas")
    rows = durable(training_rows(documents, labels, areas, limit).repartition(PARTS, F.xxhash64("doc_id")), "training")
    if not areas or rows.isEmpty():
        return None
    model = Model(areas)
    context = documents.sparkSession.sparkContext

    for round_ in range(ROUNDS):
        sent = context.broadcast(model.parameters())  # 2 MB, whatever the corpus

        def part(frames: Iterator[pd.DataFrame], round_=round_, sent=sent) -> Iterator[pd.DataFrame]:
            mine, vocabulary = Model(areas), Vocabulary()
            mine.assign(sent.value)
            sentences, targets = examples(frames, areas, vocabulary, mine if round_ >= ROUNDS // 2 else None)
            if sentences:
                mine.run(sentences, np.array(targets, np.float32), EPOCHS, RATE * (1 - 0.6 * round_ / ROUNDS), round_)
                change = mine.parameters() - sent.value
                yield pd.DataFrame({"n": [len(sentences)], "change": [change.astype(np.float32).tobytes()]})

        # One update of 2 MB from each of PARTS partitions, weighted by its sentences.
        updates = rows.repartition(PARTS, F.xxhash64("doc_id")).select("text", "codes").mapInPandas(part, "n bigint, change binary").collect()
        total = sum(u.n for u in updates)
        if total:
            model.assign(sent.value + sum(np.frombuffer(u.change, np.float32) * (u.n / total) for u in updates))
        sent.unpersist()
    return model


def examples(frames, areas: list[str], vocabulary: Vocabulary, model: Model | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    sentences, targets = [], []
    scorer = Scorer(model) if model else None
    for frame in frames:
        for text, codes in zip(frame.text, frame.codes):
            mask = np.isin(areas, list(codes))
            if scorer is None and mask.sum() != 1:
                continue
            words = sentence_words(text)
            chance = scorer.chances(text) if scorer else None
            for k, sentence in enumerate(words):
                goal = mask
                if chance is not None:
                    held = chance[k] > 0.5
                    if (held & ~mask).any() or mask.sum() > 1 and not held.any():
                        continue  # an area nobody saw, or nothing to tell several apart
                    goal = held if mask.sum() > 1 else mask
                row = np.concatenate([vocabulary(w) for w in sentence])
                for _ in range(1 if _NOT_LATIN.search(sentence[0]) else RARE):
                    sentences.append(row)
                    targets.append(goal)
    return sentences, targets


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, subject_code, sentences): the areas of three or more sentences."""
    schema = "doc_id bigint, subject_code string, sentences int"
    spark = documents.sparkSession
    if model is None:
        return spark.createDataFrame([], schema)
    sent, areas = spark.sparkContext.broadcast(model.parameters()), model.areas

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Model(areas)
        mine.assign(sent.value)
        scorer = Scorer(mine)
        for batch in batches:
            doc, code, n = [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = scorer.counts(text.as_py())
                for k in np.flatnonzero(counts >= SENTENCES):
                    doc.append(d)
                    code.append(areas[k])
                    n.append(int(counts[k]))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(code, pa.string()), pa.array(n, pa.int32())], ["doc_id", "subject_code", "sentences"])

    return with_columns(documents, "doc_id", "text").filter("doc_id is not null and text is not null").mapInArrow(run, schema)


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame, limit: int = TRAIN_DOCUMENTS) -> DataFrame:
    """(doc_id, subject_code): all areas of each document.

    ``documents``: ``doc_id, text``; ``labels``: ``doc_id, subject_code`` (any case, repeated
    rows and unknown codes do not matter); ``subjects``: ``subject_code``.  Other columns are
    ignored.  Null ids and null texts have no rows, nor have texts without an area.  Without
    usable labels the result is empty.
    """
    return score(documents, fit(documents, labels, subjects, limit)).select("doc_id", "subject_code").distinct()
