"""Building and describing question sets."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.durable import durable, ship
from sievework.functions.text import plain_query, strip, terms

# Phrases that give away a prompt.
LEAKED = "фрагмент|приведён|приведен|в данном тексте|из текста"
#: Questions of a block, about: what is compared one by one in a task and sent to all others.
BLOCK = 5_000


def is_valid(question: Column) -> Column:
    return (F.length(strip(question)) >= 20) & ~F.lower(question).rlike(LEAKED)


def stratified_sample(documents: DataFrame, per_source: int, seed: int) -> DataFrame:
    """Up to ``per_source`` documents of each source, in the order of a seeded hash.

    ``documents``: one row per ``document`` with its ``source_code``.  The order replaces a
    random generator: it is the same however the table is partitioned.
    """
    order = Window.partitionBy("source_code").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "document")), "document")
    return documents.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= per_source)


def _closest(text: str, accepted: list[tuple[str, str]], best: str | None = None, score: float = 0.0) -> tuple[str | None, float]:
    """The accepted question that resembles a text most, by matching blocks; the first of equals."""
    match = difflib.SequenceMatcher(None, autojunk=False)
    match.set_seq2(text)
    for other, plain in accepted:
        match.set_seq1(plain)
        if match.real_quick_ratio() > score and match.quick_ratio() > score and (r := match.ratio()) > score:
            best, score = other, r
    return best, score


_JUDGED = "id string, kept boolean, like string, similarity double"


def greedy_distinct(questions: DataFrame, threshold: float = 0.88) -> DataFrame:
    """(id, kept, like, similarity): a question is rejected if it resembles, by matching blocks,
    one accepted before it (in the order of ids).

    Whether one is accepted depends on all before it, so the questions pass in blocks of about
    BLOCK in the order of ids: a block is compared with all accepted before, which lie in as
    many tasks as there are, and then, in one task, within itself.
    """
    spark = questions.sparkSession
    ship(spark)
    rows = questions.filter("id is not null").select("id", plain_query(F.col("query")).alias("plain"))
    blocks = max(1, -(-rows.count() // BLOCK))
    if blocks > 1:  # ranges of ids, so every id of a block is below all of the next
        rows = durable(rows.repartitionByRange(blocks, "id").withColumn("block", F.spark_partition_id()), "questions")
    out = accepted = None
    for b in range(blocks):
        part = rows.filter(F.col("block") == b).select("id", "plain") if blocks > 1 else rows
        if accepted is None:
            before = part.select("id", "plain", F.lit(None).cast("string").alias("like"), F.lit(0.0).alias("similarity"))
        else:
            asked = [tuple(r) for r in part.collect()]  # a block
            sent = spark.sparkContext.broadcast(asked)

            def compare(frames, sent=sent):
                for frame in frames:
                    held = sorted(zip(frame.id, frame.plain))
                    found = [(key, *_closest(text, held)) for key, text in sent.value]
                    yield pd.DataFrame([x for x in found if x[1] is not None], columns=["id", "like", "similarity"])

            near = accepted.mapInPandas(compare, "id string, like string, similarity double")
            # Of equal ones the first accepted counts.
            best = near.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "like")).alias("b")).select("id", F.col("b.like").alias("like"), (-F.col("b.s")).alias("similarity"))
            before = part.join(best, "id", "left").select("id", "plain", "like", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))

        def within(frame: pd.DataFrame) -> pd.DataFrame:
            accepted, judged = [], []
            for key, text, like, score in sorted(zip(frame.id, frame.plain, frame.like, frame.similarity), key=lambda x: x[:2]):
                like, score = _closest(text, accepted, like if isinstance(like, str) else None, score)
                if keep := score < threshold:
                    accepted.append((key, text))
                judged.append((key, bool(keep), like, round(score, 6)))
            return pd.DataFrame(judged, columns=["id", "kept", "like", "similarity"])

        done = before.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(within, _JUDGED)
        if blocks > 1:
            done = durable(done, "judged")
            fresh = durable(part.join(done.filter("kept").select("id"), "id", "left_semi"), "accepted")
            accepted = fresh if accepted is None else accepted.unionByName(fresh)
        out = done if out is None else out.unionByName(done)
    return out


def profile(questions: DataFrame) -> DataFrame:
    """Lengths, style and variety of the questions of each ``grp``."""
    n = F.length("query")
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    style = questions.groupBy("grp").agg(
        F.count("*").alias("questions"), F.count_distinct("query").alias("kinds_of_question"), F.min(n).alias("shortest"), F.percentile(n, F.lit(0.5)).alias("median"), F.max(n).alias("longest"), F.round(F.percentile(n, F.lit(0.9)), 6).alias("p90"),
        share(F.col("query").rlike("^[a-zа-яё]")).alias("lower_start"), share(F.col("query").rlike(r"(^|[^\p{L}\p{N}_])[A-ZА-ЯЁ]{2,}([^\p{L}\p{N}_]|$)")).alias("with_abbreviation"), share(~F.col("query").rlike(r"\?\s*$")).alias("no_mark"),
    )
    words = questions.select("grp", F.explode(terms(F.col("query"))).alias("term")).groupBy("grp").agg(F.round(F.count_distinct("term") / F.count("*"), 6).alias("type_token_ratio"))
    return style.join(words, "grp")
