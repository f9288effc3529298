"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents; all documents that aren't held out are
the unlabelled web text. The class prior pi is estimated as the share of
positives among the labelled documents (with one of each kind added). A linear
model on features of the whole text minimises the non-negative unbiased risk

    pi E_pos[l(z)] + max(0, E_unl[l(-z)] - pi E_pos[l(-z)]),   l logistic,

with full-batch steps: each is one Spark aggregation over the staged features of
all documents, so only a vector of the features' length reaches the driver. When
the bracket is negative the step goes up its gradient instead, as the method
asks. Features are ratios squashed to 0..1, the same at any text length.

Labels are only read of documents outside the held-out quarter; language,
source, id and labels are no features.

Defined results: a null text is empty and gets the score of an empty text, by
the same formula. Labels that contradict each other count as the lowest; null
labels are none. Rows that share an id are scored by their own texts. Extra
columns are ignored. An empty table gives an empty result; without a positive
the score is the estimated prior of every document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stage, text_or_empty
from .quality_rules import STOP_WORDS

#: (name, value at which the squashed ratio is one half).
FEATURES = (
    ("symbols", 0.05),
    ("shouts", 0.05),
    ("capitals", 0.2),
    ("bars", 0.05),
    ("digits", 0.1),
    ("repeated_triples", 0.1),
    ("repeated_lines", 0.3),
    ("stop_words", 0.1),
    ("word_length", 6.0),
    ("long_words", 0.1),
    ("brevity", 10.0),
)
STEPS, RATE, DECAY, ASCENT = 60, 0.5, 1e-4, 0.5

_stop = frozenset(STOP_WORDS)
_symbols = re.compile(r"[#*$%&|<>]")


def measure(text: str) -> list[float]:
    """The features of one text, each from 0 to 1."""
    words = text.split()
    n = max(1, len(words))
    raw = np.frombuffer(text.encode(), np.uint8)
    capitals = int(((raw >= 65) & (raw <= 90)).sum())
    small = int(((raw >= 97) & (raw <= 122)).sum())
    triples = len(words) - 2
    distinct = len(set(zip(words, words[1:], words[2:], strict=False)))
    lines = [x for x in text.split("\n") if x.strip()]
    values = (
        len(_symbols.findall(text)) / n,
        text.count("!") / n,
        capitals / max(1, capitals + small),
        text.count(" | ") / n,
        int(((raw >= 48) & (raw <= 57)).sum()) / max(1, len(raw)),
        1 - distinct / triples if triples > 0 else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        sum(w.lower() in _stop for w in words) / n,
        sum(map(len, words)) / n,
        sum(len(w) > 20 for w in words) / n,
        1 / n,
    )
    return [v / (v + half) for v, (_, half) in zip(values, FEATURES, strict=True)]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, held_out, x): the features of every document."""
    rows = docs.select(F.col(id_col).alias("__id"), held_out(F.col(id_col)).alias("held_out"), text_or_empty(text_col).alias("__text"))
    ddl = f"__id {rows.schema['__id'].dataType.simpleString()}, held_out boolean, x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [measure(v.as_py()) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x, pa.list_(pa.float64()))], names=["__id", "held_out", "x"])

    return map_arrow(rows, run, ddl)


def fit(measured: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", steps: int = STEPS) -> tuple[list[float], float]:
    """Weights (the intercept last, for raw features) and the prior."""
    k = len(FEATURES)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("__label_id")).agg(F.min(label_col).alias("y"))
    rows = measured.filter(~F.col("held_out"))
    train = stage(
        rows.join(known, rows["__id"] == known["__label_id"], "left").select(*[F.col("x")[i].alias(f"x{i}") for i in range(k)], "y"),
        "pu-train",
    )
    seen = train.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("y").alias("labelled"),
        F.count_if(F.col("y") == 1).alias("positive"),
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(k)],
        *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(k)],
    ).first()
    prior = (seen.positive + 1) / (seen.labelled + 2)
    if not seen.positive:
        return [0.0] * k + [math.log(prior / (1 - prior))], prior
    mean = np.array([seen[f"m{i}"] for i in range(k)])
    scale = np.array([seen[f"s{i}"] or 0.0 for i in range(k)])
    scale[scale < 1e-9] = 1.0
    w = np.zeros(k + 1)
    first, second = np.zeros(k + 1), np.zeros(k + 1)
    columns = [(F.col(f"x{i}") - float(mean[i])) / float(scale[i]) for i in range(k)] + [F.lit(1.0)]
    positive = F.col("y") == 1
    for step in range(1, steps + 1):
        z = sum((c * float(a) for c, a in zip(columns, w, strict=True)), F.lit(0.0))
        # l(z) = log(1 + exp(-z)); its derivative is p - 1, that of l(-z) is p.
        p = 1 / (1 + F.exp(-z))
        loss = F.log1p(F.exp(F.least(z, F.lit(30.0)))) + F.greatest(z - 30, F.lit(0.0))
        now = train.select(positive.alias("t"), p.alias("p"), loss.alias("loss"), *[c.alias(f"c{i}") for i, c in enumerate(columns)])
        g = now.agg(
            F.avg("loss").alias("unl"),
            F.avg(F.when(F.col("t"), F.col("loss"))).alias("pos"),
            *[F.avg(F.col("p") * F.col(f"c{i}")).alias(f"u{i}") for i in range(k + 1)],
            *[F.avg(F.when(F.col("t"), F.col("p") * F.col(f"c{i}"))).alias(f"q{i}") for i in range(k + 1)],
            *[F.avg(F.when(F.col("t"), (F.col("p") - 1) * F.col(f"c{i}"))).alias(f"r{i}") for i in range(k + 1)],
        ).first()
        negative = np.array([g[f"u{i}"] - prior * g[f"q{i}"] for i in range(k + 1)])
        if g.unl - prior * g.pos >= 0:
            gradient = prior * np.array([g[f"r{i}"] for i in range(k + 1)]) + negative
        else:
            gradient = -ASCENT * negative
        gradient = gradient + DECAY * w
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        rate = RATE / math.sqrt(1 + step / 10)
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights = w[:k] / scale
    return [*map(float, weights), float(w[k] - (weights * mean).sum())], prior


def score(measured: DataFrame, weights: list[float]) -> Column:
    z = sum((F.col("x")[i] * a for i, a in enumerate(weights[:-1])), F.lit(weights[-1]))
    return 1 / (1 + F.exp(-z))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    measured = stage(features(docs, id_col, text_col), "pu-features")
    weights, _ = fit(measured, labels, label_col, id_col)
    return measured.select(F.col("__id").alias(id_col), "held_out", score(measured, weights).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
