"""Quality of texts by naive Bayes support vectors.

A text is the set of its hashed n-grams: of one to three bytes, and of one to three word
shapes (case, first and last character, length, whether the word repeats the one before). An
indicator is scaled by the log-ratio of the classes' counts, the vector brought to length
one, and a linear model with hinge loss fitted by dual coordinate descent. The margins become
probabilities through a logistic curve, fitted on rows that the descent did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marquee.llm.common import Tables, by_arrow, text_runs, with_columns
from marquee.llm.words import U64, find_words, mix, word_hashes

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SIZES = (1, 2, 3)
SMOOTHING = 1.0
# Bounds of the sample that the model is fitted on, in rows and in n-grams of all rows. The
# counts of the classes are those of all labelled rows.
MOST_ROWS = 8192
MOST_GRAMS = 1 << 24
# Every such row of the sample is kept for the logistic curve.
CURVE_EACH = 4
COST, EPOCHS, SLACK = 1.0, 40, 0.02
MOST_LENGTH = 8

LETTERS = np.zeros((2, 256), dtype=bool)
LETTERS[0, 97:123] = True  # a-z
LETTERS[1, 65:91] = True  # A-Z
# Letters and what is beyond ASCII look alike in a shape, digits too.
LOOKS = np.arange(256, dtype=np.int64)
LOOKS[LETTERS.any(axis=0)] = 97
LOOKS[128:] = 97
LOOKS[48:58] = 48


def grams(units: np.ndarray, family: int) -> Iterator[np.ndarray]:
    """Buckets of the runs of one, two and three units, by place of the first."""
    for size in SIZES:
        n = max(0, len(units) - size + 1)
        total = np.full(n, family * 16 + size, dtype=U64)
        for i in range(size):
            total = total * U64(0x9E3779B97F4A7C15) + units[i : i + n]
            total ^= total >> U64(29)
        yield ((total * U64(0xBF58476D1CE4E5B9)) >> U64(64 - BUCKET_BITS)).astype(np.int64)


def indicators(texts: list[str]) -> Iterator[np.ndarray]:
    """The buckets that each text has, ascending."""
    words = find_words(texts, lower=False)
    data = words.data
    sizes = [len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts]
    begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    hashes = word_hashes(words)
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (words.text[1:] == words.text[:-1])
    shape = np.minimum(words.end - words.start, MOST_LENGTH) * 2 + again
    for case in LETTERS:
        sums = np.concatenate([[0], np.cumsum(case[data])])
        shape = shape * 2 + (sums[words.end] > sums[words.start])
    if len(hashes):
        shape = (shape * 256 + LOOKS[data[words.start]]) * 256 + LOOKS[data[words.end - 1]]
    families = [
        (list(grams(data.astype(U64), 0)), begins[:-1], begins[1:] - 1),
        (list(grams(mix(shape), 1)), words.first[:-1], words.first[1:]),
    ]
    seen = np.zeros(BUCKETS, dtype=bool)
    for i in range(len(texts)):
        for runs, low, high in families:
            for size, buckets in zip(SIZES, runs, strict=True):
                seen[buckets[low[i] : max(low[i], high[i] - size + 1)]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


def class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each label that have a bucket; bucket -1 counts all texts."""
    counts = np.zeros((2, BUCKETS + 1), dtype=np.int64)
    for part, texts in text_runs(batches, "text"):
        labels = part.column(part.schema.get_field_index("label")).to_pylist()
        for label, found in zip(labels, indicators(texts), strict=True):
            counts[label, found] += 1
            counts[label, -1] += 1
    there = np.flatnonzero(counts.any(axis=0))
    places = np.where(there == BUCKETS, -1, there)
    columns = [pa.array(places), *[pa.array(row[there]) for row in counts]]
    yield pa.RecordBatch.from_arrays(columns, names=["bucket", "bad", "good"])


@dataclass(frozen=True)
class Quality:
    """Weights of the indicators, their squared scales, and the curve of the margins."""

    weights: np.ndarray
    squares: np.ndarray
    offset: float
    slope: float
    shift: float

    def margins(self, sets: Iterator[np.ndarray]) -> np.ndarray:
        out = []
        for found in sets:
            length = self.squares[found].sum()
            out.append(self.offset + (self.weights[found].sum() / np.sqrt(length) if length else 0.0))
        return np.array(out)

    def scores(self, texts: list[str]) -> np.ndarray:
        return chances(self.slope * self.margins(indicators(texts)) + self.shift)


def chances(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def log_ratios(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Of the classes' smoothed counts, each class's brought to a sum of one."""
    p, q = good + SMOOTHING, bad + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descended(sets: list[np.ndarray], labels: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (with the scales in them) and offset of the least hinge loss, by dual
    coordinate descent: a row's multiplier takes its best value while the others rest. The
    rarer class costs more, so that both weigh alike."""
    signs = np.where(labels == 1, 1.0, -1.0)
    each = np.bincount(labels, minlength=2)
    cost = COST * len(labels) / (2 * np.maximum(each, 1))[labels]
    lengths = np.array([np.sqrt(np.square(scale[found]).sum()) for found in sets])
    scales = 1 / np.where(lengths > 0, lengths, 1.0)
    # A constant of one beside the indicators is the offset.
    squares = (lengths > 0) + 1.0
    multipliers = np.zeros(len(sets))
    weights, offset = np.zeros(len(scale)), 0.0
    random = np.random.default_rng(5)
    for _ in range(EPOCHS):
        worst = 0.0
        for i in random.permutation(len(sets)):
            found = sets[i]
            x = scale[found] * scales[i]
            slope = signs[i] * (weights[found] @ x + offset) - 1
            now = multipliers[i]
            if (now == 0 and slope >= 0) or (now == cost[i] and slope <= 0):
                continue
            worst = max(worst, abs(slope))
            multipliers[i] = min(max(now - slope / squares[i], 0.0), cost[i])
            step = (multipliers[i] - now) * signs[i]
            weights[found] += step * x
            offset += step
        if worst < SLACK:
            break
    return weights * scale, offset


def curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve with the least log loss, by Newton steps; the
    targets are drawn in by the counts, so that a clean cut has a finite slope."""
    good, bad = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    place = np.array([0.0, np.log((good + 1) / (bad + 1))])
    x = np.column_stack([margins, np.ones(len(margins))])

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float((np.logaddexp(0, z) - target * z).sum())

    for _ in range(100):
        p = chances(x @ place)
        gradient = x.T @ (p - target)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-9 * np.eye(2), gradient)
        size = 1.0
        while size > 1e-6 and loss(place - size * step) > loss(place):
            size /= 2
        place = place - size * step
        if np.abs(step).max() < 1e-9:
            break
    return float(place[0]), float(place[1])


def agreed(labels: DataFrame, key: str, label: str) -> DataFrame:
    """One label per id; ids without one, or with both, are left out."""
    known = labels.where(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{key}`").isNotNull())
    each = known.groupBy(F.col(f"`{key}`").alias("id")).agg(
        F.min(f"`{label}`").cast("int").alias("label"), F.max(f"`{label}`").cast("int").alias("most")
    )
    return each.where("label = most").drop("most")


def sample(docs: DataFrame, labels: DataFrame, tables: Tables) -> tuple[list[np.ndarray], np.ndarray]:
    """N-grams and labels of the labelled documents whose hashed ids come first, up to the
    two bounds."""
    ids = docs.select("id").distinct().join(labels, "id")
    first = ids.withColumn("order", F.xxhash64("id")).orderBy("order", "id").limit(MOST_ROWS)
    # At most MOST_ROWS ids, so they may go to every task.
    chosen = docs.join(F.broadcast(tables.written(first, "sample")), "id").select("order", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_runs(batches, "text"):
            sets = list(indicators(texts))
            sizes = np.array([len(found) for found in sets])
            flat = pa.array(np.concatenate(sets).astype(np.int32))
            ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            columns = [part.column(0), part.column(1), pa.array(sizes), pa.ListArray.from_arrays(ends, flat)]
            yield pa.RecordBatch.from_arrays(columns, names=["order", "label", "size", "grams"])

    schema = "order long, label int, size long, grams array<int>"
    coded = tables.written(chosen.transform(by_arrow(run, schema)), "indicators")
    # Documents of one id may be many, so rows are bounded once more, together with the n-grams.
    sizes = coded.select("order", "size").orderBy("order", "size").limit(MOST_ROWS).collect()
    number = int(np.searchsorted(np.cumsum([r["size"] for r in sizes]), MOST_GRAMS, side="right"))
    if not number:
        return [], np.zeros(0, dtype=np.int64)
    kept = coded.where(F.col("order") <= sizes[number - 1]["order"])
    kept = kept.orderBy("order", "size", "grams", "label").limit(number).toArrow()
    chunks = [c for c in kept.column("grams").chunks if len(c)]
    sets = [found for c in chunks for found in np.split(c.flatten().to_numpy(), np.cumsum(c.value_lengths())[:-1])]
    return sets, kept.column("label").to_numpy().astype(np.int64)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> Quality:
    """The model of all documents of ``docs`` that ``labels`` marks 0 or 1.

    Ids with other marks, or with both, teach nothing, nor do null ids; several documents
    of one id all have its label, and null texts count as empty. The counts
    are summed by Spark over all labelled documents. The descent and the curve see at most
    ``MOST_ROWS`` of them with at most ``MOST_GRAMS`` n-grams. Where one of the labels does not
    occur (or too few rows for a curve), every text scores the share of label 1, drawn
    towards a half: 0.5 without any label.
    """
    tables = Tables()
    plain = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    marks = tables.written(agreed(labels, key, label), "labels")
    # Labels grow with the documents; each task holds those of its ids, and texts stream by.
    taught = plain.join(marks.hint("shuffle_hash"), "id").select("label", "text")
    rows = taught.transform(by_arrow(class_counts, "bucket long, bad long, good long"))
    sums = rows.groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    bucket, bad, good = (sums.column(c).to_numpy() for c in ("bucket", "bad", "good"))
    counts = np.zeros((2, BUCKETS + 1))
    counts[:, bucket] = bad, good
    totals, counts = counts[:, -1], counts[:, :-1]
    flat = float(np.log((totals[1] + 1) / (totals[0] + 1)))
    sets, known = sample(plain, marks, tables) if totals.all() else ([], np.zeros(0, dtype=np.int64))
    tables.delete()
    seen = np.arange(len(sets)) % CURVE_EACH != 0
    if min(len(set(known[seen])), len(set(known[~seen]))) < 2:
        zero = np.zeros(BUCKETS)
        return Quality(zero, zero, 0.0, 0.0, flat)
    scale = log_ratios(*counts)
    weights, offset = descended([s for s, yes in zip(sets, seen, strict=True) if yes], known[seen], scale)
    model = Quality(weights, scale * scale, offset, 1.0, 0.0)
    rest = model.margins(s for s, yes in zip(sets, seen, strict=True) if not yes)
    return Quality(weights, scale * scale, offset, *curve(rest, known[~seen]))


def scored(docs: DataFrame, model: Quality, text: str = "text") -> DataFrame:
    """The documents with ``score``, the probability of label 1, from the text alone.

    Null and empty texts have no n-grams and score what the offset says. A column named
    ``score`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = StructType([StructField("score", DoubleType())])
    return with_columns(docs, text, added, lambda texts: [shared.value.scores(texts)])


def predicted(score: str = "score", least: float = 0.3) -> Column:
    return (F.col(score) >= least).cast("int")
