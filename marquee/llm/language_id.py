"""Languages by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from marquee.llm.common import Tables, by_arrow, text_runs, with_columns
from marquee.llm.words import U64

SIZES = (1, 2, 3)
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 0.5
# Bound of the matrix that is sent to the tasks: 32 MB.
MOST_LANGUAGES = 256
# N-grams whose log-probabilities of all languages are looked up at once (32 MB at most).
BLOCK = 1 << 15
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def gram_buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The buckets of all n-grams and the number of each one's text, in blocks of at most
    ``BLOCK`` n-grams of one size, so that a text of any length takes little besides itself."""
    low = [t.lower() for t in texts]
    ends = np.cumsum([len(t) for t in low])
    begins = ends - [len(t) for t in low]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    for at in range(0, len(points), BLOCK):
        # N-grams that begin in this block end up to two places behind it.
        end = min(at + BLOCK + max(SIZES) - 1, len(points))
        here = points[at:end].astype(U64)
        of = np.repeat(np.arange(len(texts)), np.clip(ends, at, end) - np.clip(begins, at, end))
        for size in SIZES:
            n = min(BLOCK, len(here) - size + 1)
            if n <= 0:
                continue
            total = here[:n] * U64(0x9E3779B97F4A7C15 + 2 * size)
            for i in range(1, size):
                total = (total ^ (total >> U64(29))) * U64(0xBF58476D1CE4E5B9) + here[i : i + n]
            buckets = ((total ^ (total >> U64(32))) * U64(0x94D049BB133111EB)) >> U64(64 - BUCKET_BITS)
            whole = of[:n] == of[size - 1 : size - 1 + n]
            yield buckets[whole].astype(np.int64), of[:n][whole]


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task by language and bucket; bucket -1 counts the texts."""
    counts: dict[str, np.ndarray] = {}
    texts_of: dict[str, int] = {}
    for part, texts in text_runs(batches, "text"):
        langs = part.column(0).to_pylist()
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs])
        for name in names:
            counts.setdefault(name, np.zeros(BUCKETS, dtype=np.int64))
            texts_of[name] = texts_of.get(name, 0) + langs.count(name)
        for buckets, of in gram_buckets(texts):
            grid = np.bincount(code[of] * BUCKETS + buckets, minlength=len(names) * BUCKETS)
            for i, name in enumerate(names):
                counts[name] += grid[i * BUCKETS : (i + 1) * BUCKETS]
    for name, row in counts.items():
        there = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name] * (len(there) + 1)),
                pa.array(np.append(there, -1), pa.int64()),
                pa.array(np.append(row[there], texts_of[name]), pa.int64()),
            ],
            names=["lang", "bucket", "count"],
        )


class Model:
    """Log-probabilities by bucket and language, and of the languages themselves."""

    def __init__(self, counts: np.ndarray, texts: np.ndarray, langs: list[str]) -> None:
        self.langs = langs
        likely = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
        self.grams = np.ascontiguousarray(np.log(likely).T, dtype=np.float32)
        self.prior = np.log(texts / texts.sum()) if len(langs) else np.zeros(0)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior probability; unknown without letters."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        scores = np.tile(self.prior, (len(texts), 1))
        for buckets, of in gram_buckets(texts):
            # Texts' n-grams lie together: sums between their first places.
            first = np.flatnonzero(np.diff(of, prepend=-1))
            if len(first):
                scores[of[first]] += np.add.reduceat(self.grams[buckets], first, axis=0, dtype=np.float64)
        best = scores.argmax(axis=1)
        chance = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
        letters = [LETTER.search(t) is not None for t in texts]
        names = [self.langs[b] if yes else UNKNOWN for b, yes in zip(best, letters, strict=True)]
        return names, np.where(letters, chance, 0.0)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of all documents with a language. The counts are taken once, summed by
    Spark and written to the shared folder for as long as they are read; what reaches the driver is one number per language and bucket, for at most
    ``MOST_LANGUAGES`` languages (more are an error). Null texts count as empty."""
    plain = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    rows = plain.where("lang IS NOT NULL").transform(by_arrow(gram_counts, "lang string, bucket long, count long"))
    held = Tables()
    sums = held.written(rows.groupBy("lang", "bucket").agg(F.sum("count").alias("count")), "grams")
    head = sums.where("bucket = -1").orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(head) > MOST_LANGUAGES:
        held.delete()
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = [r["lang"] for r in head]
    row = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(langs), BUCKETS))
    for batch in sums.where("bucket >= 0").toArrow().to_batches():
        names = batch.column(0).to_pylist()
        counts[[row[x] for x in names], batch.column(1).to_numpy()] = batch.column(2).to_numpy()
    held.delete()
    return Model(counts, np.array([r["count"] for r in head], dtype=float), langs)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with ``lang_pred`` and ``score``, from the text alone.

    A null, empty or letterless text is ``und`` with score 0. Of equally likely
    languages the first by name wins. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return with_columns(docs, text, added, lambda texts: list(shared.value.predict(texts)))
