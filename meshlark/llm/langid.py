"""Language identification by nearest centroids.

A text is a normalised TF-IDF vector of hashed byte trigrams.  Document
frequencies come from all labelled training texts; the centroids, several per
language, from a bounded sample of them by spherical k-means.  A prediction is
the language of the nearest centroid by cosine; a text is rejected if it is
farther from it than nearly all training texts, and pieces of them, with as
many trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, worker_keeps

DIMS = 8192
#: Centroids are fitted on about this many texts per language, chosen by a hash of the id; document frequencies on all.
SAMPLE_PER_LANGUAGE = 1000
#: Languages whose centroids, about 100 kB each, are compared at a time; more are compared in further passes.
BLOCK = 200
#: Labels that may be broadcast to draw the samples; a larger table of them is joined by a shuffle.
LABELS = 100_000
CENTROIDS = 3
#: A cluster with a smaller share of a language's sample starts anew elsewhere.
LEAST_CLUSTER = 0.05
#: A text is rejected below this part of the cosine that all but REJECT_QUANTILE of the training pieces of its length class reach.
REJECT_QUANTILE, REJECT_FACTOR = 0.01, 0.3
#: Length classes: powers of two of the number of different trigrams.  Training texts are cut into pieces of so many bytes to fill the short ones.
LENGTHS, PIECES = 14, (8, 16, 32, 64, 128, 256, 512, 1024, 4096)
UNDETERMINED = "und"
PIECE = 1 << 20
#: ASCII other than letters counts as a space.
_SPACED = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def trigram_counts(text: str) -> np.ndarray:
    """Counts of the hashed trigrams of a whole text, read in pieces of bounded size."""
    raw = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_SPACED) + b" "
    counts = np.zeros(DIMS, "f4")
    for at in range(0, max(len(raw) - 2, 1), PIECE):
        b = np.frombuffer(raw[at : at + PIECE + 2], "u1").astype("u4")
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        counts += np.bincount((code[code != 0x202020] * np.uint32(2654435761)) >> np.uint32(19), minlength=DIMS).astype("f4")
    return counts


def has_letter(text: str | None) -> bool:
    """A letter is a character of Unicode's category L; numbers such as a half or a Roman eight are none."""
    return any(map(str.isalpha, text or ""))


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum((counts > 0).sum(axis=-1), 1)).astype("i8"), LENGTHS - 1)


@dataclass
class Model:
    """``labels[i]`` is the language of ``centroids[i]``, and ``least[i]`` the cosine that a text needs, by length class.

    About 100 kB a language; texts are compared with BLOCK of them at a time.
    """

    idf: np.ndarray
    centroids: np.ndarray
    labels: list[str]
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        tfidf = np.log1p(counts) * self.idf
        return tfidf / np.maximum(np.linalg.norm(tfidf, axis=-1, keepdims=True), 1e-12)

    def blocks(self, languages: int) -> list[Model]:
        """Models of so many languages each."""
        number = np.unique(self.labels, return_inverse=True)[1]
        parts = [np.flatnonzero((number >= first) & (number < first + languages)) for first in range(0, number.max() + 1, languages)]
        return [Model(self.idf, self.centroids[p], [self.labels[i] for i in p], self.least[p]) for p in parts]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows.

    Starts from rows drawn with chances by their distance from those drawn
    before, so that no row far from all others decides; a cluster that catches
    hardly any rows starts anew from one of the largest cluster.
    """
    rng = np.random.default_rng(len(x))
    chosen = [int(rng.integers(len(x)))]
    while len(chosen) < min(k, len(x)):
        far = np.maximum(1 - (x @ x[chosen].T).max(axis=1), 0).astype("f8")
        far[chosen] = 0
        far = far if far.sum() > 1e-9 else (~np.isin(np.arange(len(x)), chosen)).astype("f8")
        chosen.append(int(rng.choice(len(x), p=far / far.sum())))
    centroids = x[chosen]
    for turn in range(rounds):
        nearest = np.argmax(x @ centroids.T, axis=1)
        size = np.bincount(nearest, minlength=len(centroids))
        means = np.stack([x[nearest == i].mean(axis=0) if size[i] else c for i, c in enumerate(centroids)])
        centroids = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
        if turn < rounds // 2:
            for i in np.flatnonzero(size < LEAST_CLUSTER * len(x)):
                centroids[i] = x[rng.choice(np.flatnonzero(nearest == size.argmax()))]
    return centroids


def _pieces(text: str) -> Iterator[str]:
    """The text, and a piece of every length from its middle, cut at a blank."""
    yield text
    for n in PIECES:
        if len(text) > 2 * n:
            at = len(text) // 2
            piece = text[at : at + n + 40].partition(" ")[2][:n]
            if has_letter(piece):
                yield piece


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_keeps()
    df, n = np.zeros(DIMS, "i8"), 0
    for batch in batches:
        for text in batch.column(0):
            df += trigram_counts(text.as_py()) > 0
            n += 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.append(n, df))], ["dim", "df"])


def is_held_out(id_: Column) -> Column:
    """Whether a document is kept from training: the CRC of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(False))


def _fit_language(idf: np.ndarray, k: int):
    """Centroids of one language's sample, and the cosines its texts and pieces of them have, by length class."""

    def run(sample: pd.DataFrame) -> pd.DataFrame:
        worker_keeps()
        texts = sorted(sample["text"])
        model = Model(idf, np.zeros((0, DIMS), "f4"), [], np.zeros(0))
        x, n = np.empty((len(texts), DIMS), "f4"), 0  # 32 MB of a thousand texts, the only copy
        for t in texts:
            counts = trigram_counts(t)
            if counts.any():
                x[n] = model.vectors(counts)
                n += 1
        x = x[:n]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "least": []})
        centroids = spherical_kmeans(x, k)
        reached: list[list[float]] = [[] for _ in range(LENGTHS)]
        for t in texts:
            counts = np.stack([trigram_counts(p) for p in _pieces(t)])
            for n, c in zip(length_class(counts), (model.vectors(counts) @ centroids.T).max(axis=1)):
                reached[n].append(float(c))
        low = [REJECT_FACTOR * float(np.quantile(r, REJECT_QUANTILE)) if r else 0.0 for r in reached]
        # More trigrams can only make a text surer: a class asks for no less than those before it.
        low = np.maximum.accumulate(low)
        return pd.DataFrame({"lang": [sample["lang"].iloc[0]] * len(centroids), "centroid": list(centroids.astype("f4")), "least": [low] * len(centroids)})

    return run


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, k: int = CENTROIDS,
    languages: int | None = None,
) -> Model | None:
    """Fit on rows with an id, a language and a text with letters that aren't held out; None without any.

    Every language is learned, on its own sample in a task of its own; with
    ``languages`` only so many, those with the most rows.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    train = rows.where(F.col("doc").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~is_held_out(F.col("doc")))
    sizes = materialize(train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("lang", "s_lang"), "languages")
    if languages is not None:
        sizes = sizes.orderBy(F.desc("n"), "s_lang").limit(languages)
    labels = sizes.count()
    if not labels:
        return None
    found = train.select("text").mapInArrow(_document_frequency, "dim bigint, df bigint").groupBy("dim").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(DIMS + 1)
    df[found["dim"].to_numpy() + 1] = found["df"].to_numpy()
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype("f4")
    # A share per language, by a hash of the id: the same rows whatever the partitions.
    few = F.broadcast(sizes) if labels <= LABELS else sizes
    drawn = F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) < F.lit(float(per_language)) / F.col("n") * 1_000_000
    part = train.join(few, F.col("lang") == F.col("s_lang")).where(drawn).select("text", "lang")
    fitted = part.groupBy("lang").applyInPandas(_fit_language(idf, k), "lang string, centroid array<float>, least array<double>")
    fitted = fitted.toPandas().sort_values("lang", kind="stable")  # a few centroids a language
    return Model(idf, np.stack(fitted["centroid"]).astype("f4"), list(fitted["lang"]), np.stack(fitted["least"])) if len(fitted) else None


RESULT = ("lang_pred", "score", "rejected")
FOUND = (T.StructField("lang_pred", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("least", T.DoubleType()))


def _nearest(model: Model, text_at: int):
    """Compares texts with one block of languages; a nearer centroid than those of the blocks before takes their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column(text_at).to_pylist()
                pred, cosine, least = (part.column(text_at + i).to_pylist() for i in (1, 2, 3))
                lettered = [i for i, t in enumerate(texts) if has_letter(t)]
                if lettered:
                    counts = np.stack([trigram_counts(texts[i]) for i in lettered])
                    near = model.vectors(counts) @ model.centroids.T
                    best = near.argmax(axis=1)
                    for i, b, s, low in zip(lettered, best, near.max(axis=1), model.least[best, length_class(counts)]):
                        if cosine[i] is None or s > cosine[i]:
                            pred[i], cosine[i], least[i] = model.labels[b], float(s), float(low)
                yield pa.RecordBatch.from_arrays([*part.columns[: text_at + 1], pa.array(pred, pa.string()), pa.array(cosine, pa.float64()), pa.array(least, pa.float64())], part.schema.names)

    return run


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", reject_below: float | None = None) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``, replacing columns of these names.

    A text that is null or has no letter is ``und`` with score 0, and rejected;
    so is every text if nothing could be learned.  Another is rejected if its
    cosine is below what the model asks of its language and length, or below
    ``reject_below`` if that is given, and keeps its nearest language.  Texts
    are read whole, in pieces, whatever their length, once for each block of
    languages.  Every row stands for itself, repeated or not; ids may be null;
    an empty table stays empty.
    """
    rest = [c for c in docs.columns if c not in RESULT]
    # A text is sent once, not in its row as well, unless the row has nothing else or the text is of another type there.
    own = text_col if len(rest) > 1 and text_col in rest and docs.schema[text_col].dataType == T.StringType() else None
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest if c != own]).alias("row"), F.col(text_col).cast("string").alias("text"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in FOUND))
    schema = T.StructType([*found.schema.fields[:2], *FOUND])
    for part in model.blocks(BLOCK) if model else ():
        found = found.mapInArrow(_nearest(part, 1), schema)
    low = F.col("least") if reject_below is None else F.lit(float(reject_below))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("cosine", F.lit(0.0))))
    columns = [F.col("text").alias(c) if c == own else F.col(f"row.`{c}`").alias(c) for c in rest]
    return found.select(*columns, F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"), score.alias("score"), F.coalesce(F.col("cosine") < low, F.lit(True)).alias("rejected"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fitting) -> DataFrame:
    """Fit on the labelled rows that aren't held out, and predict all: ``id_col``, ``held_out``, ``lang_pred``, ``score``, ``rejected``."""
    model = fit(docs, id_col, text_col, lang_col, **fitting)
    rows = docs.select(F.col(id_col), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("_text"))
    return predict(rows, model, "_text").drop("_text")
