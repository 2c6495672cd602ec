"""Language identification: the nearest of several centroids per language, by cosine of TF-IDF n-gram vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from labelmesh.llm.shipping import ship
from labelmesh.llm.tokens import forget
from labelmesh.runtime import cut, fits_broadcast

#: hashed n-grams (n = 1, 2, 3) of letters and word ends
DIMENSIONS, ORDERS = 4096, (1, 2, 3)
#: characters whose n-grams are counted in one go
BLOCK = 1 << 20
#: labelled rows that the centroids are fitted on, shared evenly by the languages; rows of a language that the sample grows by
SAMPLE_ROWS, LANGUAGE_ROWS, CENTROIDS = 1600, 8, 3
#: a text is rejected if its cosine is below this share of the lowest (but for one in a hundred) that texts of its language
#: and length have; lengths, in n-grams, from which a class of texts begins, and n-grams that a character gives about
REACH, LENGTHS, NGRAMS_A_CHARACTER = 0.6, (0, 16, 32, 64, 128, 256, 512, 1024, 4096), 3
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x32000)]))
    return _letters[0]


def count_ngrams(text: str) -> np.ndarray:
    """Counts of the whole text's n-grams by hash; all zero without a letter."""
    counts = np.zeros(DIMENSIONS)
    table, tail, any_letter = _is_letter(), np.empty(0, dtype=np.uint64), False
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[at:at + BLOCK].lower().encode("utf-32-le", "replace"), dtype="<u4")
        letter = table[np.minimum(codes, len(table) - 1)]
        any_letter = any_letter or bool(letter.any())
        codes = np.where(letter, codes, 32).astype(np.uint64)
        codes = np.concatenate((np.array([32], dtype=np.uint64) if at == 0 else tail[-2:], codes, [np.uint64(32)] if at + BLOCK >= len(text) else []))
        codes = codes.astype(np.uint64)
        keep = np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))
        codes = codes[keep]
        done = 0 if at == 0 else 2  # the last characters of the block before, there only to begin n-grams
        for n in ORDERS:
            if len(codes) < n:
                continue
            mixed = codes[:len(codes) - n + 1] * np.uint64(0x9E3779B1)
            for k in range(1, n):
                mixed = (mixed ^ (mixed >> np.uint64(15))) * np.uint64(0x85EBCA77) + codes[k:len(codes) - n + 1 + k] * np.uint64(0xC2B2AE3D)
            mixed = (mixed ^ (mixed >> np.uint64(17))) * np.uint64(0x27D4EB2F165667C5)
            ends = mixed[max(0, done - n + 1):]
            counts += np.bincount((ends >> np.uint64(40)) & np.uint64(DIMENSIONS - 1), minlength=DIMENSIONS)
        tail = codes
    return counts if any_letter else np.zeros(DIMENSIONS)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    of: np.ndarray  # language of each centroid
    floor: np.ndarray  # least cosine that each language accepts, by class of length

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        weighted = np.log1p(counts)
        weighted *= self.idf  # in place: a sample's vectors are held once
        size = np.linalg.norm(weighted, axis=1, keepdims=True)
        weighted /= np.where(size > 0, size, 1)
        return weighted

    def predict(self, counts: np.ndarray) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each row of counts."""
        empty = counts.sum(axis=1) == 0
        if not len(self.languages):
            return [(UNKNOWN, 0.0, True)] * len(counts)
        cosine = self.vectors(counts) @ self.centroids.T
        best = np.maximum.reduceat(cosine, np.searchsorted(self.of, np.arange(len(self.languages))), axis=1)
        nearest, first = cosine.argmax(axis=1), best.argmax(axis=1)
        power = np.exp(20 * (best - best.max(axis=1, keepdims=True)))
        score = power.max(axis=1) / power.sum(axis=1)
        length = np.searchsorted(LENGTHS, counts.sum(axis=1), "right") - 1
        far = cosine.max(axis=1) < self.floor[self.of[nearest], length]
        return [(UNKNOWN, 0.0, True) if e else (self.languages[f], float(s), bool(r)) for e, f, s, r in zip(empty, first, score, far)]


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit vectors by cosine; starts from the vectors least like the ones before."""
    centers = vectors[:1]
    while len(centers) < min(k, len(vectors)):
        centers = np.vstack((centers, vectors[(vectors @ centers.T).max(axis=1).argmin()]))
    for _ in range(rounds):
        mine = (vectors @ centers.T).argmax(axis=1)
        sums = np.stack([vectors[mine == i].sum(axis=0) if (mine == i).any() else centers[i] for i in range(len(centers))])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = sums / np.where(size > 0, size, 1)
    return centers


def fit_counts(counts: np.ndarray, langs: list[str], centroids: int = CENTROIDS) -> Model:
    keep = counts.sum(axis=1) > 0
    if not keep.all():
        counts, langs = counts[keep], [lang for lang, k in zip(langs, keep) if k]
    languages = sorted(set(langs))
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(counts.dtype)
    model = Model(languages, idf, np.empty((0, DIMENSIONS)), np.empty(0, dtype=int), np.zeros((len(languages), len(LENGTHS))))
    vectors, label = model.vectors(counts), np.array(langs)
    rows, of = [], []
    for i, language in enumerate(languages):
        own = vectors[label == language]
        centers = cluster(own, centroids)
        rows += list(centers)
        of += [i] * len(centers)
    if rows:
        model.centroids, model.of = np.stack(rows), np.array(of)
    return model


def nearness(model: Model, text: str) -> list[float | None]:
    """Largest cosine of the text cut to each class's length; null where the text is shorter."""
    sizes = [max(1, length // NGRAMS_A_CHARACTER) for length in LENGTHS]
    cuts = [count_ngrams(text[:size]) for size in sizes if size <= len(text)]
    found = (model.vectors(np.stack(cuts)) @ model.centroids.T).max(axis=1).tolist() if cuts else []
    return found + [None] * (len(sizes) - len(found))


def floors(model: Model, langs: list[str], found: np.ndarray) -> np.ndarray:
    """For each language and class of length the least cosine that is accepted. ``found``: a row of ``nearness`` each.

    A class that no row of a language reaches takes the floor of the class below it.
    """
    out, label = np.zeros((len(model.languages), len(LENGTHS))), np.array(langs)
    for i, language in enumerate(model.languages):
        own = found[label == language]
        for c in range(len(LENGTHS)):
            known = own[~np.isnan(own[:, c]), c]
            out[i, c] = REACH * float(np.quantile(known, 0.01)) if len(known) else out[i, c - 1] if c else 0.0
    return out


def held_out(key: Column) -> Column:
    """Rows that no model may learn from: the CRC-32 of the key as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 3 == 1


def _counted(rows: DataFrame, columns: list[str]) -> DataFrame:
    def run(batches):
        forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = [count_ngrams(t.as_py() or "").astype(np.float32) for t in part.column(part.schema.get_field_index("text"))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(columns))), pa.array(counts, pa.list_(pa.float32()))], names=[*columns, "counts"])

    schema = T.StructType([rows.schema[c] for c in columns]).add("counts", T.ArrayType(T.FloatType()))
    return rows.select(*columns, "text").mapInArrow(run, schema)


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fits on about ``sample_rows`` labelled rows, or ``LANGUAGE_ROWS`` a language if these are more, the same on every run.

    Every language has a row at least; rows equal in key, text and language count once.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("key")))
    order = F.xxhash64(F.lit("language"), "key", "text")
    rows = rows.withColumn("order", order).withColumn("draw", F.pmod("order", F.lit(1 << 30)) / float(1 << 30))
    sizes = cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least")), "language-sizes")
    languages = sizes.count()
    if not languages:
        return fit_counts(np.zeros((0, DIMENSIONS)), [])
    each = max(sample_rows / languages, LANGUAGE_ROWS)
    sizes = F.broadcast(sizes) if fits_broadcast(languages, 100) else sizes
    sample = rows.join(sizes, "lang").filter((F.col("draw") < F.lit(float(each)) / F.col("n")) | (F.col("draw") == F.col("least")))
    sample = cut(sample.select("lang", "order", "text").dropDuplicates(["lang", "order"]), "language-sample")
    found = _counted(sample, ["lang", "order"]).toArrow()
    langs = found.column("lang").to_pylist()
    rank = np.lexsort((np.array(langs), np.array(found.column("order").to_pylist()))) if langs else []
    counts, place, at = np.empty((len(langs), DIMENSIONS), dtype=np.float32), np.argsort(rank), 0
    for chunk in found.column("counts").chunks:  # rows go straight to their places
        counts[place[at:at + len(chunk)]] = chunk.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)
        at += len(chunk)
    del found
    model = fit_counts(counts, [langs[i] for i in rank])
    if not len(model.languages):
        return model

    def near(batches):
        forget()
        for batch in batches:
            rows = [nearness(model, t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["lang", "near"])

    cosines = sample.select("lang", "text").mapInArrow(near, "lang string, near array<double>").toArrow()
    model.floor = floors(model, cosines.column("lang").to_pylist(), np.array(cosines.column("near").to_pylist(), dtype=float).reshape(-1, len(LENGTHS)))
    return model


def language_of(text: Column, model: Model, spark: SparkSession) -> Column:
    """Struct (lang_pred, score, rejected) of each whole text. The model travels with the function."""
    ship(spark)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    @F.arrow_udf(kind)
    def identify(texts: pa.Array) -> pa.Array:
        forget()
        out = []
        for at in range(0, len(texts), 256):
            out += model.predict(np.stack([count_ngrams(t.as_py() or "") for t in texts.slice(at, 256)]))
        return pa.StructArray.from_arrays(
            [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.float64()), pa.array([r[2] for r in out], pa.bool_())],
            names=["lang_pred", "score", "rejected"])

    return identify(text.cast("string"))


def identify_languages(docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: key, ``held_out``, ``lang_pred``, ``score`` and ``rejected``.

    Fitted on ``docs`` unless a model is given; predictions read the whole text and nothing else. A null text or one
    without a letter is ``und`` with score 0 and rejected, as is every text if there is no labelled row. Ties go to the
    language first in order. Repeated rows and null keys are predicted row by row; an empty table gives no rows.
    """
    model = model or fit(docs, key=key, text=text, lang=lang)
    rows = docs.select(F.col(key).alias("key"), language_of(F.col(text), model, docs.sparkSession).alias("found"))
    return rows.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "found.lang_pred", "found.score", "found.rejected")
