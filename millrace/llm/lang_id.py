"""Language identification by error-correcting output codes over byte n-grams.

Each language gets a codeword of bits: all distinct splits of the languages while there are at most six, else
seeded random codewords, drawn several times and kept by the largest smallest distance. One logistic classifier for each
bit learns from hashed byte 1- to 3-grams of a text. A text's language is the codeword with the least logistic loss
summed over the bits, each bit weighted by how well its classifier did in training. The result is ambiguous if the
second codeword's loss is close.

Training takes at most `SAMPLE` texts of each language, those of the smallest xxhash64 of the text (ties by doc_id): a
bound on the classifier's fit only. A text of the sample is counted whole. One task gets their feature vectors (`DIM`
numbers each) and fits; the driver gets the fitted weights.

Defined results. A null text, or one without a letter, is "und" with score 0. Without a labelled text that has a
letter, all are "und"; with one language only, all texts with a letter get it, with score 1. Null lang is unlabelled.
Repeated rows each give a row and are sampled once. Other columns are never inputs.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, record, small_batches

UNKNOWN = "und"
DIM = 4096
SAMPLE = 600
ROUNDS = 200
RATE = 2.0
DECAY = 1e-4
#: The losses of the two best codewords differ by less than this share of the second: ambiguous.
AMBIGUOUS = 0.1
#: Languages beyond this need fewer splits than all of them.
ALL_SPLITS = 6
#: Bytes of text at a time.
CHUNK_BYTES = 1 << 20

PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_()), ("second", pa.string())])
PREDICTED_DDL = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean, second string"


def features(text: str) -> np.ndarray | None:
    """A unit vector of hashed byte 1-, 2- and 3-grams; None if the text has no letter."""
    if not any(map(str.isalpha, text)):
        return None
    raw = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    grams = [raw * np.uint32(0x9E3779B1)]
    if len(raw) > 1:
        two = raw[:-1] << np.uint32(8) | raw[1:]
        grams.append(two * np.uint32(0x85EBCA77))
        if len(raw) > 2:
            grams.append((two[:-1] << np.uint32(8) | raw[2:]) * np.uint32(0xC2B2AE3D))
    shift = np.uint32(32 - (DIM - 1).bit_length())
    count = np.zeros(DIM)
    for g in grams:
        count += np.bincount((g >> shift).astype(np.int64), minlength=DIM)
    count = np.sqrt(count)
    return (count / np.sqrt(count @ count)).astype(np.float32)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of bits as -1 and 1, each pair of rows far apart, no column constant."""
    if k <= ALL_SPLITS:
        rows = [c for c in itertools.product((-1, 1), repeat=max(k - 1, 0)) if k < 2 or -1 in c]
        return np.array([[1] * len(rows), *np.array(rows).T.tolist()], np.float32) if k > 1 else np.ones((1, 1), np.float32)
    rng, width, best = np.random.default_rng(seed), max(15, 4 * int(np.ceil(np.log2(k)))), (-1, None)
    for _ in range(200):
        code = rng.choice((-1, 1), (k, width))
        far = ((width - code @ code.T) // 2)[np.triu_indices(k, 1)].min() if (np.abs(code.sum(0)) < k).all() else -1
        if best[1] is None or far > best[0]:
            best = (far, code)
    return best[1].astype(np.float32)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """For each row of x the weighted loss of each language's codeword."""
        margin = x @ self.weights + self.bias
        return np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.trust


def fit(x: np.ndarray, y: list[str]) -> Model:
    """Logistic regression for each bit, by gradient steps over all rows; each language counts the same."""
    languages = tuple(sorted(set(y)))
    code = codewords(len(languages))
    place = np.array([languages.index(v) for v in y])
    target = code[place]
    share = (1 / np.bincount(place))[place][:, None] / len(languages)
    weights, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    rate, share = np.float32(RATE * 10), share.astype(np.float32)
    for _ in range(ROUNDS):
        pull = share * target / (1 + np.exp(np.clip(target * (x @ weights + bias), -30, 30)))
        weights += rate * (x.T @ pull - np.float32(DECAY) * weights)
        bias += rate * np.float32(0.1) * pull.sum(0)
    right = (share * (target * (x @ weights + bias) > 0)).sum(0)
    trust = np.clip(2 * right - 1, 0.01, 1)
    return Model(languages, code, weights.astype(np.float32), bias.astype(np.float32), (trust / trust.sum()).astype(np.float32))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """docs: doc_id, text, lang, all of which may be learned from."""
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("h"), "text")
    ranked = labelled.select("lang", "h").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("rank") <= sample).drop("rank")
    # the largest sampled hash of each language marks its sample without moving any text
    marks = {r["lang"]: r["h"] for r in ranked.groupBy("lang").agg(F.max("h").alias("h")).toLocalIterator()}
    if not marks:
        return None
    sent = docs.sparkSession.sparkContext.broadcast(marks)
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, hashes = batch.column("lang").to_pylist(), batch.column("h").to_pylist()
            mine = [i for i, (lang, h) in enumerate(zip(langs, hashes, strict=True)) if h <= sent.value[lang]]
            found = [(langs[i], hashes[i], v.tobytes()) for i in mine if (v := features(batch.column("text")[i].as_py())) is not None]
            if found:
                yield record(schema, *map(list, zip(*found, strict=True)))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((lang, h, x) for b in batches for lang, h, x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        if held:
            model = fit(np.stack([np.frombuffer(x, np.float32) for *_, x in held]), [lang for lang, *_ in held])
            yield record(pa.schema([("model", pa.binary())]), [pickle.dumps(model)])

    vectors = labelled.mapInArrow(run, "lang string, h long, x binary").dropDuplicates(["lang", "h"])
    with small_batches(docs.sparkSession):
        model = vectors.repartition(1).mapInArrow(fitted, "model binary").first()
    return pickle.loads(model["model"]) if model else None


def decide(model: Model | None, texts: list[str | None]) -> list[tuple[str, float, bool, str | None]]:
    """For each text its language, score, whether that is ambiguous, and the second language."""
    vectors = [features(t) if t else None for t in texts]
    has = [i for i, v in enumerate(vectors) if v is not None]
    out: list[tuple[str, float, bool, str | None]] = [(UNKNOWN, 0.0, False, None)] * len(texts)
    if model is not None and has and len(model.languages) == 1:
        for i in has:
            out[i] = (model.languages[0], 1.0, False, None)
    elif model is not None and has:
        loss = model.losses(np.stack([vectors[i] for i in has]))
        order = np.argsort(loss, axis=1, kind="stable")
        rows = np.arange(len(has))
        gap = 1 - loss[rows, order[:, 0]] / np.maximum(loss[rows, order[:, 1]], 1e-12)
        for i, o, g in zip(has, order, gap.tolist(), strict=True):
            out[i] = (model.languages[o[0]], min(max(g, 0.0), 1.0), g < AMBIGUOUS, model.languages[o[1]])
    return out


def predict(docs: DataFrame, model: Model | None, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous and the second language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, CHUNK_BYTES):
            found = decide(sent.value, batch.column("text").to_pylist())
            yield record(PREDICTED, batch.column("doc_id"), batch.column("held_out"), *map(list, zip(*found, strict=True)))

    rows = docs.select(F.col("doc_id").cast("long"), (held_out if held_out is not None else F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, PREDICTED_DDL)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents, with all their columns, whose language is known and not ambiguous."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, CHUNK_BYTES):
            found = decide(sent.value, batch.column("text").to_pylist())
            yield batch.filter(pa.array([name != UNKNOWN and not close for name, _, close, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
