"""Language identification: averaged embeddings of hashed subwords and a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import text_bytes

BITS = 15
WIDTH = 16
GRAMS = (2, 3, 4)
PER_LANGUAGE = 1000  # about so many labelled documents of each language are learned from
EPOCHS = 6
SEED = 7
UNKNOWN = "und"
NOT_LETTERS = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in range(256))
LETTER = re.compile(rb"[A-Za-z]")


def plain(data: bytes) -> bytes:
    """Lower-cased runs of letters (ASCII digits and signs part them), a space around each."""
    return b" " + b" ".join(data.decode("utf-8", "replace").lower().encode().translate(NOT_LETTERS).split()) + b" "


def buckets(data: bytes) -> np.ndarray:
    """Hash buckets of the 2 to 4 byte long subwords; a space may only begin or end one."""
    codes = np.frombuffer(data, np.uint8).astype(np.uint32)
    space = codes == 32
    found = []
    for n in GRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        value, good = codes[:m].copy(), np.ones(m, bool)
        for k in range(1, n):
            value = (value << np.uint32(8)) | codes[k : k + m]
            if k < n - 1:
                good &= ~space[k : k + m]
        hashed = ((value + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        found.append(hashed[good])
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def has_letter(data: bytes) -> bool:
    return bool(LETTER.search(data)) or any(map(str.isalpha, data.decode("utf-8", "replace")))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def examples(texts: list[bytes], labels: np.ndarray, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Unique buckets, their shares and the label: of each whole text and of two short runs of its words."""
    made = []
    for text, label in zip(texts, labels):
        data = plain(text)
        words = data.split()
        parts = [data]
        for _ in range(2 if len(words) > 3 else 0):
            size = int(rng.integers(2, 25))
            start = int(rng.integers(0, max(1, len(words) - size)))
            parts.append(b" " + b" ".join(words[start : start + size]) + b" ")
        for part in parts:
            found, counts = np.unique(buckets(part), return_counts=True)
            if len(found):
                made.append((found, (counts / counts.sum()).astype(np.float32), int(label)))
    return made


def fit(texts: list[bytes], labels: list[str]) -> dict[str, np.ndarray]:
    """Train on nine tenths of the rows; on the others fit a temperature, and the score that 99 % of right answers reach."""
    names = np.array(sorted(set(labels)))
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(texts))
    held = order[: len(order) // 10]
    place = {n: k for k, n in enumerate(names)}
    number = np.array([place[x] for x in labels])
    train = [(b, s, y) for b, s, y in examples([texts[i] for i in order[len(held) :]], number[order[len(held) :]], rng)]
    test = examples([texts[i] for i in held], number[held], rng) or train
    embed = rng.normal(0, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    total, done = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(train)):
            found, share, label = train[k]
            rate = 0.5 * (1 - done / total)
            done += 1
            rows = embed[found]
            hidden = share @ rows
            slope = softmax(hidden @ out + bias)
            slope[label] -= 1
            back = out @ slope
            out -= rate * np.outer(hidden, slope)
            bias -= 0.1 * rate * slope
            # a bucket's share is small, so its step is scaled by the root of it
            embed[found] = rows - 4 * rate * np.sqrt(share)[:, None] * back
    table = embed @ out
    logits = np.array([s @ table[b] + bias for b, s, _ in test]).reshape(len(test), len(names))
    truth = np.array([y for _, _, y in test], int)
    grid = np.geomspace(0.1, 10, 41)
    loss = [-np.log(softmax(logits * t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    scale = float(grid[int(np.argmin(loss))])
    sure = softmax(logits * scale)
    right = sure.max(axis=1)[sure.argmax(axis=1) == truth]
    least = float(np.quantile(right, 0.01)) if len(right) else 0.0
    return {"names": names, "table": (table * scale).astype(np.float32), "bias": bias * scale, "least": np.array(least)}


def learnable(docs: DataFrame, id_col: str, text_col: str, lang_col: str, held_out: Column, per_language: int) -> DataFrame:
    """``(text, lang)``: by a hash of the id, about ``per_language`` rows of each language, or all it has."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out)
    known = known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # a row for each language, as many as the model has classes; so no text moves before it is chosen
    shares = {r["lang"]: min(1.0, per_language / r["n"]) for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares:
        return known.select("text", "lang")
    share = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair]), F.col("lang"))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("id")), 11) / F.lit(float(1 << 53))
    return known.where(chance < share).select("text", "lang")


def train_model(samples: DataFrame) -> dict[str, np.ndarray] | None:
    """Fit one task's rows ``(text, lang)``; ``samples`` must be bounded. None if there are none."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        labels: list[str] = []
        for batch in batches:
            texts += text_bytes(batch)
            labels += batch.column("lang").to_pylist()
        if texts:
            order = sorted(range(len(texts)), key=lambda i: (labels[i], texts[i]))  # whatever the order in which they came
            file = io.BytesIO()
            np.savez(file, **fit([texts[i] for i in order], [labels[i] for i in order]))
            yield pa.RecordBatch.from_arrays([pa.array([file.getvalue()], pa.binary())], names=["model"])

    found = samples.repartition(1).mapInArrow(rows, "model binary").collect()
    if not found:
        return None
    with np.load(io.BytesIO(bytes(found[0]["model"]))) as arrays:
        return {k: arrays[k] for k in arrays.files}


def predict(docs: DataFrame, model: dict[str, np.ndarray] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, accepted)`` for every row, from the whole text alone.

    ``und`` with score 0 for null texts, texts without a letter, and without a model. ``accepted`` is false where the score
    is below what 99 % of right answers reach. Every row is judged by itself; an empty table gives no rows.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def answer(data: bytes) -> tuple[str, float, bool]:
        if model is None or not has_letter(data):
            return UNKNOWN, 0.0, False
        found = buckets(plain(data))
        if len(found) > 1 << BITS:
            total = np.bincount(found, minlength=1 << BITS).astype(np.float32) @ model["table"]
        else:
            total = model["table"][found].sum(axis=0)
        chances = softmax(total / max(1, len(found)) + model["bias"])
        best = int(chances.argmax())
        return str(model["names"][best]), float(chances[best]), bool(chances[best] >= model["least"])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [answer(x) for x in text_bytes(batch)]
            columns = [batch.column("doc_id"), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64()), pa.array([m[2] for m in made], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "accepted"])

    return chosen.mapInArrow(rows, f"doc_id {dict(chosen.dtypes)['doc_id']}, lang_pred string, score double, accepted boolean")


def thirds(id_col: str) -> Column:
    """Remainder by 3 of the CRC-32 of an id's text; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """:func:`predict` with a model of the rows whose :func:`thirds` is not 1, and ``held_out`` for those where it is.

    Rows with a null id, text or language are never learned from; a null id is not held out.
    """
    held_out = F.coalesce(thirds(id_col) == 1, F.lit(False))
    model = train_model(learnable(docs, id_col, text_col, lang_col, held_out, per_language))
    found = predict(docs, model, id_col, text_col)
    return found.select("doc_id", F.coalesce(thirds("doc_id") == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
