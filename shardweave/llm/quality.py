"""Quality classifier (9): compressed size under two trained dictionaries.

One zstandard dictionary is trained on texts labelled good and one on texts
labelled bad. A text is cut into chunks (all of it; chunks keep the
dictionary's weight the same in long texts), each chunk is compressed with
both, and the difference of the summed sizes over their sum is the feature.
A logistic curve fitted on labelled rows that trained no dictionary turns it
into a score. The curve also knows how far the text compresses at all (plain
repetition does under either dictionary) and how short it is (sizes of a few
bytes say little), and weighs the sample's rows so that both classes are as
frequent as among all labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 2048  # bytes
LEVEL = 3
SHORT = 64  # bytes at which a text counts as half short


@dataclass(frozen=True)
class Model:
    """Two dictionaries (empty: nothing to learn from) and the curve's numbers: one a feature, and a constant."""

    good: bytes
    bad: bytes
    curve: tuple[float, float, float, float]

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row a text: (size under good - size under bad) / their sum, zero for empty texts; how short it is; one; log of their sum over twice the bytes."""
        out = np.zeros((len(texts), 4))
        out[:, 2] = 1
        if not self.good:
            return out
        tools = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in self._dictionaries()]
        for i, t in enumerate(texts):
            raw = (t or "").encode("utf-8", "surrogatepass")
            out[i, 1] = SHORT / (SHORT + len(raw))
            if raw:
                parts = [raw[j : j + CHUNK] for j in range(0, len(raw), CHUNK)]
                good, bad = (sum(len(tool.compress(p)) for p in parts) for tool in tools)
                out[i, 0] = (good - bad) / (good + bad)
                out[i, 3] = min(0.0, np.log((good + bad) / (2 * len(raw))))
        return out

    def _dictionaries(self) -> list[zstandard.ZstdCompressionDict]:
        made = [zstandard.ZstdCompressionDict(d) for d in (self.good, self.bad)]
        for d in made:
            d.precompute_compress(level=LEVEL)
        return made

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ np.array(self.curve), -30, 30)))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weighted logistic regression of y on the columns of x by Newton's method, with smoothed targets."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, n1, n0 = x / scale, y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (t - p)) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w / scale)


def _dictionary(texts: list[str], size: int) -> bytes:
    parts = [raw[j : j + CHUNK] for t in texts for raw in [t.encode("utf-8", "surrogatepass")] for j in range(0, len(raw), CHUNK)]
    size = min(size, max(256, sum(map(len, parts)) // 4))
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(parts)[-size:]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text is divisible by five; a null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, max_chars: int = 20000, dictionary: int = 1 << 16) -> Model:
    """Learn from labelled rows outside the held-out fifth.

    The sample is bounded: at most ``sample`` doc_ids a class, taken by the hash
    of doc_id, of texts of ``max_chars`` code points at most; of rows that repeat
    a doc_id the least text counts. Half train the dictionaries and half the
    curve. Without rows of both classes every score is one half. Conflicting
    labels of one doc_id leave it out.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2"))
    known = known.where("q = q2").where(~held_out(F.col("doc_id"))).select("doc_id", "q")
    body = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text").between(1, max_chars))
    picked = None
    for q in (0, 1):
        ids = known.where(F.col("q") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = ids if picked is None else picked.unionByName(ids)
    found = body.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "q").agg(F.min("text").alias("text"))  # picked: 2 * sample ids
    rows = found.orderBy("doc_id").collect()  # a row an id: 2 * sample texts of max_chars
    halves: dict[tuple[int, int], list[str]] = {(q, h): [] for q in (0, 1) for h in (0, 1)}
    for i, r in enumerate(rows):
        halves[int(r["q"] > 0), i % 2].append(r["text"])
    if not all(halves.values()):
        return Model(b"", b"", (0.0, 0.0, 0.0, 0.0))
    counts = {int(r["q"] > 0): r["n"] for r in known.groupBy((F.col("q") > 0).cast("int").alias("q")).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    bare = Model(_dictionary(halves[1, 0], dictionary), _dictionary(halves[0, 0], dictionary), (0.0, 0.0, 0.0, 0.0))
    x = bare.features(halves[0, 1] + halves[1, 1])
    y = np.array([0] * len(halves[0, 1]) + [1] * len(halves[1, 1]))
    share = [counts[q] / sum(counts.values()) * len(y) / len(halves[q, 1]) for q in (0, 1)]
    return Model(bare.good, bare.bad, _curve(x, y, np.where(y > 0, share[1], share[0])))


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with a score in [0, 1] in column ``out`` (which it replaces): higher is likelier good.

    Null and empty texts get the curve's value at zero. Other columns pass
    through; nothing but the text enters the score.
    """
    schema = docs.drop(out).schema
    at = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array(model.scores(b.column(at).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*b.schema.names, out])

    return docs.drop(out).mapInArrow(run, schema.add(out, "double"))
