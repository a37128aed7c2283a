"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]; the bracket is the
sum of all pairwise interactions <v_i, v_j> x_i x_j in time linear in the features of a document.

It is trained on at most 2 * `sample_rows` labelled rows outside the held-out fold, in order of a hash
of the id; every document is scored whole. A fifth of the sample sets the calibration: the cut that
separates it best is moved to a score of 0.7. Inputs are the text and its length; labels, language,
source and id are none. Null or empty texts are scored as texts without words. Repeated rows get equal
scores; other columns, whatever their names, are ignored or kept; an empty table gives no rows. Without
labelled rows of both kinds every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.quality_rules import N_FEATURES, labelled_sample, rule_statistics

BUCKETS, FACTORS, LENGTHS = 1 << 14, 8, 24
SIZE = BUCKETS + N_FEATURES + LENGTHS
#: Scales of the structure statistics, so that usual values lie between 0 and 1.
SCALES = np.array([1 / 8, 1 / 8, 1.0, 2.0, 1.0, 2.0, 2.0, 1.0, 1.0, 1.0, 1.0])
PASS = 0.7


class Features:
    """Sparse features of a text; the hashes of words are remembered up to a bound."""

    def __init__(self, remembered: int = 50_000):
        self.memo: dict[bytes, int] = {}
        self.remembered = remembered

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        _, structure = rule_statistics(text)
        counts: dict[int, int] = {}
        memo = self.memo
        for word, n in Counter(text.encode("utf-8", "surrogatepass").lower().split()).items():
            bucket = memo.get(word)
            if bucket is None:
                if len(memo) >= self.remembered:
                    memo.clear()
                bucket = memo[word] = zlib.crc32(word) % BUCKETS
            counts[bucket] = counts.get(bucket, 0) + n
        tf = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
        if len(tf):
            tf /= np.linalg.norm(tf)
        length = BUCKETS + N_FEATURES + min(int(2 * np.log1p(len(text))), LENGTHS - 1)
        at = np.concatenate([np.fromiter(counts, np.int64, len(counts)), np.arange(BUCKETS, BUCKETS + N_FEATURES), [length]])
        return at, np.concatenate([tf, np.clip(np.array(structure) * SCALES, 0, 3), [1.0]]).astype(np.float32)


class FactorisationMachine:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.b, self.w, self.v, self.shift = 0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32), 0.0

    def raw(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return self._forward(*_flat(rows))[0] if rows else np.zeros(0)

    def _forward(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.v[at] * x[:, None]
        sums = np.add.reduceat(vx, starts)
        pairs = 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(1)
        return self.b + np.add.reduceat(self.w[at] * x, starts) + pairs, sums, vx

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.08, decay: float = 1e-5, seed: int = 5) -> FactorisationMachine:
        """AdaGrad on log loss with equal weight for both labels."""
        rng = np.random.default_rng(seed)
        gb, gw, gv = 1e-6, np.full(SIZE, 1e-6, np.float32), np.full((SIZE, FACTORS), 1e-6, np.float32)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                at, x, starts = _flat([rows[k] for k in part])
                z, sums, vx = self._forward(at, x, starts)
                g = weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
                row = np.repeat(np.arange(len(part)), np.diff([*starts, len(at)]))
                used, back = np.unique(at, return_inverse=True)
                dw, dv = np.zeros(len(used)), np.zeros((len(used), FACTORS))
                np.add.at(dw, back, g[row] * x)
                np.add.at(dv, back, (g[row] * x)[:, None] * (sums[row] - vx))
                dw, dv = dw + decay * self.w[used], dv + decay * self.v[used]
                gb, gw[used], gv[used] = gb + g.sum() ** 2, gw[used] + dw**2, gv[used] + dv**2
                self.b -= rate * g.sum() / np.sqrt(gb)
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * 0.5 * dv / np.sqrt(gv[used])
        return self

    def calibrate(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> FactorisationMachine:
        """Moves the cut with the best balanced accuracy on these rows to a score of PASS."""
        z = self.raw(rows)
        if len(z) and 0 < y.mean() < 1:
            sorted_z = np.unique(z)
            cuts = np.concatenate([[sorted_z[0] - 1], (sorted_z[1:] + sorted_z[:-1]) / 2, [sorted_z[-1] + 1]])
            right = np.array([(z[y == 1] >= c).mean() + (z[y == 0] < c).mean() for c in cuts])
            best = np.flatnonzero(right >= right.max() - 1e-12)  # the middle of the best cuts, where several are equal
            self.shift = float(np.log(PASS / (1 - PASS)) - cuts[best].mean() if np.all(np.diff(best) == 1) else np.log(PASS / (1 - PASS)) - cuts[best[len(best) // 2]])
        return self

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows).astype(float) + self.shift, -30, 30)))


def _flat(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.concatenate([a for a, _ in rows]), np.concatenate([x for _, x in rows]), np.cumsum([0, *(len(a) for a, _ in rows[:-1])])


def held_out(doc_id):
    """The fold that no label is learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> FactorisationMachine | None:
    """A machine from at most 2 * sample_rows labelled rows outside the held-out fold."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for batch in batches:
            both = [of(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"at": pa.array([a.astype(np.int32) for a, _ in both], pa.list_(pa.int32())), "x": pa.array([x for _, x in both], pa.list_(pa.float32())), "quality": batch.column(1), "doc_id": batch.column(2)})

    sample = labelled_sample(docs, labels, sample_rows, ~held_out(F.col("doc_id")))
    found = sample.select("text", "quality", "doc_id").mapInArrow(features, "at array<int>, x array<float>, quality int, doc_id long").toPandas().sort_values("doc_id")
    y = (found["quality"].to_numpy() == 1).astype(float)
    if not 0 < y.sum() < len(y):
        return None
    rows = [(np.asarray(a, np.int64), np.asarray(x, np.float32)) for a, x in zip(found["at"], found["x"], strict=True)]
    check = np.array([zlib.crc32(f"fold {i}".encode()) % 5 == 0 for i in found["doc_id"]])
    if not (0 < y[check].sum() < check.sum() and 0 < y[~check].sum() < (~check).sum()):
        check[:] = True
        return FactorisationMachine().fit(rows, y).calibrate(rows, y)
    return FactorisationMachine().fit([r for r, c in zip(rows, check, strict=True) if not c], y[~check]).calibrate([r for r, c in zip(rows, check, strict=True) if c], y[check])


def _scored(texts, machine: FactorisationMachine | None, of: Features) -> np.ndarray:
    rows = [of(t.as_py() or "") for t in texts]
    return machine.scores(rows) if machine and rows else np.full(len(rows), 0.5)


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(_scored(part.column(2), model.value, of))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", F.when(F.col("score") >= PASS, 1).otherwise(0))


def keep_predicted(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> DataFrame:
    """The rows of docs that are predicted good, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield part.filter(pa.array(_scored(part.column(part.schema.get_field_index("text")), model.value, of) >= PASS))

    return docs.mapInArrow(run, docs.schema)
