"""Quality rules: an isolation forest over rule statistics, its threshold set from labelled rows.

Every text gets the same rule statistics. Random splits over the statistics of good labelled rows
isolate unusual documents after short paths; the mean path length gives an anomaly score. A document
is rejected if it breaks a base rule (fewer than 50 words, or more than half of its words in repeated
3-word windows) or if its score is above the threshold: the lowest one at which at most `loss` of the
good labelled rows are lost, or the one that separates the labels best, whichever is higher.

Forest and threshold come from all labelled rows that break no base rule: each good row grows one of the
trees, and the threshold is that of all scores, which count in steps of 1 / STEPS. Without labelled rows only the base rules reject. Null or empty texts have no
words and are rejected. Repeated rows are judged, and count, each by itself; other columns are ignored or kept.
Of equal thresholds the lower is taken, and a score equal to the threshold is no anomaly. Very long texts
count whole, one at a time. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, staged

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SPACE = " \t\n\x0b\x0c\r"
_GAPS = SPACE.encode()
_SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGIT, _STOP = bytes(range(65, 91)), bytes(range(48, 58)), b".,;:!?"
N_FEATURES = 11
#: Trees of the forest, and the rows that a tree has at least, if there are so many; it is as deep as these need.
TREES, TREE_ROWS = 100, 256
STEPS = 100_000


def rule_statistics(text: str) -> tuple[tuple[int, ...], list[float]]:
    """The base statistics, and the features of the forest."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    solid = raw.translate(None, _GAPS)
    chars = len(text) - (len(raw) - len(solid))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines, seen, dups = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(SPACE):
            if line in seen:
                dups += 1
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts, repeats = Counter(windows), 0
    if len(counts) < len(windows):
        end = 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeats += i + 3 - max(i, end)
                end = i + 3
    upper, digits, stops = (len(raw) - len(raw.translate(None, kind)) for kind in (_UPPER, _DIGIT, _STOP))
    m = max(n, 1)
    features = [np.log1p(n), chars / m, symbols / m, dups / max(len(lines), 1), repeats / m, upper / max(chars, 1), digits / max(chars, 1), stops / m, raw.count(b"!") / m, len(set(words)) / m, raw.count(b"|") / m]
    return (n, chars, symbols, dups, repeats), features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def average_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees as arrays, so that a batch walks down all rows at once.

    Cuts are drawn from a node's range widened by `margin` of the whole range of the feature, so that
    rows beyond anything seen in fitting, or off a constant, are cut away early too.

    Trees grow level by level from what their nodes hold (how many rows, and the range of the node's feature), which
    adds up over parts of the rows. The children of node i are 2 * i + 1 and the next.
    """

    def __init__(self, x: np.ndarray, spread: np.ndarray, trees: int = 100, rows: int = 256, margin: float = 0.3, seed: int = 7):
        """Grown from an array, each tree from `rows` rows of it."""
        rng, rows = np.random.default_rng(seed), min(rows, len(x))
        own = np.concatenate([rng.choice(len(x), rows, replace=False) for _ in range(trees)])
        self._grow(lambda forest, depth: forest.held(x[own], np.repeat(np.arange(trees), rows), depth), spread, trees, rows, margin, seed)

    @classmethod
    def grown(cls, held, spread: np.ndarray, rows: int, trees: int = 100, margin: float = 0.3, seed: int = 7) -> IsolationForest:
        """Grown from `held(forest, depth)`, the sums over all rows of what `forest.held` gives; about `rows` rows a tree."""
        forest = cls.__new__(cls)
        forest._grow(held, spread, trees, rows, margin, seed)
        return forest

    def _grow(self, held, spread: np.ndarray, trees: int, rows: int, margin: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.rows = rows
        self.depth = int(np.ceil(np.log2(min(max(rows, 2), TREE_ROWS))))
        shape = (trees, 2 ** (self.depth + 1) - 1)
        self.feature, draw = rng.integers(len(spread), size=shape), rng.random(shape)
        self.cut = np.full(shape, np.inf)
        self.path = np.tile(np.floor(np.log2(np.arange(1, shape[1] + 1))), (trees, 1))
        for depth in range(self.depth + 1):
            tree, node, n, low, high = held(self, depth)
            self.path[tree, node] = depth + average_path(n)
            if depth < self.depth:
                t, i = tree[n > 1], node[n > 1]
                low, high = (v[n > 1] + sign * margin * spread[self.feature[t, i]] for v, sign in ((low, -1), (high, 1)))
                self.cut[t, i] = low + draw[t, i] * (high - low)

    def held(self, x: np.ndarray, tree: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
        """tree, node, rows, and the least and largest value of the node's feature, for nodes of that depth that rows of these trees reach."""
        at = np.zeros(len(x), int)
        for _ in range(depth):
            inner = np.isfinite(self.cut[tree, at])
            x, tree, at = x[inner], tree[inner], at[inner]
            at = 2 * at + 1 + (x[np.arange(len(x)), self.feature[tree, at]] > self.cut[tree, at])
        order = np.lexsort((at, tree))
        tree, at, value = tree[order], at[order], x[order, self.feature[tree, at][order]]
        first = np.flatnonzero(np.r_[len(at) > 0, (at[1:] != at[:-1]) | (tree[1:] != tree[:-1])]) if len(at) else np.zeros(0, int)
        ranges = [f.reduceat(value, first) if len(at) else value for f in (np.minimum, np.maximum)]
        return tree[first], at[first], np.diff(np.r_[first, len(at)]), *ranges

    @property
    def trees(self) -> list[tuple[np.ndarray, ...]]:
        """For each tree: feature, cut (infinite at a leaf), left child (right is next) and path length at a leaf of its nodes."""
        left = 2 * np.arange(self.cut.shape[1]) + 1
        return [(f, cut, left, path) for f, cut, path in zip(self.feature, self.cut, self.path, strict=True)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly between 0 and 1 for each row."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for f, cut, left, path in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                leaf = ~np.isfinite(cut[at])
                at = np.where(leaf, at, left[at] + (x[rows, f[at]] > cut[at]))
            total += path[at]
        return 2.0 ** (-total / len(self.cut) / max(float(average_path(self.rows)), 1e-9))


def steps(forest: IsolationForest, x: np.ndarray) -> np.ndarray:
    """Scores as whole numbers of steps, so that counts of all rows by score stay small."""
    return np.rint(forest.scores(x) * STEPS).astype(np.int64)


def threshold(scores: np.ndarray, good: np.ndarray, bad: np.ndarray, loss: float) -> float:
    """The lowest cut that loses at most `loss` of the good rows, or the best separating cut if that is higher.

    scores: ascending, each once, with the numbers of good and bad rows that have it.
    """
    if not good.any():
        return np.inf
    below_good, below_bad = np.cumsum(good), np.cumsum(bad)
    allowed = float(scores[np.searchsorted(below_good, np.ceil((1 - loss) * (below_good[-1] - 1)), "right")])
    if not below_bad[-1]:
        return allowed
    return max(allowed, float(scores[np.argmax(below_good / below_good[-1] - below_bad / below_bad[-1])]))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int, condition=None) -> DataFrame:
    """At most 2 * sample_rows labelled rows (doc_id, text, quality), by a hash of the id; one label an id (the lowest)."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    if condition is not None:
        ids = ids.filter(condition)
    # twice the rows: after earlier stages some labelled documents are gone
    chosen = ids.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def _features(texts) -> tuple[list[tuple[int, ...]], np.ndarray]:
    both = [rule_statistics(t.as_py() or "") for t in texts]
    return [b for b, _ in both], np.array([f for _, f in both]).reshape(-1, N_FEATURES)


def _array(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, and the features of the forest, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                base, x = _features(part.column(1))
                columns = [pa.array(c, pa.int64()) for c in zip(*base, strict=True)]
                failed = pa.array([base_failed(b[0], b[4]) for b in base], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, failed, pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", *BASE, "base_failed", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"{_STATISTICS}, x array<double>")


def fit(rows: DataFrame, labels: DataFrame, loss: float = 0.01) -> tuple[IsolationForest | None, float]:
    """The forest and the threshold, from all labelled rows of `statistics` that break no base rule.

    Each good row grows one tree of TREES, or so many that a tree has TREE_ROWS rows. A level of all trees is one pass
    over the rows, and at most a few numbers a node come back.
    """
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    seat = F.pmod(F.xxhash64("doc_id", "x"), F.lit(TREES)).cast("int")
    found = staged(rows.filter("not base_failed").select("doc_id", "x").join(label, "doc_id").select(seat.alias("seat"), "x", (F.col("quality") == 1).alias("good")), "labelled")
    sides = [side(F.get("x", i)) for side in (F.min, F.max) for i in range(N_FEATURES)]
    n, *sides = found.agg(F.count_if("good"), *sides).first()
    if n < 2:
        discard(found)
        return None, np.inf
    good, each = found.filter("good").select("seat", "x"), min(TREES, -(-TREES * TREE_ROWS // n))

    def held(forest: IsolationForest, depth: int) -> tuple[np.ndarray, ...]:
        shared = found.sparkSession.sparkContext.broadcast(forest)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    trees = (np.array(part.column(0))[:, None] + np.arange(each)) % TREES
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in shared.value.held(np.repeat(_array(part.column(1)), each, axis=0), trees.ravel().astype(np.int64), depth)], names=["tree", "node", "n", "low", "high"])

        nodes = good.mapInArrow(run, "tree long, node long, n long, low double, high double").groupBy("tree", "node").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
        shared.destroy()
        return tuple(nodes[c].to_numpy() for c in ("tree", "node", "n", "low", "high"))

    forest = IsolationForest.grown(held, np.array(sides[N_FEATURES:]) - np.array(sides[:N_FEATURES]), n * each // TREES, TREES)
    shared = found.sparkSession.sparkContext.broadcast(forest)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(steps(shared.value, _array(batch.column(0)))), batch.column(1)], names=["step", "good"])

    counts = found.select("x", "good").mapInArrow(scored, "step long, good boolean").groupBy("step").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toPandas().sort_values("step")
    shared.destroy()
    discard(found)
    return forest, threshold(counts["step"].to_numpy(), counts["good"].to_numpy(), counts["bad"].to_numpy(), loss)


def quality_rules(docs: DataFrame, labels: DataFrame, loss: float = 0.01) -> DataFrame:
    """doc_id, the base statistics, base_failed, anomaly, kept for each row."""
    rows = staged(statistics(docs), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, loss))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, x = batch.columns
            anomaly, good = _judged(model.value, np.array(columns[-1]), _array(x))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(anomaly / STEPS), pa.array(good)], names=["doc_id", *BASE, "base_failed", "anomaly", "kept"])

    return rows.mapInArrow(run, f"{_STATISTICS}, anomaly double, kept boolean")


_STATISTICS = "doc_id long, " + ", ".join(f"{n} long" for n in BASE) + ", base_failed boolean"


def _judged(model: tuple[IsolationForest | None, float], failed: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anomalies in steps, and which rows are kept."""
    forest, cut = model
    scores = steps(forest, x) if forest else np.zeros(len(x), np.int64)
    return scores, ~failed.astype(bool) & (scores <= cut)


def keep_good(docs: DataFrame, labels: DataFrame, loss: float = 0.01) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(statistics(docs), labels, loss))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                base, x = _features(part.column(part.schema.get_field_index("text")))
                yield part.filter(pa.array(_judged(model.value, np.array([base_failed(b[0], b[4]) for b in base]), x)[1]))

    return docs.mapInArrow(run, docs.schema)
