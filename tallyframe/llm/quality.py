"""Quality classifier: histogram gradient-boosted trees over document statistics.

`statistics` turns whole texts into STATS numbers with numpy over Arrow buffers. `fit` grows logistic-loss trees on
binned statistics; a forest is flattened into four arrays (statistic, threshold, left child, value), and `Forest.margin`
walks all documents down all trees level by level. Training reads at most TRAIN_ROWS labelled documents, those with
the smallest hash of doc_id; a document that repeats with one text is read once, and of a doc_id with ever more texts
no more than TRAIN_ROWS rows are fitted.

Cases: null text counts as empty; an empty text has a score like any other (its statistics are zeros); labels that are
null or whose document is missing are left out; a document that is labelled twice counts twice, one that repeats once; with no labels, or one
class only, every score is the smoothed share of label 1 (0.5 without labels); repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import LOWER, SPACE, RangeHash, buffers, id_crc, text_slices, words

TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST = 80, 4, 64, 0.15, 8
THRESHOLD = 0.7

UPPERS, LOWERS, DIGITS, MARKS, SENTENCE, BREAKS, CONT, PIPE, BANG = range(9)
CLASSES = np.zeros((9, 256), bool)
CLASSES[UPPERS, 65:91] = CLASSES[LOWERS, 97:123] = CLASSES[DIGITS, 48:58] = True
CLASSES[MARKS, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-|"]] = True
CLASSES[SENTENCE, [ord(c) for c in ".?"]] = CLASSES[BREAKS, [10, 13]] = CLASSES[CONT, 128:192] = True
CLASSES[PIPE, ord("|")] = CLASSES[BANG, ord("!")] = True
SHARES = [UPPERS, LOWERS, DIGITS, MARKS, SENTENCE, BREAKS, PIPE, BANG]
NAMES = [
    "log_chars", "log_words", "word_chars", "word_chars_dev", "longest_word", "uppers", "lowers", "digits", "marks", "sentence", "breaks", "pipe", "bang", "spaces", "distinct_words", "repeat_next",
    "top_word", "log_lines", "line_chars", "distinct_lines", "capital_words", "upper_words", "marked_words", "short_words", "sentence_words", "accents",
]
STATS = len(NAMES)


def _per(doc: np.ndarray, docs: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights=weights, minlength=docs).astype(np.float64)


def _distinct(doc: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in each document, and the count of its commonest."""
    order = np.lexsort((h, doc))
    d, k = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(docs)
    if len(at):
        np.maximum.at(top, d[at], np.diff(np.append(at, len(d))))
    return _per(d[at], docs), top


def statistics(raw: np.ndarray, offsets: np.ndarray, ranges: RangeHash) -> np.ndarray:
    """[document, STATS] of the texts in one byte array."""
    docs = len(offsets) - 1
    out = np.zeros((docs, STATS))
    if not len(raw):
        return out
    size = np.diff(offsets)
    doc = np.repeat(np.arange(docs), size)
    count = {k: _per(doc[CLASSES[k][raw]], docs) for k in range(len(CLASSES))}
    chars = np.maximum(size - count[CONT], 1)
    starts, ends, of = words(raw, offsets)
    n = _per(of, docs)
    some = np.maximum(n, 1)
    prefix = np.concatenate(([0], np.cumsum(CLASSES[CONT][raw], dtype=np.int64)))
    length = (ends - starts) - (prefix[ends] - prefix[starts])
    mean = _per(of, docs, length) / some
    spread = np.sqrt(np.maximum(0, _per(of, docs, length.astype(np.float64) ** 2) / some - mean**2))
    longest = np.zeros(docs)
    np.maximum.at(longest, of, length)
    h = ranges(LOWER[raw], starts, ends)
    distinct, top = _distinct(of, h, docs)
    again = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    brk = np.flatnonzero(raw == 10)
    line_starts = np.unique(np.concatenate((offsets[:-1][size > 0], (brk + 1)[np.isin(brk + 1, offsets, invert=True)])))
    line_doc = doc[line_starts]
    line_ends = np.minimum(np.append(line_starts[1:], len(raw)), offsets[line_doc + 1])
    lines = _per(line_doc, docs)
    line_kinds, _ = _distinct(line_doc, ranges(raw, line_starts, line_ends), docs)
    upper = np.concatenate(([0], np.cumsum(CLASSES[UPPERS][raw], dtype=np.int64)))
    ups = upper[ends] - upper[starts]
    final = raw[ends - 1]
    columns = [
        np.log1p(size - count[CONT]), np.log1p(n), mean, spread, longest, *(count[k] / chars for k in SHARES), _per(doc[SPACE[raw]], docs) / chars, distinct / some, _per(of[1:][again], docs) / some, top / some,
        np.log1p(lines), chars / np.maximum(lines, 1), line_kinds / np.maximum(lines, 1), _per(of[CLASSES[UPPERS][raw[starts]]], docs) / some, _per(of[(ups > 1) & (2 * ups >= length)], docs) / some,
        _per(of[CLASSES[MARKS][final]], docs) / some, _per(of[length <= 2], docs) / some, _per(of[CLASSES[SENTENCE][final]], docs) / some, count[CONT] / chars,
    ]
    for k, c in enumerate(columns):
        out[:, k] = c
    return out


class Forest:
    """Trees as flat arrays. Node k of tree t goes left if x[feature[t, k]] <= threshold[t, k]; leaves point at themselves."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, value: np.ndarray) -> None:
        self.base, self.feature, self.threshold, self.left, self.value = base, feature, threshold, left, value

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                left = self.left[t][node]
                inner = left > 0
                right = x[rows, self.feature[t][node]] > self.threshold[t][node]
                node = np.where(inner, left + right, node)
            out += self.value[t][node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Newton boosting on logistic loss; splits are chosen on histograms of BINS quantile bins."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    nodes = 2 ** (DEPTH + 1) - 1
    if not len(y) or y.min() == y.max():
        empty = np.zeros((0, nodes))
        return Forest(base, empty.astype(np.int64), empty, empty.astype(np.int64), empty)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), base)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(nodes, np.int64), np.zeros(nodes)
        left, value = np.zeros(nodes, np.int64), np.zeros(nodes)
        at, free = np.zeros(len(y), np.int64), 1
        value[0] = RATE * g.sum() / (h.sum() + 1)
        level = [0]
        for _ in range(DEPTH):
            grown = []
            for node in level:
                rows = np.flatnonzero(at == node)
                if len(rows) < 2 * LEAST:
                    continue
                gs, hs, total = g[rows], h[rows], (g[rows].sum(), h[rows].sum())
                best, where = 1e-6, None
                for f in range(x.shape[1]):
                    b = binned[rows, f]
                    gl = np.cumsum(np.bincount(b, weights=gs, minlength=BINS))[:-1]
                    hl = np.cumsum(np.bincount(b, weights=hs, minlength=BINS))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=BINS))[:-1]
                    gain = gl**2 / (hl + 1) + (total[0] - gl) ** 2 / (total[1] - hl + 1) - total[0] ** 2 / (total[1] + 1)
                    gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = 0
                    gain = gain[: len(edges[f])]
                    if len(gain) and gain.max() > best:
                        best, where = gain.max(), (f, int(gain.argmax()))
                if where is None:
                    continue
                f, cut = where
                feature[node], threshold[node], left[node] = f, edges[f][cut], free
                goes = binned[rows, f] > cut
                at[rows] = free + goes
                for k in (0, 1):
                    part = rows[goes == k]
                    value[free + k] = RATE * g[part].sum() / (h[part].sum() + 1)
                grown += [free, free + 1]
                free += 2
            level = grown
        margin += value[at]
        trees.append((feature, threshold, left, value))
    return Forest(base, *(np.stack([t[k] for t in trees]) for k in range(4)))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges = RangeHash()
    for batch in text_slices(batches, "text", 1 << 19):
        x = statistics(*buffers(batch.column(0)), ranges)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "key", "x"])


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, train_rows: int = TRAIN_ROWS) -> Forest:
    """docs: doc_id, text; labels: doc_id, quality. Only labels where learn_from(doc_id) holds are read.

    The ids picked are at most train_rows, so their table can be broadcast at any size of the input. So are the rows that
    reach the driver, however often an id repeats.
    """
    picked = labels.where(learn_from & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(train_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.select("text", F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id", "text", "quality").alias("key"))
    got = rows.mapInArrow(_measure, "quality int, key long, x array<double>").dropDuplicates(["key"]).orderBy("key").limit(train_rows).toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, STATS) if got.num_rows else np.zeros((0, STATS))
    y = got.column("quality").to_numpy().astype(np.float64) if got.num_rows else np.zeros(0)
    order = np.lexsort((*x.T, y))  # the same forest whatever the order of arrival
    return fit(x[order], y[order])


def predict(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = RangeHash()
        for batch in text_slices(batches, "text", 1 << 19):
            score = forest.score(statistics(*buffers(batch.column(1)), ranges))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep_good(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows of docs whose text is predicted good, all columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = RangeHash()
        for batch in text_slices(batches, "text", 1 << 19):
            yield batch.filter(pa.array(forest.score(statistics(*buffers(batch.column(at)), ranges)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def production_forest(spark, sf_dir, docs: DataFrame | None = None) -> Forest:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    return train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), id_crc(F.col("doc_id")) % 4 != 2)


def op1_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = predict(docs, production_forest(spark, sf_dir, docs))
    return scored.select("doc_id", (id_crc(F.col("doc_id")) % 4 == 2).alias("held_out"), "score", "predicted")


QUERIES = {"op1_quality": op1_quality}
