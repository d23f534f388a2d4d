"""Language ID by interpolated Kneser-Ney character models.

`train` counts character 4-grams of a bounded, hashed sample of labelled rows (DOCS_PER_LANG whole texts a language, all
their grams, all languages) and derives, for each order, one sorted array of 64-bit gram hashes with a log probability for
each language, and one of context hashes with the back-off weights. `predict` scores every whole text and takes the
lowest cross-entropy per character; a temperature fitted on held-back sample rows turns the entropies into a score,
and a threshold for each language, from the same rows, marks texts unlike any learned language as `rejected`.

Cases: texts that are null, empty or without a letter get `und` and score 0; white space, digits and signs act as one
word gap; ties go to the first language in order; without labelled rows everything is `und`; repeated rows are scored
alike and learned from once; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import buffers, id_crc, materialise, mix64, release, text_slices

ORDER = 4
DOCS_PER_LANG = 1500
DISCOUNT = 0.75
PRIME = np.uint64(0x9E3779B97F4A7C15)
_fold: list[np.ndarray] = []


def folding() -> np.ndarray:
    """Code point to its lower-case letter, 0 for anything that is no letter. Built once in each worker."""
    if not _fold:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                table[c] = ord(ch.lower()[0])
        _fold.append(table)
    return _fold[0]


def letters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters with single gaps (0), and the document of each. Every document begins with a gap."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(begins))
    code = folding()[points]
    keep = code > 0
    keep[1:] |= (code[:-1] > 0) & (doc[1:] == doc[:-1])
    gaps = np.arange(len(offsets) - 1)
    code, doc = code[keep], doc[keep]
    at = np.searchsorted(doc, gaps)
    return np.insert(code, at, 0), np.insert(doc, at, gaps)


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of letters, the letters given as columns."""
    h = columns[0].astype(np.uint64) + np.uint64(1)
    for c in columns[1:]:
        h *= PRIME
        h += c + np.uint64(1)
    return mix64(h)


def ending(code: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n letters that end at each place."""
    return gram_hash([code[at - k] for k in range(n - 1, -1, -1)])


def _inside(doc: np.ndarray) -> np.ndarray:
    """How many letters up to ORDER end at each place within its document."""
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    run = np.arange(len(doc)) - np.repeat(first, np.diff(np.concatenate((first, [len(doc)]))))
    return np.minimum(run + 1, ORDER)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        langs = np.asarray(batch.column(1).to_pylist(), object)
        code, doc = letters(*buffers(batch.column(0)))
        full = _inside(doc) == ORDER
        for lang in sorted(set(langs)):
            at = np.flatnonzero(full & (langs == lang)[doc]) if len(doc) else np.zeros(0, np.int64)
            _, first, n = np.unique(ending(code, at, ORDER), return_index=True, return_counts=True)
            last = at[first]
            points = np.stack([code[last - k] for k in range(ORDER - 1, -1, -1)], axis=1) if len(last) else np.zeros((0, ORDER), np.uint32)
            flat = pa.array(points.astype(np.int32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1, dtype=np.int32) * ORDER), flat)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(points), pa.string()), lists, pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


class Model:
    """For each order: sorted gram hashes with log probabilities [gram, language], sorted context hashes with log weights."""

    def __init__(self, langs: list[str]) -> None:
        self.langs = langs
        self.grams: list[np.ndarray] = []
        self.logs: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.weights: list[np.ndarray] = [np.zeros((0, len(langs)), np.float32)]
        self.floor = 0.0
        self.temperature, self.limits = 1.0, np.full(len(langs), np.inf)

    @classmethod
    def fit(cls, langs: list[str], lang: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> Model:
        """grams [row, ORDER] of code points with counts, all orders' statistics derived from them."""
        self = cls(langs)
        tables = [(grams, lang, counts.astype(np.float64))]
        for n in range(ORDER - 1, 0, -1):  # continuation counts: in how many longer grams of a language a suffix ends
            longer, owner, _ = tables[0]
            rows, n_distinct = np.unique(np.column_stack((owner, longer[:, 1:])), axis=0, return_counts=True)
            tables.insert(0, (rows[:, 1:], rows[:, 0], n_distinct.astype(np.float64)))
        vocabulary = max(2, len(np.unique(tables[0][0])) + 1)
        self.floor = -np.log(vocabulary)
        for n, (rows, owner, c) in enumerate(tables, 1):
            own = _row_hashes(rows)
            keys, which = np.unique(own, return_inverse=True)
            context = _row_hashes(rows[:, :-1]) if n > 1 else np.zeros(len(rows), np.uint64)
            heads, head = np.unique(context, return_inverse=True)
            total = np.zeros((len(heads), len(langs)))
            kinds = np.zeros((len(heads), len(langs)))
            np.add.at(total, (head, owner), c)
            np.add.at(kinds, (head, owner), 1.0)
            weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1e-9), 1.0)
            of = np.zeros(len(keys), np.int64)
            of[which] = head
            sample = np.zeros(len(keys), np.int64)
            sample[which] = np.arange(len(rows))
            seen = np.zeros((len(keys), len(langs)))
            np.add.at(seen, (which, owner), np.maximum(c - DISCOUNT, 0))
            lower = np.exp(self._lookup(n - 1, rows[sample][:, 1:])) if n > 1 else np.full((len(keys), len(langs)), np.exp(self.floor))
            p = seen / np.maximum(total[of], 1e-9) + weight[of] * lower
            self.grams.append(keys)
            self.logs.append(np.log(p).astype(np.float32))
            if n > 1:
                self.contexts.append(heads)
                self.weights.append(np.log(weight).astype(np.float32))
            else:
                self.unigram = np.log(weight[0]).astype(np.float32) if len(heads) else np.zeros(len(langs), np.float32)
        return self

    def _lookup(self, order: int, rows: np.ndarray) -> np.ndarray:
        code = rows.astype(np.uint64).ravel()
        at = np.arange(len(rows)) * order + order - 1
        return self._scores(code, at, np.full(len(at), order))

    def _scores(self, code: np.ndarray, at: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Log probability of the letter at each place after the (order - 1) before it, for each language."""
        out = np.zeros((len(at), len(self.langs)), np.float32)
        todo = np.arange(len(at))
        for n in range(int(order.max(initial=0)), 0, -1):
            mine, rest = todo[order[todo] >= n], todo[order[todo] < n]
            place, hit = _find(self.grams[n - 1], ending(code, at[mine], n))
            out[mine[hit]] += self.logs[n - 1][place[hit]]
            miss = mine[~hit]
            if n > 1:
                place, hit = _find(self.contexts[n - 1], ending(code, at[miss] - 1, n - 1))
                out[miss[hit]] += self.weights[n - 1][place[hit]]
            else:
                out[miss] += self.unigram + np.float32(self.floor)
                miss = miss[:0]
            todo = np.concatenate((miss, rest))
        return out

    def _index(self) -> None:
        """Where the keys of the longest grams that share their top bits begin, so that most lookups read one key."""
        keys = self.grams[-1]
        self.shift = np.uint64(64 - max(1, int(np.ceil(np.log2(4 * len(keys) + 1)))))
        self.begin = np.searchsorted(keys >> self.shift, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64)).astype(np.int32)
        self.deepest = int(np.diff(np.append(self.begin, len(keys))).max(initial=1))
        self.padded = np.append(keys, np.uint64(0))
        self.columns = [np.append(self.logs[-1][:, k], 0).astype(np.float64) for k in range(len(self.langs))]

    def entropies(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per letter [document, language], and the number of scored letters (gaps after words included)."""
        if not hasattr(self, "begin"):
            self._index()
        docs, none = len(offsets) - 1, len(self.padded) - 1
        code, doc = letters(raw, offsets)
        code = code.astype(np.uint64)
        total = np.zeros((docs, len(self.langs)))
        order = _inside(doc)
        for at in range(0, len(code), 1 << 16):
            to = min(at + (1 << 16), len(code))
            lead = min(max(at, ORDER - 1), to)
            h = gram_hash([code[lead - k : max(to - k, lead - k)] for k in range(ORDER - 1, -1, -1)])
            place = self.begin[h >> self.shift]
            hit = self.padded[place] == h
            for deeper in range(1, self.deepest):
                open_ = np.flatnonzero(~hit)
                found = open_[self.padded[np.minimum(place[open_] + deeper, none)] == h[open_]]
                place[found] += deeper
                hit[found] = True
            full = order[lead:to] == ORDER
            place = np.where(hit & full, place, none)
            of = doc[lead:to]
            for k, column in enumerate(self.columns):
                total[:, k] += np.bincount(of, weights=column[place], minlength=docs)
            rest = np.concatenate((np.arange(at, lead), lead + np.flatnonzero(~(hit & full))))
            rest = rest[order[rest] > 1]
            got = self._scores(code, rest, order[rest])
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(doc[rest], weights=got[:, k], minlength=docs)
        n = np.bincount(doc, minlength=docs) - 1
        return -total / np.maximum(n, 1)[:, None], n

    def scores(self, entropy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(entropy)), best]
        odds = np.exp(-(entropy - low[:, None]) * np.sqrt(n)[:, None] * self.temperature)
        return best, 1 / odds.sum(axis=1), low > self.limits[best]

    def calibrate(self, entropy: np.ndarray, n: np.ndarray, truth: np.ndarray) -> None:
        """Temperature of the least log loss; limits at mean + 6 deviations of a language's own texts."""
        if not len(truth):
            return
        losses = []
        for t in (grid := 2.0 ** np.arange(-3, 6)):
            z = -entropy * np.sqrt(n)[:, None] * t
            z -= z.max(axis=1, keepdims=True)
            losses.append(-np.mean(np.log(np.maximum(1e-9, np.exp(z[np.arange(len(z)), truth]) / np.exp(z).sum(axis=1)))))
        self.temperature = float(grid[int(np.argmin(losses))])
        for k in range(len(self.langs)):
            own = entropy[truth == k, k]
            if len(own) >= 10:
                self.limits[k] = own.mean() + 6 * own.std()


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    return gram_hash(list(rows.T.astype(np.uint64))) if rows.shape[1] else np.zeros(len(rows), np.uint64)


def _find(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
    place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return place, keys[place] == want


def hash_limit(rows: int, wanted: int) -> int:
    """The hash below which about 4 * wanted of so many distinct rows lie, out of 2 ** 63: in whole numbers, never 0 for any size."""
    return min((1 << 63) - 1, max(1, (4 * wanted << 63) // max(rows, 1)))


def sample_rows(docs: DataFrame, learn_from: Column, docs_per_lang: int = DOCS_PER_LANG) -> tuple[DataFrame, list[str]]:
    """(text, lang, h; the languages): of each language the docs_per_lang distinct rows (doc_id, text) of smallest hash.

    Distinct rows are estimated first, so what is ordered exactly is some thousands of keys a language. A row that repeats, or
    an id with ever more texts, takes no more places than its distinct rows.
    """
    labelled = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("doc_id", "text").bitwiseAND((1 << 63) - 1).alias("h"))
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not sizes:
        return labelled, []
    by_lang = lambda of: F.try_element_at(F.create_map(*[F.lit(x) for k, v in of.items() for x in (k, v)]), F.col("lang"))
    near = labelled.where(F.col("h") <= by_lang({r["lang"]: hash_limit(r["n"], docs_per_lang) for r in sizes})).select("lang", "h").distinct()
    placed = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= docs_per_lang)
    last = {r["lang"]: r["last"] for r in placed.groupBy("lang").agg(F.max("h").alias("last")).collect()}
    return labelled.where(F.col("h") <= by_lang(last)).dropDuplicates(["lang", "h"]), sorted(r["lang"] for r in sizes)


def train(docs: DataFrame, learn_from: Column, docs_per_lang: int = DOCS_PER_LANG) -> Model | None:
    """docs: doc_id, text, lang. Only rows where learn_from holds are read.

    One row for each language, and the grams of docs_per_lang texts for each, reach the driver.
    """
    sample, langs = sample_rows(docs, learn_from, docs_per_lang)
    if not langs:
        return None
    sample = materialise(sample, "labelled")
    rank = {lang: k for k, lang in enumerate(langs)}
    held = F.col("h") % 8 == 0
    rows = sample.where(~held).select("text", "lang").mapInArrow(_count, "lang string, gram array<int>, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = rows.toArrow()
    if not got.num_rows:
        return None
    grams = got.column("gram").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, ORDER)
    model = Model.fit(langs, np.array([rank[x] for x in got.column("lang").to_pylist()]), grams, got.column("n").to_numpy())
    check = sample.where(held).mapInArrow(_entropies(model), "lang string, entropy array<double>, n long").toArrow()
    if check.num_rows:
        model.calibrate(np.array(check.column("entropy").to_pylist()), check.column("n").to_numpy(), np.array([rank[x] for x in check.column("lang").to_pylist()]))
    release(sample)
    return model


def _entropies(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 1 << 19):
            entropy, n = model.entropies(*buffers(batch.column(0)))
            keep = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(entropy)), pa.array(n.astype(np.int64))], names=["lang", "entropy", "n"]).filter(keep)

    return run


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected, cross_entropy (of the best language, null for und)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(None).cast("double").alias("cross_entropy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, "und"], object)
        for batch in text_slices(batches, "text", 1 << 19):
            entropy, n = model.entropies(*buffers(batch.column(1)))
            best, score, rejected = model.scores(entropy, n)
            none = n <= 0
            lang = names[np.where(none, len(model.langs), best)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(rejected | none), pa.array(np.where(none, 0.0, entropy.min(axis=1)), mask=none)], names=["doc_id", "lang_pred", "score", "rejected", "cross_entropy"])

    return rows.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, rejected boolean, cross_entropy double")


def op7_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, id_crc(F.col("doc_id")) % 5 != 0)
    return predict(docs, model).select("doc_id", (id_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")


QUERIES = {"op7_language_id": op7_language_id}
