"""Substring dedup by difference-cover anchors.

A window is WINDOW consecutive words of one document. A word goes if a window that covers it has a word sequence that
also starts anywhere else, in another document or further on in the same one.

COVER is a difference cover modulo PERIOD: for any two word positions i and j there is a shift below PERIOD that takes
both to positions whose remainders lie in COVER. So of two equal windows, at least one anchor (a run of
WINDOW - PERIOD + 1 words at a cover position) lies at the same shift in both, and only anchors, about one word in four,
have to be compared over the whole corpus. Where an anchor repeats, its document is looked at again: the anchor extends
to every window that holds it at a shift below PERIOD, and the 128-bit hashes of these windows are compared in turn.

Anchors and windows that repeat within a slice of some megabytes are known at once. Of each such group one row goes to
the others' shuffle key and the rest go by their document, so a passage that stands in a third of all documents reaches the task
of its key once for each slice. No group is held in memory, and texts are never compared in pairs.

Cases: null and empty texts, and texts of fewer than WINDOW words, lose nothing; null and repeated doc_ids do not matter,
as each row is a document of its own (rows that repeat whole lose their windows like any copies); an empty table gives no
rows; extra columns are kept by `cut`, whatever their names. Two different windows are taken for one with odds of about
n ** 2 / 2 ** 129 for n windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import SPACE, RangeHash, buffers, materialise, materialise_freeing, mix64, packed, release, text_slices, words

WINDOW = 35
#: A perfect difference set: each difference modulo 21 but 0 occurs once.
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
SLICE = 4 << 20
PIECE = 1 << 20


class SequenceHash:
    """64-bit hashes of runs of consecutive words, from prefix sums of the words' own hashes."""

    def __init__(self, values: np.ndarray, base: int) -> None:
        n = len(values) + 1
        power, self.inverse = (RangeHash._powers(b, n)[:n] for b in (base | 1, pow(base | 1, -1, 1 << 64)))
        self.prefix = np.zeros(n, np.uint64)
        np.cumsum(values * power[:-1], out=self.prefix[1:])

    def __call__(self, starts: np.ndarray, length: int) -> np.ndarray:
        return mix64((self.prefix[starts + length] - self.prefix[starts]) * self.inverse[starts])


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each word, in pieces of about PIECE bytes, so that one long text needs little more than itself."""
    out, at, own = np.empty(len(starts), np.uint64), 0, RangeHash()
    while at < len(starts):
        first = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, first + PIECE, side="right")))
        out[at:to] = own(raw[first : ends[to - 1]], starts[at:to] - first, ends[at:to] - first)
        at = to
    return out


class Words:
    """Words of a batch of texts: their places, document numbers, places within the document, and document lengths."""

    def __init__(self, texts: pa.Array) -> None:
        self.raw, self.offsets = buffers(texts)
        self.starts, self.ends, self.doc = words(self.raw, self.offsets)
        self.count = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.place = np.arange(len(self.doc)) - self.first[self.doc]

    def hashes(self) -> np.ndarray:
        return word_hashes(self.raw, self.starts, self.ends)


def _shared(keys: np.ndarray, second: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shuffle keys, second keys, known): known where a pair of keys stands twice; all but the first of a pair go by their row instead."""
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    leader = first[inverse]
    same = second == second[leader]
    held = np.bincount(inverse, weights=same, minlength=len(counts))[inverse]
    follower = same & (leader != np.arange(len(keys)))
    return np.where(follower, row.astype(np.uint64), keys), np.where(follower, 0, second), same & (held > 1)


def _column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, kind)


def _signed(place: np.ndarray, known: np.ndarray) -> pa.Array:
    return pa.array(np.where(known, ~place, place).astype(np.int32), pa.int32())


def _anchors(window: int, period: int, cover: tuple[int, ...]):
    at_cover = np.isin(np.arange(period), cover)
    length = window - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE):
            w = Words(part.column("text"))
            long = w.count[w.doc] >= window
            starts = np.flatnonzero(long & at_cover[w.place % period] & (w.place + length <= w.count[w.doc]))
            if not len(starts):
                continue
            keys = SequenceHash(w.hashes(), RangeHash.BASE)(starts, length)
            row = part.column("row").to_numpy()[w.doc[starts]]
            keys, _, known = _shared(keys, keys, row)
            yield pa.record_batch([_column(keys, pa.int64()), pa.array(row), _signed(w.place[starts], known)], names=["key", "row", "place"])

    return run


def _windows(window: int, period: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE):
            w = Words(part.column("text"))
            lists = part.column("places")
            at, offsets = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(part.num_rows), offsets)
            at = np.where(at < 0, ~at, at)
            last = np.minimum(at, w.count[doc] - window)
            edge = np.zeros(len(w.doc) + 1, np.int64)
            np.add.at(edge, w.first[doc] + np.maximum(at - period + 1, 0), 1)
            np.add.at(edge, w.first[doc] + last + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            if not len(starts):
                continue
            own = w.hashes()
            one, two = (SequenceHash(v, b)(starts, window) for v, b in ((own, RangeHash.BASE), (mix64(own ^ np.uint64(0x5851F42D4C957F2D)), 0xD1342543DE82EF95)))
            row = part.column("row").to_numpy()[w.doc[starts]]
            keys, two, known = _shared(one, two, row)
            yield pa.record_batch([_column(keys, pa.int64()), _column(two, pa.int64()), pa.array(row), _signed(w.place[starts], known)], names=["key", "key2", "row", "place"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE):
            w = Words(part.column("text"))
            lists = part.column("places")
            at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            at = w.first[doc] + np.where(at < 0, ~at, at)
            edge = np.zeros(len(w.doc) + window + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            gone = np.cumsum(edge)[: len(w.doc)] > 0
            kept = np.flatnonzero(~gone)
            follows = np.zeros(len(kept), bool)
            follows[:-1] = w.doc[kept[1:]] == w.doc[kept[:-1]]
            # the byte after a word is white space of its own document if another kept word follows
            span = np.zeros(len(w.raw) + 2, np.int8)
            span[w.starts[kept]] += 1
            span[w.ends[kept] + follows] -= 1
            taken = np.cumsum(span[: len(w.raw)], dtype=np.int8) > 0
            data = np.where(SPACE[w.raw], np.uint8(0x20), w.raw)[taken]
            offsets = np.concatenate([[0], np.cumsum(taken)])[w.offsets].astype(np.int64)
            text = pa.LargeStringArray.from_buffers(part.num_rows, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
            removed = np.bincount(w.doc[gone], minlength=part.num_rows).astype(np.int64)
            carried = [c for c in part.schema.names if c not in ("text", "places")]
            yield pa.record_batch([*map(part.column, carried), pa.array(w.count), pa.array(removed), text], names=[*carried, "n_words", "n_removed", "kept"])

    return run


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(row, places) of the rows whose keys stand more than once or were known to."""
    counted = rows.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return counted.where("held > 1 OR place < 0").groupBy("row").agg(F.collect_list("place").alias("places"))


def cut_words(texts: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """texts: row (long, unique), text (string, not null) and what else is to be carried along.

    Result: texts without `text`, with n_words, n_removed and kept (the words that stay, joined by one space). Each step is
    a table of its own whose shuffle is freed before the next one begins, so the disk holds one of them at a time.
    """
    if not 0 < period <= window:
        raise ValueError("the period must not be longer than the window")
    anchors = texts.select("row", "text").mapInArrow(_anchors(window, period, cover), "key long, row long, place int")
    held = materialise_freeing(_repeated(anchors, ["key"]), "anchors")
    candidates = materialise_freeing(texts.select("row", "text").join(held, "row"), "candidates", "zstd")
    windows = candidates.mapInArrow(_windows(window, period), "key long, key2 long, row long, place int")
    starts = materialise_freeing(_repeated(windows, ["key", "key2"]), "starts")
    release(held, candidates)
    found = texts.join(starts, "row", "left").select(*texts.columns, F.coalesce("places", F.array().cast("array<int>")).alias("places"))
    carried = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return found.mapInArrow(_cut(window), f"{carried}, n_words long, n_removed long, kept string")


def cut(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs, all columns, with the words that stay as text. Texts that lose nothing stay as they are, null too."""
    rows = packed(docs, text=F.coalesce(F.col(text_col).cast("string"), F.lit(""))).select(F.col("row").alias("whole"), "text")
    rows = materialise(rows.select(F.monotonically_increasing_id().alias("row"), "whole", "text"), "numbered", "zstd")
    less = cut_words(rows.select("row", "text"), **options).where("n_removed > 0").select("row", "kept")
    name = "`" + text_col.replace("`", "``") + "`"
    new = F.col("whole").withField(name, F.coalesce(F.col("kept"), F.col(f"whole.{name}").cast("string")))
    return rows.select("row", "whole").join(less, "row", "left").select(new.alias("whole")).select("whole.*")


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay as a text), for each row of docs."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return cut_words(materialise(rows, "numbered", "zstd"), **options).drop("row")


def op13_substring_dedup(spark, sf_dir):
    found = repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op13_substring_dedup": op13_substring_dedup}
SQL = {
    "op13_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
windows AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM d, unnest(range(1, len(w) - 33)) AS u(i)
),
repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT r, list(DISTINCT i + o) AS at FROM repeated, unnest(range(0, 35)) AS u(o) GROUP BY r),
kept AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(len(g.at), 0) AS n_removed,
         CASE WHEN g.r IS NULL THEN d.w ELSE list_filter(d.w, lambda x, i: NOT list_contains(g.at, i)) END AS words
  FROM d LEFT JOIN gone g ON g.r = d.r
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(words, ' ')) AS kept_sha256 FROM kept
"""
}
