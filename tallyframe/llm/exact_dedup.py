"""Exact dedup by a cuckoo-filter index over digests.

Texts are equal when identical after lower-casing A-Z. A digest is SHA-256 of the normalised text in UTF-8. Each task
holds a cuckoo filter whose slots point at stored digests: a fingerprint hit is verified against the full digest that
its bucket stores, so false positives never merge texts. Map tasks combine their own rows first, hence a group that
holds a third of all rows reaches the shuffle as one row for each map task.

A deletion that takes a digest's largest id marks its group as stale; `update_groups` finds the next largest among the
live rows. Tasks read digests in order and hand on what they hold at every COMBINE_KEYS keys.

Cases: null text counts as empty; a null doc_id joins its group and stays only if the whole group has null ids; rows
that repeat a doc_id and a text share one decision (`dedup` then returns them once); an empty table gives no rows;
extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import ascii_lower, materialise, mix64, packed, quoted

NO_ID = np.iinfo(np.int64).min
SLOTS = 4
MAX_KICKS = 200
COMBINE_KEYS = 1 << 20


class CuckooIndex:
    """A set of 32-byte digests with a largest id and a live count for each.

    `slots[b, s]` is 0 or 1 + the row of a stored key; `prints[b, s]` its 16-bit fingerprint. A key lives in bucket
    h & mask or in that bucket xor mix(fingerprint). A full pair of buckets evicts; when evictions run out, the table
    doubles and is rebuilt from the stored keys.
    """

    def __init__(self, buckets: int = 256) -> None:
        self.size, self.resizes = 0, 0
        self.keys = np.zeros((1024, 4), np.uint64)
        self.best = np.zeros(1024, np.int64)
        self.live = np.zeros(1024, np.int64)
        self.stale = np.zeros(1024, bool)
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = np.zeros((buckets, SLOTS), np.uint16)
        self.slots = np.zeros((buckets, SLOTS), np.int64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = ((keys[:, 1] >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        one = (keys[:, 0] & np.uint64(self.mask)).astype(np.int64)
        return prints, one, one ^ self._jump(prints)

    def _jump(self, prints: np.ndarray) -> np.ndarray:
        return (mix64(prints.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where absent: fingerprint hits, verified against the stored digest."""
        prints, one, two = self._places(keys)
        rows = np.full(len(keys), -1, np.int64)
        for bucket in (one, two):
            for s in range(SLOTS):
                hit = np.flatnonzero((self.prints[bucket, s] == prints) & (rows < 0) & (self.slots[bucket, s] > 0))
                ref = self.slots[bucket[hit], s] - 1
                same = (self.keys[ref] == keys[hit]).all(axis=1)
                rows[hit[same]] = ref[same]
        return rows

    def _place(self, rows: np.ndarray) -> None:
        """Put stored keys into the table: empty slots for all at once, then evictions one by one."""
        prints, one, two = self._places(self.keys[rows])
        for which in (0, 1):
            for s in range(SLOTS):
                bucket = two if which else one
                free = np.flatnonzero(self.slots[bucket, s] == 0)
                _, first = np.unique(bucket[free], return_index=True)
                take = free[first]
                self.slots[bucket[take], s] = rows[take] + 1
                self.prints[bucket[take], s] = prints[take]
                left = np.ones(len(rows), bool)
                left[take] = False
                rows, prints, one, two = rows[left], prints[left], one[left], two[left]
                if not len(rows):
                    return
        for row, fp, b in zip(rows.tolist(), prints.tolist(), one.tolist(), strict=True):
            if not self._evict(row, fp, b):
                self._resize()
                return

    def _evict(self, row: int, fp: int, bucket: int) -> bool:
        for kick in range(MAX_KICKS):
            for b in (bucket, bucket ^ int(self._jump(np.array([fp], np.uint16))[0])):
                for s in range(SLOTS):
                    if self.slots[b, s] == 0:
                        self.slots[b, s], self.prints[b, s] = row + 1, fp
                        return True
            s = (row + kick) % SLOTS
            out = int(self.slots[bucket, s]) - 1, int(self.prints[bucket, s])
            self.slots[bucket, s], self.prints[bucket, s] = row + 1, fp
            row, fp = out
            bucket ^= int(self._jump(np.array([fp], np.uint16))[0])
        return False

    def _resize(self) -> None:
        self.resizes += 1
        self._clear(2 * (self.mask + 1))
        self._place(np.flatnonzero(self.live[: self.size] > 0))

    def insert(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Add counts live rows of each digest; `best` follows the largest id. Digests may repeat."""
        if not len(keys):
            return
        uniq, inverse = np.unique(keys.view("V32").ravel(), return_inverse=True)
        uniq = uniq.view(np.uint64).reshape(-1, 4)
        best = np.full(len(uniq), NO_ID, np.int64)
        np.maximum.at(best, inverse, ids)
        total = np.bincount(inverse, weights=counts, minlength=len(uniq)).astype(np.int64)
        rows = self.find(uniq)
        old = rows >= 0
        self.best[rows[old]] = np.maximum(self.best[rows[old]], best[old])
        self.live[rows[old]] += total[old]
        self.stale[rows[old]] &= best[old] < self.best[rows[old]]
        new = np.flatnonzero(~old)
        if not len(new):
            return
        while self.size + len(new) > len(self.keys):
            self.keys = np.concatenate((self.keys, np.zeros_like(self.keys)))
            self.best = np.concatenate((self.best, np.zeros_like(self.best)))
            self.live = np.concatenate((self.live, np.zeros_like(self.live)))
            self.stale = np.concatenate((self.stale, np.zeros_like(self.stale)))
        at = np.arange(self.size, self.size + len(new))
        self.keys[at], self.best[at], self.live[at] = uniq[new], best[new], total[new]
        self.size += len(new)
        while self.size > 0.9 * SLOTS * (self.mask + 1):
            self.resizes += 1
            self._clear(2 * (self.mask + 1))
            at = np.flatnonzero(self.live[: self.size] > 0)
        self._place(at)

    def remove(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Take live rows away, ids holding the largest removed of each. A digest without live rows leaves the filter.

        Where the largest id itself goes, `best` is unknown from here: `stale` says so until a larger one comes.
        """
        uniq, inverse = np.unique(np.ascontiguousarray(keys).view("V32").ravel(), return_inverse=True)
        uniq = uniq.view(np.uint64).reshape(-1, 4)
        total = np.bincount(inverse, weights=counts, minlength=len(uniq)).astype(np.int64)
        top = np.full(len(uniq), NO_ID, np.int64)
        np.maximum.at(top, inverse, ids)
        rows = self.find(uniq)
        known = rows >= 0
        self.live[rows[known]] = np.maximum(0, self.live[rows[known]] - total[known])
        self.stale[rows[known]] |= top[known] >= self.best[rows[known]]
        gone = known & (self.live[np.where(known, rows, 0)] == 0)
        prints, one, two = self._places(uniq[gone])
        for bucket in (one, two):
            for s in range(SLOTS):
                mine = self.slots[bucket, s] == rows[gone] + 1
                self.slots[bucket[mine], s] = 0
                self.prints[bucket[mine], s] = 0

    def items(self) -> tuple[np.ndarray, ...]:
        live = self.live[: self.size] > 0
        return tuple(x[: self.size][live] for x in (self.keys, self.best, self.live, self.stale))


GROUPS = "digest binary, best_id long, members long, stale boolean"


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    digests = batch.column(0).cast(pa.binary(32))
    raw = np.frombuffer(digests.buffers()[1], np.uint8)[32 * digests.offset : 32 * (digests.offset + len(digests))]
    ids = batch.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(raw.reshape(-1, 32)).view(np.uint64), ids, batch.column(2).to_numpy(zero_copy_only=False)


def _emit(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    keys, best, live, stale = index.items()
    for at in range(0, len(keys), 65536):
        part = slice(at, at + 65536)
        raw = np.ascontiguousarray(keys[part])
        digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([digests, pa.array(best[part], mask=best[part] == NO_ID), pa.array(live[part]), pa.array(stale[part])], names=["digest", "best_id", "members", "stale"])


def _gather(ordered: bool):
    """Rows to groups. Without order a digest may come out several times; with order once, and at most a batch of keys more is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            if batch.num_rows:
                keys, ids, counts = _columns(batch)
                if (counts > 0).any():
                    index.insert(keys[counts > 0], ids[counts > 0], counts[counts > 0])
                if (counts < 0).any():
                    index.remove(keys[counts < 0], ids[counts < 0], -counts[counts < 0])
                if index.size >= COMBINE_KEYS:
                    at = index.find(keys[-1:])[0] if ordered else -1
                    if at >= 0:  # the digest that may go on in the next batch stays
                        rest = index.keys[at : at + 1].copy(), index.best[at : at + 1].copy(), index.live[at : at + 1].copy(), bool(index.stale[at])
                        index.live[at] = 0
                    yield from _emit(index)
                    index = CuckooIndex()
                    if at >= 0:
                        index.insert(*rest[:3])
                        index.stale[0] = rest[3]
        yield from _emit(index)

    return run


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, digest (32 bytes) of the normalised text."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def _merged(rows: DataFrame) -> DataFrame:
    """(digest, best_id, members) rows to one for each digest. Insertions of a digest come before its deletions."""
    return rows.repartition("digest").sortWithinPartitions("digest", F.desc("members")).mapInArrow(_gather(True), GROUPS)


def _combined(rows: DataFrame) -> DataFrame:
    """(doc_id, digest) rows to one or few for each digest and task."""
    return rows.select("digest", F.col("doc_id").alias("best_id"), F.lit(1).cast("long").alias("members")).mapInArrow(_gather(False), GROUPS).drop("stale")


def digest_groups(rows: DataFrame) -> DataFrame:
    """(doc_id, digest) rows to one row for each digest: digest, best_id (largest doc_id), members."""
    return _merged(_combined(rows)).drop("stale")


def update_groups(groups: DataFrame, rows: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The live index after inserting and then deleting (doc_id, digest) rows.

    groups: the index before; rows: the (doc_id, digest) rows it stands for. They are read for stale digests only.
    """
    gone = removed.groupBy("digest").agg(F.max("doc_id").alias("best_id"), (-F.count(F.lit(1))).alias("members"))
    changes = groups.select("digest", "best_id", "members").unionByName(_combined(added)).unionByName(gone)
    merged = materialise(_merged(changes), "index")
    signed = lambda df, n: df.select("doc_id", "digest", F.lit(n).cast("long").alias("n"))
    all_rows = signed(rows, 1).unionByName(signed(added, 1)).unionByName(signed(removed, -1))
    stale = merged.where("stale").select("digest")
    live = all_rows.join(stale, "digest", "left_semi").groupBy("digest", "doc_id").agg(F.sum("n").alias("n")).where("n > 0")
    again = live.groupBy("digest").agg(F.max("doc_id").alias("best_id"), F.sum("n").alias("members"))
    return merged.where("NOT stale").drop("stale").unionByName(again)


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialise(digests(df, id_col, text_col), "digests")
    groups = digest_groups(rows)
    joined = rows.join(groups, "digest")
    return joined.select("doc_id", F.col("best_id").alias("keep_id"), F.col("members").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("best_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, all columns, whatever their names; of repeated rows (same id and text) one stays.

    Keys alone are shuffled by digest; the texts move once, by (id, digest).
    """
    groups = digest_groups(digests(df, id_col, text_col))
    own = lambda c: F.coalesce(quoted(c).cast("long"), F.lit(int(NO_ID)))
    keys = groups.select(own("best_id").alias("id"), "digest")
    marked = packed(df, id=own(id_col), digest=F.unhex(F.sha2(ascii_lower(F.coalesce(quoted(text_col), F.lit(""))), 256)))
    return marked.join(keys, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]).select("row.*")


def op5_exact_dedup(spark, sf_dir):
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
SQL = {
    "op5_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
}
