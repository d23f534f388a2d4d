"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A text becomes U+2581, then the text with spaces as U+2581; it is cut before each U+2581 that follows another character,
which no piece crosses. Within a chunk an agenda takes the best-scored pair of neighbours first, the leftmost of equals;
a candidate merge is skipped for good where a keyed hash of (seed, document, place, start, middle, end) falls below the
dropout rate, so every occurrence of a chunk has its own draws. Equal chunks of a slice are first segmented once without
dropout, which lists their candidates; an occurrence that skips none of them takes that result, any other is segmented
by itself. Chunks of up to LONG characters run together in numpy, those of like length as columns of one array, one merge
a round each; longer ones use a heap. At rate 0 the ids are those of the library.

Characters without a piece, and U+2581 itself, become byte pieces, so decoding gives every text back exactly.

Cases: null text gives null ids, an empty text none; repeated rows get the same ids; extra columns are kept by
`encode`; a text of any length is encoded whole. In decoding null ids give null, ids that are null or of no piece stand for
nothing, a first byte goes only if it is a space, and bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import RangeHash, buffers, mix64, quoted, text_slices

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
NO_PIECE = 0x110000
DROPOUT, SEED, LONG = 0.1, 20, 48
#: Bounds of the lengths that run side by side; the cost of no merge; a symbol that a merge has taken in.
WIDTHS = (4, 6, 8, 12, 16, 24)
COSTLY = np.int32(2**31 - 1)
GONE = -2
MASK = (1 << 64) - 1
A, B, C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def _mix(x: int) -> int:
    x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & MASK
    x = ((x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53) & MASK
    return x ^ (x >> 33)


def _span(i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
    """What a candidate's start, middle and end within its chunk add to the key of its draw."""
    i, j, k = (x.astype(np.uint64) for x in (i, j, k))
    return i * np.uint64(A) + j * np.uint64(B) + k * np.uint64(C)


class Codec:
    """Tables of a BPE model: characters to ids, pairs of ids to the merged id and its rank, ids to bytes."""

    def __init__(self, path: str = MODEL_PATH) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        normal = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for i in range(len(pieces))]
        scores = np.array([model.get_score(i) if ok else -np.inf for i, ok in enumerate(normal)])
        self.rank = np.empty(len(pieces), np.int64)
        self.rank[np.argsort(-scores, kind="stable")] = np.arange(len(pieces))
        ids = {p: i for i, (p, ok) in enumerate(zip(pieces, normal, strict=True)) if ok}
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.char_ids = np.full(NO_PIECE + 1, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        pairs = [(ids[p[:k]], ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        left, right, merged = (np.array(x, np.uint64) for x in zip(*pairs, strict=True))
        self._hash(left << np.uint64(32) | right, merged.astype(np.int32))
        text = [p.replace("▁", " ").encode() if ok else b"" for p, ok in zip(pieces, normal, strict=True)]
        for b, i in enumerate(self.byte_ids.tolist()):
            text[i] = bytes([b])
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.byte_ends = np.cumsum([len(x) for x in text])

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table with linear probes."""
        self.bits = int(np.ceil(np.log2(4 * len(keys))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size + 64, MASK, np.uint64), np.full(size + 64, -1, np.int32)
        at = (mix64(keys) >> np.uint64(64 - self.bits)).astype(np.int64)
        todo, self.probes = np.arange(len(keys)), 0
        while len(todo):
            free = self.keys[at[todo]] == MASK
            _, first = np.unique(at[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            todo = todo[~np.isin(todo, put)]
            at[todo] += 1
            self.probes += 1
        assert self.probes < 64

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each pair's merge, -1 for none."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = (mix64(keys) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        todo = np.flatnonzero((out < 0) & (self.keys[at] != MASK) & (left >= 0) & (right >= 0))
        for _ in range(1, self.probes):
            if not len(todo):
                break
            at[todo] += 1
            found = self.keys[at[todo]]
            out[todo] = np.where(found == keys[todo], self.values[at[todo]], -1)
            todo = todo[(out[todo] < 0) & (found != MASK)]
        out[(left < 0) | (right < 0)] = -1
        return out

    def heap(self, code: list[int], key: int, drop: int) -> list[int]:
        """Ids of one chunk through an agenda; -1 - place for a character without a piece."""
        ids = self.char_ids[code].tolist()
        n = len(ids)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            m = int(self.merged(np.array([ids[i]]), np.array([ids[j]]))[0])
            if m >= 0 and (not drop or _mix((key + i * A + j * B + end[j] * C) & MASK) >= drop):
                heapq.heappush(agenda, (int(self.rank[m]), i, j, end[j], m))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, stop, m = heapq.heappop(agenda)
            if ids[i] is None or end[i] != j or ids[j] is None or end[j] != stop:
                continue
            ids[i], ids[j], end[i] = m, None, stop
            if stop < n:
                before[stop] = i
                offer(i, stop)
            if before[i] >= 0:
                offer(before[i], i)
        return [(-1 - i) if x == -1 else x for i, x in enumerate(ids) if x is not None]

    def chunks(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, drop: int, seen: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment chunks code[start:end] together: ids, their places in code, and the chunk of each, in order.

        seen takes (chunk, spans) of all candidates, spans as _span has them.

        A character without a piece has id -1.
        """
        size = ends - starts
        longest = int(size.max(initial=0))
        if not longest:
            return (np.zeros(0, np.int64),) * 3
        order = np.argsort(size, kind="stable")
        widths = [w for w in WIDTHS if w < longest] + [longest]
        got, low = [], 0
        for width, high in zip(widths, np.searchsorted(size[order], widths, side="right").tolist(), strict=True):
            if high > low:
                got += self._columns(code, order[low:high], starts, size, keys, drop, width, seen)
            low = high
        ids, place, chunk = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(chunk, kind="stable")
        return ids[order], place[order], chunk[order]

    def _columns(self, code: np.ndarray, chunk: np.ndarray, starts: np.ndarray, size: np.ndarray, keys: np.ndarray, drop: int, width: int, seen: list | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Chunks of up to `width` characters side by side, a column each: character k in row k + 1, rows without a piece around.

        `after` and `before` are the rows of a symbol's neighbours, `to` the id of its merge with the next one, and `cost`
        that merge's rank and the row, so a column's least cost is its next merge. Columns that are done leave from time to time.
        """
        bits, drop_at, out = (width + 1).bit_length(), np.uint64(drop), []
        row = np.arange(width + 2, dtype=np.int32)[:, None]
        inside = (row > 0) & (row <= size[chunk])
        ids = np.where(inside, self.char_ids[code[np.minimum(starts[chunk] + np.maximum(row - 1, 0), len(code) - 1)]], -1).astype(np.int32)
        before, after = np.repeat(row - 1, len(chunk), 1), np.repeat(row + 1, len(chunk), 1)
        to, cost = np.full(ids.shape, -1, np.int32), np.full(ids.shape, COSTLY, np.int32)

        def offer(col: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            """Price the merges of the symbols in rows left and right of columns col."""
            n = ids.shape[1]
            at, other = left * n + col, right * n + col
            flat = ids.reshape(-1)
            m = self.merged(flat[at], flat[other])
            ok = m >= 0
            if drop or seen is not None:
                w = np.flatnonzero(ok)
                of = chunk[col[w]]
                span = _span(left[w] - 1, right[w] - 1, after.reshape(-1)[other[w]] - 1)
                if seen is not None:
                    seen.append((of, span))
                if drop:
                    ok[w] = mix64(keys[of] + span) >= drop_at
            to.reshape(-1)[at] = m
            cost.reshape(-1)[at] = np.where(ok, self.rank[m] << bits | left, COSTLY)

        first, col = np.nonzero(inside[:-1] & inside[1:])
        offer(col, first, first + 1)
        while True:
            least = cost.min(axis=0)
            col = np.flatnonzero(least < COSTLY)
            if 4 * len(col) <= 3 * len(chunk):
                done = np.flatnonzero(least == COSTLY)
                which, at = np.nonzero((ids[1:-1, done] > GONE).T & (row[1:-1].T <= size[chunk[done], None]))
                of = chunk[done[which]]
                out.append((ids[at + 1, done[which]].astype(np.int64), starts[of] + at, of))
                if not len(col):
                    return out
                chunk, ids, before, after, to, cost = chunk[col], *(np.ascontiguousarray(x[:, col]) for x in (ids, before, after, to, cost))
                least, col = least[col], np.arange(len(col))
            n = len(chunk)
            left = (least[col] & ((1 << bits) - 1)).astype(np.int64)
            at = left * n + col
            right = after.reshape(-1)[at].astype(np.int64)
            gone = right * n + col
            beyond = after.reshape(-1)[gone].astype(np.int64)
            ids.reshape(-1)[at] = to.reshape(-1)[at]
            ids.reshape(-1)[gone], cost.reshape(-1)[gone] = GONE, COSTLY
            after.reshape(-1)[at] = beyond
            before.reshape(-1)[beyond * n + col] = left
            offer(np.concatenate((col, col)), np.concatenate((left, before.reshape(-1)[at].astype(np.int64))), np.concatenate((beyond, left)))

    def encode(self, raw: np.ndarray, offsets: np.ndarray, doc_keys: np.ndarray, rate: float = DROPOUT, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the n + 1 offsets of the texts in it."""
        docs = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(docs + 1, np.int64)
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        begins = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets]
        filled = np.flatnonzero(np.diff(begins))
        code = np.where(points == SPACE, NO_PIECE, np.where(points == 32, SPACE, points))
        code = np.insert(code, begins[filled], SPACE).astype(np.int64)
        first = begins[filled] + np.arange(len(filled))
        cut = (code == SPACE) & (np.concatenate(([0], code[:-1])) != SPACE)
        cut[first] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(code))
        of = np.searchsorted(first, starts, side="right") - 1
        h = RangeHash()(code.astype(np.uint32), starts, ends)
        drop = min(int(rate * 2.0**64), MASK)
        _, pick, inverse = np.unique(h, return_index=True, return_inverse=True)
        key = np.zeros(len(starts), np.uint64)
        ids, at, chunk = [], [], []

        def segment(some: np.ndarray, rate_of: int, seen: list | None = None) -> None:
            short = ends[pick[some]] - starts[pick[some]] <= LONG
            for part in np.array_split(some[short], max(1, int(short.sum()) >> 16)):
                own_seen = None if seen is None else []
                got, places, of_part = self.chunks(code, starts[pick[part]], ends[pick[part]], key[pick[part]], rate_of, own_seen)
                ids.append(got)
                at.append(places)
                chunk.append(part[of_part])
                if seen is not None:
                    seen.extend((part[c], span) for c, span in own_seen)
            for k in some[~short].tolist() if seen is None else ():
                s, e = int(starts[pick[k]]), int(ends[pick[k]])
                got = np.array(self.heap(code[s:e].tolist(), int(key[pick[k]]), rate_of), np.int64)
                ids.append(np.maximum(got, -1))
                at.append(np.where(got < 0, s - 1 - got, s))
                chunk.append(np.full(len(got), k))

        plain = np.arange(len(pick))
        if drop:
            place = (starts - first[of]).astype(np.uint64)
            key = mix64(mix64(doc_keys[filled][of] + np.uint64(seed * B & MASK)) + place * np.uint64(A))
            seen: list[tuple[np.ndarray, np.ndarray]] = []
            segment(plain, 0, seen)  # long chunks are segmented at each occurrence
            own = self._dropped(code, starts, ends, pick, inverse, key, drop, seen)
            inverse[own] = len(pick) + np.arange(len(own))
            pick = np.concatenate((pick, own))
            segment(np.arange(len(plain), len(pick)), drop)
        else:
            segment(plain, 0)
        ids, at, chunk = (np.concatenate(x) for x in (ids, at, chunk))
        order = np.argsort(chunk, kind="stable")
        ids, at, chunk = self._bytes(ids[order], code[at[order]], chunk[order])
        size = np.bincount(chunk, minlength=len(pick))
        zero = np.cumsum(size) - size
        n = size[inverse]
        total = np.cumsum(n)
        out = ids[np.arange(int(total[-1])) + np.repeat(zero[inverse] - (total - n), n)]
        per = np.zeros(docs, np.int64)
        per[filled] = np.bincount(of, weights=n, minlength=len(filled)).astype(np.int64)
        return out, np.concatenate(([0], np.cumsum(per)))

    def _dropped(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray, pick: np.ndarray, inverse: np.ndarray, key: np.ndarray, drop: int, seen: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The occurrences that skip a candidate of their chunk's segmentation without dropout, and all longer ones.

        seen: the candidates of those segmentations, as (chunk, span).
        """
        of, span = (np.concatenate(x) for x in zip(*seen, strict=True)) if seen else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        span = span[np.argsort(of, kind="stable")]
        n = np.bincount(of, minlength=len(pick))
        zero = np.cumsum(n) - n
        hit = (ends - starts > LONG) & (drop > 0)
        todo = np.flatnonzero(~hit)
        for t in range(int(n.max(initial=0))):
            todo = todo[n[inverse[todo]] > t]
            low = mix64(key[todo] + span[zero[inverse[todo]] + t]) < np.uint64(drop)
            hit[todo[low]] = True
            todo = todo[~low]
        return np.flatnonzero(hit)

    def _bytes(self, ids: np.ndarray, code: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Replace ids of -1 by the byte pieces of their characters."""
        ids = ids.astype(np.int32)
        lost = np.flatnonzero(ids < 0)
        if not len(lost):
            return ids, code, chunk
        texts = [chr(SPACE if c == NO_PIECE else c).encode() for c in code[lost].tolist()]
        n = np.ones(len(ids), np.int64)
        n[lost] = [len(x) for x in texts]
        repeat = np.repeat(np.arange(len(ids)), n)
        out = ids[repeat]
        out[out < 0] = self.byte_ids[np.frombuffer(b"".join(texts), np.uint8)]
        return out, code[repeat], chunk[repeat]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in one array, and their offsets. A text's first byte goes if it is a space."""
        ends = self.byte_ends[ids]
        n = np.diff(self.byte_ends, prepend=0)[ids]
        total = np.concatenate(([0], np.cumsum(n)))
        raw = self.bytes[np.arange(int(total[-1])) + np.repeat(ends - n - total[:-1], n)]
        at = total[offsets]
        spaced = np.diff(at) > 0
        spaced[spaced] = raw[at[:-1][spaced]] == 0x20
        keep = np.ones(len(raw), bool)
        keep[at[:-1][spaced]] = False
        return raw[keep], np.concatenate(([0], np.cumsum(np.diff(at) - spaced)))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """A worker's codec; executors read the model from the same path as the driver."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _keys(batch: pa.RecordBatch, column: int) -> np.ndarray:
    ids = batch.column(column).cast(pa.string()).to_pylist()
    return np.array([int.from_bytes(hashlib.blake2b(str(x).encode(), digest_size=8).digest(), "little") for x in ids], np.uint64)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL_PATH, rate: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """docs with a column `ids` (array<int>) in place of the text column."""
    names = [c for c in docs.columns if c not in (text_col, "ids")]
    places = [f"c{k}" for k in range(len(names))]
    others = [quoted(c).alias(k) for c, k in zip(names, places, strict=True)]
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), *others)
    schema = T.StructType([*rows.schema.fields[2:], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in text_slices(batches, "text", 1 << 20):
            raw, offsets = buffers(batch.column(1))
            ids, at = own.encode(raw, offsets, _keys(batch, 0), rate, seed)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=batch.column(1).is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], lists], names=[*places, "ids"])

    return rows.mapInArrow(run, schema).toDF(*names, "ids")


def decode(rows: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """rows with a column `text` in place of `ids`."""
    names = [c for c in rows.columns if c not in ("ids", "text")]
    places = [f"c{k}" for k in range(len(names))]
    rows = rows.select("ids", *[quoted(c).alias(k) for c, k in zip(names, places, strict=True)])
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = part.column(0)
                size = np.array([0 if x is None else x for x in ids.value_lengths().to_pylist()], np.int64)
                flat = pc.fill_null(ids.flatten().cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
                known = (flat >= 0) & (flat < len(own.byte_ends))
                left = np.concatenate(([0], np.cumsum(known)))[np.concatenate(([0], np.cumsum(size)))]
                raw, offsets = own.decode(flat[known], left)
                text = raw.tobytes()
                strings = pa.array([None if null else text[s:e].decode(errors="replace") for null, s, e in zip(ids.is_null().to_pylist(), offsets[:-1], offsets[1:], strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], strings], names=[*places, "text"])

    return rows.mapInArrow(run, schema).toDF(*names, "text")


def round_trip(docs: DataFrame, path: str = MODEL_PATH, rate: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), lossless (decoded equals the text)."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in text_slices(batches, "text", 1 << 20):
            raw, offsets = buffers(batch.column(1))
            ids, at = own.encode(raw, offsets, _keys(batch, 0), rate, seed)
            back, ends = own.decode(ids, at)
            same, null = [], batch.column(1).is_null().to_pylist()
            for k in range(batch.num_rows):
                same.append(np.array_equal(back[ends[k] : ends[k + 1]], raw[offsets[k] : offsets[k + 1]]))
            shas = [hashlib.sha256(ids[at[k] : at[k + 1]].astype("<i4").tobytes()).hexdigest() for k in range(batch.num_rows)]
            mask = np.array(null, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), mask=mask), pa.array(shas, mask=mask), pa.array(same)], names=["doc_id", "n_tokens", "ids_sha256", "lossless"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, lossless boolean")


def op3_sentencepiece(spark, sf_dir):
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
