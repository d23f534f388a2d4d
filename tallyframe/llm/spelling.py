"""Spelling variant grouping by full neighbourhood generation.

Words are the maximal runs of LETTERS in whole texts, A-Z lower-cased. Some are misspelt on purpose by a keyed hash of
(doc_id, word), which plants variants at a known rate. Words of at least MIN_LENGTH code points and MIN_COUNT occurrences
are the vocabulary. Two words are near if one inserted, deleted or replaced code point turns one into the other; a word's
form is its most frequent near word, if that is FACTOR times as frequent, and its root is where following forms ends.

For each vocabulary word all its distinct deletions, replacements and insertions over the letters that the vocabulary
shows are generated, and an equi-join with the vocabulary keeps those that are words, so no distance is ever computed.
A candidate is a 128-bit hash: a sum of mixed (letter, place) values, which one edit changes by prefix sums, so a
word of L letters costs L times the alphabet, never L squared. Distinct by rule: of a run of equal letters only the first
is deleted, and a letter is not inserted behind its like. A Bloom filter of the vocabulary, of at most BLOOM_BITS bits,
drops nearly all candidates that are no words where they are made; what it lets pass is settled by the join.

Counting combines the words of a task's slices before the shuffle, so neither a hot source nor a hot word reaches one task whole.
Forms are followed by doubling: a form is FACTOR times as frequent as its word, so chains are short. All joins are sort-merge
joins: words and candidates grow with the input, and compressed tables of them look small enough to broadcast.

Cases: null and empty texts have no words; a null doc_id is hashed as an empty string; repeated rows count each; words of
any length are treated alike; of near words that are equally frequent the first in code-point order is the form; an empty
table gives no rows; extra columns play no part. Two words are taken for one with odds of about n ** 2 / 2 ** 129.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import LOWER, buffers, materialise, mix64, release, text_slices

#: Letters are A-Z, a-z and U+00C0 to U+00FF; the latter are two bytes, the first of which starts no other character.
LEAD = 0xC3
MIN_LENGTH = 6
MIN_COUNT = 5
FACTOR = 5
ONE_IN = 199
SLICE = 4 << 20
HELD = 1 << 20
OUT = 1 << 14
BLOOM_BITS = 1 << 27
BLOOM_LEAST = 1 << 16
CANDIDATES = 1 << 20
SHORT = 32
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

LETTER = np.zeros(256, bool)
LETTER[np.r_[0x41:0x5B, 0x61:0x7B]] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def crc_of_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each word's bytes, continued from the crc32 `before` of what stands before it."""
    out = np.zeros(len(starts), np.uint32)
    length = ends - starts
    for k in np.flatnonzero(length > SHORT).tolist():
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(before[k]))
    at = np.flatnonzero(length <= SHORT)
    at = at[np.argsort(-length[at], kind="stable")]
    state, size, first = before[at] ^ np.uint32(0xFFFFFFFF), length[at], starts[at]
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, side="left"))
        state[:n] = CRC[(state[:n] ^ data[first[:n] + k]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    out[at] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _letters(raw: np.ndarray) -> np.ndarray:
    mask = LETTER[raw]
    lead = raw == LEAD
    mask |= lead
    mask[1:] |= lead[:-1]
    return mask


def _misspelt(word: str, h: int) -> str:
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) with the counts of like words added, at most about HELD rows at a time."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows > HELD:
            held = _added(held)
            rows = sum(x.num_rows for x in held)
            if rows > HELD // 2:
                yield from held
                held, rows = [], 0
    if held:
        yield from _added(held)


def _added(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    found = pa.Table.from_batches(batches).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return found.select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches(max_chunksize=OUT)


def _count(one_in: int, min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE):
            raw, offsets = buffers(part.column("text"))
            if not len(raw):
                continue
            mask = _letters(raw)
            head = np.zeros(len(raw) + 1, bool)
            head[offsets] = True
            first = np.flatnonzero(mask & np.r_[True, ~mask[:-1] | head[1:-1]])
            if not len(first):
                continue
            last = np.flatnonzero(mask & np.r_[~mask[1:] | head[1:-1], True]) + 1
            # the words are the masked bytes, one after the other
            data = LOWER[raw[mask]]
            at = np.concatenate([[0], np.cumsum(last - first)])
            two_byte = np.concatenate([[0], np.cumsum(data == LEAD)])
            points = np.diff(at) - (two_byte[at[1:]] - two_byte[at[:-1]])
            starts, ends = at[:-1], at[1:]
            doc = np.searchsorted(offsets, first, side="right") - 1
            long = np.flatnonzero(points >= min_length)
            prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in part.column("id").to_pylist()], np.uint32)
            crc = crc_of_words(data, starts[long], ends[long], prefix[doc[long]])
            hit = crc % np.uint32(one_in) == 0
            whole = np.ones(len(starts), bool)
            whole[points < min_length] = False
            whole[long[hit]] = False
            all_words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
            found = pc.value_counts(all_words.filter(pa.array(whole)))
            words, counts = found.field("values").cast(pa.string()), found.field("counts").cast(pa.int64())
            yield pa.record_batch([words, counts], names=["word", "n"])
            odd = [_misspelt(w, h) for w, h in zip(all_words.take(pa.array(long[hit])).to_pylist(), crc[hit].tolist(), strict=True)]
            odd = [w for w in odd if len(w) >= min_length]
            yield pa.record_batch([pa.array(odd, pa.string()), pa.array(np.ones(len(odd), np.int64))], names=["word", "n"])

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = ONE_IN, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n): the words of docs of at least min_length code points, one in `one_in` misspelt."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    count = _count(one_in, min_length)
    return rows.mapInArrow(lambda batches: _combined(count(batches)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------------------------------------------ neighbourhoods


def _value(letter: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """The hash of a letter at a place; a word's hash is the sum of its letters' values."""
    with np.errstate(over="ignore"):
        return mix64((place.astype(np.uint64) * np.uint64(0x100000001B3) + letter.astype(np.uint64)) ^ np.uint64(seed))


def _points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words and the n + 1 offsets into them."""
    strings = words.to_pylist()
    return np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(w) for w in strings])]).astype(np.int64)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        points, at = _points(b.column("word"))
        place = np.arange(len(points)) - np.repeat(at[:-1], np.diff(at))
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(_value(points, place, s))]) for s in SEEDS]
        one, two = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
        yield pa.record_batch([b.column("word"), b.column("n"), pa.array(one), pa.array(two)], names=["word", "n", "h1", "h2"])


def _slots(h1: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash in a Bloom filter of `bits` bits."""
    return (h1 & np.uint64(bits - 1)).astype(np.int64), ((h1 >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _edits(points: np.ndarray, at: np.ndarray, alphabet: np.ndarray, low: int, high: int, keep) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, h1, h2) of all distinct edits at the letters low to high of a batch, those that `keep` lets pass.

    A word has one place more than it has letters: the one behind the last, where letters can be inserted.
    """
    size = np.diff(at)
    spots = at + np.arange(len(at))
    word = np.searchsorted(spots, np.arange(low, high), side="right") - 1
    place = np.arange(low, high) - spots[word]
    inner = place < size[word]
    here = np.where(inner, points[np.minimum(at[word] + place, len(points) - 1)], 0)
    before = np.where(place > 0, points[np.maximum(at[word] + place - 1, 0)], 0)
    everywhere = np.arange(len(points)) - np.repeat(at[:-1], size)
    own, left, right = [], [], []
    for s in SEEDS:
        own.append(np.concatenate([[np.uint64(0)], np.cumsum(_value(points, everywhere, s))]))
        left.append(np.concatenate([[np.uint64(0)], np.cumsum(_value(points, everywhere - 1, s))]))
        right.append(np.concatenate([[np.uint64(0)], np.cumsum(_value(points, everywhere + 1, s))]))
    start, here_at, end = at[word], at[word] + place, at[word + 1]
    head = [o[here_at] - o[start] for o in own]
    after = np.minimum(here_at + 1, end)
    parts = []

    def add(which: np.ndarray, one: np.ndarray, two) -> None:
        passed = np.flatnonzero(keep(one))
        parts.append((word[which[passed]], one[passed], two(passed)))

    gone = np.flatnonzero(inner & ((place == 0) | (here != before)))
    deleted = [h[gone] + x[end[gone]] - x[after[gone]] for h, x in zip(head, left, strict=True)]
    add(gone, deleted[0], lambda k: deleted[1][k])
    tail = [o[end] - o[after] for o in own]
    moved = [x[end] - x[here_at] for x in right]
    for c in alphabet:
        letter = np.full(len(word), c)
        values = [_value(letter, place, s) for s in SEEDS]
        other = np.flatnonzero(inner & (here != c))
        add(other, (head[0] + values[0] + tail[0])[other], lambda k, v=values, w=other: (head[1] + v[1] + tail[1])[w[k]])
        grown = np.flatnonzero((place == 0) | (before != c))
        add(grown, (head[0] + values[0] + moved[0])[grown], lambda k, v=values, w=grown: (head[1] + v[1] + moved[1])[w[k]])
    return tuple(np.concatenate([p[j] for p in parts]) for j in range(3))


def _neighbourhood(alphabet: np.ndarray, bloom, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.unpackbits(bloom.value, bitorder="little").view(bool)

        def keep(h: np.ndarray) -> np.ndarray:
            one, two = _slots(h, bits)
            return filled[one] & filled[two]

        for batch in batches:
            points, at = _points(batch.column("word"))
            ids = batch.column("id").to_numpy()
            total, step = len(points) + len(ids), max(1, CANDIDATES // (2 * len(alphabet) + 1))
            for low in range(0, total, step):
                word, one, two = _edits(points, at, alphabet, low, min(low + step, total), keep)
                yield pa.record_batch([pa.array(ids[word]), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["id", "h1", "h2"])

    return run


def _bloom(vocabulary: DataFrame, most_bits: int) -> tuple[np.ndarray, int]:
    """Bloom filter of h1 as packed bits: 16 bits a word up to most_bits, at most an eighth of which reaches the driver in bytes."""
    n = vocabulary.count()
    bits = min(most_bits, max(BLOOM_LEAST, 1 << (16 * max(n, 1) - 1).bit_length()))
    low = F.col("h1").bitwiseAND(bits - 1)
    high = F.shiftrightunsigned("h1", 32).bitwiseAND(bits - 1)
    set_bits = vocabulary.select(F.explode(F.array(low, high)).alias("bit"))
    masks = set_bits.groupBy(F.shiftright("bit", 6).alias("place")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))).alias("mask"))
    found = masks.toArrow()
    packed = np.zeros(bits // 64, np.int64)
    packed[found.column("place").to_numpy()] = found.column("mask").to_numpy()
    return packed.view(np.uint8), bits


def near_words(vocabulary: DataFrame, most_bits: int = BLOOM_BITS) -> DataFrame:
    """(id, near, near_n) for vocabulary (id long, word, n, h1, h2): a row for each two near words, in either direction."""
    spark = vocabulary.sparkSession
    # at most the 26 + 64 letters of the pattern
    letters = sorted(r[0] for r in vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect())
    bits, n_bits = _bloom(vocabulary, most_bits)
    made = vocabulary.select("id", "word").mapInArrow(_neighbourhood(np.array([ord(c) for c in letters], np.uint32), spark.sparkContext.broadcast(bits), n_bits), "id long, h1 long, h2 long")
    # Spark takes the candidates for no larger than the words they are made from, so that it would broadcast them
    return made.join(vocabulary.select("h1", "h2", F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), ["h1", "h2"]).select("id", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, root): roots are followed to their end, by doubling."""
    current = materialise(forms, "roots")
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        last, current = current, materialise(current.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        release(last)
        if current.where("moved").isEmpty():
            return current.select("word", "root")


def variants(counts: DataFrame, min_count: int = MIN_COUNT, factor: int = FACTOR, most_bits: int = BLOOM_BITS) -> DataFrame:
    """word, form, root, n, n_near, form_n for counts (word, n), words that occur at least min_count times."""
    frequent = counts.where(F.col("n") >= min_count).mapInArrow(_hash, "word string, n long, h1 long, h2 long")
    vocabulary = materialise(frequent.withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    best = near_words(vocabulary, most_bits).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best"))
    top, form_n = F.col("best.near"), -F.col("best.least")
    taken = form_n >= F.col("n") * factor
    words = vocabulary.join(best.hint("merge"), "id", "left").select("word", F.when(taken, top).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, form_n).alias("form_n"))
    words = materialise(words, "words")
    release(vocabulary)
    roots = _roots(words.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return words.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir):
    return variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}

_CRC_TABLE = "SELECT list(list_reduce(range(0, 9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(0, 256) AS r(i)"


def crc_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a text's UTF-8 bytes; `tab.t` holds the table of 256 values."""
    digits = f"hex(encode({text}))"
    codes = f"[CAST('0x' || {digits}[2 * k + 1:2 * k + 2] AS BIGINT) FOR k IN range(0, len({digits}) // 2)]"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c // 256, tab.t[xor(c % 256, b) + 1]), 4294967295), 4294967295)"


SQL = {
    "op11_spelling_variants": rf"""
WITH RECURSIVE tab AS ({_CRC_TABLE}),
runs AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) GROUP BY ALL
),
hashed AS (SELECT w, n, {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM runs, tab WHERE length(w) >= 6),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS w, n FROM hashed),
v AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5),
holes AS (SELECT w, n, i, left(w, i - 1) AS a, substr(w, i + 1) AS b FROM v, unnest(range(1, length(w) + 1)) AS u(i)),
near AS (
  SELECT x.w, y.w AS o, y.n AS m FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.w <> y.w
  UNION SELECT x.w, y.w, y.n FROM holes x JOIN v y ON x.a || x.b = y.w
  UNION SELECT y.w, x.w, x.n FROM holes x JOIN v y ON x.a || x.b = y.w
),
best AS (SELECT w, count(*) AS n_near, min_by(o, (-m, encode(o))) AS o, max(m) AS m FROM near GROUP BY w),
formed AS (
  SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN o END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n
  FROM v LEFT JOIN best ON best.w = v.w
),
walk AS (
  SELECT w, w AS node, 0 AS step FROM formed
  UNION ALL SELECT walk.w, f.form, step + 1 FROM walk JOIN formed f ON f.w = walk.node WHERE f.form IS NOT NULL
),
roots AS (SELECT w, max_by(node, step) AS root FROM walk GROUP BY w)
SELECT f.w AS word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM formed f JOIN roots r ON r.w = f.w
"""
}
