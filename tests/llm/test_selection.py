"""Spelling variants, importance resampling and substring dedup against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyframe.llm import importance, lang_id, sentencepiece_codec, spelling, substring_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, row long, word string, place int, key long, `a.b` string, whole string, rank long"


def docs(spark, rows):
    """Rows of (doc_id, text) with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, 7, "w", 3, 9, "dot", "x", 5) for i, t in rows], SCHEMA)


EDGES = [(1, None), (2, ""), (3, "  \n\t"), (None, "one two"), (None, "one two"), (4, "é ▁ 🎉 " * 60), (5, "word " * 3000), (6, "x" * 30000), (6, "x" * 30000), (7, "\x00\x1fdel\x7f")]


# ----------------------------------------------------------------------------------------------------- substring dedup


def plain_cut(rows, window):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        gone = {k + o for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for o in range(window)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def passages(n=120, seed=4):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 4)))
    shared = [[word() for _ in range(k)] for k in (34, 35, 36, 50, 90)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            parts += [word() for _ in range(rnd.randint(0, 40))]
            if rnd.random() < 0.6:
                own = rnd.choice(shared)
                at = rnd.randint(0, 3)
                parts += own[at:] if rnd.random() < 0.5 else own
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(parts)))
    return rows + rows[:5]


@pytest.mark.parametrize(("window", "period", "cover"), [(35, 21, (0, 1, 4, 14, 16)), (9, 7, (0, 1, 3)), (7, 7, (0, 1, 3)), (5, 1, (0,))])
def test_cut_against_brute_force(spark, window, period, cover, monkeypatch):
    rows = passages() + EDGES
    want = plain_cut(rows, window)
    assert sum(r[2] > 0 for r in want) > 20
    for limit in (substring_dedup.SLICE, 3000):  # a small slice leaves more to the shuffle
        monkeypatch.setattr(substring_dedup, "SLICE", limit)
        got = substring_dedup.repeated_words(docs(spark, rows).repartition(3), window=window, period=period, cover=cover)
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_cover_takes_any_two_places_to_itself():
    v, d = substring_dedup.PERIOD, set(substring_dedup.COVER)
    assert all(any((i + k) % v in d and (j + k) % v in d for k in range(v)) for i in range(v) for j in range(v))


def test_cut_keeps_columns_and_untouched_texts(spark):
    passage = " ".join(f"w{k}" for k in range(40))
    rows = [(1, f"a  b\n{passage} c"), (2, passage), (3, "left  as\tis"), (4, None)]
    given = docs(spark, rows)
    got = substring_dedup.cut(given)
    assert got.columns == given.columns and dict(got.dtypes) == dict(given.dtypes)
    assert {r.doc_id: r.text for r in got.collect()} == {1: "a b c", 2: "", 3: "left  as\tis", 4: None}
    assert {r["a.b"] for r in got.collect()} == {"dot"}


def test_cut_of_an_empty_table(spark):
    none = docs(spark, [])
    assert substring_dedup.repeated_words(none).count() == 0 and substring_dedup.cut(none).count() == 0


def test_word_hashes_do_not_depend_on_the_piece(monkeypatch):
    raw = np.frombuffer(b"alpha beta " * 500 + b"x" * 900, np.uint8)
    starts, ends, _ = substring_dedup.words(raw, np.array([0, len(raw)]))
    whole = substring_dedup.word_hashes(raw, starts, ends)
    monkeypatch.setattr(substring_dedup, "PIECE", 64)
    assert (substring_dedup.word_hashes(raw, starts, ends) == whole).all() and len(set(whole.tolist())) == 3


# --------------------------------------------------------------------------------------------------- spelling variants


def plain_counts(rows, one_in):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts, least=5, factor=5):
    n = {w: c for w, c in counts.items() if c >= least}
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x.encode()), default=None)
        if best is not None and n[best] >= factor * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def spelt(seed=8):
    rnd = random.Random(seed)
    letters = "abcéÿ×"
    bases = ["".join(rnd.choice(letters) for _ in range(rnd.randint(6, 9))) for _ in range(25)]
    rows = []
    for i in range(150):
        said = []
        for _ in range(60):
            w = rnd.choice(bases[: 1 + int(25 * rnd.random() ** 3)])
            if rnd.random() < 0.3:
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice(letters) + w[k:], w[:k] + rnd.choice(letters) + w[k + 1 :]])
            said.append(w.upper() if rnd.random() < 0.1 else w)
        rows.append((i, rnd.choice([" ", "1", "œ", "—"]).join(said)))
    return rows


@pytest.mark.parametrize("bits", [spelling.BLOOM_BITS, 64])
def test_variants_against_brute_force(spark, bits, monkeypatch):
    monkeypatch.setattr(spelling, "BLOOM_LEAST", min(bits, spelling.BLOOM_LEAST))
    rows = spelt() + EDGES + [(8, "y" * 40000)] * 5
    counts = spelling.word_counts(docs(spark, rows), one_in=7)
    want = plain_counts(rows, 7)
    assert {r.word: r.n for r in counts.collect()} == want
    expected = plain_variants(want)
    assert sum(r[1] is not None for r in expected) > 20 and any(r[2] != (r[1] or r[0]) for r in expected)
    monkeypatch.setattr(spelling, "CANDIDATES", 500)
    got = spelling.variants(counts, most_bits=bits).collect()
    assert len(got) == len(expected) and set(map(tuple, got)) == expected


def test_variants_broadcast_no_table(spark):
    """Words and candidates grow with the input: none of their joins may take one through the driver."""
    rows = spelt()
    limit = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(limit, "1b")
    try:
        got = spelling.variants(spelling.word_counts(docs(spark, rows), one_in=7)).collect()
    finally:
        spark.conf.unset(limit)
    assert set(map(tuple, got)) == plain_variants(plain_counts(rows, 7))


@pytest.mark.parametrize("held", [3, 40, 10**6])
def test_counts_of_slices_are_added(monkeypatch, held):
    import pyarrow as pa

    monkeypatch.setattr(spelling, "HELD", held)
    monkeypatch.setattr(spelling, "OUT", 5)
    rnd = random.Random(2)
    slices = [[(rnd.choice("abcdefghij") * 6, rnd.randint(1, 9)) for _ in range(rnd.randint(0, 12))] for _ in range(30)]
    want, got, sizes = Counter(), Counter(), []
    for part in slices:
        for w, n in part:
            want[w] += n
    batches = [pa.record_batch([pa.array([w for w, _ in p], pa.string()), pa.array([n for _, n in p], pa.int64())], names=["word", "n"]) for p in slices]
    for b in spelling._combined(iter(batches)):
        sizes.append(b.num_rows)
        for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
            got[w] += n
    assert got == want and max(sizes) <= 5
    assert sum(sizes) == len(want) if held > 20 else sum(sizes) > len(want)


def test_every_edit_once():
    import pyarrow as pa

    words = ["aabba", "ab", "a", "zzzz"]
    points, at = spelling._points(pa.array(words))
    alphabet = np.array([ord(c) for c in "abz"], np.uint32)
    word, one, two = spelling._edits(points, at, alphabet, 0, len(points) + len(words), lambda h: np.ones(len(h), bool))
    hashed = {}
    for k, w in enumerate(words):
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "abz"} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "abz"}
        edits -= {w}
        batch = next(spelling._hash(iter([pa.record_batch([pa.array(sorted(edits)), pa.array([0] * len(edits))], names=["word", "n"])])))
        hashed[k] = sorted(zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True))
    for k in range(len(words)):
        own = word == k
        assert sorted(zip(one[own].view(np.int64).tolist(), two[own].view(np.int64).tolist(), strict=True)) == hashed[k]


def test_crc_of_words_of_any_length():
    words = [b"", b"a", b"spelling", "é".encode() * 40, b"z" * 33, b"q" * 32]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    before = np.array([zlib.crc32(f"{k}:".encode()) for k in range(len(words))], np.uint32)
    got = spelling.crc_of_words(data, np.r_[0, ends[:-1]], ends, before)
    assert got.tolist() == [zlib.crc32(f"{k}:".encode() + w) for k, w in enumerate(words)]


def test_variants_of_an_empty_table(spark):
    assert spelling.variants(spelling.word_counts(docs(spark, [(1, None), (2, "a 1")]))).count() == 0
    assert spelling.variants(spelling.word_counts(docs(spark, []))).count() == 0


# ------------------------------------------------------------------------------------------------ importance resampling


def plain_resample(rows, target, orders, buckets, share, min_words, seed):
    def runs(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, orders + 1) for i in range(len(w) - k + 1)]

    own = [runs(t) for _, t in rows]
    s, t = Counter(b for _, f in own for b in f), Counter(b for x in target for b in runs(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    scored = []
    for k, ((i, _), (w, f)) in enumerate(zip(rows, own, strict=True)):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= min_words, k])
    able = sorted((r for r in scored if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[5]))
    ranks = {r[5]: j + 1 for j, r in enumerate(able[: share * len(able) // 100])}
    return sorted(((*r[:4], ranks.get(r[5])) for r in scored), key=str)


@pytest.mark.parametrize(("orders", "chunk"), [(1, importance.CHUNK), (3, importance.CHUNK), (3, 5), (2, 2)])
def test_resample_against_brute_force(spark, orders, chunk):
    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choice("abcdé1") for _ in range(rnd.randint(1, 4))) for _ in range(60)]
    rows = [(k // 2, rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocabulary).title() for _ in range(rnd.randint(0, 60)))) for k in range(200)] + EDGES
    target = [" ".join(rnd.choice(vocabulary[:20]) for _ in range(30)) for _ in range(5)] + [None]
    given = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = importance.resample(docs(spark, rows), given, orders=orders, buckets=50, share=15, min_words=9, seed=11, chunk=chunk)
    want = plain_resample(rows, target, orders, 50, 15, 9, 11)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == want and sum(r[4] is not None for r in want) > 15


def test_resample_without_rows_or_target(spark):
    none = docs(spark, [])
    target = spark.createDataFrame([], "text string")
    assert importance.resample(none, target).count() == 0
    rows = [(1, "a b " * 12), (2, "c " * 30), (3, None)]
    assert sorted(map(tuple, importance.resample(docs(spark, rows), target, share=100).collect())) == plain_resample(rows, [], 1, 10000, 100, 20, 2024)


# ------------------------------------------------------------------------------------------------- language ID: sample


def test_the_sample_is_bounded_at_any_size():
    assert lang_id.hash_limit(10, 1500) == (1 << 63) - 1
    for rows in (2_000_000_000, 10**12, 10**18):
        share = lang_id.hash_limit(rows, 1500) / 2**63
        assert share > 0 and abs(share * rows / 6000 - 1) < 0.05


def test_the_sample_takes_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    rows = [(k, f"text {k}", "en") for k in range(3000)] + [(7, "text 7", "en")] * 500 + [(1, f"other {k}", "fr") for k in range(400)] + [(None, "null id", "de"), (None, None, "de"), (5, "no language", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample, langs = lang_id.sample_rows(table, F.lit(True), 50)
    hashed = table.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", F.xxhash64("doc_id", "text").bitwiseAND((1 << 63) - 1).alias("h")).distinct().collect()
    want = {(r.lang, r.text) for lang in ("de", "en", "fr") for r in sorted((r for r in hashed if r.lang == lang), key=lambda r: r.h)[:50]}
    got = [(r.lang, r.text) for r in sample.collect()]
    assert langs == ["de", "en", "fr"] and len(got) == len(want) == 101 and set(got) == want


# ------------------------------------------------------------------------------------------------ SentencePiece: decoding


def test_decoding_of_odd_ids(spark):
    own = sentencepiece_codec.codec(sentencepiece_codec.MODEL_PATH)
    byte = lambda b: int(own.byte_ids[b])
    rows = [(1, [byte(0xC3)]), (2, [byte(0xC3), byte(0xA9)]), (3, [None, byte(0x41), None]), (4, None), (5, []), (6, [-5, 10**7, byte(0x42)]), (7, [byte(0x20), byte(0x20), byte(0x43)]), (8, [None])]
    frame = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in sentencepiece_codec.decode(frame).collect()}
    assert got == {1: "\ufffd", 2: "é", 3: "A", 4: None, 5: "", 6: "B", 7: " C", 8: ""}
