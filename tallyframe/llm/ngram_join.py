"""Jaccard self-join on word shingles by signature trees.

A document's set holds the hashes of its distinct runs of WIDTH words (with fewer words, of the whole sequence). Equal
sets are one class. Two classes link when 9 * overlap >= 4 * (size + size), which is a Jaccard similarity of 0.8.

1. `_heavy` finds frequent shingles. They only set an order: rare shingles first, frequent ones last.
2. Linked sets share a shingle among the first size - ceil(0.8 * size) + 1 of that order. Classes that share one
   form lists. A list over LONG_LIST classes, and that of a frequent shingle, is a star: it only says that its classes
   belong to one group, so no list is ever buffered whole.
3. Signature trees: a leaf has a class's token bitmap (about one bit a shingle or two), its size, and its slack (shingles
   less bits); a node the OR of its bitmaps, the range of sizes and the largest slack. Two nodes can hold at most
   popcount(a AND b) + min(slack) common shingles, so a dual traversal drops node pairs whose largest overlap is too
   small. Short lists and the groups that stars make go through it; what is left ties classes into candidate groups.
4. Candidate groups get their whole texts once and go through the same trees, now with an exact count of common
   shingles at the leaves. Node pairs whose classes are one component already are skipped, so a group of n near copies
   costs about n counts, and only the edges that join components leave a task.
5. In both passes a group beyond its block (SIGNED signature bits, BLOCK shingles) is dealt into blocks by a salted
   hash. After ROUNDS dealings the classes outside the largest component meet every block of a size within 0.8 to
   1.25 of their own, so no link between blocks is lost, and what they carry to blocks of the first pass is a bitmap.

Sets are compared by 63-bit hashes of shingles. Two of k distinct shingles share a hash with odds of about k * k / 2 ** 64
each; a wrong link needs a fifth of a set to collide.

Cases: null and empty texts and texts without words have n_shingles 0 and only themselves as component; equal texts
share a component; a null doc_id is linked like others but never names a component unless all its members are null;
rows that repeat a doc_id share their component; an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import LOWER, RangeHash, buffers, materialise, mix64, packed, release, text_slices, words
from tallyframe.llm.components import components

WIDTH = 5
HEAVY = 65_536  # frequent shingles kept, so what is sent to tasks is bounded
FLUSH = 1 << 22
LONG_LIST = 2_000  # a longer list is a group of the signature pass instead of a row of its own
BLOCK = 1 << 19
SIGNED = 1 << 22
ROUNDS = 2
FANOUT = 8
FRONTIER = 1 << 17
SMALL = 8
TOP = np.uint64(1) << np.uint64(63)


# ---------------------------------------------------------------- sets


def shingles(raw: np.ndarray, offsets: np.ndarray, ranges: RangeHash) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hash and document of every shingle, repeats included, documents in order."""
    docs = len(offsets) - 1
    starts, ends, of = words(raw, offsets)
    if not len(of):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = ranges(LOWER[raw], starts, ends)
    n = np.bincount(of, minlength=docs)
    first = np.cumsum(n) - n
    run = np.zeros(len(h), np.uint64)
    for k in range(min(WIDTH, len(h))):
        run[: len(h) - k] = run[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
    place = np.arange(len(h)) - first[of]
    whole = place + WIDTH <= n[of]
    tokens, owner = mix64(run[whole]) >> np.uint64(1), of[whole]
    short = np.flatnonzero((n > 0) & (n < WIDTH))
    if len(short):
        extra = []
        for d in short.tolist():
            v = int(n[d])
            for x in h[first[d] : first[d] + n[d]].tolist():
                v = (v * 0x9E3779B97F4A7C15 + x) & ((1 << 64) - 1)
            extra.append(v)
        tokens = np.concatenate((tokens, mix64(np.array(extra, np.uint64)) >> np.uint64(1)))
        owner = np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        tokens, owner = tokens[order], owner[order]
    return tokens, owner


def distinct(tokens: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by document and token, once each."""
    order = np.argsort(tokens)
    small = owner[order].astype(np.uint16) if len(owner) and owner.max() < 65536 else owner[order]
    order = order[np.argsort(small, kind="stable")]
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    return tokens[new], owner[new]


def _set_keys(tokens: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each document's set and a 64-bit key of the set."""
    n = np.bincount(owner, minlength=docs)
    key = np.zeros(docs, np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        key[some] = np.add.reduceat(mix64(tokens + np.uint64(0x51ED)), (np.cumsum(n) - n)[some])
    return n, mix64(key + n.astype(np.uint64)).view(np.int64)


def bitmap_bits(n: np.ndarray) -> np.ndarray:
    return 1 << np.clip(np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 6, 16)


# ---------------------------------------------------------------- passes over the texts


def _count_heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges, held, size, docs = RangeHash(), [], 0, 0

    def flush() -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keep = n >= max(8, docs // 2000)
        return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["token", "n"])

    for batch in text_slices(batches, "text", 1 << 20):
        tokens, _ = distinct(*shingles(*buffers(batch.column(0)), ranges))
        held.append(tokens)
        size, docs = size + len(tokens), docs + batch.num_rows
        if size >= FLUSH:
            yield flush()
            held, size, docs = [], 0, 0
    yield flush()


def _heavy(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and the rank of each by count. An order only: any choice gives the same links.

    A histogram of counts gives the count from which at most HEAVY shingles are taken, so none passes through a sort of
    all. A shingle below that count stands in at most total / HEAVY documents.
    """
    rows = docs.select("text").mapInArrow(_count_heavy, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    step = F.floor(F.log2("n") * 16).cast("int").alias("step")
    rows = materialise(rows.select("token", "n", step), "frequent")
    least, held = 1 << 30, 0
    for r in sorted(rows.groupBy("step").count().collect(), reverse=True):  # at most 16 * 64 rows
        held += r["count"]
        if held > HEAVY:
            break
        least = r["step"]
    got = rows.where(F.col("step") >= least).select("token", "n").toArrow()
    tokens, n = got.column("token").to_numpy(), got.column("n").to_numpy()
    tokens = tokens[np.lexsort((tokens, -n))].astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    release(rows)
    return tokens[order], (HEAVY - np.arange(len(tokens)))[order].astype(np.uint64)


def _prefixes(heavy: tuple[np.ndarray, np.ndarray]):
    known, rank = heavy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = RangeHash()
        for batch in text_slices(batches, "text", 1 << 20):
            tokens, owner = distinct(*shingles(*buffers(batch.column(0)), ranges))
            n, key = _set_keys(tokens, owner, batch.num_rows)
            if len(known) and len(tokens):
                at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                often = known[at] == tokens
                tokens = np.where(often, TOP | rank[at] << np.uint64(40) | tokens >> np.uint64(24), tokens)
                order = np.lexsort((tokens, owner))
                tokens = tokens[order]
            place = np.arange(len(tokens)) - (np.cumsum(n) - n)[owner]
            first = place < n[owner] - (4 * n[owner] + 4) // 5 + 1
            owner = owner[first]
            yield pa.RecordBatch.from_arrays([pa.array(tokens[first].view(np.int64)), pa.array(key[owner]), pa.array(n[owner].astype(np.int32))], names=["token", "cls", "n"])

    return run


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges = RangeHash()
    for batch in text_slices(batches, "text", 1 << 20):
        tokens, owner = distinct(*shingles(*buffers(batch.column(2)), ranges))
        n, key = _set_keys(tokens, owner, batch.num_rows)
        bits = bitmap_bits(n) * (n > 0)
        zero = np.cumsum(bits) - bits
        flat = np.zeros(int(bits.sum()), np.uint8)
        flat[zero[owner] + (tokens & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)] = 1
        packed = np.packbits(flat, bitorder="little")
        maps = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((np.concatenate((zero, [len(flat)])) // 8).astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array(key), maps], names=["doc_id", "row", "n", "cls", "bits"])


# ---------------------------------------------------------------- lists of classes that share a shingle


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, cls, n) in order to rows (list, cls), a list being written once for each task; a long list as a star."""
    rest: tuple | None = None
    streaming: int | None = None  # the shingle whose list has outgrown LONG_LIST: its rows go out as they come
    seen: set[int] = set()

    def star_of(token: int, cls: np.ndarray) -> pa.RecordBatch:
        cls = np.unique(cls)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cls), token)), pa.array(cls), pa.array(np.ones(len(cls), bool))], names=["list", "cls", "star"])

    def cut(token: np.ndarray, cls: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        token, cls, n = token[new], cls[new], n[new].astype(np.int64)
        head = np.ones(len(token), bool)
        head[1:] = (token[1:] != token[:-1]) | (5 * n[:-1] < 4 * n[1:])
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(token)))
        key = mix64(np.add.reduceat(mix64(cls.view(np.uint64)), first)) >> np.uint64(1) if len(first) else np.zeros(0, np.uint64)
        keep = size > 1
        _, once = np.unique(key, return_index=True)
        only = np.zeros(len(key), bool)
        only[once] = True
        keep &= only
        fresh = np.array([k not in seen for k in key[keep].tolist()], bool)
        keep[np.flatnonzero(keep)[~fresh]] = False
        if len(seen) > 1_000_000:
            seen.clear()
        seen.update(key[keep].tolist())
        rows = np.repeat(keep, size)
        star = np.repeat(size > LONG_LIST, size)[rows]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(key, size)[rows].astype(np.int64)), pa.array(cls[rows]), pa.array(star)], names=["list", "cls", "star"])

    for batch in batches:
        got = tuple(batch.column(k).to_numpy() for k in range(3))
        if rest is not None:
            got = tuple(np.concatenate(x) for x in zip(rest, got, strict=True))
        if streaming is not None and len(got[0]):
            k = int(np.searchsorted(got[0], streaming, side="right"))
            if k:
                yield star_of(streaming, got[1][:k])
            got = tuple(x[k:] for x in got)
            streaming = streaming if not len(got[0]) else None
        if not len(got[0]):
            rest = None
            continue
        end = int(np.searchsorted(got[0], got[0][-1]))
        rest = tuple(x[end:] for x in got)
        if end:
            yield cut(*(x[:end] for x in got))
        if len(rest[0]) > LONG_LIST:
            streaming, rest = int(rest[0][0]), None
            yield star_of(streaming, got[1][end:])
    if rest is not None and len(rest[0]):
        yield cut(*rest)


# ---------------------------------------------------------------- signature trees


class Forest:
    """Union-find over places 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = int(self.up[x])
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        while True:
            above = self.up[self.up]
            if (above == self.up).all():
                return self.up
            self.up = above


class Tree:
    """Levels from leaves to root. level[l] = (bitmaps, smallest size, largest size, largest slack)."""

    def __init__(self, bits: np.ndarray, n: np.ndarray) -> None:
        slack = n - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, n, n, slack)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, slack = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))

    def raised(self, levels: int) -> None:
        while len(self.levels) < levels:
            self.levels.append(self.levels[-1])


def fold(bits: np.ndarray, words_: int) -> np.ndarray:
    return bits if bits.shape[1] == words_ else np.bitwise_or.reduce(bits.reshape(len(bits), -1, words_), axis=1)


def possible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray) -> np.ndarray:
    """Node pairs whose largest overlap can still make a link."""
    ok = (5 * a[2][i] >= 4 * b[1][j]) & (5 * b[2][j] >= 4 * a[1][i])
    w = np.flatnonzero(ok)
    common = np.bitwise_count(a[0][i[w]] & b[0][j[w]]).sum(axis=1).astype(np.int64)
    most = np.minimum(common + np.minimum(a[3][i[w]], b[3][j[w]]), np.minimum(a[2][i[w]], b[2][j[w]]))
    ok[w] = 9 * most >= 4 * (a[1][i[w]] + b[1][j[w]])
    return ok


def traverse(a: Tree, b: Tree, same: bool, at_a: np.ndarray, at_b: np.ndarray, forest: Forest, linked) -> list[tuple[int, int]]:
    """Dual traversal. at_a, at_b: places of the leaves in the forest. linked(places, places) is asked pair by pair."""
    top = max(len(a.levels), len(b.levels))
    a.raised(top)
    b.raised(top)
    edges: list[tuple[int, int]] = []
    zero = np.zeros(1, np.int64)
    stack = [(top - 1, zero, zero)]
    spans = None
    stale = True
    while stack:
        level, i, j = stack.pop()
        if len(i) > FRONTIER:
            stack.append((level, i[FRONTIER:], j[FRONTIER:]))
            i, j = i[:FRONTIER], j[:FRONTIER]
        keep = possible(a.levels[level], i, b.levels[level], j)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if stale:
            root = forest.roots()
            spans = [_spans(t, root[at]) for t, at in ((a, at_a), (b, at_b))]
            stale = False
        (la, ha), (lb, hb) = spans[0][level], spans[1][level]
        one = (la[i] == ha[i]) & (lb[j] == hb[j]) & (la[i] == lb[j])
        i, j = i[~one], j[~one]
        if level == 0:
            if same:
                i, j = i[i < j], j[i < j]
            for x, y in zip(at_a[i].tolist(), at_b[j].tolist(), strict=True):
                if forest.find(x) != forest.find(y) and linked(x, y):
                    forest.join(x, y)
                    edges.append((x, y))
                    stale = True
            continue
        down = []
        for t, nodes in ((a, i), (b, j)):
            below, here = len(t.levels[level - 1][1]), len(t.levels[level][1])
            if below == here:
                down.append((nodes, nodes + 1))
            else:
                down.append((nodes * FANOUT, np.minimum(nodes * FANOUT + FANOUT, below)))
        (ia, ib), (ja, jb) = down
        wide, tall = ib - ia, jb - ja
        n = wide * tall
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        ci = np.repeat(ia, n) + k // np.repeat(tall, n)
        cj = np.repeat(ja, n) + k % np.repeat(tall, n)
        if same:
            ci, cj = ci[ci <= cj], cj[ci <= cj]
        stack.append((level - 1, ci, cj))
    return edges


def _spans(t: Tree, root: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Smallest and largest component below each node, by level."""
    out = [(root, root)]
    for level in range(1, len(t.levels)):
        low, high = out[-1]
        if len(t.levels[level][1]) < len(low):
            at = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
        out.append((low, high))
    return out


def link_group(bits: list[np.ndarray], n: np.ndarray, linked, outside: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that join the components of one group. bits: a bitmap of 64-bit words for each member.

    outside: the component each member already has; only members of different components are compared.
    """
    forest = Forest(len(n))
    if outside is not None:
        _, first, inverse = np.unique(outside, return_index=True, return_inverse=True)
        forest.up = first[inverse]
    widths = np.array([len(b) for b in bits])
    trees, edges = {}, []
    for w in sorted(set(widths.tolist())):
        own = np.flatnonzero(widths == w)
        matrix = np.stack([bits[k] for k in own.tolist()])
        order = np.lexsort((*matrix.T[:2], n[own]))
        trees[w] = (own[order], matrix[order])
    for w, (own, matrix) in trees.items():
        tree = Tree(matrix, n[own])
        edges += traverse(tree, tree, True, own, own, forest, linked)
        if w // 2 in trees:
            under, lower = trees[w // 2]
            edges += traverse(Tree(lower, n[under]), Tree(fold(matrix, w // 2), n[own]), False, under, own, forest, linked)
    return edges


def _bits(column: pa.Array) -> list[np.ndarray]:
    raw, offsets = buffers(column)
    return [np.frombuffer(raw[s:e].tobytes(), np.uint64) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _small(bits: list[np.ndarray], n: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of groups of up to SMALL members, of which the bitmaps still allow a link."""
    left, right = [], []
    for m in range(2, SMALL + 1):
        heads = first[size == m]
        if len(heads):
            i, j = np.triu_indices(m, 1)
            left.append((heads[:, None] + i).ravel())
            right.append((heads[:, None] + j).ravel())
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    fits = (5 * n[a] >= 4 * n[b]) & (5 * n[b] >= 4 * n[a])
    a, b = a[fits], b[fits]
    good = np.zeros(len(a), bool)
    width = np.array([len(x) for x in bits])
    pair = np.minimum(width[a], width[b])
    for w in np.unique(pair).tolist():
        k = np.flatnonzero(pair == w)
        for at in range(0, len(k), 1 << 14):
            part = k[at : at + (1 << 14)]
            x, y = (np.stack([fold(bits[p][None], w)[0] for p in side[part].tolist()]) for side in (a, b))
            slack = np.minimum(*(n[side[part]] - np.bitwise_count(z).sum(axis=1).astype(np.int64) for side, z in ((a, x), (b, y))))
            most = np.bitwise_count(x & y).sum(axis=1).astype(np.int64) + slack
            good[part] = 9 * most >= 4 * (n[a[part]] + n[b[part]])
    return a[good], b[good]


def _groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 4096) -> Iterator[pa.Table]:
    """Whole groups of rows that come in order of key, several small ones at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(key).to_numpy()
            end = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
            if end:
                yield table.slice(0, end)
                held, rows = table.slice(end).to_batches(), table.num_rows - end
            else:
                held = table.to_batches()
                least = max(least, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (place, cls), each pair once: a row that repeats a thousand times is held once."""
    before: tuple[int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        place, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (cls[1:] != cls[:-1])
        new[0] = before != (place[0], cls[0])
        before = (place[-1], cls[-1])
        yield batch if new.all() else batch.filter(pa.array(new))


def _edges(a: list[int] | np.ndarray, b: list[int] | np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _heads(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return first, np.diff(np.append(first, len(keys)))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, cls, known, n, bits) in order of place to edges between classes that the trees could not tell apart."""
    for table in _groups(_once(batches), "place"):
        cls, n = table.column("cls").to_numpy(), table.column("n").to_numpy().astype(np.int64)
        bits, known = _bits(table.column("bits")), table.column("known").to_numpy()
        first, size = _heads(table.column("place").to_numpy())
        a, b = _small(bits, n, first, size)
        apart = known[a] != known[b]
        yield _edges(cls[a[apart]], cls[b[apart]])
        for f, m in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            edges = link_group(bits[f : f + m], n[f : f + m], lambda x, y: True, known[f : f + m])
            yield _edges([int(cls[f + x]) for x, _ in edges], [int(cls[f + y]) for _, y in edges])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, cls, known, text) in order of place to edges between linked classes."""
    ranges = RangeHash()
    for table in _groups(_once(batches), "place", 256):
        sets: list[np.ndarray] = []
        mine: list[np.ndarray] = []
        bits: list[np.ndarray] = []
        for batch in text_slices(iter(table.select(["text"]).to_batches()), "text", 1 << 20):
            tokens, owner = distinct(*shingles(*buffers(batch.column(0)), ranges))
            ends, key = _set_keys(tokens, owner, batch.num_rows)
            ends = np.cumsum(ends)
            mine.append(key)
            for own in np.split(tokens, ends[:-1]):
                width = int(bitmap_bits(np.array([len(own)]))[0])
                flat = np.zeros(width, np.uint8)
                flat[(own & np.uint64(width - 1)).astype(np.int64)] = 1
                sets.append(own)
                bits.append(np.packbits(flat, bitorder="little").view(np.uint64))
        # A row that shares its doc_id with a class but holds another text is not of that class.
        own = np.flatnonzero(np.concatenate(mine) == table.column("cls").to_numpy())
        table, sets, bits = table.take(pa.array(own)), [sets[k] for k in own.tolist()], [bits[k] for k in own.tolist()]
        if not len(own):
            continue
        cls, known = table.column("cls").to_numpy(), table.column("known").to_numpy()
        n = np.array([len(s) for s in sets], np.int64)

        def linked(x: int, y: int) -> bool:
            small, large = (sets[x], sets[y]) if n[x] <= n[y] else (sets[y], sets[x])  # noqa: B023
            if not len(small):
                return False
            common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
            return 9 * common >= 4 * (len(small) + len(large))

        first, size = _heads(table.column("place").to_numpy())
        a, b = _small(bits, n, first, size)
        good = [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if known[x] != known[y] and linked(x, y)]
        yield _edges([int(cls[x]) for x, _ in good], [int(cls[y]) for _, y in good])
        for f, m in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            edges = link_group(bits[f : f + m], n[f : f + m], lambda x, y, f=f: linked(f + x, f + y), known[f : f + m])
            yield _edges([int(cls[f + x]) for x, _ in edges], [int(cls[f + y]) for _, y in edges])


# ---------------------------------------------------------------- the join


def _place(*parts: Column, round_: int) -> Column:
    return F.xxhash64("grp", *parts, F.lit(round_)).alias("place")


def _block(round_: int, blocks: str = "blocks") -> Column:
    return F.pmod(F.xxhash64("cls", F.lit(round_)), F.col(blocks))


def _again(groups: DataFrame, round_: int, true: DataFrame) -> DataFrame:
    """(cls, known, place) of classes whose group has several blocks and is not one component yet."""
    known = groups.where("blocks > 1").join(true, groups.cls == true.node, "left").select("grp", "cls", "n", "weight", "blocks", F.coalesce("label", "cls").alias("known"))
    sizes = known.groupBy("grp", "known").agg(F.count(F.lit(1)).alias("m"))
    main = sizes.groupBy("grp").agg(F.max_by("known", F.struct("m", "known")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    split = known.join(main, "grp")
    if round_ < ROUNDS:
        return split.select("cls", "known", _place(_block(round_), round_=round_))
    # Sizes within a factor of 1.25 lie in the same band or in neighbours; the base leaves room for rounding.
    split = split.withColumn("band", F.floor(F.log("n") / float(np.log(1.26))))
    per = split.groupBy("grp", "band").agg(F.greatest(F.ceil(F.sum("weight")), F.lit(1)).cast("long").alias("here"))
    inner = split.where("known = main").join(per, ["grp", "band"]).select("cls", "known", _place(F.col("band"), _block(round_, "here"), round_=round_))
    outer = split.where("known <> main").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).join(per, ["grp", "band"])
    outer = outer.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("here") - 1))).select("cls", "known", _place(F.col("band"), F.col("block"), round_=round_))
    return inner.unionByName(outer)


def _dealt(groups: DataFrame, bodies: DataFrame, tie, label: str) -> DataFrame:
    """Components (node, label) of the classes that `tie` links within groups, in rounds of blocks.

    groups: grp, cls, n, blocks, weight (share of a block). bodies: grp, cls, blocks and what `tie` reads besides.
    """
    payload = [c for c in bodies.columns if c not in ("grp", "cls", "blocks")]
    edges = true = None
    held: list[DataFrame] = []
    for round_ in range(ROUNDS + 1):
        if not round_:
            body = bodies.select(_place(_block(0), round_=0), "cls", F.col("cls").alias("known"), *payload)
        else:
            if groups.where("blocks > 1").isEmpty():
                break
            asked = materialise(_again(groups, round_, true), "asked")
            if asked.isEmpty():
                break
            held.append(asked)
            body = bodies.where("blocks > 1").join(asked.hint("merge"), "cls").select("place", "cls", "known", *payload)
        found = materialise(body.repartition("place").sortWithinPartitions("place", "cls").mapInArrow(tie, "a long, b long"), label)
        held.append(found)
        edges = found if edges is None else edges.unionByName(found)
        true = components(edges)
    release(*held)
    return true


def _grouped(members: DataFrame, weight: Column) -> DataFrame:
    """members: grp, cls, n. With the number of blocks of each group of several classes and each class's share of a block."""
    members = members.withColumn("weight", weight)
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.ceil(F.sum("weight")).cast("long").alias("blocks")).where("m > 1")
    return members.join(sizes.drop("m"), "grp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id."""
    # A row is found again by a hash of id and text, so rows without an id are no single key.
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    heavy = _heavy(texts)
    signed = materialise(texts.mapInArrow(_signatures, "doc_id long, row long, n long, cls long, bits binary"), "signatures")
    prefix = texts.select("text").mapInArrow(_prefixes(heavy), "token long, cls long, n int")
    # Both kinds of prefix rows leave one shuffle; frequent shingles (negative) are spread by class as well.
    spread = F.when(F.col("token") < 0, F.pmod(F.col("cls"), F.lit(1024))).otherwise(0).alias("spread")
    rows = prefix.select("token", "cls", "n", spread).repartition("token", "spread").sortWithinPartitions("token", "n", "cls")
    lists = materialise(rows.mapInArrow(_split_heavy, "list long, cls long, star boolean"), "lists")
    classes = signed.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    short = lists.where("NOT star").select("list", "cls").distinct()
    tied = short.join(classes.select("cls", "n", "bits"), "cls").select(F.col("list").alias("place"), "cls", F.col("cls").alias("known"), "n", "bits")
    close = materialise(tied.repartition("place").sortWithinPartitions("place", "n", "cls").mapInArrow(_candidates, "a long, b long"), "close")
    # A star's centre is a node of its own; node numbers of lists and classes are set apart by their lowest bit.
    node = lambda c, odd: F.shiftleft(F.xxhash64(c), 1).bitwiseOR(odd)
    stars = lists.where("star").select(node("cls", 0).alias("a"), node("list", 1).alias("b")).distinct()
    starred = classes.withColumn("node", node("cls", 0)).join(components(stars), "node").select(F.col("label").alias("grp"), "cls", "n", "bits")
    starred = materialise(_grouped(starred, F.greatest(F.lit(64), F.col("n") * 2) / SIGNED), "starred")
    tied = _dealt(starred, starred.select("grp", "cls", "blocks", "n", "bits"), _candidates, "tied")
    named = signed.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("n").alias("n"))
    label = components(close.unionByName(tied.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    groups = named.join(label, named.cls == label.node).select(F.col("label").alias("grp"), "cls", "row", "n")
    groups = materialise(_grouped(groups, F.col("n") / BLOCK), "groups")
    release(lists, close, starred)
    # The candidates' texts move once, by merge join at every size, and are kept for the later rounds.
    bodies = materialise(texts.select("row", "text").join(groups.select("row", "grp", "cls", "blocks").hint("merge"), "row").select("grp", "cls", "blocks", "text"), "bodies")
    true = _dealt(groups, bodies, _verified, "links")
    release(groups, bodies)
    whole = signed.select("doc_id", "n", "cls")
    least = named.join(true, named.cls == true.node, "left").select("cls", "doc_id", F.coalesce("label", "cls").alias("part"))
    smallest = least.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    named_parts = least.join(smallest, "part").select("cls", "component_id")
    some = whole.where("n > 0").join(named_parts, "cls").select("doc_id", "n", "component_id")
    none = whole.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _split_heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequent shingles (negative tokens) go straight to stars; the rest to `_lists`. Rows come in order of token."""
    heavy_seen: set[tuple[int, int]] = set()
    out: list[pa.RecordBatch] = []

    def plain() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token = batch.column(0).to_numpy()
            k = int(np.searchsorted(token, 0))
            if k:
                pairs = set(zip(token[:k].tolist(), batch.column(1).to_numpy()[:k].tolist(), strict=True)) - heavy_seen
                if len(heavy_seen) > 1_000_000:
                    heavy_seen.clear()
                heavy_seen.update(pairs)
                both = sorted(pairs)
                if both:
                    out.append(pa.RecordBatch.from_arrays([pa.array([t for t, _ in both], pa.int64()), pa.array([c for _, c in both], pa.int64()), pa.array([True] * len(both), pa.bool_())], names=["list", "cls", "star"]))
            yield batch.slice(k).select(["token", "cls", "n"])

    for batch in _lists(plain()):
        while out:
            yield out.pop()
        yield batch
    yield from out


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that name their component, and those whose doc_id is null; all columns, whatever their names."""
    parts = near_duplicates(docs.select("doc_id", "text")).where("doc_id = component_id").select("doc_id").distinct()
    rows = packed(docs, doc_id=F.col("doc_id").cast("long"))
    known = rows.where("doc_id IS NOT NULL").join(parts, "doc_id", "left_semi")
    return known.unionByName(rows.where("doc_id IS NULL")).select("row.*")


def op4_ngram_join(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_ngram_join": op4_ngram_join}
