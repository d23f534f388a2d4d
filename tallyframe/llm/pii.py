"""Personal data: fixed patterns, plus names and identity numbers from a linear-chain conditional random field.

The field labels white-space words of a line with O, B/I-name and B/I-id. Its features are
the shape of a word (runs of upper, lower, digit and sign characters collapsed), the shapes beside it, and whether it or
a neighbour is a cue word of the training table. It is trained by gradient ascent on LABELLED and decoded by Viterbi
over all lines of a slice at once. Lines of any length are decoded whole: pieces of SEGMENT words run side by side, a
later one from each label the word before it can have, and are then chained. Spans it adds never touch a base span.

Offsets are code points, ends exclusive. Cases: null text counts as empty; documents without spans have empty lists and
the digest of the empty text; digit runs and words of any length take linear time; repeated rows are scanned alike;
extra columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import LOWER, RangeHash, buffers, text_slices, words

LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "name", "id")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Invented people, numbers and prose; [name ...] and [id ...] mark what is to be found.
LABELLED = [
    "Please contact [name Mr John Smith] about the invoice.",
    "Contact: [name Mary Jones] for details",
    "Name: [name Peter Brown]",
    "My name is [name Anna Miller] and I live here.",
    "Dear [name Mrs Laura Wilson], thank you for the letter.",
    "Kind regards, [name Paul Taylor]",
    "Signed by [name Dr Susan Clark] on Monday",
    "Speak to [name Ms Karen Hall] before noon",
    "Ask [name Dr Alan Young] or [name Mr Tom Scott] about it",
    "Patient: [name Robert King] was seen today",
    "Patient [name Helen Wright] has been moved",
    "Sincerely, [name David Green]",
    "Customer name: [name Emma White], account open",
    "The SSN is [id 123-45-6789] on file",
    "SSN: [id 987-65-4321]",
    "Passport number: [id X1234567] expires soon",
    "Passport no. [id K7654321]",
    "Her passport [id AB123456] was lost",
    "National id [id 12345678] was issued",
    "IBAN [id GB29NWBK60161331926819] was used",
    "IBAN: [id DE89370400440532013000]",
    "The report was late and the board met on Monday.",
    "Early Morning rain on the roof. Grey skies Over all and silence.",
    "And Of The And, Afterwards. Long Days that was it",
    "Home Home Home Home Home about about about",
    "THE LAST OF THAT!! WAS GOOD!! IT IS",
    "the end of 2021 with 45 days 1234567 units",
    "Total: 1,234 items in 12 boxes",
    "Chapter 3 Section 2: Results and Discussion",
    "Released under the Public License. All rights reserved.",
    "Version 2.0.1 of the file was saved in 2020",
    "home | news | Blog | shop, | help. | More",
    "sale&&& half%%% Best### free*** The$$$ and",
    "She is here. He was there. They met in Paris.",
    "For the name of the thing is not the thing.",
    "Contact the office before noon. Please read it.",
    "The passport office was closed. Come back later.",
    "Dear all, thank you for the note. Kind regards from us.",
    "Order 555-0199 was sent with code A12 today",
    "And And And And And And Is Is Is To To By By then",
    "HERE, OF. IS THE BEST. IS IS THE THE",
    "well, no. Yes. Such things, a. Nothing and All",
    "we left the. Then. That kind person of. Whom. Only perhaps",
    "some account of. 4417744280351547 plus more, 2531585014589253 and then, 99887766",
    "item 1122334455667788 sold. 4417744280351547. next 2531585014589253 Done",
    "sale### up%%% discounts.*** Most items.&&& Shop$$$ today,### Here",
    "Here. Every other word. To. Another, line. Then. Stop",
]
LABELS = ("O", "B-name", "I-name", "B-id", "I-id")
K = len(LABELS)
SEGMENT = 200
CUES = "contact contact: name name: mr mrs ms dr dear regards regards, sincerely sincerely, patient patient: customer ssn ssn: passport number: national iban iban:".split()
UP, LOW_, DIG, DOT, DASH, SIGN = 1, 2, 3, 4, 5, 6
KIND = np.full(256, SIGN, np.uint8)
KIND[65:91], KIND[97:123], KIND[48:58], KIND[128:], KIND[ord(".")], KIND[ord("-")] = UP, LOW_, DIG, LOW_, DOT, DASH
TRIM = np.zeros(256, bool)
TRIM[[ord(c) for c in ".,;:!?"]] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses: each '@' takes the whole run before it, so no start has to be tried twice."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            out.append((start, done))
        at = text.find("@", done)
    return out


def base_spans(text: str, digits: bool = True) -> list[tuple[int, int, int]]:
    """(kind, start, end) in order. digits: whether the text has any."""
    out = [(0, s, e) for s, e in emails(text)]
    if digits:
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


class Words:
    """The words of a byte array with their feature hashes; ends are without closing punctuation."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, ranges: RangeHash) -> None:
        self.starts, ends, self.doc = words(raw, offsets)
        n = len(self.starts)
        cut = TRIM[raw[ends - 1]] & (ends - self.starts > 1) if n else np.zeros(0, bool)
        self.ends = ends - cut
        self.cue = ranges(LOWER[raw], self.starts, ends)
        kind = KIND[raw]
        change = np.ones(len(raw) + 1, bool)
        change[1:-1] = kind[1:] != kind[:-1]
        change[self.starts] = True
        rank = np.concatenate(([0], np.cumsum(change[:-1])))
        self.shape = ranges(kind[change[:-1]], rank[self.starts], rank[ends]) if n else np.zeros(0, np.uint64)
        self.begins = np.zeros(n, bool)
        if n:
            breaks = np.concatenate(([0], np.cumsum(raw == 10)))
            self.begins[0] = True
            self.begins[1:] = (self.doc[1:] != self.doc[:-1]) | (breaks[self.starts[1:]] != breaks[self.starts[:-1]])


def _ids(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """1 + place in the sorted table, 0 for anything else."""
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at + 1, 0)


class ChainField:
    """Weights of six indicator features for each label, and of label pairs."""

    def __init__(self, shapes: np.ndarray, cues: np.ndarray) -> None:
        self.shapes, self.cues = shapes, cues
        self.sizes = [len(shapes) + 2] * 3 + [len(cues) + 2] * 3
        self.weights = [np.zeros((n, K)) for n in self.sizes]
        self.pairs = np.zeros((K, K))
        self.pairs[[0, 0, 1, 1, 2, 3, 3, 4], [2, 4, 4, 0, 4, 2, 0, 2]] = [-50, -50, -50, 0, -50, -50, 0, -50]
        self.first = np.array([0.0, 0.0, -50.0, 0.0, -50.0])

    def features(self, w: Words) -> list[np.ndarray]:
        """Index of each word's features; the last index of a table stands for the border of a line."""
        out = []
        last = np.append(w.begins[1:], True)
        for own in (_ids(self.shapes, w.shape), _ids(self.cues, w.cue)):
            edge = (len(self.shapes) if len(out) == 0 else len(self.cues)) + 1
            before, after = np.roll(own, 1), np.roll(own, -1)
            before[w.begins], after[last] = edge, edge
            out += [own, before, after]
        return out

    def unary(self, features: list[np.ndarray]) -> np.ndarray:
        score = self.weights[0][features[0]]
        for table, f in zip(self.weights[1:], features[1:], strict=True):
            score = score + table[f]
        return score

    def fit(self, w: Words, labels: np.ndarray, steps: int = 200, rate: float = 0.15, decay: float = 0.002) -> None:
        """Adam on the penalised log likelihood."""
        features = self.features(w)
        first = np.flatnonzero(w.begins)
        size = np.diff(np.append(first, len(labels)))
        free = self.pairs > -40
        moments = [[np.zeros_like(x) for x in (*self.weights, self.pairs)] for _ in range(2)]
        for step in range(1, steps + 1):
            score = self.unary(features)
            grads = [np.zeros_like(x) for x in self.weights]
            pair_grad = np.zeros((K, K))
            node = np.zeros_like(score)
            for at, n in zip(first, size, strict=True):
                s = score[at : at + n]
                alpha, beta = np.zeros((n, K)), np.zeros((n, K))
                alpha[0] = s[0] + self.first
                for t in range(1, n):
                    alpha[t] = s[t] + _logsum(alpha[t - 1][:, None] + self.pairs, 0)
                for t in range(n - 2, -1, -1):
                    beta[t] = _logsum(self.pairs + (s[t + 1] + beta[t + 1])[None], 1)
                z = _logsum(alpha[-1], 0)
                node[at : at + n] = -np.exp(alpha + beta - z)
                for t in range(1, n):
                    pair_grad -= np.exp(alpha[t - 1][:, None] + self.pairs + (s[t] + beta[t])[None] - z)
                    pair_grad[labels[at + t - 1], labels[at + t]] += 1
            node[np.arange(len(labels)), labels] += 1
            for g, f in zip(grads, features, strict=True):
                np.add.at(g, f, node)
            for k, (x, g) in enumerate(zip((*self.weights, self.pairs), (*grads, pair_grad * free), strict=True)):
                g = g - decay * x * (free if k == 6 else 1)
                moments[0][k] = 0.9 * moments[0][k] + 0.1 * g
                moments[1][k] = 0.99 * moments[1][k] + 0.01 * g**2
                x += rate * moments[0][k] / (1 - 0.9**step) / (np.sqrt(moments[1][k] / (1 - 0.99**step)) + 1e-8)

    def decode(self, w: Words) -> np.ndarray:
        """The best labels of all lines: Viterbi over their pieces, then over the scores of whole pieces."""
        n = len(w.starts)
        labels = np.zeros(n, np.int64)
        if not n:
            return labels
        score = self.unary(self.features(w))
        lines = np.flatnonzero(w.begins)
        pieces = -(-np.diff(np.append(lines, n)) // SEGMENT)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(lines, pieces) + nth * SEGMENT
        size = np.diff(np.append(first, n))
        head, tail = np.flatnonzero(nth == 0), np.flatnonzero(nth)
        head, tail = head[np.argsort(-size[head], kind="stable")], tail[np.argsort(-size[tail], kind="stable")]
        final, back = self._forward(score, first[head], size[head], (score[first[head]] + self.first)[:, None])
        total, leave = np.zeros((len(first), K)), np.zeros(len(first), np.int64)
        total[head] = final[:, 0]
        if len(tail):
            through, back_tail = self._forward(score, first[tail], size[tail], self.pairs + score[first[tail]][:, None])
            enter = np.zeros((len(first), K), np.int64)
            row = np.zeros(len(first), np.int64)
            row[tail] = np.arange(len(tail))
            by_nth = np.argsort(nth, kind="stable")
            levels = np.split(by_nth, np.flatnonzero(np.diff(nth[by_nth])) + 1)[1:]
            for at in levels:
                step = total[at - 1][:, :, None] + through[row[at]]
                enter[at], total[at] = step.argmax(axis=1), step.max(axis=1)
        leave[:] = total.argmax(axis=1)
        if len(tail):
            for at in reversed(levels):
                leave[at - 1] = enter[at, leave[at]]
            self._backward(labels, first[tail], size[tail], back_tail, leave[tail - 1], leave[tail])
        self._backward(labels, first[head], size[head], back, np.zeros(len(head), np.int64), leave[head])
        return labels

    def _forward(self, score: np.ndarray, first: np.ndarray, size: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """One step for the t-th words of all pieces that have one, longest piece first. best: by piece, label before it, label."""
        alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
        back = []
        final = np.zeros_like(best)
        for t in range(1, size[0] + 1):
            m = alive[t] if t < size[0] else 0
            final[m:len(best)] = best[m:]
            if not m:
                break
            step = best[:m, :, :, None] + self.pairs
            back.append(step.argmax(axis=2).astype(np.int8))
            best = step.max(axis=2) + score[first[:m] + t][:, None]
        return final, back

    @staticmethod
    def _backward(labels: np.ndarray, first: np.ndarray, size: np.ndarray, back: list[np.ndarray], enter: np.ndarray, leave: np.ndarray) -> None:
        now = leave.copy()
        alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
        for t in range(size[0] - 1, -1, -1):
            m = alive[t]
            labels[first[:m] + t] = now[:m]
            if t:
                now[:m] = back[t - 1][np.arange(m), enter[:m], now[:m]]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(rows: list[str] | None = None) -> ChainField:
    """rows: lines with [name ...] and [id ...] marks. A small table, so the driver fits the field."""
    lines, marks = [], []
    for row in rows or LABELLED:
        for part in re.findall(r"\[(name|id) ([^\]]*)\](\S*)|(\S+)", row):
            kind, inner, tail, plain = part
            tokens = (inner + tail).split() if kind else [plain]
            lines += tokens
            marks += [0] if not kind else [LABELS.index(f"B-{kind}"), *[LABELS.index(f"I-{kind}")] * (len(tokens) - 1)]
        lines[-1] += "\n"
    raw = np.frombuffer(" ".join(lines).replace("\n ", "\n").encode(), np.uint8)
    ranges = RangeHash()
    w = Words(raw, np.array([0, len(raw)]), ranges)
    cue_text = " ".join(CUES).encode()
    cues = np.frombuffer(cue_text, np.uint8)
    s, e, _ = words(cues, np.array([0, len(cues)]))
    field = ChainField(np.unique(w.shape), np.unique(ranges(cues, s, e)))
    field.fit(w, np.array(marks))
    return field


def _added(field: ChainField, raw: np.ndarray, offsets: np.ndarray, ranges: RangeHash) -> dict[int, list[tuple[int, int, int]]]:
    """Spans of the field by document: (kind, start, end)."""
    w = Words(raw, offsets, ranges)
    labels = field.decode(w)
    out: dict[int, list[tuple[int, int, int]]] = {}
    hit = np.flatnonzero(labels)
    if not len(hit):
        return out
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    for i in hit.tolist():
        doc, kind = int(w.doc[i]), 4 + (int(labels[i]) - 1) // 2
        zero = points[offsets[doc]]
        start, end = int(points[w.starts[i]] - zero), int(points[w.ends[i]] - zero)
        spans = out.setdefault(doc, [])
        if labels[i] % 2 == 0 and spans and labels[i - 1]:
            spans[-1] = (kind, spans[-1][1], end)
        else:
            spans.append((kind, start, end))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, field: ChainField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end) as text, in the order of KINDS and then of start."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = RangeHash()
        for batch in text_slices(batches, "text", 1 << 19):
            raw, offsets = buffers(batch.column(1))
            seen = np.concatenate(([0], np.cumsum((raw >= 48) & (raw <= 57))))[offsets]
            signs = np.concatenate(([0], np.cumsum(raw == 64)))[offsets]
            added = _added(field, raw, offsets, ranges)
            texts, base_out, all_out = batch.column(1), [], []
            for i in range(batch.num_rows):
                base = []
                if seen[i + 1] > seen[i] or signs[i + 1] > signs[i]:
                    base = base_spans(texts[i].as_py() or "", bool(seen[i + 1] > seen[i]))
                more = [x for x in added.get(i, ()) if not any(s < x[2] and x[1] < e for _, s, e in base)]
                base_out.append(base)
                all_out.append(sorted(base + more))
            count = lambda kind: pa.array([sum(k == kind for k, _, _ in b) for b in base_out], pa.int64())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(count, range(4)), pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base_out]), pa.array([_joined(b) for b in all_out])],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op10_pii(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), train())


QUERIES = {"op10_pii": op10_pii}
