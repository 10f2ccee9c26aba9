"""SentencePiece encoding and decoding by a weighted finite-state transducer (operator 9).

The model is compiled once per worker into one machine: the normaliser's arcs (a space is read
as the piece mark; an arc without input puts a mark before the text), a trie of the pieces, and
fallback arcs that spell an unknown character in bytes. For byte-pair models a second factor
joins the machine: its states are the last pieces, and the arc from one piece to the next has a
finite weight only if merging would leave the two side by side. One path through a text then
has a finite weight: the tokens that merging by rank would give. For unigram models arcs weigh
the pieces' negative log-probabilities. Composed with an input, the machine is a lattice whose
shortest path in the tropical semiring gives the ids; the lattice is made lazily, where a path
of finite weight arrives.

No path runs across a place whose two characters stand side by side in no piece, nor, as marks
only begin pieces, across the front of a run of marks: texts fall apart there, and paths are
remembered per distinct segment. The arc without input is taken on the input itself (a space is
put before the text), so that the first segment is remembered like any other.

Decoding walks the inverted machine: an arc for each id, whose output is the piece's bytes with
marks as spaces, and whose first state drops the mark before the text. For models with the
identity normaliser the text returns exactly (the mark itself, U+2581, returns as a space).

Cases: null and empty text have no ids; a null doc_id is kept; control characters are spelt in
bytes; a very long segment costs in proportion to its length; repeated rows each return a row;
extra columns are ignored; an empty table returns no rows. Models with a normaliser other than
identity, or that fold white space, are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import _text as T
from plumbline.llm._memo import Memo
from plumbline.llm._stage import small_batches

MARK = "▁"
NEVER = float("inf")
BPE, UNIGRAM = 2, 1
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: What a byte-fallback arc weighs for each byte, and a piece arc of a byte-pair model.
FALLBACK, PIECE = 1e6, 1.0
#: Pairs of pieces whose arc a worker remembers at most.
PAIRS = 400_000


def _model(path: str):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


class Machine:
    """The compiled transducer of one model file."""

    def __init__(self, path: str) -> None:
        model = _model(path)
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only the identity normaliser with escaped white space is compiled")
        self.kind, self.prefix = model.trainer_spec.model_type, rules.add_dummy_prefix
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.piece = [p.piece for p in model.pieces]
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
        self.score = [p.score for p in model.pieces]
        self.trie: list[dict[str, int]] = [{}]
        self.final: list[int] = [-1]
        for text, i in self.id.items():
            at = 0
            for c in text:
                nxt = self.trie[at].get(c)
                if nxt is None:
                    nxt = self.trie[at][c] = len(self.trie)
                    self.trie.append({})
                    self.final.append(-1)
                at = nxt
            self.final[at] = i
        for arcs in self.trie:  # the normaliser's arc: a space is read as the mark
            if MARK in arcs:
                arcs[" "] = arcs[MARK]
        if MARK in self.id:
            self.id[" "] = self.id[MARK]
        if any(MARK in t.lstrip(MARK) for t in self.id):
            raise ValueError("only models whose marks begin pieces are compiled")
        #: Whether two characters stand side by side in a piece, for ASCII characters (the mark as a space); others may.
        self.joins = np.ones((256, 256), bool)
        self.joins[:128, :128] = False
        for t in self.id:
            t = t.replace(MARK, " ")
            for x, y in zip(t, t[1:]):
                if x < "\x80" and y < "\x80":
                    self.joins[ord(x), ord(y)] = True
        self.split: dict[str, tuple[str, str]] = {}
        self.follows: dict[int, bool] = {}
        self.edge: dict[int, tuple] = {}

    def rank(self, text: str) -> float:
        i = self.id.get(text)
        return NEVER if i is None else -self.score[i]

    def last_merge(self, text: str) -> tuple[str, str] | None:
        """The parts that merging joins last to make a piece; None if merging makes something else of its characters."""
        got = self.split.get(text)
        if got is None:
            parts, got = list(text), ("", "")
            while len(parts) > 1:
                ranks = [self.rank(a + b) for a, b in zip(parts, parts[1:])]
                k = ranks.index(min(ranks))
                if ranks[k] == NEVER:
                    break
                got = (parts[k], parts[k + 1])
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) > 1:
                got = ("", "")
            self.split[text] = got
        return got if got[0] else None

    def spine(self, i: int, right: bool) -> list[tuple[str, float]]:
        """The symbols at one edge of a piece while it is merged, each with the rank of the merge that ends it."""
        out, text, after = [], self.piece[i], NEVER
        while True:
            out.append((text, after))
            if len(text) == 1:
                return out[::-1]
            parts = self.last_merge(text)
            if parts is None:
                return []
            after, text = self.rank(text), parts[1 if right else 0]

    def allowed(self, a: int, b: int) -> bool:
        """Whether merging leaves piece b right after piece a."""
        key = a * len(self.piece) + b
        got = self.follows.get(key)
        if got is None:
            if len(self.follows) > PAIRS:
                self.follows.clear()
            left, right = self.edge.get((a, 1)), self.edge.get((b, 0))
            if left is None:
                left = self.edge[a, 1] = self.spine(a, True)
            if right is None:
                right = self.edge[b, 0] = self.spine(b, False)
            i = j = 0
            got = bool(left and right)
            while got:
                (x, ends_x), (y, ends_y) = left[i], right[j]
                across = self.rank(x + y)
                if across < ends_x and across <= ends_y:
                    got = False  # the two edges would merge before either grows
                elif ends_x == ends_y == NEVER:
                    break
                elif ends_x <= ends_y:
                    i += 1
                else:
                    j += 1
            self.follows[key] = got
        return got

    def shortest(self, text: str) -> list[int]:
        """The shortest path through the machine composed with a segment.

        The composition is a lattice over (place, last piece) and has no cycles, so its states are
        relaxed place by place; a state that no path of finite weight reaches is never made.
        """
        trie, final, follows, size, n, bpe = self.trie, self.final, self.follows, len(self.piece), len(text), self.kind == BPE
        lattice: list[dict[int, tuple] | None] = [None] * (n + 1)
        lattice[0] = {-1: (0.0, 0, -1, ())}
        for at in range(n):
            states = lattice[at]
            if states is None:
                continue
            node, end = 0, at
            while end < n:
                node = trie[node].get(text[end], -1)
                if node < 0:
                    break
                end += 1
                i = final[node]
                if i < 0:
                    continue
                to, weight = (i, PIECE) if bpe else (-1, -self.score[i])
                for last, state in states.items():
                    if last >= 0:
                        ok = follows.get(last * size + i)
                        if not (self.allowed(last, i) if ok is None else ok):
                            continue
                    there, total = lattice[end], state[0] + weight
                    if there is None:
                        lattice[end] = {to: (total, at, last, i)}
                    elif to not in there or total < there[to][0]:
                        there[to] = (total, at, last, i)
            if text[at] not in self.id:
                raw = text[at].encode("utf-8", "replace")
                last = min(states, key=lambda k: states[k][0])  # noqa: B023  called at once
                total = states[last][0] + FALLBACK * len(raw)
                there = lattice[at + 1] = lattice[at + 1] or {}
                if -1 not in there or total < there[-1][0]:
                    there[-1] = (total, at, last, tuple(self.bytes[x] for x in raw) if self.bytes else (self.unknown,))
        if lattice[n] is None:
            raise ValueError("no path")
        at, last, out = n, min(lattice[n], key=lambda k: lattice[n][k][0]), []
        while at:
            _, at, last, ids = lattice[at][last]
            out += ids[::-1] if isinstance(ids, tuple) else (ids,)
        return out[::-1]

    def encode(self, span: bytes) -> list[int]:
        """Ids of a segment."""
        return self.shortest(span.decode("utf-8", "replace"))


class Inverse:
    """The inverted machine: one arc for each id, from pieces to bytes and from marks to spaces.

    It has two states. From the first one an arc drops the mark that the normaliser has put
    before the text; all arcs lead to the second one.
    """

    def __init__(self, path: str) -> None:
        model = _model(path)
        rest, start = [], []
        for p in model.pieces:
            out = bytes([int(p.piece[3:-1], 16)]) if p.type == BYTE else b"" if p.type in (CONTROL, UNKNOWN) else p.piece.replace(MARK, " ").encode()
            rest.append(out)
            start.append(out[1:] if model.normalizer_spec.add_dummy_prefix and p.type in (NORMAL, USER) and out[:1] == b" " else out)
        self.size = len(rest)
        self.out = np.frombuffer(b"".join(rest + start), np.uint8)
        self.length = np.fromiter(map(len, rest + start), np.int64, 2 * self.size)
        self.at = np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes that all rows' ids spell, one row after another, and the rows' offsets."""
        arc = ids.astype(np.int64)
        arc[off[:-1][np.diff(off) > 0]] += self.size
        n = self.length[arc]
        return self.out[T.ranges(self.at[arc], n)].tobytes(), np.concatenate(([0], np.cumsum(n)))[off]



@cache
def inverse(path: str) -> Inverse:
    return Inverse(path)


_machines: dict[str, tuple[Machine, Memo]] = {}


def machine(path: str) -> tuple[Machine, Memo]:
    if path not in _machines:
        m = Machine(path)
        _machines[path] = (m, Memo(lambda spans: list(map(m.encode, spans))))
    return _machines[path]


def segments(buf: np.ndarray, off: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all rows' segments, cut where no piece can reach across, and the rows' offsets among them."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    first = np.ones(len(buf), bool)
    first[1:] = ~joins[buf[:-1], buf[1:]] | (buf[1:] == 32) & (buf[:-1] != 32)
    first[off[:-1][off[:-1] < off[1:]]] = True
    s = np.flatnonzero(first)
    return s, np.append(s[1:], len(buf)), np.searchsorted(s, off)


def encode_rows(path: str, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows and the rows' offsets among them."""
    m, memo = machine(path)
    raw = buf.tobytes()
    mark = MARK.encode()
    if mark in raw:  # the mark itself is read as a space
        rows = [raw[a:b].replace(mark, b" ") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        buf, off = np.frombuffer(b"".join(rows), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in rows])))
    if m.prefix:
        full = np.diff(off) > 0
        buf = np.insert(buf, off[:-1][full], 32)
        off = off + np.concatenate(([0], np.cumsum(full)))
    s, e, w = segments(buf, off, m.joins)
    ids, at = memo.ids_of(buf, s, e)
    return ids, at[w]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) per row."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.bytes_of(batch.column("text"))
            for lo, hi in T.slices(off):
                ids, w = encode_rows(path, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                raw = ids.astype("<u4")
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "ids": pa.array([raw[a:b].tobytes() for a, b in zip(w[:-1].tolist(), w[1:].tolist(), strict=True)], pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text (as bytes) that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = T.bytes_of(batch.column("ids"))
            for lo, hi in T.slices(at):
                data, w = inverse(path).decode(np.frombuffer(raw[at[lo] : at[hi]].tobytes(), "<u4"), (at[lo : hi + 1] - at[lo]) // 4)
                text = pa.array([data[a:b] for a, b in zip(w[:-1].tolist(), w[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "ids": batch.column("ids").slice(lo, hi - lo), "decoded": text})

    return encoded.mapInArrow(run, "doc_id long, ids binary, decoded binary")
