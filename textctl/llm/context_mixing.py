"""LM scoring by online logistic context mixing.

A text is its words (A-Z lower-cased) joined by single blanks, and one end
mark. It is coded byte by byte along a binary code tree, so that a byte is a
few binary decisions. Several predictors, each with a context (the last
two, four or five bytes), give the probability of each decision from counts
gathered over all training texts.
Their logits are combined by weights chosen by a gate (the kind of the last
byte, the depth in the tree); the weights learn online within each text, and
an adaptive map refines the mixture's probability. The sum over decisions is
the text's log-probability; it divides into bits per byte.

Distribution: a context with the byte after it is one number, predictor and
bytes as they are, so no two contexts share counts and what is gathered grows
with the input. A block of some megabytes of texts asks for each such number
once, with its count in training texts; the numbers are dealt by their
context into pieces, whose number grows with the input as well. A piece adds
up the counts of all blocks and answers each block with the logits of the
decisions it asked for, which meet the block's texts in a join. Nothing is
broadcast but the code, and blocks and pieces are written before they are
dealt, so a task that runs again sends the same rows.
Scoring starts each text from the same weights, so results depend neither on
partitions nor on other texts. Texts of a batch are scored side by side: the
weights are updated after blocks of bytes, 32 at first and then a sixteenth
of what has been read. A byte with the longest context before it is a gram; a
block looks up its distinct grams instead of its bytes, as all predictors'
numbers and decisions of a byte follow from its gram.

The base line is a smoothed unigram model over words, learnt from the same
texts and gathered in the same way: a block asks once for each of its distinct
words, identified by 64-bit hashes, and is answered with the corpus counts.
Neither tokens nor a row for each word are moved.

Defined results: a null or empty text is one end mark; a null id counts as
'' when texts are held out; equal texts get equal scores; without training
texts all counts are 0; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import heapq
import math
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import LOWER, mix64, saved, text_session, word_hashes

_END_HASH = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Params:
    """``bits``: log2 of each predictor's counters where a ``Scorer`` is given
    arrays of fixed size; ``score`` gathers by context and has none.
    ``block_bytes``, ``block_tokens``: of texts that ask for counts together."""

    bits: tuple[int, ...] = (18, 22, 22)
    prior: float = 0.05
    rate: float = 0.02
    start: tuple[float, ...] = (0.3, 0.4, 0.45)
    block_tokens: int = 4_000_000
    block_bytes: int = 4 << 20
    piece_bytes: int = 4 << 20


def normalised(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).strip(b" ")
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data + b"\n"


_PLAIN = bytes(32 if 9 <= b <= 13 else b for b in LOWER)  # blanks alone between words


class Code:
    """A Huffman code of the 256 bytes for each byte that may stand before:
    the inner nodes passed and the turns taken, one after the other. A usual
    byte is few decisions; the bits are the same as with any other code tree,
    as the predictors decide each turn."""

    def __init__(self, counts: np.ndarray):
        """``counts``: 256 x 256, of pairs of bytes."""
        counts = np.asarray(counts).reshape(256, 256)
        length, nodes, turns = np.zeros((256, 256), np.int64), [], []
        unseen = _paths(np.zeros(256, np.int64))  # one code for all bytes never seen
        for before in range(256):
            paths = _paths(counts[before]) if counts[before].any() else unseen
            for b, path in enumerate(paths):
                length[before, b] = len(path)
                nodes.extend(n for n, _ in path)
                turns.extend(t for _, t in path)
        self.length = length.ravel()
        self.offset = np.cumsum(self.length) - self.length
        self.node = np.array(nodes)
        self.turn = np.array(turns, np.uint8)
        depth = np.arange(len(nodes)) - np.repeat(self.offset, self.length)
        self.gate = np.minimum(depth, 3)

    @cached_property
    def mark(self) -> np.ndarray:
        """Of each step its gate and turn, as one number."""
        kind = np.repeat(np.repeat(_KIND, 256), self.length)  # of the byte before
        return ((kind + self.gate) << 1 | self.turn).astype(np.int16)


def _paths(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each byte its path from the root (node 0): nodes and turns."""
    heap = [(int(c) + 1, b, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    for node in range(256, 511):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[2]], parent[b[2]] = (node, 0), (node, 1)
        heapq.heappush(heap, (a[0] + b[0], node, node))
    out = []
    for b in range(256):
        path, at = [], b
        while at in parent:
            at, turn = parent[at]
            path.append((510 - at, turn))
        out.append(path[::-1])
    return out


_PAD = 8  # zero bytes before each text


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with padding, and where each starts."""
    data = np.frombuffer(b"".join(b"\0" * _PAD + t for t in texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    return data, np.cumsum(sizes + _PAD) - sizes


def _along(start: np.ndarray, each: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of paths of ``each`` steps (one at least) that start there: the place
    of each step; ``ends``: the sums of ``each``. Sums of differences, as
    repeating short paths takes longer."""
    x = np.ones(ends[-1] if len(ends) else 0, np.int64)
    x[:1] = start[:1]
    x[ends[:-1]] += np.diff(start) - each[:-1]
    return np.cumsum(x)


def _taken(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``x`` at places known to be in it: not checking each is faster."""
    return x.take(at, mode="clip")


def _mix32(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def _contexts(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """A 32-bit hash of each predictor's context before the bytes ``at``."""
    one, two, three, four, five = (data[at - i].astype(np.uint32) for i in range(1, 6))
    two = one | (two << np.uint32(8))
    four = two | (three << np.uint32(16)) | (four << np.uint32(24))
    mixed = _mix32(four)
    return [_mix32(two + np.uint32(0x1000000)), mixed, _mix32(mixed + five)]


class Places:
    """The decisions of some bytes, and each predictor's counter for them:
    the hash of the context, its last bits exchanged by the node's number.
    So a context's counters lie side by side, the usual nodes' in one line
    of the cache."""

    def __init__(self, code: Code, data: np.ndarray, at: np.ndarray, bits: tuple[int, ...]):
        symbols = data[at] | (data[at - 1].astype(np.int64) << 8)
        self.each = code.length.take(symbols)
        self._code, self._data, self._at, self.bits = code, data, at, bits
        self.place = _along(code.offset.take(symbols), self.each, np.cumsum(self.each))
        self.turn = code.turn.take(self.place)

    def counter(self, k: int) -> np.ndarray:
        x = np.repeat((self._hashes[k] >> np.uint32(32 - self.bits[k])).astype(np.int64), self.each)
        x ^= self._node
        return x

    @cached_property
    def _hashes(self) -> list[np.ndarray]:
        return _contexts(self._data, self._at)

    @cached_property
    def _node(self) -> np.ndarray:
        return self._code.node.take(self.place)


def _kinds() -> np.ndarray:
    """The gate's kinds of bytes."""
    kind = np.full(256, 2)
    kind[[0, 32]] = 0
    kind[97:123] = 1
    kind[128:] = 3
    return 4 * kind


_KIND = _kinds()
_GATES = 16
_STEPS = 33  # of the adaptive map, over logits from -8 to 8


class Gathered:
    """The decisions of the bytes of some texts, whose first bytes are at
    ``start`` of ``spans``: of each byte where its decisions start in
    ``steps``, and how many it has (the lowest byte)."""

    def __init__(self, steps: np.ndarray, spans: np.ndarray, start: np.ndarray):
        self.steps, self.spans, self.start = steps, spans, start

    def decisions(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of the bytes ``at``: the sums of the numbers of decisions, and each
        decision's gate, turn and logits."""
        span = _taken(self.spans, at)
        each = span & 0xFF
        span >>= 8
        ends = np.cumsum(each)
        step = _taken(self.steps, _along(span, each, ends)).view(np.int16).reshape(-1, 4)
        x = [step[:, k].astype(np.float32) for k in range(3)]
        for one in x:
            one *= np.float32(1 / _UNIT)
        gate = step[:, 3].astype(np.int64)
        turn = gate & 1
        gate >>= 1
        return ends, gate, turn, x


class Hashed:
    """The same from arrays of logits in sixteenths for hashed contexts."""

    def __init__(self, code: Code, tables: list[np.ndarray], bits: tuple[int, ...], texts: list[bytes]):
        self.code, self.tables, self.bits = code, tables, bits
        self.data, self.start = _buffer(texts)

    def decisions(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        d = Places(self.code, self.data, at, self.bits)
        gate = np.repeat(_KIND[self.data[at - 1]], d.each) + self.code.gate.take(d.place)
        return np.cumsum(d.each), gate, d.turn.astype(np.int64), [t.take(d.counter(k), mode="clip").astype(np.float32) / np.float32(16) for k, t in enumerate(self.tables)]


class Scorer:
    """``tables``: what was gathered for the texts, or per predictor an array
    of logits in sixteenths for hashed contexts."""

    def __init__(self, code: Code, tables: list[np.ndarray] | Gathered, p: Params):
        self.code, self.p = code, p
        self.tables = tables

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Natural logarithms of the texts' probabilities."""
        p = self.p
        source = self.tables if isinstance(self.tables, Gathered) else Hashed(self.code, self.tables, p.bits, texts)
        size = np.array([len(t) for t in texts])
        order = np.argsort(-size, kind="stable")  # the longest first: those still read are a prefix
        start, size = source.start[order], size[order]
        total = np.zeros(len(texts))
        # of each gate the predictors' weights and the rate of learning
        weights = np.empty((len(texts) * _GATES, 4), np.float32)
        weights[:, :3] = p.start
        packed = weights.view(np.complex128).ravel()
        refined = np.tile((1 / (1 + np.exp(-np.linspace(-8, 8, _STEPS)))).astype(np.float32), len(texts))
        seen = np.full(len(texts) * _STEPS, 6.0, np.float32)
        read = 0
        while (alive := int(np.searchsorted(-size, -read))) > 0:
            n = np.minimum(size[:alive] - read, max(32, min(read // 16, 1 << 16)))
            upto = np.cumsum(n)
            ends, gate, turn, x = source.decisions(_along(start[:alive] + read, n, upto))
            edge = ends.take(upto - 1)  # after each text's decisions
            mine = np.diff(edge, prepend=0)
            gate += np.repeat(np.arange(alive) * _GATES, mine)
            m = alive * _GATES
            weights[:m, 3] = p.rate / (1 + np.bincount(gate, minlength=m) / 64)
            weight = _taken(packed, gate).view(np.float32).reshape(-1, 4)
            bit = turn.astype(np.float32)
            logit = np.zeros(len(bit), np.float32)
            for k, one in enumerate(x):
                logit += one * weight[:, k]
            np.clip(logit, -7.99, 7.99, out=logit)
            mix = np.exp(-logit)
            mix += 1
            np.divide(1, mix, out=mix)
            # the adaptive map, between the two nearest of its values
            step = logit
            step += np.float32(8)
            step *= np.float32((_STEPS - 1) / 16)
            whole = np.floor(step)
            step -= whole
            low = whole.astype(np.intp)
            low += np.repeat(np.arange(alive) * _STEPS, mine)
            final = _taken(refined, low)
            final *= 1 - step
            final += mix
            above = _taken(refined[1:], low)
            above *= step
            final += above
            final /= 2
            # the probability of the turn taken
            final -= 1 - bit
            np.abs(final, out=final)
            total[:alive] += np.add.reduceat(np.log(final), edge - mine, dtype=np.float64)
            # learning, once per block
            error = bit - mix
            error *= weight[:, 3]
            for k, one in enumerate(x):
                one *= error
                weights[:m, k] += np.bincount(gate, one, m).astype(np.float32)
            m = alive * _STEPS
            low += (step > 0.5).astype(np.intp)
            low <<= 1
            low |= turn
            met = np.bincount(low, minlength=2 * m).reshape(m, 2)  # zeros and ones
            upto = seen[:m] + (met[:, 0] + met[:, 1])
            refined[:m] += ((met[:, 1] - (upto - seen[:m]) * refined[:m]) / upto).astype(np.float32)
            seen[:m] = np.minimum(upto, 255)
            read += int(n[0])
        out = np.empty(len(texts))
        out[order] = total
        return out


def counts(code: Code, texts: list[bytes], bits: tuple[int, ...], into: list[np.ndarray]) -> None:
    """Adds the texts' decisions to the predictors' counters (left and right
    turns side by side)."""
    data, start = _buffer(texts)
    n = np.array([len(t) for t in texts])
    at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
    d = Places(code, data, at, bits)
    for k, array in enumerate(into):
        slot = d.counter(k)
        slot <<= 1
        slot |= d.turn
        np.add(array, np.bincount(slot, minlength=len(array)), out=array, casting="unsafe")


def _logits(ones: np.ndarray, all_: np.ndarray, prior: float) -> np.ndarray:
    """One byte per counter: the logit in sixteenths."""
    x = np.log((ones + prior) / (all_ - ones + prior)) * 16
    return np.clip(np.rint(x), -127, 127).astype(np.int8)


_ORDERS = (2, 4, 5)  # bytes of each predictor's context
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))
_UNIT = 32  # a logit of 1 among gathered logits
_TEXT_BYTES = 1 << 20  # of texts worked on together
_SCORED_BYTES = 1 << 19  # of texts scored side by side
_HASHED_BYTES = 1 << 16  # of texts whose words are hashed together


def _chunks(texts: list[bytes], most: int = _TEXT_BYTES) -> Iterator[list[bytes]]:
    chunk, size = [], 0
    for t in texts:
        chunk.append(t)
        size += len(t)
        if size >= most:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bytes ``at``, each with the longest context, as numbers; the byte
    itself and the nearest bytes come last."""
    eight = np.ndarray(len(data) - 7, ">u8", data, strides=(1,)).astype(np.uint64)  # from each byte on
    return _taken(eight, at - 7) & _lowest(1 + max(_ORDERS))


def _lowest(n: int) -> np.uint64:
    """A mask of ``n`` bytes."""
    return np.uint64((1 << 8 * n) - 1)


def _dealt(keys: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct keys by piece, and the place of each in it."""
    order = np.argsort(keys)
    small = piece.astype(np.min_scalar_type(piece.max()))  # short numbers are sorted faster
    order = order[np.argsort(small[order], kind="stable")]
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return order, rank


def _cuts(piece: np.ndarray) -> list[tuple[int, int]]:
    """Where each piece starts and ends."""
    edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
    return list(zip(edges, edges[1:]))


class Words:
    """The distinct words of a block of texts, by piece, with ``piece``;
    ``code``: which of them each token is, ``sizes``: the tokens of each
    text."""

    def __init__(self, texts: list[bytes], pieces: int):
        self.sizes = np.array([_n_tokens(t) for t in texts])
        code, keys = pd.factorize(np.concatenate([_token_hashes(*some) for some in _chunks(texts, _HASHED_BYTES)]))
        piece = (mix64(keys) % np.uint64(pieces)).astype(np.int64)
        order, rank = _dealt(keys, piece)
        self.keys, self.piece, self.code = keys[order], piece[order], _taken(rank, code)

    def learnt(self, train: np.ndarray) -> np.ndarray:
        """The words' numbers in training texts."""
        return np.bincount(self.code[np.repeat(train, self.sizes)], minlength=len(self.keys))

    def base(self, count: np.ndarray, log_all: float) -> tuple[list[int], list[float]]:
        """Of each text the tokens with a count and the score, from the
        answers in the order of the keys."""
        logs = _taken(np.log10(count + 0.1) - log_all, self.code)
        edge = [0, *np.cumsum(self.sizes).tolist()]
        known = np.add.reduceat(_taken(count > 0, self.code), edge[:-1], dtype=np.int64)
        return known.tolist(), [math.fsum(logs[x:y].tolist()) for x, y in zip(edge, edge[1:])]


def _n_tokens(data: bytes) -> int:
    """Of a normalised text: its words and the end."""
    return data.count(b" ") + (len(data) > 1) + 1


def _token_hashes(*texts: bytes) -> np.ndarray:
    """Of normalised texts, one after the other: their words and the ends."""
    words = [_n_tokens(t) - 1 for t in texts]
    return np.insert(word_hashes(b"".join(texts)), np.cumsum(words), _END_HASH)


def _word_pieces(pieces: int) -> int:
    """Words are fewer than contexts."""
    return max(1, pieces // 4)


class Asked:
    """The distinct ``keys`` of a block of texts, by piece, with ``piece``: a
    predictor, its context's bytes and the byte after it. They are found from
    the distinct grams, as a byte's gram has its key of each predictor;
    ``code``: which gram each byte is, ``which``: per predictor, which key
    each gram has."""

    def __init__(self, chunks: list[list[bytes]], pieces: int):
        grams = []
        for chunk in chunks:
            data, start = _buffer(chunk)
            n = np.array([len(t) for t in chunk])
            grams.append(_grams(data, _along(start, n, np.cumsum(n))))
        # multiplied by an odd number, as a hash table scatters letters badly
        code, found = pd.factorize((np.concatenate(grams) * _ODD).view(np.int64))
        self.grams = found.view(np.uint64) * _BACK
        self.code = code.astype(np.int32)
        found, which, known = [], [], 0
        for k, order in enumerate(_ORDERS):
            code, keys = pd.factorize(self.grams & _lowest(order + 1))
            which.append(code + known)
            found.append(keys | np.uint64(k << 48))
            known += len(keys)
        keys = np.concatenate(found)
        piece = (mix64(keys >> np.uint64(8)) % np.uint64(pieces)).astype(np.int64)
        order, rank = _dealt(keys, piece)
        self.keys, self.piece = keys[order], piece[order]
        self.which = [_taken(rank, c) for c in which]

    def learnt(self, train: np.ndarray) -> np.ndarray:
        """The keys' numbers in the bytes of training texts."""
        n = self._numbers(train)
        return sum(np.bincount(c, n, len(self.keys)) for c in self.which).astype(np.int64)

    def pairs(self, train: np.ndarray) -> np.ndarray:
        """The numbers of pairs of bytes there; a text's first byte stands
        after a zero byte."""
        return np.bincount((self.grams & _lowest(2)).astype(np.int64), self._numbers(train), 1 << 16).astype(np.int64)

    def _numbers(self, train: np.ndarray) -> np.ndarray:
        return np.bincount(self.code[train], minlength=len(self.grams))

    def spans(self, code: Code, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From all answers in the order of the keys the steps of all grams,
        four short numbers side by side (the predictors' logits, then gate and
        turn), and of each byte where its steps start and their number."""
        begin, which, _ = _decisions(code, self.keys)
        logits = _taken(logits, which)
        del which
        pair = (self.grams & _lowest(2)).astype(np.int64)
        each = _taken(code.length, pair)
        ends = np.cumsum(each)
        steps = np.empty((int(each.sum()), 4), np.int16)
        for k, keys in enumerate(self.which):
            steps[:, k] = _taken(logits, _along(_taken(begin, keys), each, ends))
        steps[:, 3] = _taken(code.mark, _along(_taken(code.offset, pair), each, ends))
        return steps.view(np.int64).ravel(), _taken((ends - each) << 8 | each, self.code)


def _decisions(code: Code, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys whose contexts stand together: where each path starts, which
    decision of its context each step is, and the first step of each
    decision. Paths of one context share their decisions."""
    pair = (keys & np.uint64(0xFFFF)).astype(np.int64)
    length = _taken(code.length, pair)
    ends = np.cumsum(length)
    begin = ends - length
    place = _along(_taken(code.offset, pair), length, ends)
    edge = np.flatnonzero(np.diff(keys >> np.uint64(8), prepend=np.uint64((1 << 64) - 1)))  # first key of each context
    start = _taken(begin, edge)
    # some contexts at a time: the first step at each of their nodes
    slot = np.repeat(np.arange(len(edge)) % _TOGETHER << 8, np.diff(start, append=len(place)))
    slot += _taken(code.node, place)
    step, met = np.arange(len(place)), np.empty(len(place), np.int64)
    at = np.empty(min(_TOGETHER, len(edge)) << 8, np.int64)
    cut = [*start[::_TOGETHER].tolist(), len(place)]
    for x, y in zip(cut, cut[1:]):
        at[slot[x:y][::-1]] = step[x:y][::-1]
        at.take(slot[x:y], out=met[x:y], mode="clip")
    new = met == step
    return begin, _taken(np.cumsum(new) - 1, met), np.flatnonzero(new)


_TOGETHER = 1 << 9  # contexts whose nodes are in the cache together


def _packed(x: np.ndarray, strategy: int = zlib.Z_DEFAULT_STRATEGY) -> bytes:
    """Numbers as planes of bytes, compressed; ``zlib.Z_RLE`` suits planes
    without repeated sequences."""
    packer = zlib.compressobj(1, strategy=strategy)
    return packer.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()) + packer.flush()


def _unpacked(payload: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(payload), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _texts_packed(texts: list[bytes]) -> bytes:
    data = b"".join(texts)
    return len(data).to_bytes(8, "little") + _TEXTS.compress(data, asbytes=True)


def _texts_unpacked(payload: bytes) -> list[bytes]:
    """A text's only line feed is its end."""
    data = _TEXTS.decompress(payload[8:], int.from_bytes(payload[:8], "little"), asbytes=True)
    return [t + b"\n" for t in data.split(b"\n")[:-1]]


_TEXTS = pa.Codec("zstd", compression_level=4)


def _asked(rows: DataFrame, pieces: int, p: Params) -> DataFrame:
    """Four kinds of rows from (id, held, text). Kind 0, a document: its
    block and place in it; the first of some documents has all their texts,
    which are smaller compressed together. Kind 1, keys of a block that are in one
    piece, as differences, and their numbers in training texts. Kind 2, the
    same of a block's words. Kind 3, a pair of bytes (part) and its number in
    a task's training texts."""
    names = ["kind", "block", "part", "id", "held", "payload", "learnt", "n"]
    kind = rows.schema["id"].dataType
    types = [pa.int32(), pa.int64(), pa.int32(), to_arrow_type(kind), pa.bool_(), pa.binary(), pa.binary(), pa.int64()]

    def batch(rows: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(rows, t) for c, t in zip(names, types)], names)

    def questions(kind: int, block: int, keys: np.ndarray, piece: np.ndarray, learnt: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = _cuts(piece)
        for i in range(0, len(cut), 200):
            some = cut[i : i + 200]
            payload = [_packed(np.diff(keys[x:y], prepend=np.uint64(0)), zlib.Z_RLE) for x, y in some]
            numbers = [_packed(learnt[x:y].astype(np.uint32), zlib.Z_RLE) for x, y in some]
            yield batch(len(some), kind=[kind] * len(some), block=[block] * len(some), part=[int(piece[x]) for x, _ in some], payload=payload, learnt=numbers)

    def flushed(seen: np.ndarray, ids: list, held: list, texts: list) -> Iterator[pa.RecordBatch]:
        block = int.from_bytes(os.urandom(8), "big") >> 1
        train = ~np.array(held, bool)
        asked = Asked(list(_chunks(texts)), pieces)
        learnt = np.repeat(train, [len(t) for t in texts])
        seen += asked.pairs(learnt)
        yield from questions(1, block, asked.keys, asked.piece, asked.learnt(learnt))
        del asked
        words = Words(texts, _word_pieces(pieces))
        yield from questions(2, block, words.keys, words.piece, words.learnt(train))
        for i in range(0, len(ids), 200):
            j = range(i, min(i + 200, len(ids)))
            yield batch(len(j), kind=[0] * len(j), block=[block] * len(j), part=list(j), id=ids[i : j.stop], held=held[i : j.stop], payload=[_texts_packed(texts[i : j.stop]), *[None] * (len(j) - 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: tuple[list, list, list] = ([], [], [])
        size, tokens, seen = 0, 0, np.zeros(1 << 16, np.int64)
        for b in batches:
            for doc, held, text in zip(*(c.to_pylist() for c in b.columns)):
                data = normalised(text)
                for column, value in zip(block, (doc, held, data)):
                    column.append(value)
                size += len(data)
                tokens += _n_tokens(data)
                if size >= p.block_bytes or tokens >= p.block_tokens:
                    yield from flushed(seen, *block)
                    block, size, tokens = ([], [], []), 0, 0
        if size:
            yield from flushed(seen, *block)
        (some,) = np.nonzero(seen)
        yield batch(len(some), kind=[3] * len(some), part=some, n=seen[some])

    return rows.select("id", "held", "text").mapInArrow(run, f"kind int, block long, part int, id {kind.simpleString()}, held boolean, payload binary, learnt binary, n long")


def _by_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list, list]]:
    """Of each piece the blocks, their keys and numbers."""
    piece, held = None, ([], [], [])
    for b in batches:
        for part, block, payload, learnt in zip(*(c.to_pylist() for c in b.columns)):
            if part != piece:
                if held[0]:
                    yield piece, *held
                piece, held = part, ([], [], [])
            held[0].append(block)
            held[1].append(np.cumsum(_unpacked(payload, np.uint64), dtype=np.uint64))
            held[2].append(_unpacked(learnt, np.uint32))
    if held[0]:
        yield piece, *held


def _questions(asked: DataFrame, kind: int) -> DataFrame:
    rows = asked.filter(F.col("kind") == kind).select("part", "block", "payload", "learnt")
    return rows.repartition("part").sortWithinPartitions("part")


def _word_counts(asked: DataFrame) -> DataFrame:
    """(block, part, payload, total, known): for each block and piece the
    counts of its words in all blocks; once for each piece the sum of its
    words' counts, and how many have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, blocks, keys, learnt in _by_piece(batches):
            distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(which, np.concatenate(learnt), len(distinct)).astype(np.uint64)
            mine = np.split(which, np.cumsum([len(k) for k in keys])[:-1])
            once = [0] * (len(blocks) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array([piece] * len(blocks), pa.int32()), pa.array([_packed(n.take(w)) for w in mine], pa.binary()), pa.array([int(n.sum()), *once], pa.int64()), pa.array([int(np.count_nonzero(n)), *once], pa.int64())],
                ["block", "part", "payload", "total", "known"],
            )

    return _questions(asked, 2).mapInArrow(run, "block long, part int, payload binary, total long, known long")


def _paths_logits(code: Code, keys: np.ndarray, n: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The logits of the decisions of sorted distinct keys that occur ``n``
    times, one path after the other, and where each path starts."""
    edge = np.flatnonzero(np.diff(keys >> np.uint64(8), prepend=np.uint64((1 << 64) - 1)))  # first key of each context
    out, begins, done = [], [], 0
    for x, y in zip(edge[::_CONTEXTS], [*edge[_CONTEXTS::_CONTEXTS], len(keys)]):
        begin, which, _ = _decisions(code, keys[x:y])
        begins.append(begin + done)
        pair = (keys[x:y] & np.uint64(0xFFFF)).astype(np.int64)
        length = _taken(code.length, pair)
        turn = _taken(code.turn, _along(_taken(code.offset, pair), length, begin + length))
        times = np.repeat(n[x:y], length)
        all_ = np.bincount(which, times)
        ones = np.bincount(which, times * turn, len(all_))
        logit = np.log((ones + prior) / (all_ - ones + prior)) * _UNIT
        out.append(_taken(np.rint(logit).astype(np.int16), which))
        done += len(which)
    return np.concatenate(out), np.concatenate(begins)


_CONTEXTS = 1 << 13  # whose counters are in memory together


def _answers(asked: DataFrame, code, p: Params) -> DataFrame:
    """(block, part, payload): for each block and piece the logits of the
    decisions of its keys, from the numbers in all blocks. ``code`` is
    broadcast."""

    def answered(piece: int, blocks: list, keys: list, learnt: list) -> Iterator[pa.RecordBatch]:
        sizes = [len(k) for k in keys]
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(which, np.concatenate(learnt))
        logits, begin = _paths_logits(code.value, distinct, n, p.prior)
        at = 0
        for block, size in zip(blocks, sizes):
            mine = which[at : at + size]
            at += size
            path, _, first = _decisions(code.value, distinct.take(mine))
            key = np.searchsorted(path, first, "right") - 1
            place = _taken(begin, _taken(mine, key)) + first - _taken(path, key)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([piece], pa.int32()), pa.array([_packed(_taken(logits, place))], pa.binary())], ["block", "part", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_piece(batches):
            yield from answered(*held)

    return _questions(asked, 1).mapInArrow(run, "block long, part int, payload binary")


def _scored(texts: list[bytes], steps: np.ndarray, spans: np.ndarray, code: Code, p: Params) -> np.ndarray:
    """Natural logarithms of the probabilities of a block's texts; texts of
    like sizes are scored together."""
    n = np.array([len(t) for t in texts])
    start = np.cumsum(n) - n
    order = np.argsort(n, kind="stable")
    out, done = np.empty(len(texts)), 0
    for chunk in _chunks([texts[i] for i in order], _SCORED_BYTES):
        some = order[done : done + len(chunk)]
        out[some] = Scorer(code, Gathered(steps, spans, start[some]), p)(chunk)
        done += len(chunk)
    return out


def score(docs: DataFrame, held_out: Column, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` and ``score`` (log10), ``n_bytes`` and
    ``bits_per_byte``. Learns from the rows that are not held out."""
    spark = docs.sparkSession
    text_session(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    pieces = 32 + n_bytes // p.piece_bytes
    asked = saved(_asked(rows, pieces, p), "asked", by="kind")
    seen = np.zeros(1 << 16, np.int64)
    for r in asked.filter("kind = 3").groupBy("part").agg(F.sum("n").alias("n")).collect():
        seen[r["part"]] = r["n"]
    sent = spark.sparkContext.broadcast(Code(seen))
    counts = saved(_word_counts(asked), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    log_all = math.log10(total + 0.1 * (distinct + 1))
    kind = rows.schema["id"].dataType.simpleString()
    answers = [x.select("block", F.lit(i).alias("kind"), "part", "payload", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("boolean").alias("held")) for i, x in enumerate((_answers(asked, sent, p), counts))]
    both = answers[0].unionAll(answers[1]).unionAll(asked.filter("kind = 0").select("block", F.lit(2).alias("kind"), "part", "payload", "id", "held"))
    # a block's answers come before its documents
    both = both.repartition("block").sortWithinPartitions("block", "kind", "part")
    arrow = to_arrow_type(rows.schema["id"].dataType)

    def scores(answers: list, counts: list, docs: list) -> pa.RecordBatch:
        code = sent.value
        texts = [t for d in docs if d[0] is not None for t in _texts_unpacked(d[0])]
        words = Words(texts, _word_pieces(pieces))
        known, base = words.base(np.concatenate([_unpacked(c, np.uint64) for c in counts]), log_all)
        block = Asked(list(_chunks(texts)), pieces)
        logs = _scored(texts, *block.spans(code, np.concatenate([_unpacked(a, np.int16) for a in answers])), code, p)
        n = np.array([len(t) for t in texts], np.int64)
        ids, held = (pa.array([d[i] for d in docs], t) for i, t in ((1, arrow), (2, pa.bool_())))
        return pa.RecordBatch.from_arrays(
            [ids, held, pa.array(words.sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(logs / math.log(10)), pa.array(n), pa.array(-logs / math.log(2) / np.maximum(n, 1))],
            ["id", "held", "n_tokens", "n_known", "base_score", "score", "n_bytes", "bits_per_byte"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, ([], [], [])
        for b in batches:
            for one, what, payload, *rest in zip(*(c.to_pylist() for c in b.columns)):
                if one != block:
                    if block is not None:
                        yield scores(*held)
                    block, held = one, ([], [], [])
                held[what].append((payload, *rest) if what == 2 else payload)
        if block is not None:
            yield scores(*held)

    scored = both.select("block", "kind", "payload", "id", "held").mapInArrow(run, f"id {kind}, held boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, bits_per_byte double")
    return scored.select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(total)).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        "n_bytes",
        "bits_per_byte",
    )
