"""Language-model scoring with a sharded Elias-Fano n-gram trie of order three.

Words are counted first: a word's id is its place in the order of all words' hashes, in
which hash ranges are shards. Then each task turns texts into ids, sums their trigrams
in numpy before the shuffle, and deals them by their first word; those of a frequent
first word are dealt by their second word too, so shards are even whatever the words'
frequencies. A shard is a trie. Level 1 holds first words with back-off weights, level 2
their successors with discounted probabilities and back-off weights, level 3 the
successors of those pairs. Monotone pointers lead from an entry to its successors in the
next level. Pointers and successors are Elias-Fano sequences, probabilities are quantised
to 16 bits, and a shard is one file in the session's shared folder.

Scoring: tasks map shards into memory and look up each batch's distinct n-grams in
order. A context's entry gives the range of its successors by pointer, and the next word
is sought in that range. No text is shuffled.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiepoint.llm.common import bound_batches, checkpoint_dir, materialise, remainder

#: Taken off each n-gram's count for the words that did not follow.
DISCOUNT = 0.75
#: Added to each word's count, and to that of one unknown word.
ADD = 0.1
#: Bytes of text for each shard, shards at least, tokens summed together, tokens scored together, bytes hashed together.
SHARD_BYTES, LEAST_SHARDS, TOKENS, SCORED, CHUNK = 16_000_000, 32, 1_200_000, 750_000, 1_500_000
#: A word is frequent if it makes up this part of a shard's tokens on average; there are 1 / FREQUENT of them for each shard at most.
FREQUENT = 0.25
#: Shards that a task keeps open.
OPEN = 1024
#: Quantised log10 probabilities: 0 to -LOWEST in 65535 steps.
LOWEST = 12.0

U = np.uint64
END = U(0x3B1F58D6C0A94E72)
_MULTIPLIER = 0xD6E8FEB86659FD93


@dataclass(frozen=True)
class Hasher:
    """Hashes of all words of a buffer at once, by prefix sums of a polynomial."""

    letters: np.ndarray
    blank: np.ndarray
    powers: np.ndarray
    inverses: np.ndarray

    @staticmethod
    def of(size: int) -> Hasher:
        lower = np.arange(256)
        lower[65:91] += 32
        letters = np.random.default_rng(11).integers(0, 1 << 64, 256, U)[lower]
        blank = np.zeros(256, bool)
        blank[[32, *range(9, 14)]] = True
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([[U(1)], np.full(size, U(_MULTIPLIER))]))
            inverses = np.cumprod(np.concatenate([[U(1)], np.full(size, U(pow(_MULTIPLIER, -1, 1 << 64)))]))
        return Hasher(letters, blank, powers, inverses)

    def words(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word in order, and its text's index; texts are ``raw[starts[i]:starts[i + 1]]``."""
        if not len(raw):
            return np.zeros(0, U), np.zeros(0, np.int64)
        blank = self.blank[raw]
        inner = starts[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        first, last = np.concatenate([[True], blank[:-1]]), np.concatenate([blank[1:], [True]])
        first[inner] = True
        last[inner - 1] = True
        s, e = np.nonzero(~blank & first)[0], np.nonzero(~blank & last)[0] + 1
        sums = np.concatenate([[U(0)], np.cumsum(self.letters[raw] * self.powers[: len(raw)])])
        return _mixed((sums[e] - sums[s]) * self.inverses[s] + (e - s).astype(U)), np.searchsorted(starts, s, side="right") - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def token_batches(columns: Iterator[pa.Array], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(words, ends)`` for runs of whole texts of binary columns: hashes of all tokens, and where each text's end token stands."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    tokens = 0
    hasher = Hasher.of(CHUNK)
    for column in columns:
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
            to = min(to, len(column))
            size = int(offsets[to] - offsets[at])
            # a text above the usual size gets powers of its own
            words, owner = (hasher if size <= CHUNK else Hasher.of(size)).words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            per = np.bincount(owner, minlength=to - at)
            ends = np.cumsum(per + 1) - 1
            w = np.empty(len(words) + to - at, U)
            w[np.arange(len(words)) + owner] = words
            w[ends] = END
            held.append((w, ends + tokens))
            tokens += len(w)
            at = to
            if tokens >= most:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, tokens = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def distinct(major: np.ndarray, minor: np.ndarray, inverse: bool = False):
    """Distinct pairs of small whole numbers in order, packed into 64 bits, with their counts or each input pair's place among them."""
    return np.unique((major.astype(U) << U(32)) | minor.astype(U), return_counts=not inverse, return_inverse=inverse)


def halves(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (packed >> U(32)).astype(np.int64), (packed & U(0xFFFFFFFF)).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary with a directory of ones."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.ones = ones.astype(np.int64)
        self.zeros = None

    @staticmethod
    def build(values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (universe // max(1, n)).bit_length() - 1)
        values = values.astype(U)
        high = (values >> U(bits)).astype(np.int64) + np.arange(n)
        words = np.zeros(((universe >> bits) + n) // 64 + 2, U)
        _set(words, high >> 6, U(1) << (high & 63).astype(U))
        low = np.zeros(n * bits // 64 + 2, U)
        if bits and n:
            low_part, at = values & U((1 << bits) - 1), np.arange(n) * bits
            shift = (at & 63).astype(U)
            _set(low, at >> 6, low_part << shift)
            over = (at & 63) + bits > 64
            _set(low, (at[over] >> 6) + 1, low_part[over] >> (U(64) - shift[over]))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]]).astype(np.uint32)
        return EliasFano(n, bits, low, words, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(U)
        value = (self.low[word] >> shift) | ((self.low[word + 1] << U(1)) << (U(63) - shift))
        return value & U((1 << self.low_bits) - 1)

    def _select(self, k: np.ndarray, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Position of the k-th set bit; ``before`` has the set bits ahead of each word."""
        word = np.searchsorted(before, k, side="right") - 1
        left, x, at = k - before[word], words[word], word << 6
        for width in (32, 16, 8, 4, 2, 1):
            part = x & U((1 << width) - 1)
            have = np.bitwise_count(part).astype(np.int64)
            go = left >= have
            left = np.where(go, left - have, left)
            x = np.where(go, x >> U(width), part)
            at = np.where(go, at + width, at)
        return at

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, self.high, self.ones) - i).astype(U) << U(self.low_bits)) | self._low(i)

    def find(self, keys: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """Index of the first element equal to each key, or -1; if asked for, only from ``low`` on and before ``high``."""
        out = np.full(len(keys), -1)
        if not self.n or not len(keys):
            return out
        if self.zeros is None:
            self.zeros = (np.arange(len(self.high)) << 6) - self.ones
        bucket, rest = (keys >> U(self.low_bits)).astype(np.int64), keys & U((1 << self.low_bits) - 1)
        inverted = _Inverted(self.high)
        start = np.where(bucket > 0, self._select(np.maximum(bucket - 1, 0), inverted, self.zeros) - bucket + 1, 0)
        stop = self._select(bucket, inverted, self.zeros) - bucket
        if low is not None:
            start, stop = np.maximum(start, low), np.minimum(stop, high)
        live = np.nonzero(start < stop)[0]
        lo, hi = start[live], stop[live]
        while len(live):
            mid = (lo + hi) >> 1
            value = self._low(mid)
            wanted = rest[live]
            same = value == wanted
            less = value < wanted
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            out[live[same]] = mid[same]
            go = lo < hi
            live, lo, hi = live[go], lo[go], hi[go]
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "ones": self.ones.astype(np.uint32)}


class _Inverted:
    def __init__(self, words: np.ndarray):
        self.words = words

    def __getitem__(self, at):
        return ~self.words[at]


def _set(words: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    """Adds bits to words whose indices do not fall."""
    if len(at):
        starts = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
        words[at[starts]] |= np.bitwise_or.reduceat(bits, starts)


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities, never rounded up, so that they still sum to 1 at most."""
    return np.clip(np.ceil(-np.log10(np.maximum(p, 1e-300)) * (65535 / LOWEST) - 1e-9), 0, 65535).astype(np.uint16)


def value_of(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (code * (-LOWEST / 65535))


def local_path(uri: str) -> str | None:
    """The path of a shared folder that is mounted; None where a file system client is needed."""
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def write_shared(uri: str, data: list[bytes]) -> None:
    """Writes a file whole or not at all; a task that runs again replaces it with the same."""
    if (path := local_path(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        draft = f"{path}.{uuid.uuid4().hex}"
        with open(draft, "wb") as f:
            f.writelines(data)
        os.replace(draft, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as f:
        for d in data:
            f.write(d)
    store.move(draft, path)


def map_shared(uri: str) -> np.ndarray | None:
    """A shared file's bytes, mapped into memory, or None if there is no such file; from a remote store by way of a local copy that is already unlinked."""
    if (path := local_path(uri)) is not None:
        if not os.path.exists(path):
            return None
        with open(path, "rb") as f:  # the map outlives the descriptor, of which a task has few
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), np.uint8)
    from pyarrow import fs

    store, remote = fs.FileSystem.from_uri(uri)
    if store.get_file_info(remote).type != fs.FileType.File:
        return None
    with tempfile.NamedTemporaryFile() as copy, store.open_input_stream(remote) as f:
        while part := f.read(1 << 24):
            copy.write(part)
        copy.flush()
        return np.memmap(copy.name, np.uint8, "r")


def packed(meta: dict, arrays: dict[str, np.ndarray]) -> list[bytes]:
    at, out, places = 0, [], {}
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        places[name] = [at, a.dtype.str, len(a)]
        out.append(raw + bytes(-len(raw) % 8))
        at += len(out[-1])
    head = json.dumps(meta | {"arrays": places}).encode()
    head += b" " * (-len(head) % 8)
    return [len(head).to_bytes(8, "little"), head, *out]


def unpacked(raw: np.ndarray) -> tuple[dict, dict[str, np.ndarray]]:
    size = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + size].tobytes())
    return head, {k: np.frombuffer(raw, np.dtype(kind), n, 8 + size + at) for k, (at, kind, n) in head.pop("arrays").items()}


def _sequences(parts: dict[str, EliasFano]) -> tuple[dict, dict[str, np.ndarray]]:
    return {k: [e.n, e.low_bits] for k, e in parts.items()}, {f"{k}.{a}": v for k, e in parts.items() for a, v in e.arrays().items()}


def _sequence(head: dict, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano(*head[name], *(arrays[f"{name}.{a}"] for a in ("low", "high", "ones")))


class Words:
    """The words of a range of hashes, in order, with their counts."""

    @staticmethod
    def build(shift: int, words: np.ndarray, counts: np.ndarray) -> list[bytes]:
        meta, arrays = _sequences({"words": EliasFano.build(words & U((1 << shift) - 1), 1 << shift)})
        return packed(meta, arrays | {"counts": np.append(counts, 0).astype(np.min_scalar_type(int(counts.max(initial=0))))})

    def __init__(self, raw: np.ndarray, shift: int):
        head, arrays = unpacked(raw)
        self.words, self.counts, self.prefix = _sequence(head, arrays, "words"), arrays["counts"], U((1 << shift) - 1)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's place, or -1, and its count."""
        at = self.words.find(words & self.prefix)
        return at, self.counts[at].astype(np.int64)  # the last count is 0


class Trie:
    """One shard of the trie; ids are below ``size``."""

    @staticmethod
    def build(size: int, totals: dict[int, int], a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray, discount: float) -> tuple[list[bytes], dict[int, int]]:
        """From trigrams with counts, in any order and repeated; returns the file, and for words in ``totals`` how many kinds follow them here.

        ``totals`` has the counts of frequent words, of which other shards have successors
        too. Where ``c`` is ``size - 1`` the text is over.
        """
        firsts, x = np.unique(a, return_inverse=True)
        pairs, y = distinct(x, b, inverse=True)
        triples, z = distinct(y, c, inverse=True)
        n3 = np.bincount(z, n, minlength=len(triples)).astype(np.int64)
        y, c = halves(triples)
        n2 = np.bincount(y, n3, minlength=len(pairs)).astype(np.int64)
        x, b = halves(pairs)
        kinds2 = np.bincount(x, minlength=len(firsts))
        n1 = np.bincount(x, n2, minlength=len(firsts)).astype(np.int64)
        shared = {i: int(kinds2[at]) for at, i in enumerate(firsts.tolist()) if i in totals}
        for at, i in enumerate(firsts.tolist()):
            n1[at] = totals.get(i, n1[at])
        real = c != size - 1
        y, c, n3 = y[real], c[real], n3[real]
        kinds3 = np.bincount(y, minlength=len(pairs))
        follow = lambda kinds: EliasFano.build(np.concatenate([[0], np.cumsum(kinds)]), int(kinds.sum()) + 1)
        meta, arrays = _sequences({
            "first": EliasFano.build(firsts, size), "to2": follow(kinds2),
            "second": EliasFano.build(x.astype(U) * U(size) + b.astype(U), max(1, len(firsts)) * size), "to3": follow(kinds3),
            "third": EliasFano.build(y.astype(U) * U(size) + c.astype(U), max(1, len(pairs)) * size),
        })
        # one more entry at the end of each, which is read for what is not found: no probability, all weight to the shorter context
        arrays |= {"back2": quantised(np.append(np.minimum(1, discount * kinds2 / n1), 1.0)), "p2": quantised(np.append((n2 - discount) / n1[x], 0.0))}
        arrays |= {"back3": quantised(np.append(np.where(kinds3 > 0, discount * kinds3 / n2, 1.0), 1.0)), "p3": quantised(np.append((n3 - discount) / n2[y], 0.0))}
        return packed(meta, arrays), shared

    def __init__(self, raw: np.ndarray, size: int):
        head, arrays = unpacked(raw)
        self.first, self.to2, self.second, self.to3, self.third = (_sequence(head, arrays, k) for k in ("first", "to2", "second", "to3", "third"))
        self.back2, self.p2, self.back3, self.p3 = (arrays[k] for k in ("back2", "p2", "back3", "p3"))
        self.size = U(size)

    @staticmethod
    def _after(entries: np.ndarray, words: np.ndarray, pointers: EliasFano, level: EliasFano, size: np.uint64) -> np.ndarray:
        """Places of words among the successors of entries; -1 where there is no such entry or successor."""
        out = np.full(len(entries), -1)
        some = np.nonzero(entries >= 0)[0]
        at = entries[some]
        ends = pointers.access(np.concatenate([at, at + 1])).astype(np.int64)
        out[some] = level.find(at.astype(U) * size + words[some].astype(U), ends[: len(at)], ends[len(at) :])
        return out

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of level 1 and of level 2 for sorted first words and their successors."""
        firsts, x = np.unique(a, return_inverse=True)
        nodes = self.first.find(firsts.astype(U))[x]
        return nodes, self._after(nodes, b, self.to2, self.second, self.size)

    def triples(self, entries: np.ndarray, c: np.ndarray) -> np.ndarray:
        return self._after(entries, c, self.to3, self.third, self.size)


@dataclass(frozen=True)
class Model:
    """``starts``: the id of each word shard's first word; ``back``: weights of frequent words, by id."""

    folder: str
    starts: tuple[int, ...]
    tokens: int
    words: int
    back: dict[int, float]

    @property
    def shards(self) -> int:
        return len(self.starts)

    @property
    def shift(self) -> int:
        return 65 - self.shards.bit_length()

    @property
    def size(self) -> int:
        """Ids: all words, the start of a text, what follows its end."""
        return self.words + 2


def _dealt(model: Model, frequent: np.ndarray, hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The shard of pairs of words, by their places in ``hashes``; ``frequent`` says which of them are."""
    where = np.where(frequent[a], _mixed(hashes[a] * U(3) + hashes[b]), hashes[a])
    return (where >> U(model.shift)).astype(np.int64)


class Reader:
    """The model as one task sees it."""

    def __init__(self, model: Model):
        self.model, self._open = model, OrderedDict()

    def _shard(self, kind: str, s: int):
        """A shard, or None if it has no words; of the open ones the longest unused is let go."""
        key = (kind, s)
        if key not in self._open:
            raw = map_shared(f"{self.model.folder}/{kind}-{s:06d}")
            self._open[key] = None if raw is None else Words(raw, self.model.shift) if kind == "words" else Trie(raw, self.model.size)
            if len(self._open) > OPEN:
                self._open.popitem(last=False)
        self._open.move_to_end(key)
        return self._open[key]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted hashes."""
        ids, counts = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        for s, at in _runs((hashes >> U(self.model.shift)).astype(np.int64)):
            if (shard := self._shard("words", s)) is not None:
                place, counts[at] = shard.find(hashes[at])
                ids[at] = np.where(place >= 0, place + self.model.starts[s], -1)
        return ids, counts

    def log10(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: known or not, log10 of its base probability, log10 of its probability after the two tokens before it."""
        model = self.model
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes, w = np.unique(words, return_inverse=True)
        ids, counts = self.words(hashes)
        base = (counts + ADD) / (model.tokens + ADD * (model.words + 1))
        start = len(hashes)  # the start of a text, as the last of the words
        hashes, ids = np.append(hashes, U(0)), np.append(ids, model.words)
        v = np.concatenate([[start], w[:-1]])
        v[starts] = start
        pairs, pair = distinct(v, w, inverse=True)
        a, b = halves(pairs)
        # the pair before a token is its context; the first of a text has none
        context = np.concatenate([[len(pairs)], pair[:-1]])
        context[starts] = len(pairs)
        triples, triple = distinct(context, pair, inverse=True)
        before, last = halves(triples)

        weight = np.array([model.back.get(i, -1.0) for i in ids.tolist()])
        frequent = weight >= 0
        back2 = np.where(frequent, weight, 1.0)[a]
        p2, p3, back3 = np.zeros(len(pairs)), np.zeros(len(triples)), np.ones(len(pairs) + 1)
        entries = np.full(len(pairs) + 1, -1)
        usable = np.nonzero((ids[a] >= 0) & (ids[b] >= 0))[0]
        of = np.full(len(pairs) + 1, -1)
        lone = np.nonzero(~frequent[a] & (ids[a] >= 0))[0]  # the weight of a context counts for unknown words too
        of[usable] = _dealt(model, frequent, hashes, a[usable], b[usable])
        of[lone] = _dealt(model, frequent, hashes, a[lone], b[lone])
        by_pair = np.argsort(of[:-1], kind="stable")
        by_triple = np.argsort(of[before], kind="stable")
        slices = dict(_runs(of[before][by_triple]))
        for s, at in _runs(of[:-1][by_pair]):
            if s < 0 or (shard := self._shard("trie", s)) is None:
                continue
            at = by_pair[at]
            nodes, found = shard.pairs(ids[a[at]], ids[b[at]])
            back2[at] = np.where(frequent[a[at]], back2[at], value_of(shard.back2[nodes]))
            p2[at] = np.where(found >= 0, value_of(shard.p2[found]), 0.0)
            entries[at] = found
            back3[at] = value_of(shard.back3[found])
            if s in slices:
                at = by_triple[slices[s]]
                at = at[(entries[before[at]] >= 0) & (ids[b[last[at]]] >= 0)]
                found = shard.triples(entries[before[at]], ids[b[last[at]]])
                p3[at] = np.where(found >= 0, value_of(shard.p3[found]), 0.0)
        smooth = p2 + back2 * base[b]
        full = np.log10(p3 + back3[before] * smooth[last])
        return (counts > 0)[w], np.log10(base)[w], full[triple]


def _runs(values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """``(value, slice)`` for each run of equal values."""
    cuts = np.concatenate([[0], np.nonzero(np.diff(values))[0] + 1, [len(values)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a < b:
            yield int(values[a]), slice(a, b)


def _by_shard(of: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each shard that occurs in ``of``, which rises: its slice of each column as bytes."""
    cuts = np.concatenate([[0], np.nonzero(np.diff(of))[0] + 1, [len(of)]]) if len(of) else np.zeros(1, np.int64)
    out = [pa.array(of[cuts[:-1]].astype(np.int32))]
    for c in columns.values():
        offsets = (cuts * c.itemsize).astype(np.int32)
        out.append(pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(c).tobytes())]))
    return pa.RecordBatch.from_arrays(out, ["shard", *columns])


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])


def train(docs: DataFrame, text_col: str = "text", discount: float = DISCOUNT) -> Model:
    """Counts all words and trigrams of all rows, and writes the trie to the session's shared folder.

    The driver sees a row for each shard, and the frequent words, of which there are
    1 / FREQUENT for each shard at most.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = f"{checkpoint_dir(spark)}/ngram-{uuid.uuid4().hex}"
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    shards = 1 << max(LEAST_SHARDS - 1, size // SHARD_BYTES).bit_length()
    shift = 65 - shards.bit_length()

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, _ in token_batches((b.column(0) for b in batches), TOKENS):
            words, counts = np.unique(w, return_counts=True)
            yield _by_shard((words >> U(shift)).astype(np.int64), {"words": words, "counts": counts.astype(np.uint32)})

    def write_words(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        words, at = np.unique(_column(table, "words", U), return_inverse=True)
        counts = np.bincount(at, _column(table, "counts", np.uint32), minlength=len(words)).astype(np.int64)
        write_shared(f"{folder}/words-{s:06d}", Words.build(shift, words, counts))
        top = np.argsort(-counts, kind="stable")[: int(shards / FREQUENT)]
        return pa.table({"shard": pa.array([s], pa.int32()), "words": pa.array([len(words)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64()), "top": pa.array([top.tolist()], pa.list_(pa.int64())), "of_top": pa.array([counts[top].tolist()], pa.list_(pa.int64())), "texts": pa.array([int(counts[words == END].sum())], pa.int64())})

    sums = texts.mapInArrow(count_words, "shard int, words binary, counts binary")
    done = sums.groupBy("shard").applyInArrow(write_words, "shard int, words long, tokens long, top array<long>, of_top array<long>, texts long")
    done = materialise(done)
    kinds, tokens, n_texts = {r["shard"]: r["words"] for r in done.select("shard", "words").collect()}, *(done.agg(F.sum("tokens"), F.sum("texts")).first())
    tokens, n_texts = tokens or 0, n_texts or 0
    starts = [0]
    for s in range(shards):
        starts.append(starts[-1] + kinds.get(s, 0))
    often = done.select("shard", F.explode(F.arrays_zip("top", "of_top")).alias("x")).where(F.col("x.of_top") > FREQUENT * tokens / shards)
    totals = {starts[r["shard"]] + r["top"]: r["of_top"] for r in often.select("shard", "x.*").collect()} | {starts[-1]: n_texts}
    counted = Model(folder, tuple(starts[:-1]), tokens, starts[-1], {i: 0.0 for i in totals})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(counted)
        for words, ends in token_batches((b.column(0) for b in batches), TOKENS):
            hashes, w = np.unique(words, return_inverse=True)
            ids, _ = reader.words(hashes)
            ids, hashes = np.append(ids, [counted.words, counted.words + 1]), np.append(hashes, [U(0), U(0)])
            a, c = np.concatenate([[0], w[:-1]]), np.append(w[1:], 0)
            a[np.concatenate([[0], ends[:-1] + 1])], c[ends] = len(hashes) - 2, len(hashes) - 1
            pairs, pair = distinct(a, w, inverse=True)
            triples, n = distinct(pair, c)
            pair, c = halves(triples)
            a, b = halves(pairs)
            of = _dealt(counted, np.array([i in totals for i in ids.tolist()]), hashes, a, b)[pair]
            order = np.argsort(of, kind="stable")
            pair, c = pair[order], c[order]
            kind = np.min_scalar_type(counted.size)
            yield _by_shard(of[order], {"a": ids[a[pair]].astype(kind), "b": ids[b[pair]].astype(kind), "c": ids[c].astype(kind), "n": n[order].astype(np.uint32)})

    def build(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        kind = np.min_scalar_type(counted.size)
        a, b, c = (_column(table, x, kind).astype(np.int64) for x in "abc")
        data, shared = Trie.build(counted.size, totals, a, b, c, _column(table, "n", np.uint32), discount)
        write_shared(f"{folder}/trie-{s:06d}", data)
        return pa.table({"id": pa.array(list(shared), pa.int64()), "kinds": pa.array(list(shared.values()), pa.int64())})

    sums = texts.mapInArrow(count, "shard int, a binary, b binary, c binary, n binary")
    kinds_of = sums.groupBy("shard").applyInArrow(build, "id long, kinds long").groupBy("id").agg(F.sum("kinds").alias("kinds")).collect()
    # to the same steps as the weights in the shards
    back = {r["id"]: float(value_of(quantised(np.array([min(1.0, discount * r["kinds"] / totals[r["id"]])])))[0]) for r in kinds_of}
    return Model(folder, counted.starts, tokens, counted.words, back)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            found = []
            for words, ends in token_batches(iter([batch.column(1)]), SCORED):
                known, base, full = reader.log10(words, ends)
                starts = np.concatenate([[0], ends[:-1] + 1])
                found.append((ends - starts + 1, *(np.add.reduceat(x, starts) for x in (known.astype(np.int64), base, full))))
            cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0)] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(np.full(batch.num_rows, model.tokens), pa.int64()), pa.array(cols[2]), pa.array(cols[3])], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """Scores every row by a model of the rows outside fold 0.

    A null text counts as empty: it has one token, its end. Repeated rows are counted
    and scored again. Without training rows every word has the same probability. A text
    of any length is scored whole, an empty table gives no rows, a null id is like an empty one.
    """
    model = train(docs.where(remainder(F.col(id_col), folds) != 0), text_col)
    held = remainder(F.col("doc_id"), folds) == 0
    return score(docs, model, id_col, text_col).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
