"""Byte-level BPE by speculation and verification.

Distinct words of a batch are cut greedily into their longest tokens (one automaton
pass over all of them), then every adjacent pair of the proposed tokens is tested in
numpy: two tokens may stand side by side only if no merge across their border comes
before the merges that made them. A word whose pairs all pass is encoded; only the
others are merged exactly. Decoding goes through the tokens' bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiepoint.llm.common import bound_batches

#: Fixed value: how byte-level vocabularies cut a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose encoding a task remembers; then it starts over.
REMEMBERED = 250_000
#: Bytes of a word up to which failing words are merged together in numpy; longer ones go one by one.
TOGETHER = 64
#: Characters of the texts that are encoded together; a longer text goes alone, whole.
GROUP = 300_000
NEVER = np.int64(1 << 40)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file, to its byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes as the vocabulary file says."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        vocab = file["model"]["vocab"]
        raw = {t: bytes(letters[c] for c in t) for t in vocab}
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special = special
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._words = regex.compile(PATTERN)
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes_of = [b""] * size
        for t, i in vocab.items():
            self.bytes_of[i] = raw[t]
        for t, i in special.items():
            self.bytes_of[i] = t.encode()
        self.text_of = [str(i) for i in range(size)]
        self._numbers = list(range(size))  # one object for each id
        self.byte_id = {raw[t][0]: i for t, i in vocab.items() if len(raw[t]) == 1}
        #: how each token was made: its parts and the merge's rank (-1: a byte; NEVER: by no merge)
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank = np.where([len(b) == 1 for b in self.bytes_of], np.int64(-1), NEVER)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.merges[x, y] = (rank, made)
            if self.rank[made] == NEVER:
                self.left[made], self.right[made], self.rank[made] = x, y, rank
        keys = sorted((x << 32 | y, rank) for (x, y), (rank, _) in self.merges.items())
        self._keys = np.array([k for k, _ in keys] or [-1], np.int64)
        self._ranks = np.array([r for _, r in keys] or [NEVER], np.int64)
        self._made = np.zeros(len(file["model"]["merges"]) + 1, np.int64)
        for rank, made in self.merges.values():
            self._made[rank] = made
        self._of_byte = np.array([self.byte_id[b] for b in range(256)], np.int64)
        self._sound = self._soundness()
        self._automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if self._sound[i]:
                self._automaton.add_word(raw[t].decode("latin-1"), (len(raw[t]), i))
        self._automaton.make_automaton()
        self._known: dict[str, tuple[int, ...]] = {s: (i,) for s, i in special.items()}

    def _merge_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = (x.astype(np.int64) << 32) | y
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge joins an end of ``a`` with a start of ``b`` before rank ``before``.

        The two tokens are taken apart from their last merge backwards. While ``x`` and
        ``y`` face each other, a merge of the two happens if its rank comes before the
        merge that ends this state; of equal ranks the left one comes first.
        """
        ok = np.ones(len(a), bool)
        x, y, at = np.asarray(a).copy(), np.asarray(b).copy(), np.arange(len(a))
        limit = np.full(len(a), NEVER) if before is None else np.asarray(before).copy()
        while len(at):
            crossed = self._merge_rank(x, y) < limit
            ok[at[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            x, y, at, rx, ry = x[go], y[go], at[go], rx[go], ry[go]
            first = rx > ry  # the left token was finished after the right one
            limit = np.where(first, rx, ry + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return ok

    def _soundness(self) -> np.ndarray:
        """Whether merging a token's own bytes makes that token."""
        made = (self.rank >= 0) & (self.rank < NEVER)
        sound = self.rank == -1
        sound[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for i in np.argsort(self.rank, kind="stable"):
            if made[i]:
                sound[i] &= sound[self.left[i]] and sound[self.right[i]]
        return sound

    def merge_exactly(self, word: bytes) -> tuple[int, ...]:
        """All merges of one word in order of rank, then from the left."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            j = after[i] if ids[i] == x else n
            if j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (m := self.merges.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q], m[1]))
        return tuple(t for t in ids if t >= 0)

    def merge_together(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The same for many words at once: each round takes every word's first merge of the lowest rank."""
        out: list[tuple[int, ...]] = [()] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = self._of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        ranks = np.full(len(ids), NEVER)
        inner = np.nonzero(owner[1:] == owner[:-1])[0]
        ranks[inner] = self._merge_rank(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.concatenate([[0], np.nonzero(owner[1:] != owner[:-1])[0] + 1])
            ends = np.append(starts[1:], len(ids))
            best = np.minimum.reduceat(ranks, starts)
            done = best == NEVER
            if done.any():
                flat = list(map(self._numbers.__getitem__, ids.tolist()))
                for w, a, b in zip(owner[starts[done]].tolist(), starts[done].tolist(), ends[done].tolist(), strict=True):
                    out[w] = tuple(flat[a:b])
                left = np.repeat(~done, ends - starts)
                ids, owner, ranks = ids[left], owner[left], ranks[left]
                best, sizes = best[~done], (ends - starts)[~done]
                if not len(ids):
                    break
            else:
                sizes = ends - starts
            hits = np.nonzero(ranks == np.repeat(best, sizes))[0]
            hits = hits[np.concatenate([[True], owner[hits[1:]] != owner[hits[:-1]]])]
            ids[hits] = self._made[ranks[hits]]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            at = (np.cumsum(keep) - 1)[hits]
            ids, owner, ranks = ids[keep], owner[keep], ranks[keep]
            ranks[at] = NEVER
            right = at[(at + 1 < len(ids))]
            right = right[owner[right] == owner[right + 1]]
            ranks[right] = self._merge_rank(ids[right], ids[right + 1])
            before = at[at > 0] - 1
            before = before[owner[before] == owner[before + 1]]
            ranks[before] = self._merge_rank(ids[before], ids[before + 1])
        return out

    def learn(self, words: list[str]) -> int:
        """Encodes words into memory; returns how many had to be merged exactly."""
        if not words:
            return 0
        raw = [w.encode("utf-8", "replace") for w in words]
        found = list(self._automaton.iter_long("Ā".join(map(bytes.decode, raw, ["latin-1"] * len(raw)))))
        ends = np.fromiter((e for e, _ in found), np.int64, len(found))
        size = np.fromiter((t[0] for _, t in found), np.int64, len(found))
        ids = np.fromiter((t[1] for _, t in found), np.int64, len(found))
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        owner = np.searchsorted(np.cumsum(lengths + 1) - 1, ends)
        good = np.bincount(owner, size, minlength=len(raw)) == lengths
        near = np.nonzero(owner[1:] == owner[:-1])[0]
        pairs, inverse = np.unique((ids[near] << 32) | ids[near + 1], return_inverse=True)
        fits = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[inverse]
        good[owner[near[~fits]]] = False
        starts = np.searchsorted(owner, np.arange(len(raw) + 1)).tolist()
        flat = list(map(self._numbers.__getitem__, ids.tolist()))
        short = [i for i in np.nonzero(~good)[0].tolist() if lengths[i] <= TOGETHER]
        merged = dict(zip(short, self.merge_together([raw[i] for i in short]), strict=True))
        for i, (w, a, b, g) in enumerate(zip(words, starts, starts[1:], good.tolist(), strict=False)):
            self._known[w] = tuple(flat[a:b]) if g else merged[i] if i in merged else self.merge_exactly(raw[i])
        return int((~good).sum())

    def _parts(self, text: str) -> list[str]:
        return self._cut.split(text) if self._cut is not None and any(s in text for s in self.special) else [text]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each whole text; strings of special tokens in a text become their ids."""
        cut = [[[p] if p in self.special else self._words.findall(p) for p in self._parts(t)] for t in texts]
        words = dict.fromkeys(chain.from_iterable(chain.from_iterable(cut)))
        if len(words) + len(self._known) > self.remembered:
            self._known = {s: (i,) for s, i in self.special.items()}
        self.learn([w for w in words if w not in self._known])
        return [list(chain.from_iterable(map(self._known.__getitem__, chain.from_iterable(parts)))) for parts in cut]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def groups(texts: list[str], most: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row, and ``ids`` where asked for.

    Null texts count as empty (no tokens); repeated rows are encoded again.
    ``path`` names the vocabulary file on every machine; a task remembers the encoding
    of ``remembered`` words and learns them anew beyond, which changes no result. Texts
    of any length are encoded whole, an empty table gives no rows, a null id stays null.
    """
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, remembered)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at, to in groups(texts):
                ids = codec.encode_batch(texts[at:to])
                cols = [batch.column(0).slice(at, to - at), pa.array(map(len, ids), pa.int64()), pa.array((sha(",".join(map(codec.text_of.__getitem__, i))) for i in ids), pa.string()), pa.array((sha(codec.decode(i)) for i in ids), pa.string())]
                if with_ids:
                    cols.append(pa.array([np.array(i, np.int32) for i in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in fields.split(", ")])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, fields)
