"""Language identification with language-bitmask n-gram filters.

Letters, and letter trigrams (with word ends), are counted per language over all
training texts. A language keeps all its letters, of which Unicode bounds the number,
and its GRAMS most frequent trigrams, so the filter is bounded and a language of many
characters and few repeated trigrams is known by its characters. The
filter is a bit-sliced Bloom filter: one position holds a bit for each language, and
the AND of an n-gram's positions is the set of all languages that contain it. A
document's language has the most n-grams after the hits that false positives
explain are taken off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiepoint.llm.common import bound_batches, materialise, remainder

#: Trigrams that a language keeps at most, by count; those that tie beyond it are left out together.
GRAMS = 20_000
#: A language keeps an n-gram only if its share there is this part of the largest share in any language.
RELATIVE = 0.2
HASHES = 4
BITS_PER_GRAM = 12
UNDETERMINED = "und"
#: Code points that are looked at together.
CHUNK = 1_000_000


#: Marks a single letter among packed trigrams.
_SINGLE = np.uint64(1 << 63)


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of some texts, and the index of each one's text: for each letter the trigram around it, then the letters alone. A blank stands for what lies between words."""
    texts = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    seen = np.nonzero(np.bincount(codes))[0]
    letter = np.zeros(int(seen[-1]) + 1, bool)
    letter[[c for c in seen.tolist() if chr(c).isalpha()]] = True
    is_letter = letter[codes]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])[: len(codes)]
    before = np.zeros(len(codes), np.uint64)
    after = np.zeros(len(codes), np.uint64)
    plain = np.where(is_letter, codes, 32).astype(np.uint64)
    before[1:], after[:-1] = plain[:-1], plain[1:]
    before[0] = after[-1] = 32
    own = plain[is_letter]
    packed = (before[is_letter] << np.uint64(42)) | (own << np.uint64(21)) | after[is_letter]
    owner = owner[is_letter]
    return np.concatenate([packed, own | _SINGLE]), np.concatenate([owner, owner])


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about CHUNK code points."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Filter:
    languages: list[str]
    #: (words, positions) of uint64: bit l % 64 of word l // 64 is language l
    slices: np.ndarray
    #: false-positive rate by language
    false_rate: np.ndarray
    default: str

    @staticmethod
    def build(grams: dict[str, np.ndarray], default: str = UNDETERMINED) -> Filter:
        languages = sorted(grams)
        most = max([len(g) for g in grams.values()], default=0)
        positions = 1 << max(10, int(most * BITS_PER_GRAM).bit_length())
        slices = np.zeros(((len(languages) + 63) // 64, positions), np.uint64)
        for i, name in enumerate(languages):
            for k in range(HASHES):
                at = (_mix(grams[name], k) & np.uint64(positions - 1)).astype(np.int64)
                slices[i // 64][at] |= np.uint64(1 << (i % 64))
        fill = np.array([np.count_nonzero(slices[i // 64] & np.uint64(1 << (i % 64))) / positions for i in range(len(languages))])
        return Filter(languages, slices, fill**HASHES, default)

    def members(self, packed: np.ndarray) -> np.ndarray:
        """(words, grams): the languages that contain each gram, as bitmasks."""
        mask = np.uint64(self.slices.shape[1] - 1)
        out = None
        for k in range(HASHES):
            part = self.slices[:, (_mix(packed, k) & mask).astype(np.int64)]
            out = part if out is None else out & part
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return labels, scores
        known = [t or "" for t in texts]
        for a, b in _chunks(known):
            packed, owner = grams_of(known[a:b])
            total = np.bincount(owner, minlength=b - a)
            masks = self.members(packed)
            hits = np.array([np.bincount(owner[(masks[i // 64] & np.uint64(1 << (i % 64))) != 0], minlength=b - a) for i in range(len(self.languages))])
            rate = self.false_rate[:, None]
            real = np.clip((hits - total * rate) / np.maximum(1 - rate, 1e-9), 0, None)
            best = real.argmax(axis=0)
            for i in np.nonzero(total)[0].tolist():
                labels[a + i] = self.languages[best[i]] if real[best[i], i] > 0 else self.default
                scores[a + i] = float(min(1.0, real[best[i], i] / total[i]))
        return labels, scores


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", grams: int = GRAMS, relative: float = RELATIVE) -> Filter:
    """Learns from every row whose text and language are not null. The driver gets at most ``grams`` trigrams and the letters of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            names = sorted(set(langs))
            index = {n: i for i, n in enumerate(names)}
            parts: dict[str, list] = {n: [] for n in names}
            for a, b in _chunks(texts):
                packed, owner = grams_of(texts[a:b])
                of = np.array([index[x] for x in langs[a:b]])[owner] if len(owner) else owner
                for n in set(langs[a:b]):
                    parts[n].append(np.unique(packed[of == index[n]], return_counts=True))
            for n in names:
                keys, at = np.unique(np.concatenate([k for k, _ in parts[n]]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([c for _, c in parts[n]]), minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialise(counts)
    # letters alone are the negative numbers; a text has as many of them as trigrams
    totals = {r["lang"]: r["n"] for r in counts.where("gram < 0").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    # how many trigrams occur n times, and from which n on they are no more than are kept: a row per language and count
    levels = counts.where("gram >= 0").groupBy("lang", "n").agg(F.count("*").alias("kinds"))
    upto = F.sum("kinds").over(Window.partitionBy("lang").orderBy(F.desc("n")))
    least = levels.withColumn("upto", upto).where(F.col("upto") <= grams).groupBy("lang").agg(F.min("n").alias("least"))
    kept = counts.join(least, "lang", "left").where("gram < 0 or n >= least").select("lang", "gram", "n").toPandas()
    kept["share"] = kept["n"] / kept["lang"].map(totals)
    kept = kept[kept["share"] >= relative * kept.groupby("gram")["share"].transform("max")]
    found = {n: g["gram"].to_numpy(np.int64).view(np.uint64) for n, g in kept.groupby("lang")}
    return Filter.build(found, max(totals, key=lambda n: (totals[n], n), default=UNDETERMINED))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row.

    Learns from rows outside fold ``held``. ``und`` with score 0 for a null text or
    one without letters, and for all if nothing could be learned; a text of which no
    n-gram is known gets the most frequent language with score 0. The score is the
    share of the text's n-grams that the language contains. Repeated rows count again; of
    languages that contain equally many the first by name is taken. An empty table gives no
    rows; texts of any length are read whole.
    """
    model = train(docs.where(remainder(F.col(id_col), folds) != held), text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = model.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(F.col(id_col), folds) == held).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
