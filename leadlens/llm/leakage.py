"""Problem 9: passages of evaluation items inside the corpus.

Method: winnowing. Text is reduced to its letters and digits in one form, and of every window of
``WINDOW`` consecutive k-gram hashes the smallest is kept, so that every shared span of at least
``GRAM + WINDOW - 1`` bytes gives a common fingerprint. The evaluation items are a stated set: their
fingerprints are sent to the tasks in blocks of bounded size and joined with those of each document
where it is read, so no document is shuffled. Hits are then extended: the sentence of the item that
a hit lies in is aligned with its place in the document.

A sentence counts as held if most of its characters stand there in order and its names and figures
do too; the same phrasing with other names and figures does not. Words that very many items have are no
names; they are counted over all items first, so the blocks do not matter.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.functions.unify import EXPANSIONS, look_pairs
from leadlens.session import small_rows

GRAM, WINDOW = 14, 8
#: Least share of a sentence's characters in place, of its names and figures, and of the passage held.
ALIGNED, ANCHORED, HELD = 0.7, 0.6, 0.45
#: A capitalised word is no name if more than one of so many items has it, and more than ``FEW`` items.
ONE_IN, FEW = 50, 2
#: Evaluation items per block that is sent to the tasks.
BLOCK = 20_000
_SENTENCE = regex.compile(r"(?<=[.?!])\s+|(?<=[。？！])|\n+")
_DROPPED = regex.compile(r"[^\p{L}\p{N}\p{Mn}\p{Mc}]+|[͏︀-️]")
_ANCHOR = regex.compile(r"(?:\p{Lu}\p{Ll}+)+|\p{N}+")


@functools.cache
def _table() -> dict[int, str]:
    seen, meant = look_pairs()
    return {ord(s): m for s, m in zip(seen, meant)} | {ord(s): m for s, m in EXPANSIONS.items()}


def one_form(text: str) -> str:
    """Letters and digits of a text, of one look, without case, blanks, marks and punctuation."""
    bare = _DROPPED.sub("", text)
    if bare.isascii():
        return bare.lower()
    folded = unicodedata.normalize("NFC", bare).translate(_table())
    return _DROPPED.sub("", folded).lower()


def fingerprints(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that winnowing keeps."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h = h * np.uint64(0x100000001B3) + raw[j : j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    w = min(WINDOW, n)
    low = np.lib.stride_tricks.sliding_window_view(h, w)
    at = np.unique(np.arange(n - w + 1) + (w - 1 - low[:, ::-1].argmin(axis=1)))
    return h[at], at


class Items:
    """The fingerprints and sentences of a block of evaluation items; ``common`` words are no names."""

    def __init__(self, items: list[tuple[int, str]], common: set[str] = frozenset()):
        self.ids = [i for i, _ in items]
        self.sentences: list[list[tuple[str, list[str]]]] = []
        hashes, owners, places, ends, characters = [], [], [], [], []
        base = 0
        self.first: list[int] = []  # of each item its first sentence among all
        for n, (_, passage) in enumerate(items):
            cut: list[tuple[str, list[str]]] = []
            for sentence in _SENTENCE.split(passage):
                plain = one_form(sentence)
                if plain:
                    anchors = [one_form(a) for a in _ANCHOR.findall(sentence) if a not in common or a[0].isdigit()]
                    cut.append((plain, [a for a in anchors if a]))
            self.first.append(len(ends))
            self.sentences.append(cut)
            h, at = fingerprints("".join(c[0] for c in cut).encode())
            hashes.append(h)
            owners.append(np.full(len(h), n))
            places.append(at + base)
            for plain, _ in cut:
                data = np.frombuffer(plain.encode(), np.uint8)
                characters.append(np.cumsum((data & 0xC0) != 0x80) - 1)  # of every byte, its character in the sentence
                base += len(data)
                ends.append(base)
        joined = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.argsort(joined, kind="stable")
        self.hashes = joined[order]
        owner = np.concatenate([np.zeros(0, np.int64), *owners])[order].astype(np.int64)
        place = np.concatenate([np.zeros(0, np.int64), *places])[order].astype(np.int64)
        at = np.searchsorted(np.array(ends, np.int64), place, "right")
        inside = np.concatenate([np.zeros(0, np.int64), *characters])[place]
        self.owner, self.inside = owner, inside
        self.sentence = at - np.array([*self.first, 0], np.int64)[owner]

    def _holds(self, plain: str, sentence: str, anchors: list[str], places: set[int]) -> bool:
        if anchors:
            for a in anchors:
                if len(a) >= 5:
                    at = plain.find(a)
                    while at >= 0:
                        places.add(at - sentence.find(a))
                        at = plain.find(a, at + 1)
        done = -1
        for at in sorted(places):
            if at <= done:
                continue
            done = at + 4
            part = plain[max(0, at - 12) : at + len(sentence) + 24]
            if anchors and sum(a in part for a in anchors) < ANCHORED * len(anchors):
                continue
            blocks = SequenceMatcher(None, sentence, part, autojunk=False).get_matching_blocks()
            least = 1 if ord(sentence[len(sentence) // 2]) > 0x2E7F else 2
            if sum(b.size for b in blocks if b.size >= least) >= ALIGNED * len(sentence):
                return True
        return False

    def leaks(self, text: str) -> list[int]:
        """Ids of the items of which the text holds about half or more."""
        plain = one_form(text)
        data = plain.encode()
        h, at = fingerprints(data)
        low = np.searchsorted(self.hashes, h, "left")
        count = np.searchsorted(self.hashes, h, "right") - low
        hit = np.flatnonzero(count)
        if not len(hit):
            return []
        characters = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
        # every pair of a hit and an item's fingerprint at once
        many = count[hit]
        pair = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        where = np.repeat(characters[at[hit]], many) - self.inside[pair]
        found: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for owner, s, place in zip(self.owner[pair].tolist(), self.sentence[pair].tolist(), where.tolist()):
            found[owner][s].add(place)
        out = []
        for owner, by in found.items():
            sentences = self.sentences[owner]
            whole = sum(len(c[0]) for c in sentences)
            # a sentence can only be held if most of its names stand in the text; an item whose sentences do not suffice is passed over
            able = [s for s, (_, anchors) in enumerate(sentences) if (sum(a in plain for a in anchors) >= ANCHORED * len(anchors) if anchors else s in by)]
            if max(sum(len(sentences[s][0]) for s in able) / whole, len(able) / len(sentences)) < HELD:
                continue
            held = count_held = 0
            for s in able:
                sentence, anchors = sentences[s]
                places = by.get(s, set())
                if (places or any(len(a) >= 5 for a in anchors)) and self._holds(plain, sentence, anchors, set(places)):
                    held += len(sentence)
                    count_held += 1
            if max(held / whole, count_held / len(sentences)) >= HELD:
                out.append(self.ids[owner])
        return out


def common_words(items: DataFrame, passage: str) -> set[str]:
    """Capitalised words of more than one in ``ONE_IN`` items and more than ``FEW``; of an item's words only as many can be that common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for p in batch.column(0).to_pylist() for w in {*_ANCHOR.findall(p)}], pa.string())], names=["word"])

    texts = items.select(F.col(f"`{passage}`").alias("p")).where("p is not null")
    least = max(FEW, texts.count() // ONE_IN)
    counts = texts.mapInArrow(run, "word string").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return {r.word for r in small_rows(counts.where(F.col("n") > least).select("word"))}


def leaks(documents: DataFrame, items: DataFrame, key: str, text: str, item: str, passage: str) -> DataFrame:
    """``(key, item)``: documents that hold about half or more of an item's passage, sentence by sentence.

    Null and empty texts and passages give no rows; copies of a document count each. The items are
    read to the driver in blocks of ``BLOCK``: they are a stated query set.
    """
    spark = documents.sparkSession
    kind, item_kind = documents.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    rows = items.select(item, passage).where(f"`{item}` is not null and `{passage}` is not null").toLocalIterator()
    parts, held = [], []
    common = common_words(items.where(f"`{item}` is not null"), passage)

    def joined(block: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast((block, common))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Items(*sent.value)
            for batch in batches:
                docs, found = [], []
                for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for i in index.leaks(value) if value else []:
                        docs.append(doc)
                        found.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field(0).type), pa.array(found, pa.int64() if item_kind == "bigint" else None)], names=[key, item])

        return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{item}` {item_kind}")

    for row in rows:
        held.append((row[0], row[1]))
        if len(held) == BLOCK:
            parts.append(joined(held))
            held = []
    parts.append(joined(held))
    return functools.reduce(lambda a, b: a.unionByName(b), parts).distinct()
