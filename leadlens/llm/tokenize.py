"""Problem 8: encode the corpus with a public byte-level BPE.

Method: the pieces of a batch of texts go into padded numpy matrices, bucketed by length; each
round every row merges its pair of minimum rank, found by a hashed pair lookup, and rows without a
pair that merges leave the matrix. All occurrences of the pair that do not overlap are merged in one
round, from the left: a pair with the merged token ranks later, so the ids are those of one merge a
round, and a long piece takes no more rounds than it has different pairs. A text that is null or empty
gives an empty list.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Cells of one matrix, and pieces kept in a worker's memory.
CELLS = 1 << 21
KEPT = 1 << 18
_NONE = np.int32(1 << 30)


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return letters


class Bpe:
    """A byte-level BPE with an open-addressed hash table of pairs."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.byte_ids = np.zeros(256, np.int32)
        for letter, byte in _byte_letters().items():
            self.byte_ids[byte] = vocabulary[letter]
        left = np.array([vocabulary[a] for a, _ in merges], np.int64)
        right = np.array([vocabulary[b] for _, b in merges], np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        keys = (left << 32) | right
        self.bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.ranks[slot[first]] = keys[todo[first]], todo[first]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, slot = todo[rest], slot[rest]
            slot = np.where(self.keys[slot] >= 0, (slot + 1) & ((1 << self.bits) - 1), slot)
        self.cache: dict[str, np.ndarray] = {}

    @classmethod
    def load(cls, text: str) -> Bpe:
        model = json.loads(text)["model"]
        return cls(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair, ``_NONE`` where it doesn't merge; a negative id is padding."""
        keys = ((left.astype(np.int64) << 32) | right.astype(np.int64)).ravel()
        out = np.full(len(keys), _NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(keys[todo])
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there >= 0)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)

    def _merged(self, ids: np.ndarray) -> list[np.ndarray]:
        """Ids of the rows of a padded matrix: all occurrences of a row's pair of minimum rank a round."""
        done: list[np.ndarray] = [None] * len(ids)  # type: ignore[list-item]
        rows = np.arange(len(ids))
        ranks = np.full(ids.shape, _NONE, np.int32)  # of every token and the next one
        ranks[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            best = ranks.min(axis=1)
            over = best == _NONE
            if over.any():
                for i in np.flatnonzero(over):
                    done[rows[i]] = ids[i][ids[i] >= 0]
                rows, ids, best, ranks = rows[~over], ids[~over], best[~over], ranks[~over]
                if not len(rows):
                    break
            place = np.arange(ids.shape[1])
            hits = ranks == best[:, None]
            begins = hits.copy()
            begins[:, 1:] &= ~hits[:, :-1]
            # of a run of hits that overlap every other one counts, from its begin
            hits &= (place - np.maximum.accumulate(np.where(begins, place, 0), axis=1)) % 2 == 0
            ids = np.where(hits, self.merged[best][:, None], ids)
            keep = ids >= 0
            keep[:, 1:] &= ~hits[:, :-1]
            counts = keep.sum(axis=1)
            to = (np.cumsum(keep, axis=1) - 1)[keep]
            of = np.repeat(np.arange(len(rows)), counts)
            shape = (len(rows), int(counts.max()))
            moved, old, new = np.full(shape, -1, np.int32), np.full(shape, _NONE, np.int32), np.zeros(shape, bool)
            moved[of, to], old[of, to], new[of, to] = ids[keep], ranks[keep], hits[keep]
            ids, ranks = moved, old
            new[:, :-1] |= new[:, 1:]  # only pairs with a merged token have another rank
            new[:, -1] = False
            ranks[:, -1] = _NONE
            row, at = np.nonzero(new)
            ranks[row, at] = self.rank(ids[row, at], ids[row, at + 1])
        return done

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of every piece; pieces should be distinct."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes = np.array([len(r) for r in raw])
        out: list[np.ndarray] = [None] * len(raw)  # type: ignore[list-item]
        for i in np.flatnonzero(sizes == 1):
            out[i] = self.byte_ids[[raw[i][0]]]
        order = np.flatnonzero(sizes > 1)
        order = order[np.argsort(sizes[order], kind="stable")]
        low = 0
        while low < len(order):
            width = int(sizes[order[low]])
            top = int(np.searchsorted(sizes[order], max(4, width + width // 4), side="right"))
            top = min(top, low + max(1, CELLS // (2 * width)))
            chosen = order[low:top]
            width = int(sizes[chosen].max())
            matrix = np.full((len(chosen), width), -1, np.int32)
            inside = np.arange(width)[None, :] < sizes[chosen][:, None]
            matrix[inside] = self.byte_ids[np.frombuffer(b"".join(raw[i] for i in chosen), np.uint8)]
            for i, ids in zip(chosen, self._merged(matrix)):
                out[i] = ids
            low = top
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text."""
        split = regex.compile(PATTERN)
        pieces = [split.findall(t) if t else [] for t in texts]
        fresh = list({p for ps in pieces for p in ps if p not in self.cache})
        if len(self.cache) + len(fresh) > KEPT:
            self.cache = {}
            fresh = list({p for ps in pieces for p in ps})
        self.cache.update(zip(fresh, self.encode_pieces(fresh)))
        empty = np.zeros(0, np.int32)
        return [np.concatenate([self.cache[p] for p in ps]) if ps else empty for ps in pieces]


def encoded(documents: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, ids)``: one row per document; strings that spell a special token are plain text.

    The vocabulary is read on the driver and sent with the tasks: its size is fixed.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(spec.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                ids = bpe.encode(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
