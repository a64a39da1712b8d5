"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Items are taken in blocks of bounded size. Every n-gram of an item is a seed, however frequent, so which
copies are found doesn't depend on the corpus. A pass over the texts looks for seeds, and where one hits
aligns the item with the surrounding words, unless too few words of the item stand there to reach the score
in any order. A document that holds enough of an item in order, even if edited, is contaminated.

At scale: the pass streams over the texts without a shuffle; only the hits leave the tasks. Removal is
part of the pass: documents aren't joined. A block of items goes out as sorted arrays. Each further block is another pass over the
texts: one for each million words of items.

Defined cases: null and empty texts and items match nothing; items shorter than a seed match only texts of the same words;
equal items are each reported; repeated rows, and rows with null id, are each reported; texts of any length are searched whole;
of several places of an item the best is reported, the first of equals; empty tables give empty results; other columns pass
through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import in_slices
from .tokens import shingles, word_ids

SEED = 4
#: Part of an item's best score from which a document is contaminated, and least words aligned.
SCORE, LEAST_WORDS = 0.5, 8
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items and their words in a block, which goes to every task: 32 bytes a word and 16 an item, so about 33 MB at most.
BLOCK_ITEMS, BLOCK_WORDS = 50_000, 1_000_000
_letters = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words (A-Z), punctuation taken as space."""
    return (text or "").encode().lower().translate(_letters).split()


@dataclass(frozen=True)
class Block:
    """Items as flat arrays: item k has ids[ends[k] : ends[k + 1]]; seeds are sorted, each at a place in `ids`."""

    names: list
    ids: np.ndarray
    ends: np.ndarray
    seeds: np.ndarray
    places: np.ndarray
    width: int

    @classmethod
    def of(cls, items: list[tuple], width: int = SEED) -> Block:
        """items: (name, word ids). An item's first n-grams are its own seeds; one shorter than a seed is one."""
        ids = [np.asarray(x, np.uint64) for _, x in items]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
        grams = [shingles(x, width) for x in ids]
        seeds = np.concatenate([*grams, np.array([], np.uint64)])
        places = np.concatenate([*(a + np.arange(len(g)) for a, g in zip(ends, grams, strict=False)), np.array([], np.int64)]).astype(np.int32)
        order = np.argsort(seeds, kind="stable")
        return cls([n for n, _ in items], np.concatenate([*ids, np.array([], np.uint64)]), ends, seeds[order], places[order], width)

    def item(self, k: int) -> np.ndarray:
        return self.ids[self.ends[k] : self.ends[k + 1]]


def blocks(items: DataFrame, id: str, text: str, width: int = SEED) -> Iterator[Block]:
    """The items in order of id, a bounded number at a time; an item that is longer than a block is one."""
    part, size = [], 0
    for row in items.filter(F.col(text).isNotNull()).select(id, text).orderBy(id, text).toLocalIterator():
        ids = word_ids(words(row[1]))
        if len(ids) == 0:
            continue
        part.append((row[0], ids))
        size += len(ids)
        if len(part) >= BLOCK_ITEMS or size >= BLOCK_WORDS:
            yield Block.of(part, width)
            part, size = [], 0
    if part:
        yield Block.of(part, width)


class Members:
    """Fast test of which hashes are in a sorted array: a bit per low 20 bits first, then a search."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.bits = np.zeros(1 << 20, np.bool_)
        self.bits[(values & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where x is in the array, and from where to where it stands there."""
        at = np.flatnonzero(self.bits[(x & np.uint64((1 << 20) - 1)).view(np.int64)])
        first = np.searchsorted(self.values, x[at])
        last = np.searchsorted(self.values, x[at], "right")
        good = last > first
        return at[good], first[good], last[good]


def align(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Best local score of the item in the region, and where it starts and ends there."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        steps = np.arange(1, len(b) + 1) * -GAP
        row, top, end = np.zeros(len(b) + 1, np.int64), 0, 0
        for x in a:
            new = np.maximum(row[:-1] + np.where(b == x, MATCH, MISMATCH), np.maximum(row[1:] + GAP, 0))
            new = np.maximum.accumulate(new + steps) - steps
            row = np.concatenate(([0], new))
            if (m := int(row.max())) > top:
                top, end = m, int(row.argmax())
        return top, end

    score, end = best(item, region)
    _, back = best(item[::-1], region[:end][::-1])
    return score, end - back, end


def hits_in(ids: np.ndarray, members: Members, block: Block, score: float) -> list[tuple[int, float, int, int]]:
    """(number of the item, part of its best score, start, end in words) of each item the text holds.

    Around each seed as many words are looked at as an alignment with this score can reach.
    """
    if not len(ids):
        return []
    at, first, last = members.find(shingles(ids, block.width))
    n = last - first
    which = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.array([], np.int64)
    places = block.places[which].astype(np.int64)
    of = np.searchsorted(block.ends, places, "right") - 1
    starts = np.unique(np.stack((of, np.repeat(at, n) - (places - block.ends[of]))), axis=1) if len(of) else np.zeros((2, 0), np.int64)
    out = []
    for part in np.split(starts, np.flatnonzero(np.diff(starts[0])) + 1, axis=1) if starts.shape[1] else ():
        item, own = int(part[0, 0]), block.item(int(part[0, 0]))
        slack, found, until = int(2 * (1 - score) * len(own)) + 4, None, None
        for s in part[1].tolist():
            if until is not None and s <= until:
                continue
            until = s + slack // 2  # starts this near are covered by the same region
            a, b = max(0, s - slack), min(len(ids), s + len(own) + slack + slack // 2)
            # Each word of the item can match once at most.
            if np.isin(own, ids[a:b]).sum() < score * len(own):
                continue
            got, x, y = align(own, ids[a:b])
            good = got / (MATCH * len(own))
            if good >= score and y - x >= min(LEAST_WORDS, len(own)) and (found is None or good > found[1]):
                found = (item, good, a + x, a + y)
        if found:
            out.append(found)
    return out


def _matcher(block: Block, score: float, id_type: pa.DataType, item_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("item", item_type), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])

    def match(batches):
        members = Members(block.seeds)
        for batch in batches:
            for start, texts in in_slices(batch, 2_000_000, 1):
                rows = []
                for i, text in enumerate(texts):
                    for item, part, a, b in hits_in(word_ids(words(text)), members, block, score):
                        rows.append((batch.column(0)[start + i].as_py(), block.names[item], part, a, b))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return match


def _remover(column: int, block: Block, score: float):
    def remove(batches):
        members = Members(block.seeds)
        for batch in batches:
            clean = [not hits_in(word_ids(words(t.as_py())), members, block, score) for t in batch.column(column)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return remove


def contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = SEED, score: float = SCORE) -> DataFrame:
    """(id, item_id, score, start, end): each document and item that it holds, with the words aligned."""
    kind, item_kind = docs.schema[id].dataType, items.schema[item_id].dataType
    own = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    ddl = f"id {kind.simpleString()}, item {item_kind.simpleString()}, score double, start long, end long"
    out = docs.sparkSession.createDataFrame([], ddl)
    for block in blocks(items, item_id, item_text, width):
        out = out.unionAll(own.mapInArrow(_matcher(block, score, to_arrow_type(kind), to_arrow_type(item_kind)), ddl))
    return out.select(F.col("id").alias(id), F.col("item").alias(item_id), "score", "start", "end")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = SEED, score: float = SCORE) -> DataFrame:
    """Documents that hold none of the items, with their own columns."""
    out = docs
    for block in blocks(items, item_id, item_text, width):
        out = out.mapInArrow(_remover(docs.columns.index(text), block, score), docs.schema)
    return out
