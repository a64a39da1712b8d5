"""Packing documents into windows of tokens, by Karmarkar-Karp multiway differencing.

A document's ids, closed by one of END, are cut into pieces of a window's size; the last piece is shorter. Whole pieces are windows.
The others are dealt to windows: every piece starts as a partial partition, with one window filled and the rest empty; the two partitions
with the widest spread between their fullest and emptiest window are merged, the fullest windows of one with the emptiest of the
other, until one partition is left. So spreads cancel out, and the windows come out nearly equal. There are as many windows as the
tokens need; where one is over capacity there is no room for so equal a filling, so the count rises, by what the excess needs, and
differencing starts again.

What room is left is then used up by cutting: of a group's windows, as many as its tokens fill exactly are kept, the fullest; the
pieces of the others are cut to fill the kept ones to the last place, and their remainder becomes sequences whose lengths are
powers of two, the binary digits of its size. A sequence is only padded when its length isn't a power of two, so none is padded.

At scale: one pass over the texts makes pieces, which are dealt to groups by their place, about GROUP pieces to each, whatever document or source
they are of; a group is packed in one task, so a task holds GROUP pieces of at most a window. Documents longer than a window are many
pieces in many groups. Groups are sized by the bytes of the texts: they can be larger than GROUP by a factor of FEWEST at most.
Nothing passes through the driver but the sum of sizes, and the vocabulary's file, which is sent to executors. Pieces are told apart by their place in their partition, so the
documents should come in the same order when a task is repeated, as from a table.

Defined cases: a null text counts as an empty one, whose only id is END. Texts of any length are cut whole. Repeated rows, and rows that
share an id or have none, are documents of their own. An empty table gives an empty result. Columns that aren't named are not read.
"""

from __future__ import annotations

import bisect
import heapq
import json
from array import array
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import in_slices

CAPACITY, END = 2048, 1
#: Pieces of a group, about; bytes of text a token stands for at least, when groups are sized.
GROUP, FEWEST = 2048, 3
#: New entries, and as many old ones, of a process's tables of words and of their parts, and the longest kept there.
MOST_WORDS, LONG_WORD = 300_000, 64
#: Characters that Python takes for white space and the tokenizer doesn't.
_ODD = "\x1c\x1d\x1e\x1f"
#: White space, and characters that are their own composition and whose lower case is one character whatever stands around them.
PLAIN = regex.compile(r"[\x09-\x0D\x20-\x7E\u00A1-\u012F\u0131-\u0148\u014A-\u017E]+")
_loaded: dict[tuple, Words] = {}


class Kept(dict):
    """make(word) of words met lately: when full, its words become the old ones and the old ones go, so memory is bounded and frequent words stay."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) <= LONG_WORD:
            if len(self) >= MOST_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Words:
    """Packed ids of texts. The tokenizer drops white space and joins nothing across it, so words are encoded alone, and kept.

    Most words of a large corpus are rare ones, met for the first time. In plain characters, which the tokenizer's normalizers only
    lower-case, they are parted by the tokenizer's own pattern, and the parts given to its model; so what is alike in words, as a
    name with a comma, is encoded once. Other words are encoded as they are.
    """

    def __init__(self, encoder, kind):
        self.encoder, self.kind, self.split, self.runs = encoder, kind, None, False
        about = json.loads(encoder.to_str())
        steps = (about["pre_tokenizer"] or {}).get("pretokenizers", [])
        norms = [x["type"] for x in (about["normalizer"] or {}).get("normalizers", [])]
        self.special = [x["content"] for x in about["added_tokens"]]
        known = [x["type"] for x in steps] == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"] and not about["post_processor"]
        if known and steps[0]["behavior"] == "Removed" and steps[0]["invert"]:
            from tokenizers import pre_tokenizers

            as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=steps[1]["add_prefix_space"], use_regex=steps[1]["use_regex"])
            pattern = steps[0]["pattern"]["Regex"]
            self.split = regex.compile(pattern)
            # Whether a word of letters alone is one part: nothing that the pattern tries before a run of letters starts with one.
            first, found, _ = pattern.partition(r"|[\p{L}]+|")
            self.runs = bool(found) and all(x[:1] == "'" for x in first.split("|"))
            self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0x21, 0x180) if not chr(c).isspace()}
        tokenize, char = encoder.model.tokenize, kind.char

        def of_part(part: str) -> bytes:
            return array(char, [t.id for t in tokenize(part.translate(self.letters))]).tobytes()

        def of_word(word: str) -> bytes:
            # A word that is one part has its entry here; only parts of several words are worth one of their own.
            if self.runs and word.isalpha():
                return of_part(word)
            return b"".join(map(self.parts.__getitem__, self.split.findall(word)))

        self.parts, self.lower = Kept(of_part), Kept(of_word)
        self.whole = Kept(self.encode)

    def encode(self, text: str) -> bytes:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def plain(self, text: str) -> bool:
        return bool(self.split and PLAIN.fullmatch(text)) and not any(s in text for s in self.special)

    def ids(self, text: str | None) -> bytes:
        if not text or any(c in text for c in _ODD):
            return self.encode(text or "")
        if self.plain(text):
            return b"".join(map(self.lower.__getitem__, text.lower().split()))
        return b"".join(self.lower[w.lower()] if self.plain(w) else self.whole[w] for w in text.split())


def words_of(source: str, kind: np.dtype | None = None) -> Words:
    """The words of a tokenizer's file, given as text: one table in a Python process, for all tasks that it runs. kind: of packed ids, else the narrowest."""
    from tokenizers import Tokenizer

    key = blake2b(source.encode()).digest(), kind
    if key not in _loaded:
        _loaded.clear()
        encoder = Tokenizer.from_str(source)
        _loaded[key] = Words(encoder, kind or np.dtype("<u2" if encoder.get_vocab_size() <= 1 << 16 else "<u4"))
    return _loaded[key]


def _cutter(source, capacity: int, end: int, groups: int, kind: np.dtype, schema: pa.Schema):
    def cut(batches):
        words = words_of(source.value, kind)
        close, step, task, at = np.array([end], kind).tobytes(), capacity * kind.itemsize, TaskContext.get().partitionId(), 0
        for batch in batches:
            for start, texts in in_slices(batch, 1_000_000, 1):
                rows, group, first, total, pieces = [], [], [], [], []
                for i, text in enumerate(texts):
                    ids = words.ids(text) + close
                    for k in range(0, len(ids), step):
                        rows.append(start + i)
                        # Tasks start at different groups, so small ones don't all fill the first.
                        group.append((task * 7919 + at) % groups)
                        first.append(k // kind.itemsize)
                        total.append(len(ids) // kind.itemsize)
                        pieces.append(ids[k : k + step])
                        at += 1
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(total, pa.int64()), pa.array(first, pa.int64()), pa.array(pieces, pa.binary())], schema=schema)

    return cut


def differencing(sizes: list[int], windows: int) -> list[tuple[int, int, list[int]]]:
    """(sum, a place, places in sizes) of each non-empty window, emptiest first: Karmarkar-Karp over `windows` windows."""
    # A partition has its non-empty windows, emptiest first; what it lacks to `windows` is empty.
    heap = [(-s if windows > 1 else 0, k, [(s, k, [k])]) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        over = len(a) + len(b) - windows
        if over > 0:  # the emptiest windows of a take the fullest of b
            b[-over:] = [(x[0] + y[0], x[1], x[2] + y[2]) for x, y in zip(a[:over], reversed(b[-over:]), strict=True)]
            del a[:over]
        if len(b) == 1:
            bisect.insort(a, b[0])
        else:
            a += b
            a.sort()
        heapq.heappush(heap, ((a[0][0] if len(a) == windows else 0) - a[-1][0], n, a))
        n += 1
    return heap[0][2] if heap else []


def near_equal(sizes: list[int], capacity: int) -> list[tuple[int, int, list[int]]]:
    """Windows of differencing, as few as stay within the capacity."""
    windows = -(-sum(sizes) // capacity)
    while True:
        found = differencing(sizes, windows)
        excess = sum(max(0, w[0] - capacity) for w in found)
        if not excess:
            return found
        windows += -(-excess // capacity)


def fill(windows: list[tuple[int, int, list[int]]], sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (place in sizes, start in it, length) without padding: see above."""
    full = sum(sizes) // capacity
    windows = windows[::-1]
    out = [[(k, 0, sizes[k]) for k in members] for _, _, members in windows[:full]]
    loose = [(k, 0, sizes[k]) for _, _, members in windows[full:] for k in members][::-1]

    def draw(n: int):
        while n:
            k, at, left = loose.pop()
            yield k, at, min(n, left)
            if left > n:
                loose.append((k, at + n, left - n))
            n -= min(n, left)

    for sequence, window in zip(out, windows, strict=False):
        sequence.extend(draw(capacity - window[0]))
    rest = sum(sizes) % capacity
    out.extend(list(draw(1 << bit)) for bit in range(capacity.bit_length() - 1, -1, -1) if rest >> bit & 1)
    return out


def _packer(capacity: int, kind: np.dtype, schema: pa.Schema):
    def packed(group: pa.Table) -> pa.Table:
        pieces = [np.frombuffer(x, kind) for x in group["ids"].to_pylist()]
        whole = [k for k, p in enumerate(pieces) if len(p) == capacity]
        short = [k for k, p in enumerate(pieces) if len(p) < capacity]
        sizes = [len(pieces[k]) for k in short]
        sequences = [[(k, 0, capacity)] for k in whole]
        sequences += [[(short[k], at, n) for k, at, n in s] for s in fill(near_equal(sizes, capacity), sizes, capacity)]
        rows, starts, lengths, ids, number, offsets = [], [], [], [], [], []
        for j, sequence in enumerate(sequences):
            offset = 0
            for k, at, n in sequence:
                rows.append(k)
                starts.append(at)
                lengths.append(n)
                ids.append(pieces[k][at : at + n].astype("<u4").tobytes())
                number.append(j)
                offsets.append(offset)
                offset += n
        picked = group.take(pa.array(rows, pa.int64()))
        start = np.asarray(picked["start"]) + np.array(starts, np.int64)
        sequence = (np.asarray(picked["group"]) << 24) + np.array(number, np.int64)
        columns = [picked["id"], pa.array(start), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), picked["doc_tokens"], pa.array(sequence), pa.array(offsets, pa.int64())]
        return pa.table(columns, schema=schema)

    return packed


def sequences(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset) of every piece; ids are little-endian unsigned 32-bit numbers.

    `path` is a tokenizers file, of a tokenizer that drops white space and joins no words across it; capacity is a power of two.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        source = f.read()
    kind = words_of(source).kind if end < 1 << 16 else np.dtype("<u4")
    size = docs.select(F.col(f"`{text}`").alias("text")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    groups = max(1, -(-(size.n + size.b // (FEWEST * capacity)) // GROUP))
    id_type = to_arrow_type(docs.schema[id].dataType)
    named = docs.schema[id].dataType.simpleString()
    schema = pa.schema([("group", pa.int64()), ("id", id_type), ("doc_tokens", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
    cut = _cutter(spark.sparkContext.broadcast(source), capacity, end, groups, kind, schema)
    pieces = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(cut, f"group long, id {named}, doc_tokens long, start long, ids binary")
    out = pa.schema([("id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    return pieces.groupBy("group").applyInArrow(_packer(capacity, kind, out), f"id {named}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id)


def packed(docs: DataFrame, path: str, **options) -> DataFrame:
    """sequences() with the checksum of each piece's ids in their place."""
    found = sequences(docs, path, **options)
    return found.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
