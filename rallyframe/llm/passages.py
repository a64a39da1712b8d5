"""Repeated passages by compact windows.

A text's tokens are its word shingles. For each of a few hash functions, the Cartesian tree over the
tokens' hashes gives the compact windows: (left, smallest, right), such that every run of tokens between
left and right that holds the smallest has it as its min-hash. Only windows as wide as the shortest passage
matter, about two for each such width. Two texts that share a passage have windows of one min-hash around it.

Links are found in two steps. First, windows of a min-hash are joined with those of one text, the centre; where, for a
pair of texts, windows of enough hash functions overlap along one diagonal, the passages between are verified on the
texts: at least `words` words, and shingle sets as similar as asked. Then what this left apart is compared with
each other: windows of two functions that overlap make a sharper key. Of each such key, the places in texts of other
components than the key's home meet all places of the key in blocks of bounded size; places of one component that lie in no
verified passage, with room for one, meet one of them. So a link between components is lost only where fewer than two functions
agree on it: 2.7 % for a shortest passage at a similarity of exactly 0.8.

At scale: equal texts are one text, and no copies become pairs. A window is 28 bytes, and texts give about
`2 * FUNCTIONS / words` windows a word. Windows are shuffled, texts only those of candidates. A min-hash shared by a third of
all texts costs a row for each in the first step; in the second, only places left apart are compared, in tasks of bounded
size, and no pair becomes a row unless it joins two components or verifies a place for the first time. Lists are
collected per text or pair of texts, and bounded by a text's length.

Defined cases: null texts and texts of fewer words have no passage; a passage repeated inside one text
counts, if its places are a passage apart, also with words inserted or left out; rows with null id are left out; rows that
share an id count as one document; repeated rows give one row; of equal hashes the leftmost token counts; an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import discard, in_slices, keep_ids, likely, written
from .components import components
from .tokens import shingles, word_ids, words_of

WORDS, WIDTH, PERCENT = 50, 5, 80
#: Hash functions, and how many of them must agree.
FUNCTIONS, AGREE = 4, 2
#: Tokens by which edits may shift one place against the other.
SHIFT = 16
#: Places of one side of a block; tokens on either side of a place that are compared there, as shortest passages' widths.
BLOCK, AROUND = 2048, 1
_random = np.random.default_rng(20240611)
TIMES = _random.integers(1, 2**63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bits of a sort key that hold a token's place; the others hold the start of its hash.
PLACE = np.uint64(28)


def hashes(values: np.ndarray, f: int) -> np.ndarray:
    h = values * TIMES[f]
    h ^= h >> np.uint64(32)
    h *= TIMES[f]
    return (h & ~np.uint64(7)) | np.uint64(f)


def smallest(h: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Places, in order, of the leftmost smallest of the `least` hashes from each start on."""
    n = len(h)
    key = np.full(-(-n // least) * least, np.iinfo(np.uint64).max, np.uint64)
    key[:n] = (h >> PLACE << PLACE) | np.arange(n, dtype=np.uint64)
    rows = key.reshape(-1, least)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(after[starts], before[starts + least - 1]) & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    return at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at


def tree(order: list, at: list, text: list, bounds: list):
    """The Cartesian tree over these tokens, from left to right: (kept, lo, hi, again) of its nodes.

    A node spans the tokens between the next smaller ones on both sides, within its text. Equal tokens without
    a smaller one between them are one node, the first of them; again is the last of them.
    """
    kept, lo, hi, again = [], [], [], []
    stack: list[int] = []  # numbers of open nodes, from small to large
    last = -1
    for i, x in enumerate(order):
        p = at[i]
        if text[i] != last:
            for node in stack:
                hi[node] = bounds[last + 1]
            stack, last = [], text[i]
        while stack and order[kept[stack[-1]]] > x:
            hi[stack.pop()] = p
        if stack and order[kept[stack[-1]]] == x:
            again[stack[-1]] = p
            continue
        lo.append(again[stack[-1]] + 1 if stack else bounds[last])
        stack.append(len(kept))
        kept.append(i)
        hi.append(p)
        again.append(p)
    for node in stack:
        hi[node] = bounds[last + 1]
    return kept, lo, hi, again


def compact_windows(tokens: list[np.ndarray], least: int):
    """(text, key, lo, at, hi, again) as arrays: the windows of `least` tokens or more of each text, hi exclusive, sorted by text.

    The function's number is in a key's low bits. Texts have `least` tokens or more.
    """
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    values, of = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), sizes)
    starts = np.flatnonzero(bounds[of + 1] - np.arange(len(values)) >= least)
    parts = []
    for f in range(FUNCTIONS):
        h = hashes(values, f)
        at = smallest(h, starts, least)
        kept, lo, hi, again = tree((h[at] >> PLACE).tolist(), at.tolist(), of[at].tolist(), bounds.tolist())
        at = at[kept]
        first = bounds[of[at]]
        parts.append((of[at], h[at].view(np.int64), np.array(lo, np.int64) - first, at - first, np.array(hi, np.int64) - first, np.array(again, np.int64) - first))
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    by_text = np.argsort(columns[0], kind="stable")
    return [c[by_text] for c in columns]


def own_repeats(values: np.ndarray, at: np.ndarray, words: int, least: int, percent: int, gap: int) -> list[tuple[int, int, int, int]]:
    """Passages that repeat inside the text, `words` tokens apart or more: (start, end, first start, first end) in tokens.

    at: places of windows' smallest tokens. Where such a token stands `words` tokens apart, the tokens that recur at about
    this distance are verified like passages of two texts.
    """
    _, code, n = np.unique(values, return_inverse=True, return_counts=True)
    picked = np.zeros(len(n), bool)
    picked[code[at]] = True
    places = np.flatnonzero((picked & (n > 1))[code])
    places = places[np.argsort(code[places], kind="stable")]
    shifts: set[int] = set()
    for where in np.split(places, np.flatnonzero(np.diff(code[places])) + 1) if len(places) else ():
        before = np.searchsorted(where, where - words, "right") - 1  # the nearest that is far enough
        shifts.update((where - where[before])[before >= 0].tolist())
    out, group = [], []
    for d in [*sorted(shifts), None]:
        if group and (d is None or d - group[-1] > SHIFT):
            seen = np.zeros(len(values), bool)
            for x in group:
                seen[x:] |= values[x:] == values[:-x]
            for a, b in dense(seen, gap):
                low = max(0, a - group[-1] - gap)
                for p, q, x, y in verified(values[a:b], values[low : b - group[0] + gap], least, percent, gap) if b - a >= least else ():
                    if a + p - (low + x) >= words:
                        out.append((a + p, a + q, low + x, low + y))
            group = []
        group.append(d)
    return out


CUT = "node long, digest binary, n_words int, keys array<long>, lo array<int>, at array<int>, hi array<int>, own array<array<int>>"


def _cutter(words: int, width: int, percent: int, id_type: pa.DataType):
    ints, own_type = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))
    schema = pa.schema([("node", pa.int64()), ("digest", pa.binary()), ("n_words", pa.int32()), ("keys", pa.list_(pa.int64())), ("lo", ints), ("at", ints), ("hi", ints), ("own", own_type), ("id", id_type)])
    least = words - width + 1

    def cut(batches):
        for batch in batches:
            for start, texts in in_slices(batch, 2_000_000, 1):
                split = [(i, word_ids(w)) for i, w in ((i, words_of(t)) for i, t in enumerate(texts)) if len(w) >= words]
                if not split:
                    continue
                tokens = [shingles(ids, width) for _, ids in split]
                of, key, lo, at, hi, again = compact_windows(tokens, least)
                ends = np.searchsorted(of, np.arange(len(tokens) + 1))
                twice = set(of[again != at].tolist())
                pairs = np.lexsort((key, of))
                twice |= set(of[pairs[1:]][(np.diff(key[pairs]) == 0) & (np.diff(of[pairs]) == 0)].tolist())
                own = [[[a, b + width - 1, x, y + width - 1] for a, b, x, y in own_repeats(tokens[k], at[ends[k] : ends[k + 1]], words, least, percent, 2 * width)] if k in twice else [] for k in range(len(tokens))]
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c, t)) for c, t in ((key, pa.int64()), *((c, pa.int32()) for c in (lo, at, hi)))]
                rows = pa.array([start + i for i, _ in split])
                digest = [hashlib.md5(texts[i].encode("utf-8", "surrogatepass")).digest() for i, _ in split]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(digest, pa.binary()), pa.array([len(ids) for _, ids in split], pa.int32()), *lists, pa.array(own, own_type), batch.column(2).take(rows)], schema=schema)

    return cut


def regions(collisions: list[tuple], least: int, agree: int = AGREE) -> list[tuple[int, int, int, int]]:
    """Where, in both texts, windows of enough functions overlap along one diagonal. collisions: (f, lo, at, hi, rlo, rat, rhi)."""
    out: list[tuple[int, int, int, int]] = []

    def chains(run: list[tuple]) -> None:
        """Of windows along one diagonal, chains that overlap by a passage's width."""
        run.sort(key=lambda w: w[1])
        k = 0
        while k < len(run):
            f, lo, _, hi, rlo, _, rhi = run[k]
            seen, k = {f}, k + 1
            while k < len(run) and run[k][1] + least <= hi:
                w = run[k]
                seen.add(w[0])
                hi, rlo, rhi, k = max(hi, w[3]), min(rlo, w[4]), max(rhi, w[6]), k + 1
            if len(seen) >= agree:
                out.append((lo, hi, rlo, rhi))

    run: list[tuple] = []
    for c in sorted(collisions, key=lambda c: c[2] - c[5]):
        if run and c[2] - c[5] - (run[-1][2] - run[-1][5]) > SHIFT:
            chains(run)
            run = []
        run.append(c)
    chains(run)
    return out


def dense(mask: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """Runs of matching tokens with holes of at most `gap`."""
    at = np.flatnonzero(mask)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > gap) + 1
    return [(int(x[0]), int(x[-1]) + 1) for x in np.split(at, cut)]


def marks(x: np.ndarray, n: int) -> np.ndarray:
    """Which of n codes stand in x."""
    out = np.zeros(n, np.bool_)
    out[x] = True
    return out


def similar(x: np.ndarray, y: np.ndarray, percent: int, n: int) -> bool:
    """x and y as codes below n."""
    in_x, in_y = marks(x, n), marks(y, n)
    return 100 * np.count_nonzero(in_x & in_y) >= percent * np.count_nonzero(in_x | in_y)


def token_pairs(s: np.ndarray, r: np.ndarray) -> list[tuple[int, int]]:
    """Places of equal tokens. A token that makes more than 64 pairs is paired by its turn, so pairs stay few."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(r.tolist()):
        places.setdefault(x, []).append(j)
    tokens = s.tolist()
    often, turn = Counter(tokens), Counter()
    out = []
    for i, x in enumerate(tokens):
        js = places.get(x, [])
        if len(js) * often[x] > 64:
            js, turn[x] = js[turn[x] : turn[x] + 1], turn[x] + 1
        out += [(i, j) for j in reversed(js)]
    return out


def longest_chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The most pairs that rise on both sides; pairs are sorted by the first, and falling by the second."""
    tops, ends, links = [], [], []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        links.append(ends[k - 1] if k else -1)
        tops[k : k + 1], ends[k : k + 1] = [j], [n]
    chain, at = [], ends[-1] if ends else -1
    while at >= 0:
        chain.append(pairs[at])
        at = links[at]
    return chain[::-1]


def once(s: np.ndarray, r: np.ndarray, n: int) -> np.ndarray | None:
    """Places of equal tokens, if no token of s or r stands there twice and they come in one order; else None."""
    if np.bincount(s).max() > 1 or np.bincount(r).max() > 1:
        return None
    where = np.full(n, -1, np.int64)
    where[r] = np.arange(len(r))
    j = where[s]
    i = np.flatnonzero(j >= 0)
    return np.stack((i, j[i]), axis=1) if (np.diff(j[i]) > 0).all() else None


def in_order(s: np.ndarray, r: np.ndarray, least: int, percent: int, n: int) -> tuple[int, int, int, int] | None:
    """The longest similar stretch along a chain of equal tokens; a chain that has none gives way to the next."""

    def longest(at: np.ndarray) -> tuple[int, int, int, int] | None:
        # Tokens between two pairs are similar where (100 + percent) times the pairs reach percent times both lengths.
        level = (100 + percent) * np.arange(len(at)) - percent * at.sum(axis=1)
        first = np.searchsorted(-np.minimum.accumulate(level), -(level + 100 - percent))
        size = (at - at[first]).min(axis=1) + 1
        k = int(size.argmax())
        (a, x), (b, y) = at[first[k]].tolist(), at[k].tolist()
        if size[k] >= least and similar(s[a : b + 1], r[x : y + 1], percent, n):
            return a, b + 1, x, y + 1
        return None

    at = once(s, r, n)
    if at is not None:
        return longest(at) if len(at) * 100 >= percent * least else None
    pairs = token_pairs(s, r)
    while len(chain := longest_chain(pairs)) * 100 >= percent * least:
        if found := longest(np.array(chain)):
            return found
        used = set(chain)
        pairs = [p for p in pairs if p not in used]
    return None


def verified(s: np.ndarray, r: np.ndarray, least: int, percent: int, gap: int) -> list[tuple[int, int, int, int]]:
    """Passages of s and r, at least `least` tokens each, with similar enough sets; from the widest down.

    A run of s that isn't similar to any run of r is trimmed to what it has in common with each of them; where
    nothing is left to trim, the longest stretch in one order is taken, and the rest is looked at again.
    """
    known, codes = np.unique(np.concatenate((s, r)), return_inverse=True)
    s, r, n = codes[: len(s)], codes[len(s) :], len(known)
    out, met = [], set()
    todo = [(a, b, 0, len(r)) for a, b in dense(marks(r, n)[s], gap)]
    while todo:
        state = a, b, x, y = todo.pop()
        if min(b - a, y - x) < least or state in met:
            continue
        met.add(state)
        own = s[a:b]
        runs = [(x + u, x + v) for u, v in dense(marks(own, n)[r[x:y]], gap) if v - u >= least]
        if same := next((run for run in sorted(runs, key=lambda z: z[0] - z[1]) if similar(own, r[slice(*run)], percent, n)), None):
            out.append((a, b, *same))
            continue
        smaller = [(a + p, a + q, u, v) for u, v in runs for p, q in dense(marks(r[u:v], n)[own], gap)]
        if smaller != [state]:
            todo += smaller
        elif part := in_order(own, r[x:y], least, percent, n):
            p, q, u, v = part
            out.append((a + p, a + q, x + u, x + v))
            todo += [(a, a + p, x, y), (a + q, b, x, y)]
        else:
            at = np.flatnonzero(marks(r[x:y], n)[own])
            k = int(np.diff(at).argmax()) if len(at) > 1 else 0
            if len(at) > 1 and at[k + 1] - at[k] > 1:
                todo += [(a + int(at[0]), a + int(at[k]) + 1, x, y), (a + int(at[k + 1]), a + int(at[-1]) + 1, x, y)]
    return out


def _tuples(lists: pa.Array) -> list[list[tuple]]:
    """Rows of a list<struct> column, as lists of tuples of numbers."""
    flat = lists.flatten()
    rows = list(zip(*(flat.field(k).to_pylist() for k in range(flat.type.num_fields)), strict=True))
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())))
    return [rows[a:b] for a, b in zip(ends, ends[1:], strict=False)]


PAIR = "node long, rep long, regions array<struct<lo:int,hi:int,rlo:int,rhi:int>>"
REGION = pa.struct([(n, pa.int32()) for n in ("lo", "hi", "rlo", "rhi")])
PASSAGE = "node long, start int, end int, rep long, rstart int, rend int"
PASSAGES = pa.schema([("node", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("rep", pa.int64()), ("rstart", pa.int32()), ("rend", pa.int32())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _finder(least: int):
    schema = pa.schema([("node", pa.int64()), ("rep", pa.int64()), ("regions", pa.list_(REGION))])

    def find(batches):
        for batch in batches:
            found = [regions(x, least) for x in _tuples(batch.column(2))]
            keep = pa.array([bool(x) for x in found], pa.bool_())
            listed = [[dict(zip(("lo", "hi", "rlo", "rhi"), r, strict=True)) for r in x] for x in found if x]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(listed, pa.list_(REGION))], schema=schema)

    return find


def _verifier(words: int, width: int, percent: int):
    least = words - width + 1

    def verify(batches):
        lately: dict = {}

        def tokens(node: int, text) -> np.ndarray:
            if node not in lately:
                if len(lately) >= 200:
                    lately.clear()
                lately[node] = shingles(word_ids(words_of(text.as_py())), width)
            return lately[node]

        for batch in batches:
            nodes, reps = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for i, found in enumerate(_tuples(batch.column(2))):
                own, theirs = tokens(nodes[i], batch.column(3)[i]), tokens(reps[i], batch.column(4)[i])
                for lo, hi, rlo, rhi in found:
                    for a, b, x, y in verified(own[lo:hi], theirs[rlo:rhi], least, percent, 2 * width):
                        rows.append((nodes[i], lo + a, lo + b + width - 1, reps[i], rlo + x, rlo + y + width - 1))
            yield _rows(rows, PASSAGES)

    return verify


def sharper(node: int, windows: list[tuple], spans: list[tuple], least: int, width: int) -> list[tuple]:
    """(key, at, open) where windows of two functions overlap: the key of both, the middle of their smallest tokens, whether there is room around it for a passage that touches no span.

    windows: (key, lo, at, hi, center); spans in words. Runs that hold both smallest tokens have both min-hashes. Where both
    min-hashes have one centre, all their texts have been compared with it: it is left out itself.
    """
    out = set()
    by = sorted(windows, key=lambda w: w[2])
    places = [w[2] for w in by]
    starts, ends = [], []  # of the tokens that spans cover, merged
    for a, b in sorted((a, b - width + 1) for a, b in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def room(p: int) -> bool:
        k = bisect_right(starts, p)
        before = ends[k - 1] if k else -least
        return before <= p and (starts[k] if k < len(starts) else p + least) - before >= least

    for k, (key, lo, at, hi, center) in enumerate(by):
        for j in range(k + 1, bisect_left(places, hi)):
            other, lo2, at2, hi2, center2 = by[j]
            if other & 7 == key & 7 or lo2 > at or min(hi, hi2) - max(lo, lo2) < least or center == center2 == node:
                continue
            both = (min(key, other) * 0x9E3779B97F4A7C15 ^ max(key, other)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
            middle = (at + at2) // 2
            out.add((both - 2**63, middle, room(middle)))
    return list(out)


PLACES = "node long, part long, key long, at int, open boolean"


def _sharpener(words: int, width: int):
    schema = pa.schema([("node", pa.int64()), ("part", pa.int64()), ("key", pa.int64()), ("at", pa.int32()), ("open", pa.bool_())])

    def sharpen(batches):
        for batch in batches:
            nodes, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            windows, spans = _tuples(batch.column(2)), _tuples(batch.column(3))
            rows = []
            for node, part, w, s in zip(nodes, parts, windows, spans, strict=True):
                rows += [(node, part, *x) for x in sharper(node, w, s, words - width + 1, width)]
                if len(rows) > 100_000:
                    yield _rows(rows, schema)
                    rows = []
            yield _rows(rows, schema)

    return sharpen


def _slicer(least: int, width: int):
    """Of texts (node, text, places), the tokens around each place, 32 bits of each."""
    schema = pa.schema([("node", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("tokens", pa.list_(pa.int32()))])

    def cut(batches):
        for batch in batches:
            for start, texts in in_slices(batch, 1_000_000, 1):
                rows = []
                for i, text in enumerate(texts, start):
                    values = (shingles(word_ids(words_of(text)), width) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    for at in batch.column(2)[i].as_py():
                        low = max(0, at - AROUND * least)
                        rows.append((batch.column(0)[i].as_py(), at, low, values[low : at + AROUND * least]))
                yield _rows(rows, schema)

    return cut


def stretches(xs: list[np.ndarray], ys: list[np.ndarray], least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For all x and y: whether x has a stretch of `least` tokens or more of which `percent` stand in y, and 100 times 2 in (100 / percent + 1).

    Two stretches with sets so similar have `percent` of each in the other, and of the smaller one the second part.
    Texts with a token twice pass both.
    """
    longest = max(map(len, xs))
    padded, raw = np.zeros((len(xs), longest), np.int64), np.tile(np.arange(longest) + (1 << 40), (len(xs), 1))
    known, code = np.unique(np.concatenate(ys), return_inverse=True)  # number 0 is left for tokens that no y has
    inside = np.zeros((len(ys), len(known) + 1), np.bool_)
    inside[np.repeat(np.arange(len(ys)), [len(y) for y in ys]), code + 1] = True
    for k, x in enumerate(xs):
        at = np.searchsorted(known, x)
        at[at == len(known)] = 0
        padded[k, : len(x)], raw[k, : len(x)] = np.where(known[at] == x, at + 1, 0), x
    out = np.zeros((2, len(xs), len(ys)), np.bool_)
    step = max(1, 2_000_000 // (len(ys) * longest))
    for k in range(0, len(xs) if longest >= least else 0, step):
        seen = inside[:, padded[k : k + step]]  # by y, x and place
        # A stretch has no fewer tokens in common than the shortest needs.
        j, i = np.nonzero(100 * np.count_nonzero(seen, axis=2) >= percent * least)
        for at in range(0, len(i), 20_000):
            some, x, y = seen[j[at : at + 20_000], i[at : at + 20_000]], k + i[at : at + 20_000], j[at : at + 20_000]
            for which, (part, whole) in enumerate(((percent, 100), (2 * percent, 100 + percent))):
                sums = np.zeros((len(some), longest + 1), np.int32)
                np.cumsum(np.where(some, np.int32(whole - part), np.int32(-part)), axis=1, out=sums[:, 1:], dtype=np.int32)
                low = np.minimum.accumulate(sums, axis=1)
                out[which, x, y] = (sums[:, least:] >= low[:, : longest + 1 - least]).any(axis=1)
    ordered = np.sort(raw, axis=1)
    out[:, (ordered[:, 1:] == ordered[:, :-1]).any(axis=1)] = True
    return out[0], out[1]


def apart(xs: list[dict], ys: list[dict], least: int, width: int, percent: int):
    """Passages between places of xs and of ys, each with node, part, open, at, low and tokens.

    Only such as join components that nothing before joined, or as verify an open place for the first time. Texts of different
    components are compared where x is away from the key's home; other open places meet the second centre.
    """
    joined: dict = {}
    still = {(r["node"], r["at"]): r["open"] for side in (xs, ys) for r in side}

    def root(p):
        while joined.get(p, p) != p:
            p = joined[p]
        return p

    def compare(xs: list[dict], ys: list[dict]):
        tokens = [[r["tokens"] for r in side] for side in (xs, ys)]
        in_x, much_x = stretches(*tokens, least, percent)
        rows = np.flatnonzero(in_x.any(axis=1))
        if not len(rows):
            return
        columns = np.flatnonzero(in_x.any(axis=0))
        in_y, much_y = stretches([tokens[1][j] for j in columns], [tokens[0][i] for i in rows], least, percent)
        here = np.ix_(rows, columns)
        for i, j in zip(*np.nonzero(in_x[here] & in_y.T & (much_x[here] | much_y.T)), strict=True):
            x, y = xs[rows[i]], ys[columns[j]]
            p, q = root(x["part"]), root(y["part"])
            here, there = (x["node"], x["at"]), (y["node"], y["at"])
            if here[0] == there[0] or p == q and not (y["second"] and (still[here] or still[there])):
                continue
            found = verified(x["tokens"], y["tokens"], least, percent, 2 * width)
            for a, b, u, v in found:
                yield here[0], x["low"] + a, x["low"] + b + width - 1, there[0], y["low"] + u, y["low"] + v + width - 1
            if found:
                still[here] = still[there] = False
                joined[max(p, q)] = min(p, q)

    # Places that are both away meet twice, once in each order: the smaller text's turn is enough.
    xs, ys = (sorted(side, key=lambda r: r["node"]) for side in (xs, ys))
    second = [r for r in ys if r["second"]]
    for some, others in (([r for r in xs if r["away"]], ys), ([r for r in xs if r["open"] and not r["away"]], second)):
        for a in range(0, len(some), 256):
            for b in range(0, len(others), 256):
                left, right = some[a : a + 256], others[b : b + 256]
                if not (right[-1]["node"] < left[0]["node"] and all(r["away"] for r in right)):
                    yield from compare(left, right)


def _linker(least: int, width: int, percent: int):
    def link(batches):
        key, sides = None, ([], [])
        for batch in batches:
            out, tokens = [], batch.column(batch.num_columns - 1)
            flat, ends = tokens.flatten().to_numpy(), np.concatenate(([0], np.cumsum(tokens.value_lengths().to_numpy())))
            for k, row in enumerate(batch.select(range(batch.num_columns - 1)).to_pylist()):
                at = row["key"], row["i"], row["j"]
                if at != key:
                    out += apart(*sides, least, width, percent) if all(sides) else ()
                    key, sides = at, ([], [])
                sides[not row["first"]].append(row | {"tokens": flat[ends[k] : ends[k + 1]].copy()})
            yield _rows(out, PASSAGES)
        yield _rows(list(apart(*sides, least, width, percent)) if all(sides) else [], PASSAGES)

    return link


def with_texts(rows: DataFrame, own: DataFrame, member: DataFrame) -> DataFrame:
    """rows and the text of their node; of rows of own that share an id, the one with the node's digest.

    Texts are shuffled once, those that rows ask for alone.
    """
    asked = written(rows.join(member.select("node", "id", "digest"), "node"), "asked")
    found = likely(own, asked.select("id"), "id").withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    return found.dropDuplicates(["id", "digest"]).join(asked, ["id", "digest"]).select(*rows.columns, "text")


def missed(own: DataFrame, member: DataFrame, windows: DataFrame, between: DataFrame, words: int, width: int, percent: int) -> DataFrame:
    """Passages that the join with centres left out. windows: (key, node, lo, at, hi, center); between: passages found."""
    least = words - width + 1
    parts = components(between.select(F.col("rep").alias("a"), F.col("node").alias("b")))
    spans = between.select("node", "start", "end").union(between.select("rep", "rstart", "rend")).distinct()
    spans = spans.groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    listed = windows.groupBy("node").agg(F.collect_list(F.struct("key", "lo", "at", "hi", "center")).alias("windows"))
    each = listed.join(spans, "node", "left").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("part"), "windows", "spans")
    places = written(each.mapInArrow(_sharpener(words, width), PLACES), "places")
    keys = places.groupBy("key").agg(F.count("*").alias("n"), F.min(F.when(F.col("open"), F.col("node"))).alias("second"), F.max(F.when(F.col("open"), F.col("node"))).alias("last"), F.min("part").alias("home"), F.max("part").alias("other"), F.min("node").alias("low"), F.max("node").alias("high"))
    keys = keys.filter("low <> high and (second <> last or home <> other)").select("key", "home", "second", (F.col("home") != F.col("other")).alias("several"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = places.join(keys, "key").withColumn("second", F.coalesce((F.col("node") == F.col("second")) & F.col("open"), F.lit(False)))
    met = written(met.filter("several or open").select("key", "several", "blocks", "node", "part", "at", "open", "second", (F.col("part") != F.col("home")).alias("away")), "apart")
    discard(places)
    wanted = met.groupBy("node").agg(F.collect_set("at").alias("places"))
    sliced = with_texts(wanted, own, member).select("node", "text", "places")
    sliced = written(sliced.mapInArrow(_slicer(least, width), "node long, at int, low int, tokens array<int>").withColumn("content", F.xxhash64("tokens", F.size("tokens"))), "slices")
    mine, every = F.pmod(F.xxhash64("node", "at"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    same = ("node", "part", "open", "second", "at")
    x = met.filter("away or open and not second").select("key", mine.alias("i"), every.alias("j"), F.lit(True).alias("first"), "away", *same)
    # Equal tokens of one component: two of them stand for all, so that each place meets one of another text.
    ends = [f(F.struct("node", "at")).alias(n) for f, n in ((F.min, "a"), (F.max, "b"))]
    y = met.filter("several or second").join(sliced.select("node", "at", "content"), ["node", "at"]).groupBy("key", "blocks", "part", "open", "second", "away", "content").agg(*ends)
    y = y.select("key", "blocks", "part", "open", "second", "away", F.explode(F.array_distinct(F.array("a", "b"))).alias("p")).select("key", "blocks", "part", "open", "second", "away", "p.node", "p.at")
    y = y.select("key", mine.alias("j"), every.alias("i"), F.lit(False).alias("first"), "away", *same).select(*x.columns)
    both = x.unionByName(y).join(sliced, ["node", "at"]).select("key", "i", "j", "first", "away", "node", "part", "open", "second", "at", "low", "tokens")
    both = both.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return both.mapInArrow(_linker(least, width, percent), PASSAGE)


def repeated_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, start, end, rep, rstart, rend): passages, in words, with another place of each; rep is not the larger id. Equal texts are linked with one of them."""
    own = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).filter("id is not null")
    kind = own.schema["id"].dataType
    numbered = own.select(F.monotonically_increasing_id().alias("node"), "text", "id")
    cut = written(numbered.mapInArrow(_cutter(words, width, percent, to_arrow_type(kind)), f"{CUT}, id {kind.simpleString()}"), "windows")
    first = written(cut.groupBy("digest").agg(F.min("node").alias("rep")), "first")
    member = written(cut.select("node", "id", "digest", "n_words").join(first, "digest"), "member")
    discard(first)
    copies = member.filter("node <> rep")
    # Copies go while a text's windows are one row; what is left is dealt by key once, which tells the keys that several texts have.
    alone = keep_ids(cut.select("node", "keys", "lo", "at", "hi"), member.filter("node = rep").select("node"), "node")
    window = alone.select("node", F.explode(F.arrays_zip("keys", "lo", "at", "hi")).alias("w")).select(F.col("w.keys").alias("key"), "node", F.col("w.lo").alias("lo"), F.col("w.at").alias("at"), F.col("w.hi").alias("hi"))
    of_key = Window.partitionBy("key")
    met = window.withColumn("center", F.min("node").over(of_key)).withColumn("last", F.max("node").over(of_key))
    met = written(met.filter("center <> last").select("key", "node", "lo", "at", "hi", "center"), "shared")
    own_places = written(cut.filter(F.size("own") > 0).select("id", "own"), "own")
    discard(cut)
    r = met.filter("node = center").select("key", F.struct("lo", "at", "hi").alias("r"))
    each = F.struct(F.expr("cast(key & 7 as int)").alias("f"), "lo", "at", "hi", F.col("r.lo").alias("rlo"), F.col("r.at").alias("rat"), F.col("r.hi").alias("rhi"))
    pairs = met.filter("node <> center").join(r, "key").groupBy("node", F.col("center").alias("rep")).agg(F.collect_list(each).alias("found"), F.expr("bit_or(shiftleft(1, cast(key & 7 as int)))").alias("functions"))
    pairs = written(pairs.filter(F.bit_count("functions") >= AGREE).select("node", "rep", "found").mapInArrow(_finder(words - width + 1), PAIR), "pairs")
    centres = written(with_texts(pairs.select(F.col("rep").alias("node")).distinct(), own, member), "centres")
    full = with_texts(pairs, own, member).join(centres.select(F.col("node").alias("rep"), F.col("text").alias("rep_text")), "rep").select("node", "rep", "regions", "text", "rep_text")
    between = written(full.mapInArrow(_verifier(words, width, percent), PASSAGE), "between")
    discard(centres)
    between = between.union(missed(own, member, met, between, words, width, percent)).distinct()
    name = member.select("node", "id")
    ours = between.join(name, "node").join(name.select(F.col("node").alias("rep"), F.col("id").alias("rep_id")), "rep").select("id", "start", "end", "rep_id", "rstart", "rend")
    equal = copies.join(name.select(F.col("node").alias("rep"), F.col("id").alias("rep_id")), "rep").select("id", F.lit(0).alias("start"), F.col("n_words").alias("end"), "rep_id", F.lit(0).alias("rstart"), F.col("n_words").alias("rend")).filter("id <> rep_id")
    within = own_places.select("id", F.explode("own").alias("p")).selectExpr("id", "p[0] start", "p[1] end", "id rep_id", "p[2] rstart", "p[3] rend")
    swap = F.col("id") < F.col("rep_id")
    turned = [F.when(swap, F.col(b)).otherwise(F.col(a)).alias(n) for a, b, n in (("id", "rep_id", "id"), ("start", "rstart", "start"), ("end", "rend", "end"), ("rep_id", "id", "rep"), ("rstart", "start", "rstart"), ("rend", "end", "rend"))]
    return ours.union(equal).union(within).select(*turned).distinct()


def merged(spans: DataFrame) -> DataFrame:
    """(id, n, words, spans): the union of each id's spans (id, start, end)."""
    along = Window.partitionBy("id").orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("reach") >= F.col("start"), 0).otherwise(1)).over(along)
    runs = spans.distinct().withColumn("reach", reach).withColumn("island", island).groupBy("id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return runs.groupBy("id").agg(F.count("*").alias("n_passages"), F.sum(F.col("end") - F.col("start")).cast("long").alias("n_repeated"), listed.alias("spans"))


def substring_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """A row for each document with a passage that also stands elsewhere.

    n_repeated words lie in such passages, at `spans` (start:end in words); n_removable of them are not
    the first place. component_id is the smallest id that passages link the document with.
    """
    found = written(repeated_passages(docs, id, text, words, width, percent), "passages")
    later = found.select("id", "start", "end")
    every = later.union(found.select(F.col("rep").alias("id"), F.col("rstart").alias("start"), F.col("rend").alias("end")))
    parts = components(found.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    removable = merged(later).select("id", F.col("n_repeated").alias("n_removable"))
    out = merged(every).join(removable, "id", "left").join(parts.withColumnRenamed("node", "id"), "id")
    return out.select(F.col("id").alias(id), F.col("component").alias("component_id"), "n_passages", "n_repeated", F.coalesce("n_removable", F.lit(0)).cast("long").alias("n_removable"), "spans")
