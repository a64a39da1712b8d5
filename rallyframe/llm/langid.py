"""Language identification by unigram pieces, with all segmentations summed.

The pieces are those of a fixed public vocabulary. For each language their probabilities are learned
by expectation-maximisation; the probability of a word is the sum over all its segmentations, by a
forward pass over its characters; that of a text is the product over its words. The language with the
largest posterior, under equal priors, is predicted, and the posterior is the score. Words are runs of anything but ASCII
white space, in lower case, cut by one function for learning and scoring.

The fit uses at most about `sample` labelled rows a language, chosen by hash, and `MOST_LANGUAGES` languages at most; documented
bounds, so the driver gets the word counts of that many rows however large the corpus. Every row is then
scored whole, in one pass without a shuffle: words are scored once a slice, many at a time, with numpy. Words of more than
`LONGEST` characters are scored one by one, in time linear in their length, with chances rescaled as they shrink.

Defined cases: null text, or text without a letter, is `und` with score 0; unlabelled rows are scored but not learned
from; more labels than `MOST_LANGUAGES` raise an error; of languages that are equally likely the first by code point is
predicted; without any labelled row all is `und`; repeated rows count as often as they occur; rows with null id are not held
out; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import in_slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE = 300
MOST_LANGUAGES = 500
ROUNDS = 4
LONGEST = 32
SPACE = "▁"
#: Probability of a character that is no piece, and what is added to each count.
UNKNOWN, PRIOR = 1e-7, 0.1
LENGTHS = (4, 8, 12, 18, LONGEST)
TIMES = np.uint64(0x100000001B3)
UND = "und"


def pieces_of(vocabulary: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model, in lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    n = model.get_piece_size()
    return sorted({model.id_to_piece(i).lower() for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))} - {SPACE})


def code_points(words: list[str], width: int) -> np.ndarray:
    """A row a word, starting with SPACE, padded with 0."""
    return np.array([SPACE + w for w in words], f"U{width + 1}").view(np.uint32).reshape(len(words), width + 1)


def hashed(piece: str) -> int:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for c in piece:
            h = (h ^ np.uint64(ord(c))) * TIMES
            h ^= h >> np.uint64(32)
    return int(h)


class Pieces:
    """Pieces by hash: index(h) gives the number of each, or -1."""

    def __init__(self, pieces: list[str]):
        pairs = sorted((hashed(p), p) for p in pieces)
        self.names = [p for _, p in pairs]
        self.keys = np.array([h for h, _ in pairs], np.uint64)
        self.longest = max(map(len, pieces), default=1)
        self.lengths = {len(p) for p in pieces}
        self.bits = np.zeros(1 << 18, np.bool_)
        self.bits[(self.keys & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def index(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.bits[(h & np.uint64((1 << 18) - 1)).astype(np.int64)])
        if len(maybe) and len(self.keys):
            k = np.searchsorted(self.keys, h[maybe])
            k[k == len(self.keys)] = 0
            good = self.keys[k] == h[maybe]
            out[maybe[good]] = k[good]
        return out

    def edges(self, codes: np.ndarray):
        """(start, end, rows, pieces): where pieces lie in the words; rows that have none aren't listed."""
        for i in range(codes.shape[1]):
            h = np.zeros(len(codes), np.uint64)
            rows = np.flatnonzero(codes[:, i])
            h = h[rows]
            for j in range(i + 1, min(i + self.longest, codes.shape[1]) + 1):
                c = codes[rows, j - 1]
                if not c.all():
                    rows, h, c = rows[c > 0], h[c > 0], c[c > 0]
                if not len(rows):
                    break
                h = (h ^ c) * TIMES
                h ^= h >> np.uint64(32)
                k = self.index(h)
                hit = k >= 0
                yield i, j, rows[hit], k[hit]


def forward(codes: np.ndarray, table: Pieces, p: np.ndarray) -> np.ndarray:
    """alpha[end, word, language]; p: probability by piece and language."""
    alpha = np.zeros((codes.shape[1] + 1, len(codes), p.shape[1]))
    alpha[0] = 1.0
    at = -1
    for i, j, rows, k in table.edges(codes):
        if i != at:
            at = i
            alpha[i + 1] += alpha[i] * UNKNOWN
        alpha[j][rows] += alpha[i][rows] * p[k]
    return alpha


def pieces_in(word: str, table: Pieces) -> np.ndarray:
    """Of one word, with SPACE before it: the number of the piece of each length from each place on, or -1."""
    codes = code_points([word], len(word))[0].astype(np.uint64)
    out = np.full((len(codes), table.longest), -1, np.int64)
    h = np.zeros(len(codes), np.uint64)
    for n in range(min(table.longest, len(codes))):
        h = (h[: len(codes) - n] ^ codes[n:]) * TIMES
        h ^= h >> np.uint64(32)
        out[: len(h), n] = table.index(h)
    return out


def rescaled(found: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward sums of one word: alpha[end, language], each row less its own scale, and the logs of the scales."""
    n, longest = found.shape
    alpha, scale = np.zeros((n + 1, p.shape[1])), np.zeros((n + 1, p.shape[1]))
    alpha[0] = 1.0
    near = np.zeros((longest, p.shape[1]))  # the last rows of alpha, latest first, all on the latest scale
    near[0] = 1.0
    for end in range(1, n + 1):
        m = min(longest, end)
        k = found[np.arange(end - 1, end - 1 - m, -1), np.arange(m)]
        value = near[0] * UNKNOWN
        if (k >= 0).any():
            value = value + (near[:m] * np.where(k[:, None] >= 0, p[k], 0.0)).sum(axis=0)
        near[1:] = near[:-1]
        near[0] = value
        near /= value
        alpha[end], scale[end] = 1.0, scale[end - 1] + np.log(value)
    return alpha, scale


def long_counts(word: str, table: Pieces, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces in n (by language) of a long word, over all its segmentations."""
    found = pieces_in(word, table)
    _, ahead = rescaled(found, p)
    # The same sums from the right: a piece that ends at a place starts at its mirror.
    size, longest = found.shape
    turned = np.full_like(found, -1)
    for length in range(1, min(longest, size) + 1):
        turned[: size - length + 1, length - 1] = found[: size - length + 1, length - 1][::-1]
    _, behind = rescaled(turned, p)
    got = np.zeros_like(p)
    for length in range(1, min(longest, size) + 1):
        start = np.flatnonzero(found[: size - length + 1, length - 1] >= 0)
        k = found[start, length - 1]
        part = np.exp(ahead[start] + np.log(p[k]) + behind[size - start - length] - ahead[size])
        np.add.at(got, k, n * part)
    return got


def log_chances(words: list[str], table: Pieces, p: np.ndarray) -> np.ndarray:
    """Log of the probability of each word in each language."""
    out = np.zeros((len(words), p.shape[1]))
    length = np.fromiter(map(len, words), np.int64, len(words))
    for i in np.flatnonzero(length > LONGEST):
        out[i] = rescaled(pieces_in(words[i], table), p)[1][-1]
    low = 0
    for high in LENGTHS:
        at = np.flatnonzero((length > low) & (length <= high))
        low = high
        for part in np.array_split(at, max(1, len(at) // 20_000)) if len(at) else ():
            alpha = forward(code_points([words[i] for i in part], high), table, p)
            out[part] = np.log(np.maximum(alpha[length[part] + 1, np.arange(len(part))], 1e-300))
    return out


def learn(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> tuple[Pieces, np.ndarray, list[str]]:
    """Piece probabilities by language, from word counts by language. Pieces in no word are left out."""
    langs = sorted(counts)
    words = sorted(set(chain.from_iterable(counts.values())))
    longer = [w for w in words if len(w) > LONGEST]
    full, used = Pieces(pieces), np.zeros(len(pieces), np.bool_)
    groups = []
    low = 0
    for high in LENGTHS:
        some = [w for w in words if low < len(w) <= high]
        low = high
        for k in range(0, len(some), 20_000):
            groups.append((part := some[k : k + 20_000], code_points(part, high)))
    for _, codes in groups:
        for *_, k in full.edges(codes):
            used[k] = True
    for w in longer:
        k = pieces_in(w, full)
        used[k[k >= 0]] = True
    table = Pieces([full.names[k] for k in np.flatnonzero(used)])
    weight = [np.array([[counts[x].get(w, 0) for x in langs] for w in part], float).reshape(len(part), len(langs)) for part, _ in groups]
    p = np.full((max(len(table.names), 1), len(langs)), 1.0 / max(len(table.names), 1))
    for _ in range(rounds):
        got = np.full_like(p, PRIOR)
        for (part, codes), n in zip(groups, weight, strict=True):
            alpha = forward(codes, table, p)
            end = np.fromiter(map(len, part), np.int64, len(part)) + 1
            beta = np.zeros_like(alpha)
            beta[end, np.arange(len(part))] = n / np.maximum(alpha[end, np.arange(len(part))], 1e-300)
            seen, at = list(table.edges(codes)), codes.shape[1]
            for i, j, rows, k in sorted(seen, key=lambda e: -e[0]):
                while at > i:  # all edges that start at or after `at` are done
                    at -= 1
                    beta[at] += beta[at + 1] * UNKNOWN
                flow = p[k] * beta[j][rows]
                beta[i][rows] += flow
                np.add.at(got, k, flow * alpha[i][rows])
        for w in longer if table.names else ():
            got += long_counts(w, table, p, np.array([counts[x].get(w, 0) for x in langs], float))
        p = got / got.sum(axis=0)
    return table, p, langs


def words_in(text: str | None) -> list[bytes]:
    """Words in lower case, in UTF-8."""
    return (text or "").lower().encode().split()


def scores(texts: list[str | None], table: Pieces, p: np.ndarray) -> np.ndarray:
    """Log of each text's probability in each language."""
    import pandas as pd

    split = [words_in(t) for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    out = np.zeros((len(texts), p.shape[1]))
    if sizes.sum():
        code, distinct = pd.factorize(np.fromiter(chain.from_iterable(split), object, int(sizes.sum())))
        each = log_chances([w.decode() for w in distinct], table, p)[code]
        full = np.flatnonzero(sizes)
        out[full] = np.add.reduceat(each, np.concatenate(([0], np.cumsum(sizes[full])[:-1])))
    return out


def _predictor(table: Pieces, p: np.ndarray, langs: list[str], id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("lang_pred", pa.string()), ("score", pa.float64())])

    def predict(batches):
        for batch in batches:
            for start, texts in in_slices(batch, 1_500_000, 1):
                s = scores(texts, table, p)
                best = s.argmax(axis=1) if langs else np.zeros(len(texts), np.int64)
                posterior = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1) if langs else np.zeros(len(texts))
                known = [bool(langs and t) and any(map(str.isalpha, t)) for t in texts]
                pred = [langs[b] if k else UND for b, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(pred, pa.string()), pa.array(np.where(known, posterior, 0.0))], schema=schema)

    return predict


def _counter(batches):
    """Of labelled texts (lang, text): how often each word stands in them."""
    for batch in batches:
        held: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.update((lang, w) for w in words_in(text))
        lang, word = zip(*held, strict=True) if held else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array([w.decode() for w in word], pa.string()), pa.array(list(held.values()), pa.int64())], names=["lang", "word", "n"])


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id: str, text: str, lang: str, vocabulary: str = VOCABULARY, sample: int = SAMPLE) -> tuple[Pieces, np.ndarray, list[str]]:
    """Learns from about `sample` rows of each language that aren't held out."""
    rows = docs.filter(~held_out(F.col(f"`{id}`"))).select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).filter("text is not null and lang is not null")
    n = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(n) > MOST_LANGUAGES:
        raise ValueError(f"{len(n)} labels are more than {MOST_LANGUAGES}")
    if not n:
        return Pieces([]), np.zeros((1, 0)), []
    part = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, sample / v))) for k, v in n.items()))
    drawn = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(1_000_000)) / 1e6
    chosen = rows.filter(drawn < F.element_at(part, F.col("lang")))
    words = chosen.select("lang", "text").mapInArrow(_counter, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {k: {} for k in n}
    for r in words.toLocalIterator():
        counts[r.lang][r.word] = r.n
    return learn(counts, pieces_of(vocabulary))


def predict_languages(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", vocabulary: str = VOCABULARY, sample: int = SAMPLE) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row."""
    table, p, langs = train(docs, id, text, lang, vocabulary, sample)
    kind = docs.schema[id].dataType
    own = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    got = own.mapInArrow(_predictor(table, p, langs, to_arrow_type(kind)), f"id {kind.simpleString()}, lang_pred string, score double")
    return got.select(F.col("id").alias(id), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
