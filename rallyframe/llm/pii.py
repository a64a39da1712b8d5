"""Personal data by patterns, and the terms that would give it away.

Patterns find protected entities: mail addresses, IP addresses, card and phone numbers. Terms that stand with an
entity may reveal it even when it is masked. The corpus tells how strongly: the pointwise mutual information of term
and entity over whole documents, against the information content of the entity itself. Judged are terms that stand
within `NEAR` words of the entity in at least `support` different surroundings; one whose share of the information reaches
`disclosure` is generalised, or removed if it gives away nearly all, wherever it stands in a document that holds the entity.

Words are runs of anything but ASCII white space, terms are words in lower case without punctuation at their ends, of any
length; the same function cuts them in all passes. Terms and entities are held as 64-bit hashes.

At scale: one pass finds spans and surroundings, without a shuffle of texts; pairs of entity and term
are counted with map-side sums. How many documents hold a term is counted over the whole corpus, for
terms that passed the support only: they are sent to every task if few, else counted in all and joined. Pairs that no
count of common documents could make disclosing are dropped before these are counted. Texts are read again only where a
disclosing term stands.

Defined cases: null and empty texts have no spans; texts of any length are searched whole, in time
linear in their length; repeated rows, and rows with null id, are all judged and counted, but equal surroundings support a
pair once; an entity in every document has no information to give away; a span that overlaps one before it is masked with it;
spans with one start are listed in the order of the kinds; empty tables give empty results; other columns are not read,
whatever their names, and pass through the masking.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import fresh, in_slices, written

KINDS = ("email", "ip", "card", "phone", "term")
TERM = 4
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = ".,;:!?()[]{}\"'"
#: Words on either side of an entity whose terms are judged.
NEAR = 8
SUPPORT, DISCLOSURE, NEARLY_ALL = 3, 0.8, 0.95
#: Terms sent to every task at most, 8 bytes each; and those of one task that are counted before they are passed on.
BROADCAST_TERMS, HELD_TERMS = 100_000, 200_000
SPANS = "array<struct<start:int,kind:int,end:int>>"
NEARBY = "array<struct<entity:long,context:long,term:long>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches of local@domain, found from each @ outwards, so a long run of letters costs no more than its length."""
    last, at = 0, text.find("@")
    while at >= 0:
        if at >= last and (m := DOMAIN.match(text, at + 1)):
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                last = m.end()
                yield start, last
        at = text.find("@", at + 1)


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := "".join(DIGITS.findall(m[0]))) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(DIGITS.findall(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


class _Terms(dict):
    """Hash of the term of each word (in lower case) met lately; 0 of a word without one. Travels empty."""

    def __reduce__(self):
        return _Terms, ()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        term = word.strip(EDGE.encode())
        self[word] = h = (xxhash.xxh3_64_intdigest(term) or 1) - 2**63 if term else 0
        return h


_terms = _Terms()


def terms_of(text: str) -> set[int]:
    """Terms of the text."""
    found = set(map(_terms.__getitem__, set(text.lower().encode().split())))
    found.discard(0)
    return found


def located(text: str) -> list[tuple[int, int, int]]:
    """(term, start, end) of each word that has one, without the punctuation at its ends."""
    out = []
    for m in WORDS.finditer(text):
        if h := _terms[m[0].lower().encode()]:
            a = m.end() - len(m[0].lstrip(EDGE))
            out.append((h, a, a + len(m[0].strip(EDGE))))
    return out


def nearby(text: str, spans, near: int = NEAR) -> list[tuple[int, int, int]]:
    """(entity, surroundings, term) of the words near each span."""
    words = located(text)
    starts, ends = [a for _, a, _ in words], [b for *_, b in words]
    first, reach, top = [s for s, *_ in spans], [], 0
    for *_, e in spans:
        top = max(top, e)
        reach.append(top)

    def inside(a: int, b: int) -> bool:
        k = bisect_left(first, b)
        return k > 0 and reach[k - 1] > a

    out = []
    for start, kind, end in spans:
        before, after = bisect_right(ends, start), bisect_left(starts, end)
        terms = [t for t, a, b in words[max(0, before - near) : before] + words[after : after + near] if not inside(a, b)]
        entity = xxhash.xxh3_64_intdigest(f"{kind}:{text[start:end].lower()}")
        context = xxhash.xxh3_64_intdigest(repr(terms))
        out += [(entity - 2**63, context - 2**63, t) for t in terms]
    return out


def _finder(id_type: pa.DataType):
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    near_type = pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("term", pa.int64())]))
    schema = pa.schema([("id", id_type), ("key", pa.binary()), ("spans", spans_type), ("base_sha256", pa.string()), ("near", near_type), ("terms", pa.list_(pa.int64()))])

    def search(batches):
        for batch in batches:
            for start, texts in in_slices(batch, 4_000_000, 1):
                rows = []
                for text in texts:
                    spans = find(text)
                    joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
                    rows.append((hashlib.md5(text.encode()).digest(), spans, hashlib.sha256(joined.encode()).hexdigest(), nearby(text, spans) if spans else [], list(terms_of(text)) if spans else []))
                key, spans, sha, near, terms = zip(*rows, strict=True)
                spans = [[dict(zip(("start", "kind", "end"), s, strict=True)) for s in x] for x in spans]
                near = [[dict(zip(("entity", "context", "term"), s, strict=True)) for s in x] for x in near]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(key, pa.binary()), pa.array(spans, spans_type), pa.array(sha, pa.string()), pa.array(near, near_type), pa.array(terms, pa.list_(pa.int64()))], schema=schema)

    return search


def _holders(terms: frozenset | None):
    """Counts of the documents that hold each of terms, or each term at all."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def counted(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], schema=schema)

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for _, texts in in_slices(batch, 4_000_000, 0):
                for text in texts:
                    held.update(terms_of(text) if terms is None else terms & terms_of(text))
                    if len(held) > HELD_TERMS:
                        yield counted(held)
                        held = Counter()
        yield counted(held)

    return count


def documents_with(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_term): how many documents hold each of terms. docs: (id, text)."""
    few = [r.term for r in terms.limit(BROADCAST_TERMS + 1).collect()]
    known = frozenset(few) if len(few) <= BROADCAST_TERMS else None
    held = docs.select("text").mapInArrow(_holders(known), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    return held if known is not None else held.join(terms, "term", "left_semi")


def disclosing(found: DataFrame, docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, term, part): terms that reveal an entity, and what part of its information."""
    # A document counts once for each pair, and for each entity, however often they stand in it.
    near = found.select(F.explode(F.array_distinct("near")).alias("x")).select("x.*")
    pairs = near.groupBy("entity", "term").agg(F.countDistinct("context").alias("contexts")).filter(F.col("contexts") >= support).select("entity", "term")
    pairs = written(pairs, "pairs")
    if not pairs.limit(1).count():
        return pairs.withColumn("part", F.lit(0.0))
    texts = F.lit(float(found.count()))
    held = found.filter(F.size("near") > 0).select(F.explode(F.array_distinct("near.entity")).alias("entity"), "terms")
    entity = held.groupBy("entity").agg(F.count("*").alias("n_entity"))
    info = F.log(texts / F.col("n_entity"))

    def part(n_pair) -> Column:
        return F.when(info > 0, F.log(n_pair * texts / (F.col("n_entity") * F.col("n_term"))) / info).otherwise(0.0)

    n_term = documents_with(docs, pairs.select("term").distinct())
    likely = pairs.join(entity, "entity").join(n_term, "term").filter(part(F.least("n_entity", "n_term")) >= disclosure)
    likely = written(likely, "likely")
    n_pair = held.join(likely.select("entity", "term"), "entity").filter(F.array_contains("terms", F.col("term"))).groupBy("entity", "term").agg(F.count("*").alias("n_pair"))
    return likely.join(n_pair, ["entity", "term"]).withColumn("part", part(F.col("n_pair"))).filter(F.col("part") >= disclosure).select("entity", "term", "part")


def search(docs: DataFrame, id: str = "doc_id", text: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """(id, key, spans, base_sha256) of each row, and (key, terms) of the texts that hold revealing terms: (term, part) each."""
    kind = docs.schema[id].dataType
    own = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    found = written(own.mapInArrow(_finder(to_arrow_type(kind)), f"id {kind.simpleString()}, key binary, spans {SPANS}, base_sha256 string, near {NEARBY}, terms array<long>"), "pii")
    flagged = written(disclosing(found, own, support, disclosure), "disclosing")
    holding = found.filter(F.size("near") > 0).select("key", "terms", F.explode(F.array_distinct("near.entity")).alias("entity"))
    terms = holding.join(flagged, "entity").filter(F.array_contains("terms", F.col("term"))).groupBy("key", "term").agg(F.max("part").alias("part"))
    terms = terms.groupBy("key").agg(F.collect_list(F.struct("term", "part")).alias("terms"))
    return found.drop("near", "terms"), written(terms, "terms")


#: Texts with revealing terms that may be sent to every executor, and their terms: 16 bytes of key, 16 of each term.
FEW_TEXTS, FEW_TERMS = 20_000, 200_000


def with_terms(docs: DataFrame, text: str, terms: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with the key of the text and the revealing terms that the text has, else null; and the names of both columns."""
    key, name = names = fresh(docs, "text_key", "terms")
    terms = terms.select(F.col("key").alias(key), F.col("terms").alias(name))
    size = terms.agg(F.count("*").alias("n"), F.sum(F.size(name)).alias("terms")).first()
    if size.n <= FEW_TEXTS and (size.terms or 0) <= FEW_TERMS:
        terms = F.broadcast(terms)
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.withColumn(key, F.unhex(F.md5(content.cast("binary")))).join(terms, key, "left").select(*[F.col(f"`{c}`") for c in docs.columns], *names), names


def places(text: str, terms) -> list[tuple[int, int, float]]:
    """(start, end, part) where terms stand outside entities. terms: dicts of term and part."""
    part = {t["term"]: t["part"] for t in terms or ()}
    if not part:
        return []
    taken = sorted(find(text))
    starts, reach, far = [s for s, _, _ in taken], [], 0
    for _, _, e in taken:
        far = max(far, e)
        reach.append(far)

    def free(a: int, b: int) -> bool:
        """Whether none of the entities that start before b reaches beyond a."""
        before = bisect_left(starts, b)
        return not before or reach[before - 1] <= a

    return [(a, b, part[h]) for h, a, b in located(text) if h in part and free(a, b)]


def _placer():
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("key", pa.binary()), ("found", kind)])

    def run(batches):
        for batch in batches:
            rows = [[{"start": a, "kind": TERM, "end": b} for a, b, _ in places(batch.column(1)[i].as_py(), batch.column(2)[i].as_py())] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], schema=schema)

    return run


def find_personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans) of each row."""
    found, terms = search(docs, id, text)
    wide, (key, name) = with_terms(docs.select(F.col(f"`{text}`").cast("string").alias("text")), "text", terms)
    held = wide.filter(F.col(name).isNotNull()).dropDuplicates([key]).select(key, "text", name).mapInArrow(_placer(), f"key binary, found {SPANS}")
    every = F.array_sort(F.concat("spans", F.coalesce("found", F.array().cast(SPANS))))
    name_of = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    text_of = F.array_join(F.transform(every, lambda s: F.concat_ws(":", name_of(s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.join(held, "key", "left").select(F.col("id").alias(id), *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.greatest(F.size("found"), F.lit(0)).cast("long").alias("n_term"), "base_sha256", text_of.alias("spans"))


def mask(text: str, terms) -> str:
    """The text with entities replaced by their kind, and revealing terms generalised or removed."""
    cut = [(a, b, f"[{KINDS[k].upper()}]") for a, k, b in find(text)]
    for a, b, part in places(text, terms):
        word = text[a:b]
        general = "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else "[WORD]"
        cut.append((a, b, "[REMOVED]" if part >= NEARLY_ALL else general))
    out, last = [], 0
    for a, b, with_ in sorted(cut):
        if a < last:  # overlaps what is masked already: mask the rest of it too
            last = max(last, b)
            continue
        out += [text[last:a], with_]
        last = b
    return "".join([*out, text[last:]])


def _masker(column: int):
    def run(batches):
        for batch in batches:
            texts, terms = batch.column(column), batch.column(batch.num_columns - 1)
            new = [None if (t := texts[i].as_py()) is None else mask(t, terms[i].as_py()) for i in range(batch.num_rows)]
            columns = list(batch.columns[:-1])
            columns[column] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return run


def sanitise(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text masked; all other columns as they are. Null texts stay null."""
    _, terms = search(docs, id, text)
    wide, (key, _) = with_terms(docs, text, terms)
    return wide.drop(key).mapInArrow(_masker(docs.columns.index(text)), docs.schema)
