"""Secret scans with an incremental ledger of blobs.

Every version of every file is content-addressed; the ledger has a row for each pair of blob and
rule version that was scanned, with what was found. A scan looks only at pairs the ledger lacks,
appends them, and joins the findings back to all paths, old and new.

At scale: texts are shuffled once, by digest, with copies merged before the shuffle, so a blob with
a third of all paths is scanned once and sent once per task. The join back carries digests and findings
only, and Spark can split it where one blob has very many paths. Scans stream through Arrow batches.

Defined cases: null text is the empty blob; blobs of any length are scanned whole, in time linear in their length; repeated
rows, and rows with null id, each get the blob's findings; spans with one start are listed in the order of the kinds; an empty
table gives an empty result and leaves the ledger as it is; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
#: Three parts of at least ten letters, digits, - and _, the first from a word's start on with eyJ; looked for at the start of each maximal run.
HEAD = re.compile(r"\beyJ(?=[A-Za-z0-9_-]{10})")
TOKENS = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]{10,}+)\.([A-Za-z0-9_-]{10,}+))")


class Jwt:
    """Web tokens, leftmost and not overlapping, each run of characters looked at a fixed number of times."""

    pattern, flags = TOKENS.pattern + HEAD.pattern, 0

    @staticmethod
    def spans(text: str):
        last = 0
        for m in TOKENS.finditer(text) if "eyJ" in text else ():
            if m.start(1) >= last and (head := HEAD.search(text, m.start(1), m.end(1))):
                last = m.end(3)
                yield head.start(), last


#: Kinds in the order in which equal starts are listed; pattern, group that counts, its least length. The first three are the base, the rest are the method's own.
RULES = (
    ("assign", ASSIGN, 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),  # finds the same as runs of any length with the short ones dropped
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), 0, 1),
    ("jwt", Jwt, 0, 1),
)
BASE = 3
LEDGER = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def version_of(rules=RULES) -> str:
    return hashlib.sha256(repr([(k, p.pattern, p.flags, g, n) for k, p, g, n in rules]).encode()).hexdigest()[:16]


def find(text: str, rules=RULES) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all spans, sorted."""
    out = []
    for k, (_, pattern, group, least) in enumerate(rules):
        if hasattr(pattern, "spans"):
            out += [(a, k, b) for a, b in pattern.spans(text)]
        else:
            out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(out)


def joined(spans, rules=RULES) -> str:
    return ",".join(f"{rules[k][0]}:{a}:{b}" for a, k, b in spans)


def _scanner(version: str, rules):
    schema = pa.schema([("blob", pa.string()), ("rule_version", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def scan(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                spans = find(batch.column(1)[i].as_py(), rules)
                base = [s for s in spans if s[1] < BASE]
                n = [sum(s[1] == k for s in base) for k in range(BASE)]
                rows.append((version, *n, hashlib.sha256(joined(base, rules).encode()).hexdigest(), joined(spans, rules)))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return scan


def read_ledger(spark: SparkSession, folder: str, version: str) -> DataFrame | None:
    """A row a blob: scans that ran at a time may have listed one twice, with the same findings."""
    try:
        return spark.read.schema(LEDGER).parquet(folder).filter(F.col("rule_version") == version).dropDuplicates(["blob"])
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def scan_versions(versions: DataFrame, ledger: str, path: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """(path, blob, n_assign, n_access, n_hex, base_sha256, spans) of every row of versions.

    ledger: a folder, in storage that all executors share, to which this scan's new rows are appended.
    """
    spark, version = versions.sparkSession, version_of(rules)
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    digest = F.sha2(content.cast("binary"), 256)
    blobs = versions.select(digest.alias("blob"), content.alias("content")).groupBy("blob").agg(F.first("content").alias("content"))
    if (seen := read_ledger(spark, ledger, version)) is not None:
        blobs = blobs.join(seen.select("blob"), "blob", "left_anti")
    blobs.mapInArrow(_scanner(version, rules), LEDGER).write.mode("append").parquet(ledger)
    found = read_ledger(spark, ledger, version).drop("rule_version")
    return versions.select(F.col(f"`{path}`").alias("_path"), digest.alias("blob")).join(found, "blob", "left").select(F.col("_path").alias(path), "blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def scan_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A first scan, with a ledger of its own in the shared folder."""
    return scan_versions(docs, fresh_path(spark, "ledger")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


#: The patterns for SQL, with the group whose length counts.
IN_SQL = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"(AKIA[A-Z0-9]+)",
    "hex": r"([0-9a-f]+)",
    "pem": r"(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----)",
    "jwt": r"(\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})",
}


def _sql() -> str:
    """The same rows in SQL: a span starts after all that stands before it, in matches and between them."""
    length = lambda of: f"coalesce(list_sum(list_transform({of}, lambda x: len(x))), 0)"
    spans = []
    for k, (name, pattern) in enumerate(IN_SQL.items()):
        p = pattern.replace("'", "''")
        whole = p.replace("(", "(?:").replace("(?:?", "(?")  # a split at a pattern with groups would return these too
        spans.append(
            f"SELECT row, {k} AS k, '{name}' AS kind, CAST({length('gaps[: i]')} + {length('whole[: i - 1]')} AS BIGINT) AS a, len(whole[i]) AS n FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM ("
            f"SELECT row, regexp_extract_all(t, '{p}', 0) AS whole, regexp_extract_all(t, '{p}', 1) AS part, regexp_split_to_array(t, '{whole}') AS gaps FROM d)) WHERE len(part[i]) >= {RULES[k][3]}"
        )
    listed = lambda which: f"coalesce(string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k){which}, '')"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(spans)})
SELECT any_value(d.doc_id) AS doc_id, {", ".join(f"count(*) FILTER (kind = '{n}') AS n_{n}" for n in ("assign", "access", "hex"))}, sha256({listed(f" FILTER (k < {BASE})")}) AS base_sha256, {listed("")} AS spans
FROM d LEFT JOIN s ON s.row = d.row GROUP BY d.row
"""


SQL = _sql()
