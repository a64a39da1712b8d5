"""Quality rules by weak supervision, in DataFrame operations only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. How the rules vote together
over the whole corpus tells how accurate each is: expectation-maximisation fits, for good and for
bad documents, the chance of each vote of each rule, and a document's posterior probability of
being good replaces "all rules must pass".

At scale: features are one pass without a shuffle. The fit needs only how often each combination
of votes occurs, at most 3 ** rules rows however large the corpus, so that table alone reaches the
driver. The verdict is then an expression over a document's own votes.

Defined cases: a null or empty text has no words and fails the base rules; texts of any length are
judged whole; repeated rows, and rows with null id, are judged alike and all stay; a posterior of exactly the threshold passes;
an empty table gives an empty result. Columns whose names clash with the ones used here are left alone.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, let, words_of, written

WINDOW = 8
#: Rules: name, bad if, good if; neither (or both unknown) abstains. Names of features are bound to columns of the feature struct.
RULES = (
    ("length", "n_words < 20", "n_words >= 50"),
    ("mean_word", "word_chars < 3 * n_words or 10 * word_chars > 85 * n_words", "word_chars >= 4 * n_words and word_chars <= 7 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "n_symbols = 0"),
    ("dup_lines", "10 * n_dup_lines > 3 * n_lines", "10 * n_dup_lines <= n_lines"),
    ("repeats", "10 * n_repeat_words > 3 * n_words", "20 * n_repeat_words <= n_words"),
    ("capitals", "10 * n_upper > 3 * word_chars", "10 * n_upper <= word_chars"),
    ("punctuation", "5 * n_punct > 4 * n_words", "100 * n_punct >= 3 * n_words and 2 * n_punct <= n_words"),
    ("line_ends", "n_ended_lines = 0", "2 * n_ended_lines >= n_lines and n_lines > 0"),
)


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of `width` words that occur twice or more in the text.

    Windows are compared by 64-bit hash. A text without an equal pair, the usual case, costs one
    pass; else windows are sorted and the words under the equal ones counted from left to right.
    """

    def covered(hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def equal(s: Column) -> Column:
            def beside(e: Column, k: Column) -> Column:
                return F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))

            return F.array_sort(F.transform(F.filter(s, beside), lambda e: e["i"]))

        def add(state: Column, i: Column) -> Column:
            return F.struct((state["n"] + F.least(F.lit(width), i - state["last"])).alias("n"), i.alias("last"))

        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        counted = let(order, lambda s: F.aggregate(equal(s), start, add, lambda state: state["n"]))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(counted)

    def of(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - width)
        hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        return F.when(F.size(h) < width, F.lit(0)).otherwise(let(hashes, covered))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)  # each word is hashed once


def left(text: Column, others: str) -> Column:
    """Characters that `others` leaves. regexp_count, to count them, would hold each as a string of its own."""
    return F.length(F.regexp_replace(text, others, ""))


def features(text: Column) -> Column:
    """All that the rules look at, as one struct of longs."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    others = {"n_symbols": r"[^#*$%&|<>]+", "n_upper": r"[^A-Z]+", "n_punct": r"[^.,;:!?]+"}
    parts = {"word_chars": F.length(text) - left(text, WORD)} | {k: left(text, v) for k, v in others.items()}
    parts["n_ended_lines"] = F.regexp_count(text, F.lit(r"[.!?][\x20\x09\x0B-\x0D]*(\n|\z)"))
    longs = [v.cast("long").alias(k) for k, v in parts.items()]
    worded = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).cast("long").alias("again")))
    lined = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return let(F.struct(*longs, worded.alias("words"), lined.alias("lines")), lambda x: x)  # else each later use of a feature would compute it again


def paths(struct: str) -> dict[str, str]:
    """Feature name to its place in the struct that features() made."""
    plain = ("word_chars", "n_symbols", "n_upper", "n_punct", "n_ended_lines")
    return {k: f"{struct}.{k}" for k in plain} | {"n_words": f"{struct}.words.n", "n_repeat_words": f"{struct}.words.again", "n_lines": f"{struct}.lines.n", "n_dup_lines": f"{struct}.lines.dup"}


def vote_pattern(rules=RULES) -> Column:
    """Votes as a number in base 3, digit j of rule j: 0 bad, 1 abstains, 2 good."""
    total = F.lit(0)
    for j, (_, bad, good) in enumerate(rules):
        total += F.when(F.expr(bad), 0).when(F.expr(good), 2).otherwise(1) * 3**j
    return total.cast("int")


def digits(pattern: int, n: int) -> list[int]:
    return [pattern // 3**j % 3 for j in range(n)]


#: A rule may vote bad on this share of good documents at most. Junk comes in kinds that few rules see each; without the bound the fit takes one kind for "bad" and calls the other rules wrong.
FALSE_ALARMS = 0.004


def fit(counts: dict[int, int], n_rules: int, rounds: int = 60, tol: float = 1e-7, false_alarms: float = FALSE_ALARMS) -> tuple[float, list[list[list[float]]]]:
    """Prior of good, and chance[j][good][vote], from how often each combination of votes occurs.

    Starts with rules that rarely vote bad on good documents, and see a third of the bad ones.
    """
    total = sum(counts.values())
    prior, chance = 0.85, [[[0.3, 0.2, 0.5], [false_alarms / 2, 0.1, 0.9 - false_alarms / 2]] for _ in range(n_rules)]
    if not total:
        return prior, chance
    votes = {p: digits(p, n_rules) for p in counts}
    last = -math.inf
    for _ in range(rounds):
        good_mass, seen, like = 0.0, [[[0.5] * 3 for _ in range(2)] for _ in range(n_rules)], 0.0
        for p, n in counts.items():
            a, b = log_odds_parts(votes[p], prior, chance)
            top = max(a, b)
            z = top + math.log(math.exp(a - top) + math.exp(b - top))
            like += n * z
            g = math.exp(a - z)
            good_mass += n * g
            for j, v in enumerate(votes[p]):
                seen[j][1][v] += n * g
                seen[j][0][v] += n * (1 - g)
        prior = min(max((good_mass + 1) / (total + 2), 0.01), 0.99)
        chance = [[[x / sum(row) for x in row] for row in rule] for rule in seen]
        chance = [[rule[0], bounded(rule[1], false_alarms)] for rule in chance]
        if like - last < tol * abs(like):
            break
        last = like
    return prior, chance


def bounded(row: list[float], most: float) -> list[float]:
    """The chances of the votes of a rule on good documents, with that of bad held to `most`."""
    bad, rest = min(row[0], most), row[1] + row[2]
    return [bad, *(x * (1 - bad) / rest for x in row[1:])]


def log_odds_parts(votes: list[int], prior: float, chance) -> tuple[float, float]:
    a, b = math.log(prior), math.log(1 - prior)
    for rule, v in zip(chance, votes, strict=True):
        a += math.log(rule[1][v])
        b += math.log(rule[0][v])
    return a, b


def posterior(pattern: Column, prior: float, chance) -> Column:
    """Chance of good, from the votes in `pattern`."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for j, rule in enumerate(chance):
        vote = F.pmod(F.floor(pattern / F.lit(3**j)), F.lit(3))
        weight = [math.log(rule[1][v] / rule[0][v]) for v in range(3)]
        odds += F.when(vote == 0, weight[0]).when(vote == 1, weight[1]).otherwise(weight[2])
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, text: str = "text", carry: list[str] | None = None, threshold: float = 0.5, rules=RULES) -> tuple[DataFrame, str]:
    """The columns `carry` (all, if None) and a struct of features, votes and verdict; and its name."""
    name, votes = fresh(docs, "quality", "votes")
    carry = docs.columns if carry is None else carry
    seen = docs.select(*[F.col(f"`{c}`") for c in carry], features(F.col(f"`{text}`")).alias(name))
    at = paths(name)
    named = {k: F.col(v) for k, v in at.items()}
    base = (named["n_words"] < 20) | (100 * named["n_repeat_words"] > 30 * named["n_words"])
    bound = [(k, in_terms_of(bad, at), in_terms_of(good, at)) for k, bad, good in rules]
    pattern = vote_pattern(bound)
    stored = written(seen.select(*[F.col(f"`{c}`") for c in carry], F.struct(*[v.alias(k) for k, v in named.items()], base.alias("base_failed"), pattern.alias(votes)).alias(name)), "quality")
    counts = {r[0]: r[1] for r in stored.groupBy(F.col(f"{name}.{votes}")).count().collect()}  # at most 3 ** rules rows
    good = posterior(F.col(f"{name}.{votes}"), *fit(counts, len(rules)))
    struct = F.struct(*[F.col(f"{name}.{k}").alias(k) for k in (*named, "base_failed")], good.alias("posterior"))
    out = stored.withColumn(name, struct)
    return out.withColumn(name, F.struct(F.col(f"{name}.*"), (~F.col(f"{name}.base_failed") & (F.col(f"{name}.posterior") >= threshold)).alias("kept"))), name


def in_terms_of(rule: str, at: dict[str, str]) -> str:
    """The rule, with feature names written as their places in the struct."""
    return re.sub(r"[a-z_]+", lambda m: at.get(m[0], m[0]), rule)


def quality_filter(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Documents that pass, with their own columns."""
    judged, name = judge(docs, text, None, threshold)
    return judged.filter(f"{name}.kept").drop(name)
