"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for a document; the ledger keeps the measurements and one failure
bit a rule.  A policy is a versioned set of rules: applying it, comparing versions or taking a
rule out is then bit arithmetic over the ledger, and no text is read again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, also below other lambdas."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of five words that occurs twice or more."""

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda s, i: F.struct(s.alias("s"), i.alias("i"))))

        def twice(p: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(p, j)["s"] == x["s"], F.lit(False))
            kept = F.filter(p, lambda x, j: same(x, j - 1) | same(x, j + 1))
            spots = F.sort_array(F.transform(kept, lambda x: x["i"]))
            return F.aggregate(
                spots,
                F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
                lambda a, i: F.struct(
                    (i + WINDOW).alias("end"),
                    (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"),
                ),
                lambda a: a["n"],
            )

        # Most texts repeat nothing: a set decides that without sorting.
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            let(pairs, twice)
        )

    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
        lambda i: F.concat_ws(" ", F.slice(words, i, WINDOW)),
    )
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows, covered))


def without(text: Column, signs: str) -> Column:
    return F.translate(text, signs, "")


def measure(text: Column) -> Column:
    """All measurements of a text as one struct; null counts as empty."""

    def of(t: Column) -> Column:
        words = F.filter(F.split(t, SPACE, -1), lambda w: w != "")
        lines = F.filter(F.split(t, "\n", -1), lambda x: without(x, SPACES) != "")

        def of_words(w: Column) -> Column:
            return F.struct(
                F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")
            )

        def of_lines(x: Column) -> Column:
            return F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            )

        return F.struct(
            let(words, of_words).alias("w"),
            let(lines, of_lines).alias("l"),
            F.length(without(t, SPACES)).cast("long").alias("word_chars"),
            (F.length(t) - F.length(without(t, SYMBOLS))).cast("long").alias("n_symbols"),
            (F.length(t) - F.length(without(t, "0123456789"))).cast("long").alias("n_digits"),
        )

    return let(F.coalesce(text, F.lit("")), of)


MEASURES = {
    "n_words": "m.w.n_words",
    "word_chars": "m.word_chars",
    "n_symbols": "m.n_symbols",
    "n_dup_lines": "m.l.n_dup_lines",
    "n_repeat_words": "m.w.n_repeat_words",
    "n_lines": "m.l.n_lines",
    "n_digits": "m.n_digits",
}

#: Rules in the order of their bits; each is a failure condition on the measurements.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbol_share": "10 * n_symbols > word_chars",
    "duplicate_lines": "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines",
    "short_words": "2 * n_words > word_chars",
    "long_words": "word_chars > 16 * n_words",
    "digit_share": "5 * n_digits > word_chars",
}
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


POLICIES = {
    "base": Policy("base", BASE),
    "v1": Policy("v1", (*BASE, "symbol_share", "duplicate_lines")),
    "v2": Policy("v2", tuple(RULES)),
}


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measurements and ``failed``, the bits of the failed rules.

    A null or empty text has zero measurements and fails ``few_words`` only.  Repeated rows keep
    their rows, a null id stays null, other columns are not read.  A text is measured whole; its
    cost grows with its length (times a logarithm where it repeats windows).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), measure(F.col(text_col)).alias("m"))
    # The struct comes out of an array, so no rule measures a text again.
    once = rows.select("doc_id", F.explode(F.array("m")).alias("m"))
    named = once.select("doc_id", *[F.col(path).alias(name) for name, path in MEASURES.items()])
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << k)).otherwise(0).cast("long"))
    return named.withColumn("failed", bits)


def verdict(policy: Policy) -> Column:
    """True where the ledger row fails no rule of the policy."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """``rule, failed, only``: documents a rule of the policy fails, and those it alone fails.

    One aggregation over the ledger; ``only`` is what taking the rule out would let in.
    """
    hit = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long"))
    sums = []
    for r in policy.rules:
        bit = 1 << list(RULES).index(r)
        sums += [
            F.count(F.when(hit.bitwiseAND(F.lit(bit).cast("long")) != 0, 1)).alias(f"{r}_failed"),
            F.count(F.when(hit == bit, 1)).alias(f"{r}_only"),
        ]
    total = rows.agg(*sums)
    each = [
        F.struct(F.lit(r).alias("rule"), F.col(f"{r}_failed").alias("failed"), F.col(f"{r}_only").alias("only"))
        for r in policy.rules
    ]
    return total.select(F.inline(F.array(*each)))


def compare(rows: DataFrame, old: Policy, new: Policy) -> DataFrame:
    """``old_kept, new_kept, n``: what moving from one version to another changes."""
    return rows.groupBy(verdict(old).alias("old_kept"), verdict(new).alias("new_kept")).agg(
        F.count("*").alias("n")
    )
