"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and
one bit per failed rule; policies are versioned masks that are applied to the bits
later, and ablations are bitwise aggregations over the same ledger. Texts are read
once, in SQL functions, and no shuffle is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import BLANK, WORD


@dataclass(frozen=True)
class Rule:
    """A failed rule sets its bit; ``failed`` is SQL over the measurements."""

    bit: int
    name: str
    failed: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule(5, "shouting", "100 * n_capitals > 40 * word_chars"),
    Rule(6, "exclaiming", "100 * n_exclamations > 25 * n_words"),
)

#: Versions of the policy; a document is kept if none of the policy's rules failed.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "2024-1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "2024-2": tuple(r.name for r in RULES),
}


def mask(policy: str) -> int:
    """Bits of a policy's rules."""
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[n] for n in POLICIES[policy])


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))).cast("long")


def _repeated(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more.

    Windows are hashed and sorted with their places; neighbours with one hash are
    repeats. The places they cover are then counted in order.
    """
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1),
                                      F.get(words, i + 2)).alias("h"), i.alias("i")))

    def places(s: Column) -> Column:
        def twice(x: Column, j: Column) -> Column:
            return (F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                    | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))

        return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))

    covered = F.aggregate(
        _let(F.sort_array(windows), places),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, i: F.struct((i + 3).alias("end"),
                                (acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n")),
        lambda acc: acc["n"].cast("long"))
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(covered)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements. A null text counts as empty: all measurements are 0."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, BLANK), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda s: s.rlike(WORD))
    cut = docs.withColumns({"_words": words, "_lines": lines})
    return cut.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.regexp_replace(t, BLANK, "")).cast("long"),
        "n_symbols": _count(t, "#*$%&|<>"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _repeated(F.col("_words")),
        "n_capitals": _count(t, "A-Z"),
        "n_exclamations": _count(t, "!"),
    }).drop("_words", "_lines")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``failed_rules``, the bits of all rules that failed."""
    bits = None
    for r in RULES:
        bit = F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(docs, text).withColumn("failed_rules", bits)


def kept(policy: str, failed: str = "failed_rules") -> Column:
    """True where a document passes the policy."""
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) == 0


def ablate(led: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents that fail it, documents that fail only
    it (which come back without the rule), and documents kept without it.

    One aggregation over the bits; no text is read again and no rule evaluated.
    """
    names = {r.name: 1 << r.bit for r in RULES}
    m = mask(policy)
    bits = F.col("failed_rules").bitwiseAND(F.lit(m))
    sums = [F.count(F.lit(1)).alias("documents")]
    for n in POLICIES[policy]:
        b, rest = names[n], m & ~names[n]
        sums += [F.sum(F.when(bits.bitwiseAND(F.lit(b)) != 0, 1).otherwise(0)).alias(f"f_{n}"),
                 F.sum(F.when(bits == b, 1).otherwise(0)).alias(f"o_{n}"),
                 F.sum(F.when(bits.bitwiseAND(F.lit(rest)) == 0, 1).otherwise(0)).alias(f"k_{n}")]
    total = led.agg(*sums)
    rows = F.array(*[F.struct(F.lit(n).alias("rule"),
                              F.coalesce(F.col(f"f_{n}"), F.lit(0)).alias("failed"),
                              F.coalesce(F.col(f"o_{n}"), F.lit(0)).alias("failed_alone"),
                              F.coalesce(F.col(f"k_{n}"), F.lit(0)).alias("kept_without"))
                     for n in POLICIES[policy]])
    return total.select("documents", F.explode(rows).alias("r")).select("documents", "r.*")
