"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit per
rule. Policies are versioned bit masks applied to stored ledgers, and ablations (what a rule rejects
alone, or together with others) are sums over the distinct bit patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import BLANKS, WORD, let, words

SYMBOLS = "#*$%&|<>"  # fixed values


@dataclass(frozen=True)
class Rule:
    """A failure condition over the measurement columns; its place in the list is its bit."""

    name: str
    fails: str
    base: bool = False


# The order is the bit order: append only, never reorder, or stored ledgers lose their meaning.
RULES = (
    Rule("too_short", "n_words < 50", base=True),
    Rule("repetitive", "100 * n_repeat_words > 50 * n_words", base=True),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("dup_lines", "2 * n_dup_lines > n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("shouting", "2 * n_upper > n_upper + n_lower"),
)

# Versioned policies: the rules that reject a document.
POLICIES = {
    "v1": ("too_short", "repetitive"),
    "v2": ("too_short", "repetitive", "symbols", "dup_lines", "short_words", "long_words", "shouting"),
}
CURRENT = "v2"

FEW_WINDOWS = 1 << 24  # below this, positions take 24 bits of a key and leave 40 to the hash


def mask_of(policy: str) -> int:
    names = [r.name for r in RULES]
    return sum(1 << names.index(name) for name in POLICIES[policy])


def base_mask() -> int:
    return sum(1 << i for i, r in enumerate(RULES) if r.base)


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the word list ``w``.

    Windows get a hash; only where two hashes agree are the windows themselves compared, so the count
    is exact. Sorting keeps the cost at n log n for texts of any length.
    """
    last = F.size(w) - 3
    gram = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def candidates(h: Column) -> Column:
        """Positions of windows whose hash is not alone; the hashes are sorted beside them, in one array of longs."""
        bits = F.lit(32) - F.when(F.size(h) < FEW_WINDOWS, F.lit(8)).otherwise(F.lit(0))  # room for every position an array can have
        return let(bits, lambda n: _beside(h, n))

    def _beside(h: Column, n: Column) -> Column:
        one = F.lit(1).cast("bigint")
        low = F.call_function("shiftleft", one, n) - one
        keyed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("bigint"))))
        top = lambda k: k.bitwiseAND(F.bitwise_not(low))
        same = lambda a, b: F.coalesce(top(a) == top(b), F.lit(False))
        found = let(keyed, lambda s: F.filter(s, lambda k, i: same(k, F.get(s, i + 1)) | same(k, F.get(s, i - 1))))
        return F.transform(found, lambda k: k.bitwiseAND(low).cast("int"))

    def repeated(c: Column) -> Column:
        places = F.sort_array(F.transform(c, lambda i: F.struct(gram(i).alias("g"), i.alias("i"))))
        same = lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False))
        kept = let(places, lambda p: F.filter(p, lambda x, i: same(x, F.get(p, i + 1)) | same(x, F.get(p, i - 1))))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
        step = lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"]).cast("bigint")).alias("n"), i.alias("last"))
        return F.aggregate(at, start, step, lambda s: s["n"])

    none = F.lit(0).cast("bigint")
    count = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(repeated(candidates(h)))))
    return F.when(last < 1, none).otherwise(count)


def measurements(text: Column) -> list[Column]:
    """Measurement columns of a whole text; a NULL text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    without = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    counts = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup")))
    by_word = let(words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeat_words(w).alias("rep")))
    return [
        by_word.alias("_w"), counts.alias("_l"),
        (F.length(t) - without(BLANKS)).cast("bigint").alias("word_chars"),
        without(SYMBOLS).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("bigint").alias("n_upper"),
        F.length(F.regexp_replace(t, r"[^\p{Ll}]+", "")).cast("bigint").alias("n_lower"),
    ]


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measurement columns and ``fail_bits``; one pass over the texts, no shuffle.

    NULL and empty texts have zero counts and fail ``too_short``; columns of ``docs`` named like a
    measurement are replaced. Repeated rows are judged alike, an empty table gives an empty ledger.
    """
    made = ["n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "fail_bits"]
    rest = [c for c in docs.columns if c not in made]
    out = docs.select(F.struct(*rest).alias("doc"), *measurements(F.col(text)))
    out = out.select(
        "doc.*", F.col("_w.n").alias("n_words"), F.col("_l.n").alias("n_lines"), "word_chars", "n_symbols",
        F.col("_l.dup").alias("n_dup_lines"), F.col("_w.rep").alias("n_repeat_words"), "n_upper", "n_lower",
    )
    bits = F.lit(0).cast("bigint")
    for i, rule in enumerate(rules):
        bits = bits + F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
    return out.withColumn("fail_bits", bits)


def passes(policy: str = CURRENT, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask_of(policy))) == 0


def ablations(book: DataFrame, policy: str = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of ``policy``: documents it fails, and documents only it rejects.

    The ledger is reduced to its distinct bit patterns (at most two to the number of rules) first.
    """
    mask = mask_of(policy)
    patterns = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("bigint").alias("bit")) for i, r in enumerate(rules) if mask >> i & 1]))
    hit = patterns.select("fail_bits", "n", rule.alias("r")).select("fail_bits", "n", "r.*")
    alone = F.col("fail_bits").bitwiseAND(F.lit(mask)) == F.col("bit")
    return hit.groupBy("rule", "bit").agg(
        F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_fails"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_alone"),
        F.sum("n").alias("n_docs"), F.bit_or("fail_bits").alias("seen_bits"),
    )
