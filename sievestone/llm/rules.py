"""Quality rules as a short-circuit cascade, in DataFrame expressions alone.

Base counts (words, their code points, symbols, repeated lines, words in repeated windows) are columns of the document.
Each further rule is an expression that is true where the rule rejects. On a hashed sample of rows every rule's
selectivity (the share that it rejects) and cost are measured: the sample's rows are repeated until evaluating the rule
takes long enough to tell, and the time of a job that only carries the same columns is taken off. The rules are then
chained by falling rejection per cost in a CASE, which stops at the first that rejects. The order changes only the
time, and which of several rules that reject is named in rejected_by: a document is kept if no rule rejects it.

Edge cases: null and empty texts have no words and fail the base rule. Repeated rows and null ids are kept as they
are. An empty table (or sample) gives no rows, and the rules stand in their given order. Of the input's columns the id,
the text and those named in `carry` are read; a carried column that is called like one of the counts or of the two
inner columns (`__text`, `__words`) is refused. Very long texts are read whole, within one row.
"""

from __future__ import annotations

import re
import time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPLIT, cut

WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
SYMBOLS = "[#*$%&|<>]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that occur twice or more in the array of words, first occurrences included.

    Windows whose 64-bit hash occurs once are out; the few others are compared by their words. The places of repeated
    windows, in order, cover min(window, distance to the next) words each.
    """
    one = F.lit(1).cast("int")

    def twice(s: Column, field: str) -> Column:
        """Of structs sorted by the field, those that have a neighbour with the same value."""
        same = lambda x, j: F.when((j >= 0) & (j < F.size(s)), F.get(s, j).getField(field) == x.getField(field)).otherwise(False)
        return F.filter(s, lambda x, i: same(x, i - one) | same(x, i + one))

    def covered(w: Column, h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        candidates = let(placed, lambda s: twice(s, "h"))
        told = F.sort_array(F.transform(candidates, lambda x: F.struct(F.array_join(F.slice(w, x.getField("i") + one, window), " ").alias("t"), x.getField("i").alias("i"))))
        at = F.sort_array(F.transform(let(told, lambda s: twice(s, "t")), lambda x: x.getField("i")))
        return let(at, lambda a: F.aggregate(F.transform(a, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(a, i + one) - x, F.lit(window)))), F.lit(0).cast("bigint"), lambda acc, x: acc + x))

    def counted(w: Column) -> Column:
        # hashes of the words' hashes: slices of the words would copy the whole array for every window
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*(F.get(w, i + F.lit(k)) for k in range(window))))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(words, h)).otherwise(F.lit(0).cast("bigint")))

    some = let(F.transform(words, lambda w: F.xxhash64(w)), counted)
    return F.when(F.size(words) <= window, F.lit(0).cast("bigint")).otherwise(some)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept")


def base(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base counts and base_failed, with the text and its words still there for the rules (`__text`, `__words`)."""
    taken = {c.lower() for c in carry} & {*COUNTS, "doc_id", "__text", "__words"}
    if taken:
        raise ValueError(f"columns cannot be carried under these names: {sorted(taken)}")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *carry, text.alias("__text"), F.filter(F.split(text, WORD_SPLIT), lambda w: w != "").alias("__words"))
    lines = F.filter(F.split(F.col("__text"), "\n"), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]")))
    rows = rows.select(
        "*",
        F.size("__words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(F.col("__text"), F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


#: The rules beyond the base, as expressions over what base() gives; true rejects. Shares are of words or characters.
RULES = {
    "symbols": "n_symbols > 0.1 * n_words and n_symbols > 10",
    "word_length": "word_chars > 20 * n_words or word_chars < 2 * n_words",
    "dup_lines": "n_dup_lines >= 4 and n_dup_lines > 0.5 * size(split(__text, '\\n'))",
    "capitals": "char_length(regexp_replace(__text, '[^A-Z]', '')) > 0.5 * word_chars",
    "alphabetic": "2 * regexp_count(__text, '[\\\\p{L}]+') < n_words",
    "bangs": "char_length(__text) - char_length(replace(__text, '!', '')) > 0.5 * n_words",
    "distinct": "n_words >= 50 and size(array_distinct(__words)) < 0.1 * sqrt(50.0 / n_words) * n_words",
}


def sampled(docs: DataFrame, about: int = 300) -> DataFrame:
    """doc_id and text of about so many documents, chosen by a hash of id and place, whatever their sizes.

    One scan that only hashes; the chosen rows go to the shared folder, not to the driver. Only costs and
    selectivities are estimated on them.
    """
    step = max(1, docs.count() // about)
    return cut(docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(step)) == 0))


def measured(rows: DataFrame, rules: dict[str, str], enough: float = 0.15, most: int = 1024) -> dict[str, tuple[float, float]]:
    """For each rule the share of rows that it rejects and the seconds that it takes a row; rows: with their base counts.

    The rows are repeated 4, 16, ... up to `most` times until the rule takes `enough` seconds more than the job that
    carries its columns and tests them for null.
    """
    total = rows.count()
    if not total:
        return {k: (0.0, 0.0) for k in rules}
    share = rows.agg(*(F.avg(F.coalesce(F.expr(x), F.lit(False)).cast("double")).alias(k) for k, x in rules.items())).first()

    def seconds(value: Column, columns: list[str], times: int) -> float:
        began = time.perf_counter()
        again = rows.select(*columns, F.explode(F.sequence(F.lit(1), F.lit(times))).alias("__i"))
        again.agg(F.sum(F.when(F.col("__i") > 0, value))).collect()
        return time.perf_counter() - began

    out = {}
    for k, x in rules.items():
        columns = [c for c in rows.columns if re.search(rf"\b{re.escape(c)}\b", x)]
        carried = reduce(lambda a, b: a + b, (F.col(c).isNull().cast("int") for c in columns), F.lit(0))
        times, cost = 4, 0.0
        while True:
            cost = seconds(F.expr(x).cast("int"), columns, times) - seconds(carried, columns, times)
            if cost >= enough or times >= most:
                break
            times *= 4
        out[k] = share[k], max(cost, 1e-6) / (times * total)
    return out


def ordered(rows: DataFrame, rules: dict[str, str]) -> list[str]:
    """The rules' names by falling rejection per cost on a sample, given with its base counts; ties in the given order."""
    got = measured(cut(rows.filter(~F.col("base_failed"))), rules)
    return sorted(rules, key=lambda k: -got[k][0] / got[k][1] if got[k][1] else 0.0)


def cascade(rows: DataFrame, rules: dict[str, str], order: list[str]) -> DataFrame:
    """rows with rejected_by: "base", the first rule in the order that rejects, or null."""
    chain = F.when(F.col("base_failed"), F.lit("base"))
    for k in order:
        chain = chain.when(F.expr(rules[k]), F.lit(k))
    return rows.withColumn("rejected_by", chain)


def apply_rules(docs: DataFrame, rules: dict[str, str] | None = None, sample_rows: int = 300, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried columns, base counts, base_failed, rejected_by, kept."""
    rules = RULES if rules is None else rules
    rows = base(docs, carry)
    rows = cascade(rows, rules, ordered(base(sampled(docs, sample_rows)), rules))
    return rows.withColumn("kept", F.col("rejected_by").isNull()).drop("__text", "__words")
