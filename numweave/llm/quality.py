"""Quality rules: a ledger of measurements and failure bits, policies over it, and ablations. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Policies by version: the rules that a text must not fail. The base rules are in all of them.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "symbols", "duplicate_lines", "long_words", "capitals"),
}


def rules() -> tuple[tuple[str, Column], ...]:
    n = F.col("n_words")
    return (
        ("few_words", n < 20),
        ("repeated_words", 100 * F.col("n_repeat_words") > 30 * n),
        ("symbols", 10 * F.col("n_symbols") > 3 * n),
        ("duplicate_lines", (F.col("n_dup_lines") > 3) & (2 * F.col("n_dup_lines") > F.col("n_lines"))),
        ("long_words", F.col("word_chars") > 15 * n),
        ("capitals", 2 * F.col("n_capitals") > F.col("word_chars")),
    )


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """Words in windows of k words that the array holds twice or more.

    A window is the 64-bit hash of its words' hashes, and equal hashes count as equal windows: within one text a false
    match is about as likely as its windows squared in 2 ** 65. Only arrays with a repeated hash go on: their (hash, place) pairs
    are sorted, places with an equal neighbour stay, and each covers k words but for what the next one covers too.
    """
    n = F.size(words)
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))

    def covered(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda p: let(F.array_sort(twice(p)), cover))

    def twice(p: Column) -> Column:
        same = lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"])
        return F.transform(F.filter(p, lambda x, i: F.coalesce(same(x, i), F.get(p, i - 1)["h"] == x["h"], F.get(p, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])

    def cover(at: Column) -> Column:
        steps = F.transform(at, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(at, i + 1) - x, F.lit(k))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    some = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0).cast("bigint"))
    return F.when(n > k, let(hashes, lambda h: let(windows(h), some))).otherwise(F.lit(0).cast("bigint"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, the measurements and ``fail_bits``, every rule evaluated once.

    Null texts have no words, and like empty ones fail ``few_words``. Repeated rows are measured each by itself.
    No shuffle: all measurements are made within the row.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = rows.select(
        "doc_id", "text", F.array_remove(F.split("text", SPACE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0).alias("lines"),
    )
    measured = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÑÁÍÓÚ", ""))).cast("long").alias("n_capitals"),
    )
    bits = F.lit(0).cast("bigint")
    for k, (_, failed) in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint"))
    return measured.withColumn("fail_bits", bits)


def mask(names) -> int:
    return sum(1 << k for k, (name, _) in enumerate(rules()) if name in set(names))


def apply_policy(rows: DataFrame, version: int) -> DataFrame:
    """Adds ``base_failed``, ``kept`` and ``policy``; reads bits alone, so policies change without a new pass over texts."""
    hit = lambda names: F.col("fail_bits").bitwiseAND(F.lit(mask(names)).cast("bigint")) != 0
    return rows.withColumns({"base_failed": hit(POLICIES[1]), "kept": ~(hit(POLICIES[1]) | hit(POLICIES[version])), "policy": F.lit(version)})


def ablations(rows: DataFrame, version: int) -> DataFrame:
    """Per rule of a policy: texts that fail it, that fail it alone (kept without the rule), and the policy's failures.

    One aggregation of the bits; ``bit_or`` and ``bit_and`` tell which rules ever and always failed.
    """
    names = [name for name, _ in rules() if name in POLICIES[version]]
    whole = mask(names)
    bits = F.col("fail_bits").bitwiseAND(F.lit(whole).cast("bigint"))
    one = lambda name: F.lit(mask([name])).cast("bigint")
    total = rows.select(bits.alias("b")).agg(
        F.count("*").alias("n"), F.bit_or("b").alias("ever"), F.bit_and("b").alias("always"), F.count_if(F.col("b") != 0).alias("n_failed"),
        *(F.count_if(F.col("b").bitwiseAND(one(x)) != 0).alias(f"{x}_failed") for x in names),
        *(F.count_if(F.col("b") == one(x)).alias(f"{x}_alone") for x in names),
    )
    each = F.array(*(F.struct(F.lit(x).alias("rule"), F.col(f"{x}_failed").alias("failed"), F.col(f"{x}_alone").alias("alone"), (F.col("ever").bitwiseAND(one(x)) != 0).alias("ever"), (F.col("always").bitwiseAND(one(x)) != 0).alias("always")) for x in names))
    return total.select(F.lit(version).alias("policy"), "n", "n_failed", F.inline(each))
