"""Secret scans: three patterns, and candidate strings of high sliding-window entropy. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: The base kinds in their order, with pattern, the group whose length counts, and the least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
#: A cheap test that every text with an assignment passes.
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Candidates of the entropy scan: runs of the alphabet, at least as long as the window, with a digit.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{%d,}"
#: Class of a candidate (first match counts) and the least entropy in bits of its best window.
CLASSES = (
    ("digits", r"^[0-9+/_=-]+$", math.inf),
    ("hex", r"^(?:[0-9a-f_=-]+|[0-9A-F_=-]+)$", 3.0),
    ("one_case", r"^(?:[0-9a-z+/_=-]+|[0-9A-Z+/_=-]+)$", 3.4),
    ("mixed", r".", 3.7),
)
#: Candidates that are no secrets: UUIDs, published sample keys, plain sequences.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme",
    r"(?i)abcdefghij|0123456789",
)
#: Words joined by signs, four digits at most at the end, are allowed too: what must be found, and what must not. Three
#: plain patterns, since Java's matcher recurses on a repeated group and runs out of stack on a long path.
PATHS = ((r"^/?[A-Za-z][A-Za-z/_=-]*[0-9]{0,4}$", True), (r"[A-Za-z][/_=-]", True), (r"[/_=-][/_=-]", False))
SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint,text:string>>"
#: Counts of five bits held in one long, for the windows of the entropy scan.
PER_LONG = 12
FAR = (1 << 63) - 1


def running(values: Column, combine, ahead: bool = False) -> Column:
    """Each place's values up to it (ahead: from it on) combined, by doubling the reach: n log n steps for n values."""

    def doubled(v: Column) -> Column:
        steps = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda p: p < F.size(v))
        reach = lambda acc, i, p: F.get(acc, i + p if ahead else i - p)
        return F.aggregate(steps, v, lambda acc, p: F.transform(acc, lambda x, i: F.coalesce(combine(x, reach(acc, i, p)), x)))

    return let(values, doubled)


def match_spans(text: Column, pattern: str, rank: int, kind: str, group: int, least: int) -> Column:
    """Spans (code points, end exclusive) of the leftmost non-overlapping matches whose group is long enough.

    ``split`` and ``regexp_extract_all`` find the same matches; running sums of the lengths of the pieces between them
    and of the matches themselves are places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def spans(whole: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(whole))
        ends = running(F.zip_with(gaps, whole, lambda gap, m: (gap + F.length(m)).cast("bigint")), lambda a, b: a + b)
        rows = F.arrays_zip(ends.alias("end"), whole.alias("m"), F.transform(part, F.length).alias("n"))
        span = lambda x: F.struct((x["end"] - F.length(x["m"])).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["m"].alias("text"))
        return F.transform(F.filter(rows, lambda x: x["n"] >= least), span).cast(SPANS)

    return let(found, spans)


def best_entropy(text: Column, window: int) -> Column:
    """The most Shannon entropy (bits) of any ``window`` characters, in one pass: the entering character is added to the
    counts, the leaving one taken off, and the sum of c * log2(c) corrected by those two counts only. Counts have five
    bits, so a window has 31 characters at most."""
    if window > 31:
        raise ValueError("window must be 31 at most")
    clog = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)))
    cells = range(len(ALPHABET) + 1)
    cell = F.array(*(F.lit(k // PER_LONG) for k in cells))
    unit = F.array(*(F.lit(1 << 5 * (k % PER_LONG)).cast("bigint") for k in cells))
    held = lambda counts, code: F.call_function("div", F.get(counts, F.get(cell, code)), F.get(unit, code)).bitwiseAND(31).cast("int")

    def step(codes: Column, acc: Column, i: Column) -> Column:
        came = F.get(codes, i)
        gone = F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(0))
        of_gone = held(acc["counts"], gone)
        off = F.when(gone > 0, F.get(clog, of_gone - 1) - F.get(clog, of_gone)).otherwise(F.lit(0.0))
        of_came = held(acc["counts"], came) - (came == gone).cast("int")
        total = acc["clog"] + off + F.get(clog, of_came + 1) - F.get(clog, of_came)
        entropy = F.when(i >= window - 1, math.log2(window) - total / window).otherwise(F.lit(0.0))
        more = lambda k: F.when(k == F.get(cell, came), F.get(unit, came)).otherwise(F.lit(0).cast("bigint"))
        less = lambda k: F.when((gone > 0) & (k == F.get(cell, gone)), F.get(unit, gone)).otherwise(F.lit(0).cast("bigint"))
        counts = F.transform(acc["counts"], lambda c, k: c + more(k) - less(k))
        return F.struct(counts.alias("counts"), total.alias("clog"), F.greatest(acc["best"], entropy).alias("best"))

    codes = F.transform(F.split(text, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    zero = F.struct(F.array_repeat(F.lit(0).cast("bigint"), len(ALPHABET) // PER_LONG + 1).alias("counts"), F.lit(0.0).alias("clog"), F.lit(0.0).alias("best"))
    # the codes stay out of the accumulator, which is copied at each step
    return let(codes, lambda codes: F.aggregate(F.sequence(F.lit(0), F.length(text) - 1), zero, lambda acc, i: step(codes, acc, i), lambda acc: acc["best"]))


def free_of(base: Column, candidates: Column, wanted) -> Column:
    """The candidates that no base span overlaps and that are ``wanted``; both lists are read once, in order of start."""
    last = len(BASE)

    def pick(spans: Column) -> Column:
        ends = F.transform(spans, lambda x: F.when(x["rank"] < last, x["end"]).otherwise(F.lit(-1).cast("bigint")))
        starts = F.transform(spans, lambda x: F.when(x["rank"] < last, x["start"]).otherwise(F.lit(FAR)))
        return let(
            F.struct(running(ends, F.greatest).alias("before"), running(starts, F.least, ahead=True).alias("after")),
            lambda near: F.filter(spans, lambda x, i: (x["rank"] == last) & (F.get(near["before"], i) <= x["start"]) & (F.get(near["after"], i) >= x["end"]) & wanted(x["text"])),
        )

    return let(F.array_sort(F.concat(base, candidates)), pick)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """One row per input row: ``doc_id``, ``base`` and ``added``: arrays of spans (start, rank, kind, end, text), in order.

    ``base`` holds the fixed patterns' spans. ``added`` holds candidates whose best window reaches their class's
    entropy, unless the allow list names them or a base span overlaps them. Null texts count as empty; empty texts give
    empty arrays; repeated rows are scanned each by itself. No shuffle. The time is linear in the length of a text, and
    n log n in the number of its matches.
    """
    text = F.col("text")
    empty = F.array().cast(SPANS)
    low = F.lower(text)
    hint = low.contains(ASSIGN_HINTS[0])
    for x in ASSIGN_HINTS[1:]:
        hint = hint | low.contains(x)
    guards = {"assign": hint, "access": text.contains("AKIA"), "hex": text.rlike(BASE[2][1])}
    candidate = CANDIDATE % window
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.select(
        "doc_id",
        *(F.when(guards[kind], match_spans(text, pattern, k, kind, group, least)).otherwise(empty).alias(kind) for k, (kind, pattern, group, least) in enumerate(BASE)),
        F.when(text.rlike(candidate), match_spans(text, candidate, len(BASE), "entropy", 0, window)).otherwise(empty).alias("candidates"),
    )
    base = F.array_sort(F.concat(*(F.col(kind) for kind, *_ in BASE)))

    def secret(x: Column) -> Column:
        least = F.lit(None).cast("double")
        for _, pattern, bits in reversed(CLASSES):
            least = F.when(x.rlike(pattern), F.lit(bits)).otherwise(least)
        allowed = F.lit(True)
        for pattern, there in PATHS:
            allowed = allowed & (x.rlike(pattern) == F.lit(there))
        for pattern in ALLOWED:
            allowed = allowed | x.rlike(pattern)
        return ~allowed & F.when(least < math.inf, best_entropy(x, window) >= least).otherwise(F.lit(False))

    return found.withColumn("base", base).select(
        "doc_id", "base", F.when(F.size("candidates") > 0, free_of(F.col("base"), F.col("candidates"), secret)).otherwise(empty).alias("added")
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind, *_ in BASE),
        F.sha2(line("base"), 256).alias("base_sha256"),
        line(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )
