"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Column expressions only. Spark returns the matches of a pattern but not their places; the pieces between
the matches give them, because the lengths of pieces and matches add up to the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")

#: Characters of a candidate, each a slot of the window's counts (slots from 1; 0 means none).
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits per character that a window must reach, by the candidate's character class.
THRESHOLDS = (("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0), ("upper", r"^[A-Z0-9]+$", 3.4), ("mixed", r"^.*$", 3.6))
#: Candidates that look random and are not secret.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^sha(1|256|384|512)[-_=]",
    r"(?i)(example|placeholder|changeme|dummy|xxxx)",
    r"(?i)(abcdefghij|0123456789|1234567890|qwertyuiop)",
    r"^[A-Za-z]+([-_/][A-Za-z]+)*([-_/]?[0-9]{1,4})?$",
    r"^/?([A-Za-z0-9_-]{1,15}/){2,}[A-Za-z0-9_-]{0,15}$",
    r"^[0-9]{1,4}([-/_][0-9A-Za-z]{1,12}){2,}$",
)

_SPAN = "array<struct<start:int,kind:int,stop:int>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _places(text: Column, pattern: str, guard: str, kind: int, keep) -> Column:
    """Spans of the leftmost non-overlapping matches that ``keep`` accepts; ``guard`` is a cheaper test of the text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("before"), found.alias("match"))
    start = F.struct(F.lit(0).alias("at"), _none().alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["before"])
        end = begin + F.coalesce(F.char_length(x["match"]), F.lit(0))
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("stop")))
        good = x["match"].isNotNull() & keep(x["match"])
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.when(text.rlike(guard), F.aggregate(steps, start, step, lambda acc: acc["spans"])).otherwise(_none())


def window_entropy(word: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits a character, of any ``window`` characters in a row.

    The counts of the window are kept, not taken anew: one character enters, one leaves, and
    the sum of ``c * log2(c)`` changes by the terms of these two slots.
    """
    def term(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))

    def slot(at: Column) -> Column:
        return F.instr(F.lit(ALPHABET), F.substring(word, at, F.lit(1)))

    def step(acc: Column, i: Column) -> Column:
        enters = slot(i)
        leaves = F.when(i > window, slot(i - window)).otherwise(F.lit(0))
        same = enters == leaves
        more = F.try_element_at(acc["counts"], enters)
        less = F.try_element_at(acc["counts"], F.when(leaves > 0, leaves).otherwise(F.lit(1)))
        change = F.when(same, F.lit(0.0)).otherwise(
            term(more + 1) - term(more) + F.when(leaves > 0, term(less - 1) - term(less)).otherwise(F.lit(0.0))
        )
        counts = F.when(same, acc["counts"]).otherwise(
            F.transform(acc["counts"], lambda c, k: c + (k + 1 == enters).cast("int") - (k + 1 == leaves).cast("int"))
        )
        total = acc["total"] + change
        bits = F.when(i >= window, math.log2(window) - total / window).otherwise(F.lit(0.0))
        return F.struct(counts.alias("counts"), total.alias("total"), F.greatest(acc["best"], bits).alias("best"))

    empty = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best")
    )
    return F.aggregate(F.sequence(F.lit(1), F.char_length(word)), empty, step, lambda acc: acc["best"])


def is_random(word: Column, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Whether a candidate mixes letters and digits, is on no allow list and reaches its class's entropy."""
    needed = F.lit(9.0)
    for _, shape, bits in reversed(THRESHOLDS):
        needed = F.when(word.rlike(shape), F.lit(bits)).otherwise(needed)
    plain = F.lit(False)
    for pattern in allowed:
        plain = plain | word.rlike(pattern)
    mixed = word.rlike("[0-9]") & word.rlike("[A-Za-z]")
    return F.when(mixed & ~plain, window_entropy(word) >= needed).otherwise(F.lit(False))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and added, arrays of (start, kind, stop).

    Places are code points, the end exclusive; ``kind`` is a place in ``KINDS``. ``base`` has the fixed patterns.
    ``added`` has random-looking strings that overlap none of them. A null text counts as empty and has no spans; ids
    are passed on as they are, null and repeated ones too; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    yes = lambda m: F.lit(True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    t = F.col("text")
    found = rows.select(
        "doc_id",
        F.sort_array(F.concat(
            _places(t, ASSIGN, r"(?i:password|passwd|secret|token|api_?key)", 0, lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
            _places(t, ACCESS, "AKIA", 1, lambda m: F.char_length(m) >= 20),
            _places(t, r"[0-9a-f]{24,}", r"[0-9a-f]{24}", 2, yes),
        )).alias("base"),
        _places(t, CANDIDATE, r"[A-Za-z0-9+/_=-]{20}", 3, lambda m: is_random(m, allowed)).alias("raw"),
    )
    clear = F.filter("raw", lambda r: ~F.exists("base", lambda b: (b["start"] < r["stop"]) & (r["start"] < b["stop"])))
    return found.select("doc_id", "base", clear.alias("added"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then by kind."""
    names = F.array(*(F.lit(k) for k in KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(F.sort_array(spans), one), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    found = find_secrets(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.size("added").cast("long").alias("n_entropy"),
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.concat("base", "added")).alias("spans"),
    )
