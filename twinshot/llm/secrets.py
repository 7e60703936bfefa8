"""Secret scans in DataFrame functions alone.

Three kinds of secrets are found by pattern: assignments, access keys and hexadecimal strings. Other
candidate strings are judged by the Shannon entropy of a window that slides over them, within the
character class of the string (hexadecimal, or base 64). The window's symbol counts and the sum of
c * log2(c) over them are carried from place to place: one symbol enters, one leaves. A candidate whose
entropy stays low is prose or an identifier; an allow-list suppresses what is random by design but no
secret. Spans are code points, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: kind, pattern, group that must be long enough, its least length.
_NAME = "(" + "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key")
) + ")"
_ASSIGN = _NAME + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]%s)"""
ASSIGN = (_ASSIGN % "+", 2, 12)
ACCESS = (r"AKIA[A-Z0-9]{14,}", 0, 18)
HEX = (r"(?<![0-9a-f])[0-9a-f]{16,}", 0, 16)
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_base64"]

WINDOW = 20
#: Class of a candidate: its symbols, and the entropy in bits from which a window is suspicious. A
#: window of 20 random symbols has 3.3 bits of 4 (hexadecimal) or 4.1 of 4.32 (base 64) on average.
CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", 2.9),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.75),
}
# Candidates hold a digit and a letter, or letters whose case changes as in no identifier; words and numbers alone are neither.
_JUMBLE = r"(?:[A-Z][a-z][A-Z][a-z]?[A-Z]|[A-Z]{2}[a-z][A-Z])"
_CANDIDATE = (
    r"(?<![A-Za-z0-9+/_=-])(?:(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])|(?=[A-Za-z+/_=-]*?%s))[A-Za-z0-9+/_=-]{20,}"
    % _JUMBLE
)
_HEX_ONLY = r"^[0-9A-Fa-f]+$"
#: Identifiers, paths and dates are words and numbers of up to 8 digits between separators. They are
#: known by what they don't hold: a repeated group over a long text would overflow the matcher's stack.
NOT_AN_IDENTIFIER = r"[A-Za-z][0-9]|[0-9][A-Za-z]|[0-9]{9}|" + _JUMBLE
ALLOWED = [
    # universally unique identifiers
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    # placeholders
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|your[_-]",
    # digests named as such by their prefix
    r"^(?:sha256|sha384|sha512|sha1|md5)[-=]",
]


def _spans(text: Column, pattern: str, asked: Column, group: int, least: int, kind: str) -> Column:
    """Spans (start, kind number, end, value) of the pattern's matches, where ``asked`` holds.

    The pieces between matches and the matches themselves alternate, so their lengths give places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), found.alias("match"), value.alias("value"))
    span = "struct<start:int,kind:int,end:int,value:string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["piece"])
        end = begin + F.coalesce(F.length(part["match"]), F.lit(0))
        one = F.struct(
            begin.cast("int").alias("start"),
            F.lit(KINDS.index(kind)).cast("int").alias("kind"),
            end.cast("int").alias("end"),
            part["value"].alias("value"),
        )
        keep = F.length(part["value"]) >= least
        return F.struct(end.cast("int").alias("at"), F.when(keep, F.array_append(state["out"], one)).otherwise(state["out"]).alias("out"))

    spans = F.aggregate(parts, start, step, lambda s: s["out"])
    return F.when(asked, spans).otherwise(F.array().cast(f"array<{span}>"))


def _gain(count: Column) -> Column:
    """c * log2(c), 0 at 0."""
    return F.when(count > 0, count * F.log2(F.greatest(count, F.lit(1)).cast("double"))).otherwise(F.lit(0.0))


def peak_entropy(value: Column, symbols: str) -> Column:
    """Highest Shannon entropy, in bits, of the windows of a string; symbols of no class count as one.

    Entropy is log2(w) - sum(c * log2(c)) / w; the sum changes only by the symbols that enter and leave.
    """
    zero = F.array_repeat(F.lit(0), len(symbols) + 1)
    start = F.struct(zero.alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("seen"), F.lit(-1.0).alias("best"))
    # One pass over (symbol that enters, symbol that leaves); taking them by place would start at the
    # front of the string each time. Nothing leaves the first windows.
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(symbols), c))
    moves = F.arrays_zip(
        codes.alias("enter"), F.slice(F.concat(F.array_repeat(F.lit(-1), WINDOW), codes), F.lit(1), F.size(codes)).alias("leave")
    )

    def step(state: Column, move: Column) -> Column:
        enter, leave, counts = move["enter"], move["leave"], state["counts"]
        more, less = F.element_at(counts, enter + 1), F.element_at(counts, F.greatest(leave, F.lit(0)) + 1)
        change = _gain(more + 1) - _gain(more) + F.when(leave >= 0, _gain(less - 1) - _gain(less)).otherwise(F.lit(0.0))
        same = enter == leave
        total = F.when(same, state["sum"]).otherwise(state["sum"] + change)
        moved = F.transform(counts, lambda c, k: F.when(k == enter, c + 1).when(k == leave, c - 1).otherwise(c))
        seen = state["seen"] + 1
        bits = F.when(seen >= WINDOW, F.lit(math.log2(WINDOW)) - total / WINDOW).otherwise(F.lit(-1.0))
        return F.struct(
            F.when(same, counts).otherwise(moved).alias("counts"),
            total.alias("sum"),
            seen.alias("seen"),
            F.greatest(state["best"], bits).alias("best"),
        )

    return F.aggregate(moves, start, step, lambda s: s["best"])


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (start, kind, end, value) by start, then kind.

    ``kind`` is a place in KINDS. Base spans are those of the three patterns: matches are leftmost and
    do not overlap within a kind, and too short ones are dropped. ``spans`` adds the candidates of high
    entropy that overlap no base span and are on no allow-list. A null text is empty. Rows and columns
    of ``docs`` stay; its own columns of the two names, if any, are replaced.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = F.concat(
        _spans(body, ASSIGN[0], body.rlike(_ASSIGN % "{12,}"), ASSIGN[1], ASSIGN[2], "assign"),
        _spans(body, ACCESS[0], body.rlike(ACCESS[0]), ACCESS[1], ACCESS[2], "access"),
        _spans(body, HEX[0], body.rlike(HEX[0]), HEX[1], HEX[2], "hex"),
    )
    found = docs.withColumn("base_spans", F.array_sort(base)).withColumn(
        "spans", _spans(body, _CANDIDATE, body.rlike(_CANDIDATE), 0, WINDOW, "entropy_base64")
    )

    def suspicious(c: Column) -> Column:
        free = ~F.exists("base_spans", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        allowed = F.lit(False)
        for pattern in ALLOWED:
            allowed = allowed | c["value"].rlike(pattern)
        allowed = allowed | ~c["value"].rlike(NOT_AN_IDENTIFIER)
        (hex_symbols, hex_bits), (symbols, bits) = CLASSES.values()
        high = F.when(c["value"].rlike(_HEX_ONLY), peak_entropy(c["value"], hex_symbols) >= hex_bits).otherwise(
            peak_entropy(c["value"], symbols) >= bits
        )
        return free & ~allowed & high

    def named(c: Column) -> Column:
        kind = F.when(c["value"].rlike(_HEX_ONLY), KINDS.index("entropy_hex")).otherwise(KINDS.index("entropy_base64"))
        return F.struct(c["start"].alias("start"), kind.cast("int").alias("kind"), c["end"].alias("end"), c["value"].alias("value"))

    added = F.transform(F.filter("spans", suspicious), named)
    added = F.when(F.size("spans") > 0, added).otherwise(F.col("spans"))
    return found.withColumn("spans", F.array_sort(F.concat("base_spans", added)))


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def masked(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mask``; overlapping spans become one.

    Texts without spans stay as they are, null ones included, and no row is dropped. If there is a
    column ``n_chars`` it follows the changed texts.
    """
    columns = docs.columns
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), state["at"] + 1, s["start"] - state["at"])
        out = F.when(s["start"] < state["at"], state["out"]).otherwise(F.concat(state["out"], gap, F.lit(mask)))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate(
        "spans", start, step, lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.length(F.col(text))))
    )
    hit = F.size("spans") > 0
    out = scan(docs, text).withColumn("_clean", F.when(hit, clean).otherwise(F.col(text)))
    if "n_chars" in columns:
        size = F.length("_clean").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(hit, size).otherwise(F.col("n_chars")))
    return out.withColumn(text, F.col("_clean")).select(*columns)
