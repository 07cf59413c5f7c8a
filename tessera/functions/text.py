"""Column functions of the engine; all of them stay inside the JVM's generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.protocol import ALIASES, IGNORED

#: White space as Python strips it: Unicode's, and the four separators that Java's class lacks.
SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(c, f"(?U)^{SPACE}+", ""), f"(?U){SPACE}+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(strip(c) == "", F.lit(True))


def quote(c: Column) -> Column:
    """A JSON string literal in canonical form."""
    short = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]
    out = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), short, c)
    rest = [i for i in range(32) if chr(i) not in "\n\r\t\b\f"]
    full = reduce(lambda x, i: F.replace(x, F.lit(chr(i)), F.lit(f"\\u{i:04x}")), rest, out)
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1f]"), full).otherwise(out), F.lit('"'))


def fingerprint(messages_json: Column, tools_json: Column) -> Column:
    """SHA-256 (hex) over both canonical parts."""
    return F.sha2(F.concat(F.lit('{"messages":'), messages_json, F.lit(',"tools":'), tools_json, F.lit("}")), 256)


def role_name(c: Column) -> Column:
    """Lower-cased role with aliases resolved."""
    low = F.lower(c)
    return reduce(lambda x, p: x.when(low == p[0], F.lit(p[1])), ALIASES.items(), F.when(F.lit(False), low)).otherwise(low)


def is_finite(c: Column) -> Column:
    """NaN compares as greatest in Spark, so thresholds need this guard."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def parse_score(c: Column) -> Column:
    """A number, or a text holding one as the source format has it; else null. Booleans are no scores."""
    text = strip(c.cast("string")).cast("string")
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def flag_at(flags: Column, i: Column) -> Column:
    """Element i of an array of flags; false past its end, for null flags and a null array."""
    return F.coalesce(F.get(flags, i), F.lit(False))


def mask_labels(ids: Column, target: Column) -> Column:
    """The ids themselves where ``target``, else the ignore label for each."""
    return F.when(target, ids).otherwise(F.array_repeat(F.lit(IGNORED), F.size(ids)))


def count_targets(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != IGNORED)).cast("bigint")


def think_split(c: Column) -> tuple[Column, Column]:
    """(reasoning, answer) of a text that may open with a think block; without one all is reasoning, the answer null."""
    pattern = rf"(?sU)^{SPACE}*<think>{SPACE}*(.*?){SPACE}*</think>{SPACE}*(.*)$"
    has = c.rlike(pattern)
    return F.when(has, F.regexp_extract(c, pattern, 1)).otherwise(c), F.when(has, F.regexp_extract(c, pattern, 2))


def tagged_blocks(c: Column, tag: str) -> Column:
    """The stripped contents of all ``<tag>`` blocks, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), strip)


def without_blocks(c: Column, tag: str) -> Column:
    return strip(F.regexp_replace(c, rf"(?s)<{tag}>.*?</{tag}>", ""))


def utf8_bytes(c: Column) -> Column:
    """The bytes of a text as an array of ints."""
    pairs = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit(".."), F.lit(0))  # linear in the text, unlike a substring per byte
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def seeded_order(key: Column, seed: int) -> Column:
    """A key that orders rows as a seeded shuffle: 64 hash bits in hex, the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
