"""Unicode-exact text columns: strip, split, tokens, sentences, key terms, name-based ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points that count as white space, as a pattern and as characters.
WS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WS_CHARS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Key terms are capitalised runs, acronyms, hyphenated lower-case words.
TERMS = (
    rf"\b[A-Z][a-zA-Z]+(?:{WS}+[A-Z][a-zA-Z]+)+\b",
    r"\b[A-Z]{2,}\b",
    r"\b[a-z]+-[a-z]+(?:-[a-z]+)*\b",
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def unix_lines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def normalise(c: Column) -> Column:
    return strip(unix_lines(c))


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda x: x != "")


def tokens(c: Column) -> Column:
    """Lower-cased alphanumeric runs; each character is lowered by itself, so a final sigma stays a plain one."""
    plain = F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(F.lower(F.translate(plain, "Σ", "σ")), " "), lambda x: x != "")


def sentences(c: Column) -> Column:
    return F.filter(F.split(strip(c), rf"(?<=[.!?]){WS}+"), lambda x: x != "")


def key_terms(c: Column, limit: int = 50) -> Column:
    found = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in TERMS])
    return F.slice(F.array_sort(F.array_distinct(found)), 1, limit)


def uuid5(namespace: str | uuid.UUID, name: Column) -> Column:
    """Name-based id (version 5) of each name."""
    ns = uuid.UUID(str(namespace)).hex
    h = F.sha1(F.concat(F.unhex(F.lit(ns)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.instr(F.lit("0123456789abcdef"), F.substring(h, 17, 1)), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def iso(ts: Column) -> Column:
    """ISO time with offset; fractions only where there are any. The session's zone must be UTC."""
    return F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
