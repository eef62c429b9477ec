"""Text functions over columns: everything stays in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galleyproof import dims


def _esc(code_point: int) -> str:
    return f"\\x{{{code_point:X}}}"


def char_class(points, ranges=()) -> str:
    """Inside of a regex class; Java and RE2 read it alike."""
    return "".join(_esc(p) for p in points) + "".join(f"{_esc(a)}-{_esc(b)}" for a, b in ranges)


def merged_ranges(points, ranges=()) -> list[tuple[int, int]]:
    """Neighbouring points and ranges as few ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted([(p, p) for p in points] + list(ranges)):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_RANGES = dims.TAG_RANGES + dims.PRIVATE_RANGES + dims.SELECTOR_RANGES
ANY_MARK = char_class((), merged_ranges([c for c, _, _ in dims.named_marks()], _RANGES)) + r"\p{Cf}"
OUTSIDE = char_class((), merged_ranges([*dims.SPACE_MARKS, *dims.CONTEXTUAL_MARKS, *dims.TYPOGRAPHIC_MARKS], _RANGES))
#: Java classes that settle ASCII first, which most text is.
BEYOND_ASCII = r"\x{80}-\x{10FFFF}"
MARK = f"[{BEYOND_ASCII}&&[{ANY_MARK}]]"
NO_MARK = f"[\\x00-\\x7F[^{ANY_MARK}]]"
#: Always removable: the named set, and any other format character that no other set or range claims.
STRIPPED = f"[{BEYOND_ASCII}&&[{char_class((), merged_ranges(dims.STRIP_MARKS))}[\\p{{Cf}}&&[^{OUTSIDE}]]]]"
SPACED = f"[{BEYOND_ASCII}&&[{char_class((), merged_ranges(dims.SPACE_MARKS))}]]"
_J = f"[{char_class(dims.JOINERS)}]"
FLANKED_JOINER = f"{_J}(?<=[\\x00-\\x7E]{_J})(?=[\\x00-\\x7E])"


#: All characters of the property White_Space.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def trim_space(c: Column) -> Column:
    """Trim all Unicode white space; looks at the ends only."""
    return F.btrim(c, F.lit(WHITE))


def clean(c: Column) -> Column:
    """Strip marks go, space marks become a space, all others stay. Idempotent."""
    stripped = F.regexp_replace(F.regexp_replace(c, FLANKED_JOINER, ""), STRIPPED, "")
    return F.regexp_replace(stripped, SPACED, " ")


def newlines(c: Column) -> Column:
    return F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit("")))


def first_sentence(c: Column) -> Column:
    """Up to the first full stop that white space or the end follows; else all."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(?s)^(.*?\.)(?=(?U:\s)|\z)", 1), F.lit("")), c)


def first_blockquote(c: Column) -> Column:
    """First run of ``>`` lines before any define, without marks, joined by a space."""
    before = F.regexp_replace(c, r"(?s)\{\{\s*define.*\z", "")
    run = F.regexp_extract(before, r"(?m)((?:^[ \t]*>[^\n]*(?:\n|\z))+)", 1)
    lines = F.transform(F.split(F.regexp_replace(run, r"\n\z", ""), "\n"), lambda x: trim_space(F.regexp_replace(trim_space(x), "^>", "")))
    return F.when(run == "", F.lit("")).otherwise(F.array_join(F.filter(lines, lambda x: x != ""), " "))


def is_comment(line: Column) -> Column:
    return line.rlike(r"^(?U:\s)*(//|/\*|\*)")


def is_blank(line: Column) -> Column:
    return trim_space(line) == ""


def is_exempt_header(line: Column) -> Column:
    """Generated marker or build constraint."""
    trimmed = trim_space(line)
    return trimmed.rlike(r"^// Code generated .* DO NOT EDIT\.$") | trimmed.startswith("//go:build") | trimmed.startswith("// +build")


def is_generated(content: Column) -> Column:
    """A generated marker before the first line of code; block comments do not count."""
    header = F.regexp_extract(content, r"\A((?:\s++|//[^\n]*+|/\*(?s:.)*?\*/)*+)", 1)
    plain = F.regexp_replace(header, r"(//[^\n]*)|(/\*(?s:.)*?\*/)", "$1")
    return plain.rlike(r"(?m)^\s*// Code generated .* DO NOT EDIT\.\s*$")


def strip_heading(c: Column) -> Column:
    """Without the first line and the line breaks behind it."""
    return F.regexp_replace(c, r"\A[^\n]*\n*", "")


def frontmatter(c: Column) -> Column:
    """The block between the fences; null without both."""
    return F.nullif(F.regexp_extract(c, r"\A---\n((?s:.*?)\n)---(?:\n|\z)", 1), F.lit(""))


def import_only(diff: Column) -> Column:
    """Whether all added and removed lines of a unified diff are blank, package or import lines; an empty diff is."""
    changed = F.filter(F.split(diff, "\n"), lambda x: x.rlike(r"^[+-]") & ~x.rlike(r"^(\+\+\+|---)"))
    body = F.transform(changed, lambda x: trim_space(F.substring(x, 2, 1 << 30)))
    spec = r'^(|\(|\)|import \(|package .*|(import )?([A-Za-z_.][A-Za-z0-9_]* )?"[^"]*")$'
    return F.forall(body, lambda x: x.rlike(spec))


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def has_word(c: Column, word: str) -> Column:
    """Whether ``word`` is among the words, found without making them all."""
    whole = word.isascii() and word.isalnum() and word == word.lower()
    return F.lower(c).rlike(f"(?<![a-z0-9]){word}(?![a-z0-9])") if whole else F.when(c.isNotNull(), False)


def starts_any(c: Column, keyword: Column) -> Column:
    """Whether some word equals the keyword or starts with it."""
    return F.exists(words(c), lambda w: w.startswith(keyword))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the bytes."""
    octets = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(c), F.lit(1))), lambda i: F.conv(F.substring(F.hex(F.encode(c, "UTF-8")), i * 2 - 1, 2), 16, 10).cast("long"))
    start = F.lit(2166136261).cast("long")
    hashed = F.aggregate(octets, start, lambda h, b: ((h.bitwiseXOR(b)) * 16777619).bitwiseAND(F.lit(4294967295)))
    return F.when(F.octet_length(c) == 0, start).otherwise(hashed)


def param_int(value: Column, fallback: int) -> Column:
    """A positive whole number from text: integers, or decimals that are cut; else the fallback."""
    number = F.when(value.rlike(r"^[+-]?[0-9]{1,18}$"), value.try_cast("long")).when(value.rlike(r"^[+-]?[0-9]{1,15}\.[0-9]+$"), value.try_cast("double").cast("long"))
    return F.when(number > 0, number).otherwise(F.lit(fallback).cast("long"))


def param_bool(value: Column, fallback: bool) -> Column:
    return F.when(value.isin("1", "t", "T", "TRUE", "true", "True"), True).when(value.isin("0", "f", "F", "FALSE", "false", "False"), False).otherwise(fallback)


def param_severity(value: Column, fallback: Column) -> Column:
    return F.when(value == "error", dims.ERROR).when(value == "warning", dims.WARNING).when(value == "info", dims.INFO).otherwise(fallback)
