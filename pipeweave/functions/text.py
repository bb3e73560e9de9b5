"""Strings, patterns, encodings, digests and bytes as Columns. Absent in, absent out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# strings: positions count code points


def at(s: Column, i: int) -> Column:
    n = F.char_length(s)
    return F.when((n > i) if i >= 0 else (n >= -i), F.substring(s, i + 1 if i >= 0 else i, 1))


def char_at(s: Column, i: int) -> Column:
    return at(s, i) if i >= 0 else F.lit(None).cast("string")


def to_text(x: Column) -> Column:
    return x.cast("string")


def fmt(pattern: str, *args: Column) -> Column:
    """``{}`` in order."""
    parts = pattern.split("{}")
    out = [F.lit(parts[0])]
    for a, p in zip(args, parts[1:], strict=True):
        out += [a.cast("string"), F.lit(p)]
    return F.concat(*out)


def size(s: Column) -> Column:
    return F.char_length(s).cast("bigint")


#: Characters whose upper case in Spark is several, and the one character it is here (Unicode's simple mapping; ß has a capital of its own).
_EXPANDING = {c: t if len(t := c.title()) == 1 else c for c in map(chr, range(0x10000)) if len(c.upper()) > 1} | {"ß": "ẞ"}
_RARE = {c: t for c, t in _EXPANDING.items() if c != "ß"}
#: Characters whose lower case in Spark depends on their neighbours (a final sigma) or is several, and the one character it is here.
ONE_LOWER = {"Σ": "σ", "İ": "i"}


def _translate(s: Column, by: dict[str, str]) -> Column:
    return F.translate(s, "".join(by), "".join(by.values()))


def upper(s: Column) -> Column:
    """Each character in upper case, one for one, as SQL has it: the size stays."""
    sharp = F.translate(s, "ß", "ẞ")
    one = lambda c: F.when(c.isin(*_RARE), _translate(c, _RARE)).otherwise(F.upper(c))
    return F.when(sharp.rlike(f"[{''.join(_RARE)}]"), F.array_join(F.transform(F.split(sharp, ""), one), "")).otherwise(F.upper(sharp))


def lower(s: Column) -> Column:
    """Each character in lower case, one for one, as SQL has it: the size stays."""
    return F.lower(_translate(s, ONE_LOWER))


def trim(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def trim_start(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+", "")


def trim_end(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\s+$", "")


def capitalize(s: Column) -> Column:
    return F.concat(upper(F.substring(s, 1, 1)), F.substring(s, 2, 2147483647))


def quote(text: str) -> str:
    """A pattern that matches the text itself."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)


def split(s: Column, separator: str, limit: int = 0) -> Column:
    return F.split(s, quote(separator), limit if limit > 0 else -1)


def join(items: Column, separator: str) -> Column:
    return F.array_join(items, separator)


def replace_all(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def replace_first(s: Column, old: str, new: str) -> Column:
    i = F.instr(s, old)
    return F.when(i > 0, F.concat(s.substr(F.lit(1), i - 1), F.lit(new), s.substr(i + len(old), F.char_length(s)))).otherwise(s)


def starts_with(s: Column, part: str) -> Column:
    return F.startswith(s, F.lit(part))


def ends_with(s: Column, part: str) -> Column:
    return F.endswith(s, F.lit(part))


def contains(s: Column, part: str) -> Column:
    return F.contains(s, F.lit(part))


def index_of(s: Column, part: str) -> Column:
    return (F.nullif(F.instr(s, part), F.lit(0)) - 1).cast("bigint")


def last_index_of(s: Column, part: str) -> Column:
    i = F.instr(F.reverse(s), part[::-1])
    return F.when(i > 0, F.char_length(s) - i - len(part) + 1).cast("bigint")


def occurrences(s: Column, part: str) -> Column:
    return F.regexp_count(s, F.lit(quote(part))).cast("bigint") if part else F.when(s.isNotNull(), F.lit(0).cast("bigint"))


def _strip(s: Column, part: str, head: bool, other: Column) -> Column:
    has = starts_with(s, part) if head else ends_with(s, part)
    cut = s.substr(F.lit(len(part) + 1), F.char_length(s)) if head else s.substr(F.lit(1), F.char_length(s) - len(part))
    return F.when(has, cut).otherwise(other)


def strip_prefix(s: Column, part: str) -> Column:
    return _strip(s, part, True, F.lit(None))


def strip_suffix(s: Column, part: str) -> Column:
    return _strip(s, part, False, F.lit(None))


def trim_prefix(s: Column, part: str) -> Column:
    return _strip(s, part, True, s)


def trim_suffix(s: Column, part: str) -> Column:
    return _strip(s, part, False, s)


def equals_ignore_case(a: Column, b: Column | str) -> Column:
    return lower(a) == lower(_c(b))


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda x: x != "")


def lines(s: Column) -> Column:
    parts = F.split(s, r"\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def words(s: Column) -> Column:
    return F.filter(F.split(s, r"(?U)\s+"), lambda x: x != "")


def reverse(s: Column) -> Column:
    return F.reverse(s)


def repeat(s: Column, n: int) -> Column:
    return F.repeat(s, max(0, n))


def pad_left(s: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.char_length(s) >= width, s).otherwise(F.lpad(s, width, fill))


def pad_right(s: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.char_length(s) >= width, s).otherwise(F.rpad(s, width, fill))


def center(s: Column, width: int, fill: str = " ") -> Column:
    n = F.char_length(s)
    left = F.floor((F.lit(width) - n) / 2).cast("int")
    return F.when(n >= width, s).otherwise(F.rpad(F.concat(F.repeat(F.lit(fill), left), s), width, fill))


def truncate(s: Column, width: int) -> Column:
    return F.substring(s, 1, width)


def slice(s: Column, start: int = 0, end: int | None = None) -> Column:
    n = F.char_length(s)
    a = F.greatest(F.lit(0), n + start) if start < 0 else F.lit(start)
    b = n if end is None else n + end if end < 0 else F.least(F.lit(end), n)
    return s.substr(a + 1, F.greatest(F.lit(0), b - a))


def to_int(s: Column) -> Column:
    return F.when(s.rlike(r"^\s*[+-]?\d+\s*$"), s.try_cast("bigint"))


def to_float(s: Column) -> Column:
    x = s.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def to_decimal(s: Column, precision: int = 38, scale: int = 18) -> Column:
    return s.try_cast(f"decimal({precision},{scale})")


def to_bool(s: Column) -> Column:
    return F.when(trim(s) == "true", True).when(trim(s) == "false", False)


def is_empty(s: Column) -> Column:
    return F.char_length(s) == 0


def is_blank(s: Column) -> Column:
    return s.rlike(r"(?U)^\s*$")


def ord(s: Column) -> Column:
    return F.when(F.char_length(s) == 1, F.ascii(s).cast("bigint"))


def chr(n: Column) -> Column:
    """The character of a code point, by its UTF-32 bytes; absent outside Unicode."""
    valid = ((n >= 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n <= 0x10FFFF))
    return F.when(valid, F.decode(F.to_binary(F.lpad(F.hex(n.cast("bigint")), 8, "0"), F.lit("hex")), "UTF-32"))


def bytes(s: Column) -> Column:
    """UTF-8 octets as integers."""
    h = F.hex(F.encode(s, "UTF-8"))
    n = F.octet_length(s)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.conv(h.substr(i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"))
    return F.when(n > 0, every).when(n == 0, F.array().cast("array<bigint>"))


# patterns


def is_match(s: Column, pattern: str) -> Column:
    return s.rlike(pattern)


def find(s: Column, pattern: str) -> Column:
    return F.regexp_substr(s, F.lit(pattern))


def find_all(s: Column, pattern: str) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(0))


def captures(s: Column, pattern: str, groups: int) -> Column:
    """The whole match and each group, or absent."""
    return F.when(s.rlike(pattern), F.array(*[F.regexp_extract(s, pattern, i) for i in range(groups + 1)]))


def regex_replace_all(s: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(s, pattern, replacement)


def regex_replace_first(s: Column, pattern: str, replacement: str) -> Column:
    """The first match only: what precedes it is kept as group 1, so group numbers of the replacement move by one."""
    moved = re.sub(r"\$(\d+)", lambda m: f"${int(m[1]) + 1}", replacement)
    return F.regexp_replace(s, f"(?s)\\A(.*?){pattern}", "$1" + moved)


def regex_split(s: Column, pattern: str) -> Column:
    return F.split(s, pattern)


# encodings: hex, base64, base64url, percent


def encode(x: Column, how: str, binary: bool = False) -> Column:
    raw = x if binary else F.encode(x, "UTF-8")
    if how == "hex":
        return F.lower(F.hex(raw))
    if how in ("base64", "base64url"):
        # Spark breaks long base64 into lines
        text = F.regexp_replace(F.base64(raw), r"\s", "")
        return text if how == "base64" else F.translate(text, "+/=", "-_")
    if how == "percent":
        return F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    raise ValueError(how)


def to_bytes(s: Column, how: str) -> Column:
    if how == "hex":
        return F.try_to_binary(s, F.lit("hex"))
    if how == "base64url":
        plain = F.translate(s, "-_", "+/")
        s = F.rpad(plain, (F.ceil(F.char_length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.try_to_binary(s, F.lit("base64"))


def decode(s: Column, how: str) -> Column:
    if how == "percent":
        return F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))
    return bytes_to_text(to_bytes(s, how))


def bytes_to_text(b: Column) -> Column:
    return F.try_validate_utf8(b.cast("string"))


def bytes_size(b: Column) -> Column:
    return F.octet_length(b).cast("bigint")


def bytes_at(b: Column, i: int) -> Column:
    n = F.octet_length(b)
    return F.when((n > i) if i >= 0 else (n >= -i), F.conv(F.hex(F.substring(b, i + 1 if i >= 0 else i, 1)), 16, 10).cast("bigint"))


def bytes_slice(b: Column, start: int, end: int) -> Column:
    n = F.octet_length(b)
    a = F.greatest(F.lit(0), n + start) if start < 0 else F.lit(start)
    z = n + end if end < 0 else F.least(F.lit(end), n)
    return b.substr(a + 1, F.greatest(F.lit(0), z - a))


# digests


def digest(x: Column, how: str = "sha256") -> Column:
    return {"md5": lambda: F.md5(x), "sha1": lambda: F.sha1(x), "sha256": lambda: F.sha2(x, 256), "sha512": lambda: F.sha2(x, 512)}[how]()


def canonical(data: Column) -> Column:
    """An open value as JSON with sorted keys."""
    return F.to_json(data)


def fingerprint(data: Column) -> Column:
    return F.sha2(F.to_json(data), 256)
