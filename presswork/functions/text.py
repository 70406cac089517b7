"""String functions of the document model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space as the source data's own runtime knows it, which is more than Java's \s.
SPACE = r"[\s\u000b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


# Fixed value: the words and marks that divide a query into topics.
SPLITS = r"(?i)\b(?:and|vs\.?|versus|compared?\s+to|compare|with|&)\b|,"


def form_lines(text: Column) -> Column:
    """The lines of a form field, trimmed, without empty ones: one link a line."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), collapse), lambda x: x != "")


def form_names(text: Column) -> Column:
    """The names of a form field between commas and line ends, each once, in lower case."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[,\r\n]+"), lambda x: F.lower(collapse(x))), lambda x: x != ""))


def days_ago(now: Column, days: int) -> Column:
    """The day that many days before, as archives write it (yyyyMMdd)."""
    return F.date_format(now - F.make_dt_interval(days=F.lit(days)), "yyyyMMdd")


def ascii_lower(c: Column) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(c, UPPER, LOWER)


def contains_text(c: Column, query: Column | str, wildcards: bool = False) -> Column:
    """Substring test, blind to ASCII case; % and _ are live only with ``wildcards``."""
    query = F.lit(query) if isinstance(query, str) else query
    if wildcards:
        return F.like(ascii_lower(c), F.concat(F.lit("%"), ascii_lower(query), F.lit("%")))
    return F.contains(ascii_lower(c), ascii_lower(query))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def content_hash(c: Column) -> Column:
    """SHA-256 of a text with its white space collapsed."""
    return F.sha2(collapse(c), 256)


def keywords(query: Column, least: int = 3) -> Column:
    """Words of at least ``least`` characters."""
    return F.filter(F.split(query, f"{SPACE}+"), lambda w: F.length(w) >= least)


def sub_topics(query: Column) -> Column:
    """Parts of a free query between conjunctions, comparisons and commas; the whole where none is left."""
    parts = F.filter(F.transform(F.split(query, SPLITS), lambda p: F.trim(p)), lambda p: F.length(p) >= 3)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.trim(query)))


def slug(c: Column, limit: int = 80, suffix: Column | None = None) -> Column:
    """Lower-case ASCII words joined by dashes. Latin letters lose their accents, other letters go."""
    plain = F.translate(F.lower(c), "áàâäãåéèêëíìîïóòôöõúùûüçñýÿšž", "aaaaaaeeeeiiiiooooouuuucnyysz")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\p{M}", ""), "[^a-z0-9]+", "-")
    base = F.substring(F.regexp_replace(plain, "^-|-$", ""), 1, limit)
    return base if suffix is None else F.concat(base, F.lit("-"), F.substring(suffix, 1, 6))


def excerpt(title: Column, content: Column, size: int) -> Column:
    """Title, blank line and the first ``size`` characters: what models and extractors get to read."""
    return F.concat(title, F.lit("\n\n"), F.substring(content, 1, size))


def join_names(names: Column) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(names)
    return (
        F.when(n == 0, "")
        .when(n == 1, names[0])
        .when(n == 2, F.concat(names[0], F.lit(" and "), names[1]))
        .otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(names, -1)))
    )


def roman(n: Column) -> Column:
    """Roman numeral of 1 to 3999; other numbers as figures."""
    digits = [["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten] for one, five, ten in (("I", "V", "X"), ("X", "L", "C"), ("C", "D", "M"))]
    place = lambda table, unit: F.element_at(F.array(*map(F.lit, table)), (F.floor(n / unit) % 10 + 1).cast("int"))
    thousands = F.repeat(F.lit("M"), F.floor(n / 1000).cast("int"))
    return F.when(n <= 0, n.cast("string")).otherwise(F.concat(thousands, place(digits[2], 100), place(digits[1], 10), place(digits[0], 1)))


def volume_issue(day: Column, launch: int = 2026) -> Column:
    """struct<volume, issue>: the year since the launch in Roman figures and the day of the year."""
    return F.struct(F.concat(F.lit("Vol. "), roman(F.year(day) - launch + 1)).alias("volume"), F.concat(F.lit("No. "), F.lpad(F.dayofyear(day).cast("string"), 3, "0")).alias("issue"))


def short_label(domain: Column, names: dict[str, str] | None = None) -> Column:
    """A source's short name: from the given names, else its domain without the last label."""
    plain = F.regexp_replace(domain, r"\.[^.]+$", "")
    if not names:
        return plain
    known = F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv])
    return F.coalesce(F.try_element_at(known, domain), plain)


def impact_label(score: Column) -> Column:
    size = F.abs(score)
    return F.when(size <= 20, "minor").when(size <= 50, "moderate").when(size <= 80, "significant").otherwise("extreme")


def impact_band(score: Column) -> Column:
    """Five bands from strongly negative (-2) to strongly positive (2)."""
    return F.when(score >= 20, 2).when(score > 0, 1).when(score == 0, 0).when(score > -20, -1).otherwise(-2)


def number_setting(text: Column, default: float, low: float | None = None, high: float | None = None, whole: bool = True) -> Column:
    """A setting's leading number (whole or not), its default where there is none, kept in bounds."""
    pattern = r"^\s*([-+]?\d+)" if whole else r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
    found = F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("double"), F.lit(float(default)))
    found = F.greatest(found, F.lit(float(low))) if low is not None else found
    return F.least(found, F.lit(float(high))) if high is not None else found


def list_column(text: Column, kind: str = "array<string>") -> Column:
    """A JSON list stored as text; empty where it is malformed."""
    return F.coalesce(F.from_json(text, kind), F.array().cast(kind))


def wayback_stamp(day: Column) -> Column:
    """2024-05-03 or 2024-05-03T10:20:30 as 20240503 or 20240503102030."""
    return F.substring(F.regexp_replace(day, r"[^0-9]", ""), 1, 14)


def wayback_iso(stamp: Column) -> Column:
    """8 to 14 figures as yyyy-MM-ddTHH:mm:ssZ, missing parts zero."""
    full = F.rpad(stamp, 14, "0")
    part = lambda a, n: F.substring(full, a, n)
    return F.concat(part(1, 4), F.lit("-"), part(5, 2), F.lit("-"), part(7, 2), F.lit("T"), part(9, 2), F.lit(":"), part(11, 2), F.lit(":"), part(13, 2), F.lit("Z"))
