"""Timestamps written in many forms, read with built-in expressions only.

A stamp is first rewritten by one regular expression per form to the canonical text
``form|y|m|d|H|M|S|fraction|half|zone`` and split once; everything else is arithmetic on those
ten parts. Results are zone-less timestamps that mean UTC, so the session zone has no effect.
"""

from __future__ import annotations

from collections.abc import Callable
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and their usual short forms, accents removed, January first.
MONTHS_EN = "january february march april may june july august september october november december".split()
MONTHS_DE = "januar februar marz april mai juni juli august september oktober november dezember".split()
MONTHS_FR = "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre".split()
MONTHS_ES = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
MONTHS_SHORT = [
    "jan janv ene jen", "feb febr fevr", "mar mrz", "apr avr abr", "may", "jun", "jul juil",
    "aug ago aou", "sep sept set", "oct okt", "nov", "dec dez dic",
]
# Names of UTC, and summer-time abbreviations that have no D before their final T.
UTC_NAMES = ["Z", "UTC", "UT", "GMT", "ZULU"]
SUMMER_NAMES = ["BST", "CEST", "EEST", "WEST", "MEST", "MESZ"]

_ACCENTED, _PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn"


def month_numbers() -> dict[str, int]:
    """Every accepted month word, lower case and without accents, with its number."""
    found: dict[str, int] = {}
    for names in (MONTHS_EN, MONTHS_DE, MONTHS_FR, MONTHS_ES):
        found.update({name: i for i, name in enumerate(names, 1)})
    for i, words in enumerate(MONTHS_SHORT, 1):
        found.update({word: i for word in words.split()})
    return found


_SPACE = r"[\s\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000\ufeff]"
_CLOCK = r"(\d{1,2})(?:[:h.](\d{2}))(?:[:.](\d{2})(?:[.,](\d+))?)?"
_HALF = r"(?:\s*(am|pm|a\.m\.|p\.m\.)(?![a-z]))?"
_UNIT = r"(?:\s*(?:uhr|hrs|h)(?![a-z]))?"
_ZONE = r"\s*((?:[+-]\d{2}(?::?\d{2})?|(?:utc|gmt)[+-]\d{1,2}(?::?\d{2})?|[a-z]+(?:/[a-z_+\-0-9]+)+|[a-z]{1,5})?(?:\s*[\[(][a-z_/+\-0-9 ]+[\])])?)"
_TIME = rf"(?:(?:t|,?\s+(?:a|at|um|a las|alle)\s+|,\s*|\s+){_CLOCK}{_HALF}{_UNIT}{_ZONE})?"
_WEEKDAY = r"(?:[a-z]{2,10}\.?,?\s+)?"
_WORD = r"([a-z]{3,10})\.?"

#: name of the form, pattern over the plain lower-case text, rewriting to the ten parts.
FORMS: list[tuple[str, str, str]] = [
    ("epoch", r"(\d{9,10})(?:[.,](\d+))?", "epoch|$1||||||$2||"),
    ("milli", r"(\d{12,13})", "milli|$1||||||||"),
    ("micro", r"(\d{15,16})", "micro|$1||||||||"),
    ("nano", r"(\d{18,19})", "nano|$1||||||||"),
    ("ymd", rf"{_WEEKDAY}(\d{{4}})([-./])(\d{{1,2}})\2(\d{{1,2}}){_TIME}", "ymd|$1|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("ymd", rf"(\d{{4}})(\d{{2}})(\d{{2}})(?:t?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?{_ZONE})?", "ymd|$1|$2|$3|$4|$5|$6|$7||$8"),
    ("fig", rf"{_WEEKDAY}(\d{{1,2}})([-./])(\d{{1,2}})\2(\d{{4}}){_TIME}", "fig|$4|$1|$3|$5|$6|$7|$8|$9|$10"),
    ("word", rf"{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th|er)?\.?[\s-]+(?:de\s+)?{_WORD}[\s-]+(?:de\s+)?(\d{{4}}|\d{{2}}){_TIME}", "word|$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("word", rf"{_WEEKDAY}{_WORD}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_TIME}", "word|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
]


def plain(stamp: Column) -> Column:
    """Lower case, accents and outer space removed, inner space single: what FORMS are matched on."""
    text = F.translate(F.lower(stamp), _ACCENTED, _PLAIN)
    text = F.regexp_replace(text, r"\p{M}", "")
    return F.trim(F.regexp_replace(text, f"{_SPACE}+", " "))


def canonical(text: Column) -> Column:
    """The ten parts of a plain() stamp, joined by |, or null where it has none of the known forms."""
    # a bare run of 14 figures that begins like a year is a date, not a count
    out = F.when(text.rlike(r"^(?:19|20)\d{12}$"), F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "ymd|$1|$2|$3|$4|$5|$6|||"))
    for _, pattern, parts in FORMS:
        anchored = f"^{pattern}$"
        out = out.when(text.rlike(anchored), F.regexp_replace(text, anchored, parts))
    return out


def constant_map(values: dict[str, str]) -> Column:
    """A map as one literal text, which Spark folds into a constant."""
    return F.str_to_map(F.lit("\n".join(f"{k}={v}" for k, v in sorted(values.items()))), F.lit("\n"), F.lit("="))


def _int(part: Column) -> Column:
    return part.try_cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value to a name: used often in ``body``, it is still evaluated once a row.

    (A nested Column would be copied into the plan once per use, and the generated code of
    these expressions would outgrow what the JVM compiles.)
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def parse(stamp: Column) -> Column:
    """struct<form, wall, wall_mdy, zone, instant> of a stamp; null where it has no known form.

    ``instant`` is set for counts of seconds since 1970. For the others ``wall`` is the written
    time (day before month in all-figure dates) and ``wall_mdy`` the other reading of such a date.
    ``zone`` is the zone as written, in lower case, '' where the stamp has none.
    """
    return let(plain(stamp), lambda text: let(F.split(canonical(text), r"\|"), _from_parts))


def _from_parts(p: Column) -> Column:
    months = constant_map({k: str(v) for k, v in month_numbers().items()})
    year = F.when(F.length(p[1]) == 2, F.concat(F.when(p[1] < "50", "20").otherwise("19"), p[1])).otherwise(p[1])
    hour, half = F.coalesce(_int(p[4]), F.lit(0)), F.substring(p[8], 1, 1)
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    second = F.when(p[6] == "", "0").otherwise(p[6])
    seconds = F.when(_int(second) < 60, F.concat(second, F.lit("."), F.rpad(F.substring(p[7], 1, 6), 6, "0")).try_cast("decimal(8,6)"))
    dated, figures = p[0].isin("ymd", "fig", "word"), p[0] == "fig"
    fraction = F.rpad(F.substring(p[7], 1, 6), 6, "0").try_cast("bigint")
    count = p[1].try_cast("bigint")
    micros = F.when(p[0] == "epoch", count * 1_000_000 + F.coalesce(fraction, F.lit(0))).when(p[0] == "milli", count * 1000).when(p[0] == "micro", count).when(p[0] == "nano", (count / 1000).cast("bigint"))
    parts = F.struct(
        F.when(dated, _int(year)).alias("y"),
        F.when(p[0] == "word", _int(F.try_element_at(months, p[2]))).otherwise(_int(p[2])).alias("m"),
        _int(p[3]).alias("d"),
        hour.alias("h"),
        F.coalesce(_int(p[5]), F.lit(0)).alias("minute"),
        seconds.alias("s"),
    )

    def made(x: Column) -> Column:
        written = F.try_make_timestamp_ntz(x["y"], F.when(figures, x["d"]).otherwise(x["m"]), F.when(figures, x["m"]).otherwise(x["d"]), x["h"], x["minute"], x["s"])
        other = F.try_make_timestamp_ntz(x["y"], x["m"], x["d"], x["h"], x["minute"], x["s"])
        return F.struct(
            p[0].alias("form"),
            F.when(x["y"] >= 1, written).alias("wall"),
            F.when(figures & (x["y"] >= 1), other).alias("wall_mdy"),
            F.when(dated, F.trim(p[9])).alias("zone"),
            micros_to_ntz(micros).alias("instant"),
        )

    return let(parts, made)


def micros_to_ntz(micros: Column) -> Column:
    """Microseconds since 1970 as a zone-less UTC time."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=(micros / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)"))


def _shift(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def _to_utc(zone: Column, wall: Column) -> Column:
    return F.convert_timezone(zone, F.lit("UTC"), wall)


def _from_utc(zone: Column, instant: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), zone, instant)


def in_zone(wall: Column, zone: Column, later: Column) -> Column:
    """UTC of a wall time in an IANA zone. The earlier of two such instants unless ``later``;
    null for a time the clocks jumped over."""

    def body(x: Column) -> Column:
        hour, half = _shift(x["t"], F.lit(3600)), _shift(x["t"], F.lit(1800))
        second = F.when(_from_utc(x["z"], hour) == x["w"], hour).when(_from_utc(x["z"], half) == x["w"], half)
        return F.when(_from_utc(x["z"], x["t"]) == x["w"], F.when(later, F.coalesce(second, x["t"])).otherwise(x["t"]))

    bound = let(F.struct(wall.alias("w"), zone.alias("z")), lambda x: F.struct(x["w"].alias("w"), x["z"].alias("z"), _to_utc(x["z"], x["w"]).alias("t")))
    return let(bound, body)


def zone_table() -> dict[str, str]:
    """Lower-case names of the IANA zones, as the running Python knows them, with their spelling."""
    return {z.lower(): z for z in sorted(available_timezones()) if "/" in z and not z.startswith(("posix", "right"))}


_OFFSET = r"^(?:utc|gmt)?([+-]\d{1,2}):?(\d{2})?$"


def to_instant(parsed: Column, own_zone: Column, month_first: Column, bare_zone: Column) -> Column:
    """UTC of a parsed stamp, or null.

    own_zone: the outlet's zone, which its abbreviations mean; bare_zone: the zone of stamps
    without one; month_first: whether all-figure dates begin with the month. Offsets win over
    a zone name beside them.
    """
    proper = constant_map(zone_table())

    def body(x: Column) -> Column:
        spelled = x["z"]
        hours, minutes = F.regexp_extract(spelled, _OFFSET, 1), F.regexp_extract(spelled, _OFFSET, 2)
        seconds = F.abs(_int(hours)) * 3600 + F.coalesce(_int(minutes), F.lit(0)) * 60
        summer = F.upper(spelled).isin(*SUMMER_NAMES) | spelled.rlike("^[a-z]{1,3}dt$")
        later = (spelled != "") & ~spelled.contains("/") & ~summer
        region = F.when(spelled == "", bare_zone).when(spelled.contains("/"), F.try_element_at(proper, spelled)).when(spelled.rlike("^[a-z]{2,5}$"), own_zone)
        return (
            F.when(F.upper(spelled).isin(*UTC_NAMES), x["w"])
            .when(spelled.rlike(_OFFSET), F.when(seconds <= 18 * 3600, _shift(x["w"], seconds * F.when(hours.startswith("-"), 1).otherwise(-1))))
            .otherwise(in_zone(x["w"], region, later))
        )

    wall = F.when(month_first & (parsed["form"] == "fig"), parsed["wall_mdy"]).otherwise(parsed["wall"])
    bare = F.regexp_replace(F.regexp_replace(parsed["zone"], r"^([+-].*?|z)\s*[\[(].*$", "$1"), r"[\[\]()]", "")
    return F.coalesce(parsed["instant"], let(F.struct(wall.alias("w"), F.trim(bare).alias("z")), body))


def iso_utc(instant: Column) -> Column:
    """The one form of an instant: yyyy-MM-ddTHH:mm:ss.SSSSSSZ."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
