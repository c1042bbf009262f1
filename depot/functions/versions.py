"""Version text as a comparable struct (no UDF)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from depot.functions import fixed

VERSION_TYPE = (
    "struct<major:bigint,major_long:string,minor:bigint,minor_long:string,"
    "patch:bigint,patch_long:string,extra:string,repr:string>"
)

#: Stands for a part that does not fit a bigint; its ``_long`` field then orders it.
TOO_LONG = (1 << 63) - 1


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_version(text) -> Column:
    """``major, minor, patch`` (each with ``_long``), ``extra, repr``; null if it is no version.

    Missing parts are 0, text after the numeric prefix is ignored unless it is a
    fourth dotted part, and ``repr`` keeps the text, so ``2.0`` and ``2.0.0`` differ
    and structs order by the numbers first. A part of any length is a number: beyond a
    bigint it is ``TOO_LONG``, and ``_long`` holds its digits behind their count.
    """
    text = _col(text)

    def part(i: int) -> Column:
        return F.regexp_extract(text, fixed.VERSION_PATTERN, i)

    def number(i: int) -> Column:
        # the leading zero stands for a missing part
        return F.coalesce(F.concat(F.lit("0"), part(i)).try_cast("bigint"), F.lit(TOO_LONG))

    def long(i: int) -> Column:
        digits = F.regexp_replace(part(i), "^0+", "")
        key = F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)
        # the length of the whole text spares nearly all texts the second look
        return F.when((F.length(text) > 18) & (number(i) == TOO_LONG), key).otherwise("")

    # Every part of a short text is looked at once: filters compute repeated expressions repeatedly.
    return F.when(
        text.rlike(fixed.VERSION_START_PATTERN),
        F.struct(
            number(1).alias("major"),
            long(1).alias("major_long"),
            number(2).alias("minor"),
            long(2).alias("minor_long"),
            number(3).alias("patch"),
            long(3).alias("patch_long"),
            part(4).alias("extra"),
            text.alias("repr"),
        ),
    )


def version_literal(text: str) -> Column:
    return parse_version(F.lit(text))


def major(version) -> Column:
    return _col(version).getField("major")


def part_text(version, name: str) -> Column:
    """Digits of the part ``name`` (major, minor or patch) of a version struct."""
    v = _col(version)
    digits = F.substring(v.getField(f"{name}_long"), 11, 1 << 30)
    return F.when(digits != "", digits).otherwise(v.getField(name).cast("string"))


def major_minor(version) -> Column:
    """``major.minor`` text of a version struct."""
    return F.concat_ws(".", part_text(version, "major"), part_text(version, "minor"))


def drop_last_part(text) -> Column:
    """``12.4`` -> ``12``: a short key without its trailing numeric part."""
    return F.regexp_replace(_col(text), r"\.[0-9]+$", "")


def file_version(name, prefix: str) -> Column:
    """Version in an artifact file name ``<prefix>-<version>-....whl``, null if absent."""
    found = F.regexp_extract(_col(name), rf".*/{prefix}-([^-]+)-.*\.whl", 1)
    return F.nullif(found, F.lit(""))
