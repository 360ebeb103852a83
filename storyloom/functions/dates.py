"""Feed dates to timestamps; what cannot be read becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.functions.text import let

_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})?)?$"
#: Forms that become the one above: digits beyond microseconds go, an offset gets its colon.
_LONG_FRACTION = r"(\.\d{6})\d+"
_BARE_OFFSET = r"^(\d{4}-.*[+-]\d{2})(\d{2})$"
_ISO_ZONED = r"(?:Z|[+-]\d{2}:\d{2})$"
_ISO_DATE_ONLY = r"^\d{4}-\d{2}-\d{2}$"
_MAIL_FORMATS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm z", "d MMM yy HH:mm:ss Z", "d MMM yy HH:mm:ss z")


def _iso(c: Column) -> Column:
    zoned = (
        F.when(c.rlike(_ISO_DATE_ONLY), F.concat(c, F.lit("T00:00:00Z")))
        .when(c.rlike("T.*" + _ISO_ZONED) | c.rlike(" .*" + _ISO_ZONED), c)
        .otherwise(F.concat(c, F.lit("Z")))
    )
    return F.when(c.rlike(_ISO), zoned.try_cast("timestamp"))


def normalize_timestamp(c: Column) -> Column:
    """ISO text (a naive one counts as UTC) or mail-style text to a timestamp.

    The weekday of a mail-style date is dropped first: Spark's parser has no
    pattern letter for it.
    """

    def read(raw: Column) -> Column:
        mail = F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", "")
        even = F.regexp_replace(F.regexp_replace(raw, _LONG_FRACTION, "$1"), _BARE_OFFSET, "$1:$2")
        return F.coalesce(_iso(F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), even).otherwise(raw)), *[F.try_to_timestamp(mail, F.lit(f)) for f in _MAIL_FORMATS])

    return let(c, read)


def timestamp_from_parts(parts: Column) -> Column:
    """Array (year, month, day, hour, minute, second), missing tail counting as zero."""
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(0))
    return F.when(
        F.size(parts) > 0,
        F.try_make_timestamp(at(1), at(2), at(3), at(4), at(5), at(6).cast("decimal(16,6)"), F.lit("UTC")),
    )


def published_at(published: Column, updated: Column, parsed: Column | None = None) -> Column:
    """Date of an ingest entry: the first source that is present decides, readable or not."""
    raw = normalize_timestamp(F.coalesce(published, updated))
    return raw if parsed is None else F.when(parsed.isNotNull(), parsed).otherwise(raw)


def verdict_date(*sources: Column) -> Column:
    """Date of an entry under test: the first source that can be read."""
    return F.coalesce(*[normalize_timestamp(c) for c in sources])


def iso_text(ts: Column) -> Column:
    """ISO text without zone, fraction only when there is one."""
    plain = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.extract(F.lit("SECOND"), ts) % 1 == 0, plain).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
