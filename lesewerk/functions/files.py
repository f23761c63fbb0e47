"""Names of files and keys of saved models, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lesewerk.functions.columns import col

# Suffixes that recordings may have, with their media types.
MEDIA_TYPES = {"wav": "audio/wav", "flac": "audio/flac", "ogg": "audio/ogg", "mp3": "audio/mpeg", "m4a": "audio/mp4"}


def _suffix(name: Column | str) -> Column:
    return F.regexp_extract(F.lower(col(name)), r"[.]([a-z0-9]+)$", 1)


def audio_suffix(name: Column | str) -> Column:
    """'.flac' and the like in lower case; '.wav' for names without a suffix of a recording. Null stays null."""
    s = _suffix(name)
    return F.when(s.isin(*MEDIA_TYPES), F.concat(F.lit("."), s)).when(s.isNotNull(), ".wav")


def media_type(name: Column | str) -> Column:
    types = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.when(col(name).isNotNull(), F.coalesce(F.try_element_at(types, _suffix(name)), F.lit("application/octet-stream")))


def server_path(path: Column | str) -> Column:
    """A path with a drive letter as a Linux server mounts it; every other path stays."""
    p = col(path)
    drive, rest = F.regexp_extract(p, r"^([A-Za-z]):[\\/]", 1), F.regexp_replace(p, r"^[A-Za-z]:[\\/]", "")
    return F.when(drive != "", F.concat(F.lit("/mnt/"), F.lower(drive), F.lit("/"), F.replace(rest, F.lit("\\"), F.lit("/")))).otherwise(p)


def needs_wrapper(keys: Column, prefix: str) -> Column:
    """Whether none of the keys stands under the wrapper's prefix."""
    return ~F.exists(keys, lambda k: k.startswith(prefix))


def wrap_keys(entries: Column | str, prefix: str, added: dict[str, float]) -> Column:
    """The entries under a prefix, and what the wrapper adds to them. Null stays null."""
    wrapped = F.transform_keys(col(entries), lambda k, _: F.concat(F.lit(prefix), k))
    return F.map_concat(wrapped, F.create_map(*[F.lit(x) for pair in added.items() for x in pair]))


def missing(required: list[str], present: Column | str) -> Column:
    """What of the required names isn't there, in their order."""
    return F.array_except(F.array(*map(F.lit, required)), F.coalesce(col(present), F.array().cast("array<string>")))


def count_text(n: Column | str, one: str, many: str) -> Column:
    """'1 Satz', '3 Sätze'; '--' for null."""
    c = col(n)
    return F.when(c.isNull(), "--").when(c == 1, f"1 {one}").otherwise(F.concat(c.cast("string"), F.lit(f" {many}")))


def percent_text(share: Column | str) -> Column:
    """'2.6 %' of a share; '--' for null and NaN."""
    c = col(share)
    return F.when(c.isNull() | F.isnan(c), "--").otherwise(F.format_string("%.1f %%", c * 100))
