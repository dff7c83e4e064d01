"""Names of files, URLs, and messages worth keeping."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# File name extensions that are taken, with their case.
AUDIO_EXTENSIONS = [
    ".mp3", ".wav", ".aac", ".ogg", ".flac", ".m4a", ".wma", ".aiff", ".alac", ".ape",
    ".opus", ".amr", ".au", ".mid", ".midi", ".ac3", ".dts", ".ra", ".rm", ".voc",
    ".dsd", ".pcm", ".raw", ".tta", ".webm", ".3ga", ".8svx", ".cda", ".mp2", ".mp1",
    ".gsm", ".vox", ".dss", ".mka", ".tak", ".ofr", ".spx", ".xm", ".mod", ".s3m",
    ".it", ".nsf", ".669", ".mtm", ".med", ".far", ".umx",
]
URL_EXTENSIONS = ["mp3", "wav", "ogg"]


def suffix(path: Column) -> Column:
    """The last extension of a path with its dot, or an empty text."""
    return F.regexp_extract(path, r"[^./](\.[^./]+)$", 1)


def is_audio(path: Column) -> Column:
    return suffix(path).isin(AUDIO_EXTENSIONS)


def url_extension(url: Column) -> Column:
    """What follows the last dot of the last part of a URL's path."""
    return F.substring_index(F.substring_index(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "/", -1), ".", -1)


def is_audio_url(url: Column) -> Column:
    return url_extension(url).isin(URL_EXTENSIONS)


def with_suffix(path: Column, new: str) -> Column:
    """The path with another extension."""
    return F.concat(F.regexp_replace(path, r"(?<=[^./])\.[^./]+$", ""), F.lit(new))


def is_silent(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def size_text(n_bytes: Column) -> Column:
    """A number of bytes in the largest fitting unit, with two decimals."""
    power = F.least(F.when(n_bytes > 0, F.floor(F.log2(n_bytes) / 10)).otherwise(0), F.lit(4))
    unit = F.element_at(F.array(*(F.lit(u) for u in ("B", "KB", "MB", "GB", "TB"))), (power + 1).cast("int"))
    return F.concat(F.format_string("%.2f", n_bytes / F.pow(F.lit(1024.0), power)), F.lit(" "), unit)
