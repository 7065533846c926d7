"""Names, hashes and text of imported files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = ("fit", "gpx", "tcx")
#: XML entities, in the order in which they are undone.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))
#: An element of free text: its opener, its content, and the closer of the same name.
FREE_TEXT = r"(?s)(<((?:\w+:)?(?:name|desc|cmt))>)(.*?)(</\2>)"


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def decoded(path: Column) -> Column:
    """A path of Spark's file metadata as it is on disk: without URL escapes; other paths are left as they are."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def file_name(path: Column) -> Column:
    return decoded(F.substring_index(path, "/", -1))


def effective_hash(file_hash: Column, track_index: Column) -> Column:
    """The hash a track is known by: the file's, with the track's number where a file holds several."""
    return F.when(track_index.isNull(), file_hash).otherwise(F.concat(file_hash, F.lit(":track"), track_index))


def source_hash(effective: Column) -> Column:
    """The file's hash without a track number."""
    return F.substring_index(effective, ":track", 1)


def track_filename(path: Column, track_name: Column, track_index: Column) -> Column:
    """'stem [name or track n].suffix', with n from 1."""
    base = file_name(path)
    stem, suffix = F.regexp_replace(base, r"\.[^.]*$", ""), F.regexp_extract(base, r"(\.[^.]*)$", 1)
    title = F.coalesce(F.nullif(track_name, F.lit("")), F.concat(F.lit("track "), track_index + 1))
    return F.concat(stem, F.lit(" ["), title, F.lit("]"), suffix)


def escaped_text(text: Column) -> Column:
    """Plain text as XML text: entities undone, then markup characters escaped, so nothing is escaped twice."""
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def sanitized_gpx(xml: Column) -> Column:
    """XML with the content of name, desc and cmt elements escaped."""
    mark = "\u0001"
    pieces = F.split(F.regexp_replace(xml, FREE_TEXT, f"{mark}$1{mark}$3{mark}$4{mark}"), mark)
    # Of every four pieces, the third is a content.
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 4 == 2, escaped_text(p)).otherwise(p)), "")


def without_prefixes(xml: Column) -> Column:
    """XML with namespace prefixes of element names dropped."""
    return F.regexp_replace(xml, r"<(/?)\w+:", "<$1")


def number(text: Column) -> Column:
    """A double, null for anything that is no plain decimal number."""
    plain = F.trim(text)
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))
