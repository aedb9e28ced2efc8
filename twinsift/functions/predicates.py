"""Filters and projections of the file catalogue, as Column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: MIME types that can be read as an image.
IMAGE_MIMES = (
    "image/jpeg", "image/png", "image/gif", "image/webp", "image/bmp",
    "image/tiff", "image/x-tiff", "image/svg+xml", "image/avif", "image/heic", "image/heif", "image/jxl",
    "image/jp2", "image/jpx", "image/x-icon", "image/vnd.microsoft.icon", "image/ico",
    "image/x-canon-cr2", "image/x-canon-crw", "image/x-nikon-nef", "image/x-sony-arw", "image/x-panasonic-raw",
    "image/x-olympus-orf", "image/x-fuji-raf", "image/x-adobe-dng", "image/x-raw",
    "image/x-ms-bmp", "image/pjpeg", "image/x-png", "image/apng",
    "image/x-portable-pixmap", "image/x-portable-graymap", "image/x-portable-bitmap",
    "image/vnd.adobe.photoshop", "image/x-photoshop", "image/photoshop", "image/psd",
    "application/x-photoshop", "application/photoshop", "application/psd", "application/octet-stream",
    "image/tga", "image/x-tga", "image/x-targa", "image/targa",
    "image/iff", "image/x-iff", "image/ilbm", "image/x-ilbm", "image/x-pcx", "image/pcx",
)

#: File name extensions of images.
IMAGE_EXTENSIONS = (
    ".jpg", ".jpeg", ".jpe", ".png", ".gif", ".webp", ".bmp", ".dib",
    ".tif", ".tiff", ".svg", ".avif", ".heic", ".heif", ".jxl", ".jp2", ".jpx",
    ".ico", ".cr2", ".crw", ".nef", ".arw", ".raw", ".orf", ".raf", ".dng",
    ".ppm", ".pgm", ".pbm", ".psd", ".tga", ".targa", ".iff", ".ilbm", ".lbm", ".pcx",
)

#: Format categories, the first that fits; exact types, then parts of a type.
STANDARD = ("image/jpeg", "image/png", "image/gif", "image/webp", "image/bmp")
MODERN = ("image/heic", "image/heif", "image/avif", "image/jxl")
CATEGORY_PARTS = (
    ("raw", ("raw", "cr2", "nef", "arw", "dng")),
    ("photoshop", ("photoshop", "psd")),
    ("targa", ("tga", "targa")),
    ("amiga", ("iff", "ilbm")),
    ("pcx", ("pcx",)),
)

OCTET_STREAM = "application/octet-stream"


def extension(name: Column) -> Column:
    """Lower-cased extension with its dot, before any ``?`` or ``#``; empty without a dot."""
    clean = F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), r"^([^?#]*)", 1)
    return F.regexp_extract(clean, r"(\.[^.]*)$", 1)


def is_image_mime(mime: Column) -> Column:
    low = F.lower(F.coalesce(mime, F.lit("")))
    return low.isin(*IMAGE_MIMES) | low.startswith("image/")


def is_image_name(name: Column) -> Column:
    return extension(name).isin(*IMAGE_EXTENSIONS)


def is_supported(mime: Column, name: Column, strict_binary: bool = True) -> Column:
    """An image by type or by name. ``strict_binary``: plain binaries count by name only."""
    by_type = is_image_mime(mime)
    if strict_binary:
        by_type = by_type & (F.lower(F.coalesce(mime, F.lit(""))) != OCTET_STREAM)
    return by_type | is_image_name(name)


def size_between(size: Column, low: int, high: int) -> Column:
    return F.coalesce(size, F.lit(0)).between(low, high)


def extension_enabled(name: Column, enabled: Sequence[str] | None) -> Column:
    """Names without an extension pass; so does everything if no list is given."""
    ext = extension(name)
    return F.lit(True) if enabled is None else (ext == "") | ext.isin(*enabled)


def format_category(mime: Column) -> Column:
    low = F.lower(mime)
    out = F.when(mime.isNull() | (mime == ""), "unknown").when(low.isin(*STANDARD), "standard").when(low.isin(*MODERN), "modern")
    for name, parts in CATEGORY_PARTS:
        fits = F.lit(False)
        for part in parts:
            fits = fits | low.contains(part)
        out = out.when(fits, name)
    return out.otherwise("other")


def is_folder_mime(mime: Column, folder_type: str) -> Column:
    return mime == folder_type


def aspect_compatible(wa: Column, ha: Column, wb: Column, hb: Column, tolerance_pct: float = 20.0) -> Column:
    """Like proportions, upright or turned; true where a side is missing or zero."""
    known = lambda c: F.coalesce(c, F.lit(0)) > 0
    ra, rb = wa / ha, wb / hb
    near = lambda x, y: F.abs(x - y) / F.greatest(x, y) <= tolerance_pct / 100
    return F.when(known(wa) & known(ha) & known(wb) & known(hb), near(ra, rb) | near(ra, 1 / rb)).otherwise(True)


def link(web_view_link: Column, id_: Column, template: str) -> Column:
    """A stored link, or one made from the id by ``template`` with ``{}`` for it; null without either."""
    before, _, after = template.partition("{}")
    return F.coalesce(web_view_link, F.concat(F.lit(before), id_, F.lit(after)))


def valid_folder_id(id_: Column) -> Column:
    return F.coalesce(F.trim(id_).rlike(r"^[-\w]{10,64}$"), F.lit(False))


def valid_client_id(id_: Column, suffix: str) -> Column:
    clean = F.trim(id_)
    fits = clean.endswith(suffix) & clean.rlike(r"^[\w\-.]+$") & (F.length(clean) <= 256) & (F.length(clean) > len(suffix))
    return F.coalesce(fits, F.lit(False))


def bytes_to_human(n: Column) -> Column:
    """1536 as ``1.5 KB``; a dash where nothing is to be shown."""
    out = F.when(n.isNull() | (n <= 0), "—")
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        v = n / float(1024**power)
        whole = F.format_string("%.0f " + unit, F.floor(v + 0.5).cast("double"))
        one = F.format_string("%.1f " + unit, F.floor(v * 10 + 0.5) / 10)
        out = out.when(v >= 1, whole if power == 0 else F.when(v >= 10, whole).otherwise(one))
    return out.otherwise("0 B")


def human_duration(ms: Column) -> Column:
    s = F.floor(ms / 1000 + 0.5).cast("long")
    minutes, rest = F.floor(s / 60).cast("long"), (s % 60).cast("string")
    return F.when(ms.isNull() | (ms < 0), "—").when(minutes <= 0, F.concat(rest, F.lit("s"))).otherwise(F.concat(minutes.cast("string"), F.lit("m "), F.lpad(rest, 2, "0"), F.lit("s")))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def escape_html(s: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(char), F.lit(name))
    return s


def sized_link(link_: Column, width: int = 256) -> Column:
    """A thumbnail link with its size parameter set."""
    return F.when(link_.rlike(r"=s\d+"), F.regexp_replace(link_, r"=s\d+(-c)?", f"=s{width}")).otherwise(F.concat(link_, F.lit(f"=s{width}")))
