"""The asset table: its columns, defaults, and the media families that classify a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSET = T.StructType.fromJson(
    {"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (
        ("uris", "string"), ("mime", "string"), ("width", "integer"), ("height", "integer"), ("channels", "integer"), ("depth", "integer"),
        ("hash", "string"), ("size", "long"), ("has_audio", "boolean"), ("duration", "integer"), ("num_frames", "integer"), ("frame_rate", "float"),
        ("blob", "binary"), ("captions", {"type": "array", "elementType": "string", "containsNull": True}), ("chunk_offsets", {"type": "array", "elementType": "integer", "containsNull": True}))]}
)

# Extensions by family, as the reference has them.
IMAGE = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".ico", ".tif", ".tiff", ".avif")
ANIMATION = (".gif", ".webp", ".avif")
VIDEO = (".mp4", ".webm", ".avi", ".mkv", ".mov", ".flv", ".wmv", ".m4v", ".mpg", ".mpeg")
AUDIO = (".mp3", ".wav", ".ogg", ".flac", ".m4a", ".wma", ".aac", ".aiff", ".aifc", ".aif", ".au", ".snd", ".mid", ".midi", ".mka")
TEXT = (".txt", ".md")
APPLICATION = (".pdf", ".psd", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".rtf", ".epub")

#: In the order in which a family claims an extension that two of them have.
IMPORT_ORDER = (("animation", ANIMATION), ("image", IMAGE), ("video", VIDEO), ("audio", AUDIO), ("text", TEXT), ("application", APPLICATION))
EXPORT_ORDER = (("image", IMAGE), ("animation", ANIMATION), ("video", VIDEO), ("audio", AUDIO), ("text", TEXT), ("application", APPLICATION))
#: Allowed MIME fallbacks by family.
MIME_OF = {"image": "image/png", "animation": "image/gif", "video": "video/mp4", "audio": "audio/wav", "text": "text/plain", "application": "application/octet-stream"}


def extension(path: Column) -> Column:
    """The lower-cased suffix with its dot, or ''."""
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1))


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def family(path: Column, order=IMPORT_ORDER) -> Column:
    """The media family by suffix: import calls .gif an animation, export an image."""
    own, found = extension(path), F.when(F.lit(False), "")
    for name, suffixes in order:
        found = found.when(own.isin(*suffixes), name)
    return found


def with_defaults(assets: DataFrame) -> DataFrame:
    """Nulls of stored scalar columns become 0, 0.0, false or ''; lists and blobs stay null."""
    default = {"string": "", "integer": 0, "long": 0, "boolean": False, "float": 0.0}
    kinds = {f.name: f.dataType.typeName() for f in ASSET}
    return assets.withColumns({c: F.coalesce(F.col(c), F.lit(default[kinds[c]]).cast(ASSET[c].dataType)) for c in assets.columns if kinds.get(c) in default})


def conform(frame: DataFrame) -> DataFrame:
    """`frame` with all asset columns, missing ones null, in the asset table's order and types."""
    return frame.select(*((F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ASSET))
