"""Content keys as column expressions: normalised text, owner ids and length-prefixed digests."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the code points of Unicode White_Space.
WHITE = "\u0009-\u000d \u0085   -     　"


def normalize_text(text: Column) -> Column:
    """Runs of white space become one space; none at the ends.  Letter case stays."""
    return F.trim(F.regexp_replace(text, f"[{WHITE}]+", " "))


def owner_id(api_key: Column) -> Column:
    """The only thing kept of an API key."""
    return F.sha2(api_key, 256)


def _field(x: Column | str) -> list[Column]:
    c = F.lit(x) if isinstance(x, str) else x
    return [F.octet_length(c).cast("string"), F.lit(":"), c]


def text_key(owner: Column, provider: Column, scope: Column, model: Column, version: Column, text: Column) -> Column:
    """SHA-256 over length-prefixed fields, so no field can run into the next."""
    return F.sha2(F.concat(*(p for f in ("text", owner, provider, scope, model, version, text) for p in _field(f))), 256)


def image_key(owner: Column, provider: Column, scope: Column, model: Column, version: Column, mime: Column, data: Column) -> Column:
    return F.sha2(F.concat(*(p for f in ("image", owner, provider, scope, model, version, mime, data) for p in _field(f))), 256)


def base64_line(data: Column) -> Column:
    """Base64 without the line breaks that Spark's own function may put in."""
    return F.regexp_replace(F.base64(data), "\r\n", "")


def cache_scope(endpoint: Column, canonical: Column, kit: Column) -> Column:
    return F.concat_ws("\0", endpoint, canonical, kit)
