"""Request parsing: bodies, bearer tokens, data URIs, TTL settings and the status a request gets."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _field(body: Column, name: str) -> tuple[Column, Column]:
    """A top-level field of a JSON object as a variant, and its type's name; both null if the body is broken or lacks it."""
    v = F.try_variant_get(F.try_parse_json(body), f"$.{name}", "variant")
    return v, F.schema_of_variant(v)


def input_texts(body: Column) -> Column:
    """The top-level `input` as an array: a string is one element, an array of strings is taken as it is, anything else is
    null."""
    v, kind = _field(body, "input")
    one, many = F.array(F.try_variant_get(v, "$", "string")), F.try_variant_get(v, "$", "array<string>")
    return F.when(kind == "STRING", one).when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(many, lambda x: x.isNotNull()), many)


def model_name(body: Column) -> Column:
    """The top-level `model`, if it is a string."""
    v, kind = _field(body, "model")
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))


def is_json(body: Column) -> Column:
    return F.try_parse_json(body).isNotNull()


def bearer_token(header: Column) -> Column:
    """What follows the exact prefix `Bearer `; null for any other scheme."""
    return F.when(header.startswith("Bearer "), F.substring(header, F.lit(8), F.length(header)))


def data_uri(uri: Column) -> Column:
    """mime and data of `data:<mime>;base64,<data>`; null without the prefix, the separator or a mime type."""
    at = F.instr(uri, ";base64,")
    ok = uri.startswith("data:") & (at > 6)
    return F.when(ok, F.struct(F.substring(uri, F.lit(6), at - 6).alias("mime"), F.substring(uri, at + 8, F.length(uri)).alias("data")))


def format_data_uri(mime: Column, data: Column) -> Column:
    return F.format_string("data:%s;base64,%s", mime, data)


def mime_type(file: Column) -> Column:
    ext = F.lower(F.regexp_extract(file, r"\.([^.]+)\z", 1))
    return F.when(ext == "png", "image/png").when(ext.isin("jpg", "jpeg"), "image/jpeg").otherwise(F.raise_error(F.concat(F.lit("no image: "), file)))


def ttl_seconds(setting: Column) -> Column:
    """A positive whole number; everything else means that entries never expire."""
    n = F.when(setting.rlike(r"\A\+?[0-9]+\z"), setting.try_cast("bigint"))
    return F.when(n > 0, n)


def or_default(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def auth_mode(value: Column) -> Column:
    return F.when(value == "api-key", "api-key").otherwise("bearer")


def status(parsed: Column, inputs: Column, model: Column, token: Column, registered: Column) -> Column:
    """400 for a broken body, 422 for a missing model or wrong input, then 401, then 404, else 200."""
    return F.when(~parsed, 400).when(model.isNull() | inputs.isNull(), 422).when(token.isNull(), 401).when(~registered, 404).otherwise(200)


def failure(kind: Column) -> Column:
    """What a failed step answers: 502 if it was the provider's, 500 if the store's."""
    return F.when(kind == "provider", 502).when(kind == "store", 500)
