"""Model names of the cloud providers: grammar, canonical form, endpoint, strategy and batch size.  A wrong name gives null.

Whatever a caller may write into a host or path is checked as a whole (`\\A … \\z`, so that no final line break slips by).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BATCHES = {"openai": 100, "mistral": 100, "gemini": 100, "huggingface": 100, "azure": 100, "titan": 1, "cohere": 96, "vertex": 250}
#: Default endpoints.
BEDROCK_ENDPOINT, VERTEX_ENDPOINT = "https://bedrock-runtime.{region}.amazonaws.com", "https://{location}-aiplatform.googleapis.com"
_PLACE, _NO_ID = r"\A[a-z0-9-]+\z", "[/?#]"


def _after(text: Column, at: Column) -> Column:
    return F.substring(text, at + 1, F.length(text))


def _hash_parts(model: Column) -> tuple[Column, Column, Column]:
    """What stands before the first `#`, what after, and whether there is one."""
    at = F.instr(model, "#")
    return F.when(at > 0, F.substring(model, F.lit(1), at - 1)).otherwise(model), F.when(at > 0, _after(model, at)), at > 0


def _with(base: Column, has: Column, tail: Column) -> Column:
    return F.when(has, F.concat(base, F.lit("#"), tail)).otherwise(base)


def _checked(ok: Column, **fields: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(*(c.alias(name) for name, c in fields.items())))


def endpoint(template: str, name: str, place: Column) -> Column:
    """An endpoint template with its `{name}` replaced; a template without one stays as it is."""
    return F.replace(F.lit(template), F.lit("{" + name + "}"), place)


def bedrock(model: Column, region: str = "us-east-1", template: str = BEDROCK_ENDPOINT) -> Column:
    """[<region>/]<model>[#<input type>] → canonical, model_id, qualifier, endpoint, strategy, max_batch."""
    head, kind, has = _hash_parts(model)
    at = F.instr(head, "/")
    where = F.when(at > 0, F.substring(head, F.lit(1), at - 1)).otherwise(F.lit(region))
    name = F.when(at > 0, _after(head, at)).otherwise(head)
    titan, cohere = name.startswith("amazon.titan-embed"), name.startswith("cohere.embed")
    ok = where.rlike(_PLACE) & ~name.rlike(_NO_ID) & (titan | cohere) & ~(has & (kind == "")) & ~(titan & has)
    kind = F.when(cohere, F.coalesce(kind, F.lit("search_document")))
    return _checked(
        ok, canonical=_with(F.concat(where, F.lit("/"), name), cohere, kind), model_id=name, qualifier=kind, endpoint=endpoint(template, "region", where),
        strategy=F.when(titan, "titan").otherwise("cohere"), max_batch=F.when(titan, BATCHES["titan"]).otherwise(BATCHES["cohere"]),
    )


def vertex_host(where: Column, template: str = VERTEX_ENDPOINT) -> Column:
    """`global` and the multi-regions have hosts of their own under the default template; any other template is filled in."""
    plain = endpoint(template, "location", where)
    if template != VERTEX_ENDPOINT:
        return plain
    return F.when(where == "global", "https://aiplatform.googleapis.com").when(where.isin("us", "eu"), F.concat(F.lit("https://aiplatform."), where, F.lit(".rep.googleapis.com"))).otherwise(plain)


def vertex(model: Column, location: str = "us-central1", project: str | None = "my-project", template: str = VERTEX_ENDPOINT) -> Column:
    """[<location>/<project>/]<model>[#<task>] → canonical, model_id, qualifier, endpoint, strategy, max_batch.  Without a
    default project, a bare model name is wrong."""
    head, task, has = _hash_parts(model)
    parts = F.split(head, "/")
    long = F.size(parts) == 3
    where, owner = F.when(long, F.get(parts, 0)).otherwise(F.lit(location)), F.when(long, F.get(parts, 1)).otherwise(F.lit(project))
    name = F.when(long, F.get(parts, 2)).otherwise(F.get(parts, 0))
    ok = F.size(parts).isin(1, 3) & where.rlike(_PLACE) & owner.rlike(_PLACE) & (name != "") & ~name.rlike("[?]") & ~(has & (task == ""))
    path = F.concat(vertex_host(where, template), F.lit("/v1/projects/"), owner, F.lit("/locations/"), where, F.lit("/publishers/google/models"))
    return _checked(ok, canonical=_with(F.concat_ws("/", where, owner, name), has, task), model_id=name, qualifier=task, endpoint=path, strategy=F.lit("vertex"), max_batch=F.lit(BATCHES["vertex"]))


def azure(model: Column, version: str = "2024-05-01-preview", openai_base: str | None = "https://azure", foundry_base: str | None = "https://foundry") -> Column:
    """[foundry:]<deployment>[#<input type>] → canonical, model_id, qualifier, endpoint, strategy, max_batch; `#` is for the
    foundry surface only, and a surface without a base URL is not there."""
    head, kind, has = _hash_parts(model)
    foundry = head.startswith("foundry:")
    name = F.when(foundry, _after(head, F.lit(len("foundry:")))).otherwise(head)
    base = F.when(foundry, F.lit(foundry_base)).otherwise(F.lit(openai_base))
    ok = (name != "") & base.isNotNull() & ~(has & (~foundry | (kind == "")))
    path = F.concat(base, F.when(foundry, F.lit(f"/models/embeddings?api-version={version}")).otherwise(F.lit("/openai/v1/embeddings")))
    canonical = F.when(foundry, F.concat(F.lit("foundry:"), name, F.lit(f"@{version}"))).otherwise(F.concat(F.lit("openai:"), name))
    return _checked(ok, canonical=_with(canonical, has, kind), model_id=name, qualifier=kind, endpoint=path, strategy=F.when(foundry, "foundry").otherwise("azure_openai"), max_batch=F.lit(BATCHES["azure"]))


def simple(model: Column, base: Column, strategy: Column) -> Column:
    """The four providers with one wire: the model's name is the canonical form, the configured base URL the endpoint."""
    return _checked(model.isNotNull() & base.isNotNull(), canonical=model, model_id=model, qualifier=F.lit(None).cast("string"), endpoint=base, strategy=strategy, max_batch=F.lit(100))
