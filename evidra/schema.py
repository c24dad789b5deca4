"""Closed shapes of JSON values: what providers answer and what runs are saved as."""

from __future__ import annotations

import math

#: str, int, num and bool, each with ? where null is allowed; [x] a list of x, [] an empty one; {name: x} an object of just these members.
CITATIONS = [{"source_id": "str", "excerpt": "str"}]
CLAIM = {"value": "str?", "evidence": CITATIONS}
# The categories of a contact.
CATEGORIES = ("general", "sales", "support", "press", "other_business")
EXTRACTION = {
    "company_name": CLAIM,
    "overview_sentence_1": CLAIM,
    "overview_sentence_2": CLAIM,
    "target_audience": CLAIM,
    "contact_points": [{"email": "str", "category": CATEGORIES, "evidence": CITATIONS}],
    "team_members": [{"name": "str", "role": "str?", "linkedin_url": "str?", "relationship_evidence": CITATIONS, "role_evidence": CITATIONS, "profile_evidence": CITATIONS}],
}
_KINDS = {"str": str, "int": int, "num": (int, float), "bool": bool}
_NAMES = {"str": "string", "int": "integer", "num": "number", "bool": "boolean"}


class Misfit(ValueError):
    """Names the member that does not fit, never its value."""


def fit(value, shape, at: str = "value"):
    """value, if it has a shape; else raises."""
    if isinstance(shape, tuple):
        ok = value in shape
    elif isinstance(shape, list):
        ok = isinstance(value, list)
        for x in value if ok else ():
            fit(x, shape[0], at)
    elif isinstance(shape, dict):
        ok = isinstance(value, dict) and value.keys() == shape.keys()
        for k in shape if ok else ():
            fit(value[k], shape[k], f"{at}.{k}")
    else:
        kind = shape.rstrip("?")
        ok = (value is None and shape[-1] == "?") or (isinstance(value, _KINDS[kind]) and isinstance(value, bool) == (kind == "bool") and not (isinstance(value, float) and not math.isfinite(value)))
    if not ok:
        raise Misfit(at)
    return value


def json_schema(shape) -> dict:
    """The JSON schema of a shape, all members required and no others allowed."""
    if isinstance(shape, tuple):
        return {"type": "string", "enum": list(shape)}
    if isinstance(shape, list):
        return {"type": "array", "items": json_schema(shape[0])} if shape else {"type": "array", "maxItems": 0}
    if isinstance(shape, dict):
        return {"type": "object", "properties": {k: json_schema(v) for k, v in shape.items()}, "required": list(shape), "additionalProperties": False}
    one = {"type": _NAMES[shape.rstrip("?")]}
    return {"anyOf": [one, {"type": "null"}]} if shape[-1] == "?" else one
