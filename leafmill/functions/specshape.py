"""Whether a parsed specification has the shape that rendering it needs.

Where a part is opened it must be an object; where it is only searched for a key it may
also be a list or a text that does not hold the key. One odd part rejects the document.
"""

from __future__ import annotations

from leafmill.schema import HTTP_METHODS


class Odd(Exception):
    pass


def opened(value) -> dict:
    if not isinstance(value, dict):
        raise Odd
    return value


def inside(value, key: str):
    """What ``value`` holds under ``key``; ``Odd`` itself if it holds nothing there."""
    if isinstance(value, dict):
        return value.get(key, None) if key in value else Odd
    if not isinstance(value, (list, str)) or key in value:
        raise Odd
    return Odd


def reference(value) -> bool:
    """Whether a schema is a reference, which must be text."""
    ref = inside(value, "$ref")
    if ref is not Odd and not isinstance(ref, str):
        raise Odd
    return ref is not Odd


def _property(details) -> None:
    if opened(details).get("type", "object") == "array" and "items" in details:
        opened(details["items"])
        reference(details["items"])
    else:
        reference(details)


def _content(section) -> None:
    for kind in opened(section).values():
        schema = inside(kind, "schema")
        if schema is not Odd:
            reference(schema)


def _endpoint(details) -> None:
    opened(details)
    listed = details.get("parameters") or []
    if not isinstance(listed, list):
        raise Odd
    for parameter in listed:
        opened(opened(parameter).get("schema", {}))
    if "requestBody" in details:
        _content(opened(details["requestBody"]).get("content", {}))
    for response in opened(details.get("responses", {})).values():
        if "content" in opened(response):
            _content(response["content"])
    for example in opened(details.get("examples", {})).values():
        inside(example, "value")


def is_renderable(spec: dict) -> bool:
    try:
        opened(spec.get("info", {}))
        models = inside(spec["components"], "schemas") if "components" in spec else Odd
        models = spec.get("definitions") if models is Odd else models
        for model in opened(models).values() if models else []:
            inside(model, "description")
            fields = inside(model, "properties")
            for details in opened(fields).values() if fields is not Odd else []:
                _property(details)
        for methods in opened(spec.get("paths", {})).values():
            for method, details in opened(methods).items():
                if method in HTTP_METHODS:
                    _endpoint(details)
    except Odd:
        return False
    return True
