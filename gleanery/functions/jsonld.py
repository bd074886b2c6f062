"""Structured data in pages: the recursive part that column expressions cannot express."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from typing import Any

from gleanery.functions.dates import ISO_DATE

# Object types that describe an article.
ARTICLE_TYPES = ("NewsArticle", "Article", "ReportageNewsArticle")

_ISO = re.compile(ISO_DATE)


# A half of a character that escapes in the text spelled without its other half.
_LONE = re.compile("[\ud800-\udfff]")


def writable(text: str) -> str:
    """``text`` with lone surrogates replaced: no table can hold them."""
    return _LONE.sub("\ufffd", text) if _LONE.search(text) else text


def _parsed(text: str) -> list[Any]:
    """The JSON value, if it is one; text nested beyond what the parser takes is none."""
    try:
        return [json.loads(text)]
    except (ValueError, RecursionError):
        return []


def _snippets(text: str) -> Iterator[str]:
    """Shortest brace-to-brace snippets, for scripts that are not valid JSON, in one pass."""
    start = text.find("{")
    while start >= 0:
        end = text.find("}", start)
        if end < 0:
            return
        yield text[start : end + 1]
        start = text.find("{", end + 1)


def documents(scripts: Iterable[str]) -> Iterator[Any]:
    """Every JSON value found in the script bodies, in page order."""
    for script in scripts:
        body = (script or "").strip()
        if not body:
            continue
        found = _parsed(body) or [value for part in _snippets(body) for value in _parsed(part)]
        yield from found


def objects(value: Any) -> Iterator[dict]:
    """All objects below ``value``, each before its children, without recursion depth limits."""
    pending = [value]
    while pending:
        node = pending.pop()
        if isinstance(node, dict):
            yield node
            pending.extend(reversed(list(node.values())))
        elif isinstance(node, list):
            pending.extend(reversed(node))


def listed_urls(scripts: Iterable[str]) -> list[str]:
    """``url``, ``@id`` and ``item.url`` of every object; nested items are met twice."""
    urls = []
    for document in documents(scripts):
        for node in objects(document):
            item = node.get("item")
            candidates = [node.get("url"), node.get("@id")]
            candidates.append(item.get("url") if isinstance(item, dict) else None)
            urls.extend(writable(c) for c in candidates if isinstance(c, str))
    return urls


def article_fields(scripts: Iterable[str]) -> dict[str, str | None] | None:
    """Fields of the first object whose type is an article type."""
    for document in documents(scripts):
        for node in objects(document):
            kinds = node.get("@type")
            kinds = kinds if isinstance(kinds, list) else [kinds]
            if not any(kind in ARTICLE_TYPES for kind in kinds if isinstance(kind, str)):
                continue
            any_date = _ISO.search(_printed(node))
            return {
                "headline": _text(node.get("headline")),
                "description": _text(node.get("description")),
                "body": _text(node.get("articleBody")),
                "modified": _scalar(node.get("dateModified")),
                "published": _scalar(node.get("datePublished")),
                "any_date": any_date.group(0) if any_date else None,
            }
    return None


def _text(value: Any) -> str | None:
    return writable(value) if isinstance(value, str) else None


def _scalar(value: Any) -> str | None:
    return None if value is None else writable(_printed(value))


def _printed(value: Any) -> str:
    """The value as text; one nested too deeply for that as its scalars."""
    try:
        return str(value)
    except RecursionError:
        return " ".join(str(v) for node in objects(value) for v in node.values() if isinstance(v, (str, int, float)))
