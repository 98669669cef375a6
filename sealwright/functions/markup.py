"""Batch function that reads links and anchors out of HTML pages.

The link surface is a table: an attribute name leads to the kinds of part that it makes, each on
the elements named (none: on every element) and, where marked, only when it has a value.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd

PART_SCHEMA = "bundle_id string, path string, kind string, pos int, value string"
#: The part of a page without text.
UNREADABLE = "unreadable"

# Attribute -> (kind, elements, needs a value).
SURFACE = {
    "data": (("reference", ("object",), True),),
    "href": (("base", ("base",), False), ("reference", (), True)),
    "id": (("anchor", (), True),),
    "name": (("anchor", ("a",), True),),
    "poster": (("reference", ("video",), True),),
    "src": (("reference", (), True),),
    "srcset": (("srcset", (), False),),
}


class _Elements(HTMLParser):
    """Collects elements with their attributes; names come in lower case."""

    def __init__(self):
        super().__init__()
        self.elements: list[tuple[str, list[tuple[str, str | None]]]] = []

    def handle_starttag(self, tag, attrs):
        self.elements.append((tag, attrs))


def parts_of(html: str | None) -> list[tuple[str, int, str | None]]:
    """``(kind, pos, value)`` of a page, ``pos`` counting within its kind; one unreadable part for null."""
    if html is None:
        return [(UNREADABLE, 0, None)]
    page = _Elements()
    page.feed(html)
    listed: dict[str, list[str | None]] = {}
    for element, attributes in page.elements:
        for attribute, value in attributes:
            for kind, only, valued in SURFACE.get(attribute, ()):
                if (not only or element in only) and not (valued and value is None):
                    listed.setdefault(kind, []).append(value)
    return [(kind, pos, value) for kind, values in listed.items() for pos, value in enumerate(values)]


def page_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(bundle_id, path, html)`` to one row per reference, anchor, unsupported or unreadable part."""
    for batch in batches:
        rows = [(row.bundle_id, row.path, *part) for row in batch.itertuples(index=False) for part in parts_of(row.html)]
        yield pd.DataFrame(rows, columns=["bundle_id", "path", "kind", "pos", "value"])
