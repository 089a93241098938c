"""Elements of XML streams by local name, read one at a time."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree


def local_name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def texts_in(element, name: str) -> Iterator[str]:
    """Non-empty texts of the descendants with a local name, in document order."""
    for e in element.iter():
        if local_name(e.tag) == name and e.text and e.text.strip():
            yield e.text.strip()


def elements(stream, name: str) -> Iterator:
    """Elements with a local name. What has been read is let go, so memory holds one object at a time."""
    above = []
    for event, e in ElementTree.iterparse(stream, events=("start", "end")):
        if event == "start":
            above.append(e)
            continue
        above.pop()
        if local_name(e.tag) == name:
            yield e
            e.clear()
            if above:
                above[-1].remove(e)
