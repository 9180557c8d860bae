"""Model documents as plain nodes: XML or JSON text in, a tree of tag, attributes, children and text out.

Namespaces are dropped. Content is only data; nothing of it is evaluated.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field


class ModelError(ValueError):
    """A document that is malformed or uses what no scorer supports."""


#: Model elements of the standard that have no scorer here.
UNSCORED = ("AssociationModel", "TextModel", "SupportVectorMachineModel", "Scorecard", "NeuralNetwork", "TimeSeriesModel", "SequenceModel", "NearestNeighborModel", "GeneralRegressionModel")
MODELS = ("BaselineModel", "TreeModel", "RegressionModel", "NaiveBayesModel", "ClusteringModel", "RuleSetModel", "MiningModel")
PREDICATES = ("SimplePredicate", "SimpleSetPredicate", "CompoundPredicate", "True", "False")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)
    text: str = ""

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.attrs.get(name, default)

    def need(self, name: str) -> str:
        if name not in self.attrs:
            raise ModelError(f"{self.tag} needs {name}")
        return self.attrs[name]

    def number(self, name: str, default: float | None = None) -> float | None:
        found = self.attrs.get(name)
        return default if found is None else float(found)

    def all(self, *tags: str) -> list[Node]:
        return [c for c in self.children if c.tag in tags]

    def first(self, *tags: str) -> Node | None:
        return next((c for c in self.children if c.tag in tags), None)

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.walk()


def plain_tag(tag: str) -> str:
    """Vendors' extension elements (X-vendor-Name) go by their name alone; terms that would clash with a standard element keep an X."""
    m = re.fullmatch(r"X-[A-Za-z]+-(\w+)", tag)
    if not m:
        return tag
    return f"X-{m[1]}" if m[1] == "PredictorTerm" else m[1]


def from_xml(text: str) -> Node:
    """Parses XML; raises ModelError if it is not well-formed."""

    def turn(e: ET.Element) -> Node:
        return Node(plain_tag(e.tag.rpartition("}")[2]), {k.rpartition("}")[2]: v for k, v in e.attrib.items()}, [turn(c) for c in e if isinstance(c.tag, str)], (e.text or "").strip())

    try:
        return turn(ET.fromstring(text))
    except ET.ParseError as err:
        raise ModelError(str(err)) from err


def from_json(text: str) -> Node:
    """Parses the JSON rendering: {"tag", "attrs", "children", "text"}."""

    def turn(o: dict) -> Node:
        return Node(plain_tag(o["tag"]), {k: str(v) for k, v in o.get("attrs", {}).items()}, [turn(c) for c in o.get("children", [])], o.get("text", ""))

    return turn(json.loads(text))


def to_json(node: Node) -> str:
    def turn(n: Node) -> dict:
        return {"tag": n.tag, "attrs": n.attrs, "children": [turn(c) for c in n.children], "text": n.text}

    return json.dumps(turn(node))


def to_xml(node: Node) -> str:
    def turn(n: Node) -> ET.Element:
        e = ET.Element(n.tag, n.attrs)
        e.text = n.text or None
        e.extend(turn(c) for c in n.children)
        return e

    return ET.tostring(turn(node), encoding="unicode")


def load(text: str) -> Node:
    """XML or JSON, told apart by the first character."""
    return from_json(text) if text.lstrip().startswith("{") else from_xml(text)


def difference(a: Node, b: Node, digits: int = 8, path: str = "") -> list[str]:
    """Paths at which two documents differ; numbers are compared to ``digits`` significant figures."""

    def same(x: str, y: str) -> bool:
        try:
            return f"{float(x):.{digits}g}" == f"{float(y):.{digits}g}"
        except ValueError:
            return x == y

    here = f"{path}/{a.tag}"
    if a.tag != b.tag:
        return [f"{here}: {b.tag}"]
    out = [f"{here}@{k}" for k in sorted({*a.attrs, *b.attrs}) if k not in a.attrs or k not in b.attrs or not same(a.attrs[k], b.attrs[k])]
    if not same(a.text, b.text):
        out.append(f"{here}#text")
    if len(a.children) != len(b.children):
        return [*out, f"{here}: {len(a.children)} and {len(b.children)} children"]
    return out + [d for x, y in zip(a.children, b.children, strict=True) for d in difference(x, y, digits, here)]


def split_segments(model: Node, parts: int) -> list[Node]:
    """Copies of a document, each with its share of the first segmentation's segments, for separate runs."""
    segmentation = next((n for n in model.walk() if n.tag == "Segmentation"), None)
    if segmentation is None:
        raise ModelError("no segmentation to split")
    segments = [c for c in segmentation.children if c.tag == "Segment"]
    out = []
    for k in range(parts):
        copy = from_json(to_json(model))
        target = next(n for n in copy.walk() if n.tag == "Segmentation")
        mine = [from_json(to_json(s)) for s in segments[k::parts]]
        target.children = [c for c in target.children if c.tag != "Segment"] + mine
        out.append(copy)
    return out


def edit(node: Node, tag: str, attribute: str, value: str) -> int:
    """Sets an attribute on every element of a tag; returns how many."""
    hits = [n for n in node.walk() if n.tag == tag]
    for n in hits:
        n.attrs[attribute] = value
    return len(hits)
