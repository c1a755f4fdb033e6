"""Further scans of package parts: properties and numbers of paragraphs, list definitions, runs, object layout, formula nodes."""

from __future__ import annotations

import hashlib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.sources.packages import by_pieces, MAIN, STORY, M, O, W, _points, _root, _walk

V = "{urn:schemas-microsoft-com:vml}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _scan(parts: DataFrame, rows_of: Callable[[ET.Element], Iterator[tuple]], schema: str, stories: bool = False) -> DataFrame:
    """``path, story`` and the rows of each part; the main part, or all stories, or what ``parts`` was cut to.  What is no XML has none."""
    names = ["path", "story", *(f.split()[0] for f in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, name, body in zip(batch["path"], batch["part_name"], batch["content"], strict=True):
                root = _root(body)
                yield pd.DataFrame([(path, name, *r) for r in (rows_of(root) if root is not None else ())], columns=names).astype(object)

    kept = parts.where(F.col("part_name").rlike(f"^{STORY.pattern}$")) if stories else parts
    return by_pieces(kept.select("path", "part_name", "content"), run, f"path string, story string, {schema}")


def _main(parts: DataFrame) -> DataFrame:
    return parts.where(F.col("part_name") == MAIN)


def _value(node: ET.Element | None, name: str = "val") -> str | None:
    return None if node is None else node.get(f"{W}{name}")


def _whole(value: str | None) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def _paragraphs(root: ET.Element) -> Iterator[tuple[int, ET.Element]]:
    """Paragraphs in document order, numbered from 1; one within another counts too."""
    number = 0
    for node, _ in _walk(root):
        if node.tag == f"{W}p":
            number += 1
            yield number, node


def _own(paragraph: ET.Element) -> Iterator[tuple[ET.Element, frozenset]]:
    """Nodes of a paragraph without those of paragraphs within it."""
    return ((n, inside) for n, inside in _walk(paragraph, f"{W}p") if n is paragraph or n.tag != f"{W}p")


def paragraph_numbering(parts: DataFrame) -> DataFrame:
    """``path, story, p, style_id, num_id, level, outline, instr``: what each paragraph says itself; fields of both kinds in one text."""

    def rows(root: ET.Element) -> Iterator[tuple]:
        for p, node in _paragraphs(root):
            find = lambda name, node=node: _value(node.find(f"{W}pPr/{name}"))
            listed = node.find(f"{W}pPr/{W}numPr")
            # a list without a number is a list all the same
            num_id = None if listed is None else _value(listed.find(f"{W}numId")) or ""
            own = list(_own(node))
            instr = "".join(n.text or "" for n, _ in own if n.tag == f"{W}instrText")
            simple = [n.get(f"{W}instr", "") for n, _ in own if n.tag == f"{W}fldSimple"]
            level = None if listed is None else _whole(_value(listed.find(f"{W}ilvl"))) or 0
            yield p, find(f"{W}pStyle"), num_id, level, find(f"{W}outlineLvl"), " ".join([instr, *simple]).strip() or None

    return _scan(parts, rows, "p bigint, style_id string, num_id string, level int, outline string, instr string", stories=True)


def list_levels(parts: DataFrame) -> DataFrame:
    """``path, num_id, abstract_id, level, start, format, text``: each list through its instance, its abstract list and the overrides of its levels.

    An override without a level of its own keeps the abstract level and may only move its start.
    """

    def rows(root: ET.Element) -> Iterator[tuple]:
        def level(node: ET.Element) -> tuple:
            return _whole(_value(node.find(f"{W}start"))), _value(node.find(f"{W}numFmt")), _value(node.find(f"{W}lvlText"))

        abstract = {a.get(f"{W}abstractNumId"): {_whole(x.get(f"{W}ilvl")): level(x) for x in a.iter(f"{W}lvl")} for a in root.iter(f"{W}abstractNum")}
        for instance in root.iter(f"{W}num"):
            known = _value(instance.find(f"{W}abstractNumId"))
            levels = dict(abstract.get(known, {}))
            for override in instance.iter(f"{W}lvlOverride"):
                at, own = _whole(override.get(f"{W}ilvl")), override.find(f"{W}lvl")
                start, form, text = level(own) if own is not None else levels.get(at, (None, None, None))
                moved = _whole(_value(override.find(f"{W}startOverride")))
                levels[at] = moved if moved is not None else start, form, text
            for at, (start, form, text) in sorted((k, v) for k, v in levels.items() if k is not None):
                yield instance.get(f"{W}numId"), known, at, 1 if start is None else start, form, text

    found = _scan(parts.where(F.col("part_name") == "word/numbering.xml"), rows, "num_id string, abstract_id string, level int, start bigint, format string, text string")
    return found.drop("story")


def runs(parts: DataFrame) -> DataFrame:
    """``path, p, run, text, start, in_math, fonts, vertical, italic``: text runs of the main story with their offset in the paragraph."""

    def rows(root: ET.Element) -> Iterator[tuple]:
        for p, paragraph in _paragraphs(root):
            number = start = 0
            for node, inside in _own(paragraph):
                if node.tag != f"{W}r":
                    continue
                number += 1
                text = "".join(t.text or "" for t in node.findall(f"{W}t"))
                fonts = node.find(f"{W}rPr/{W}rFonts")
                yield p, number, text, start, f"{M}oMath" in inside, [] if fonts is None else sorted(fonts.attrib.values()), _value(node.find(f"{W}rPr/{W}vertAlign")), node.find(f"{W}rPr/{W}i") is not None
                start += len(text)

    return _scan(_main(parts), rows, "p bigint, run int, text string, start int, in_math boolean, fonts array<string>, vertical string, italic boolean").drop("story")


def object_layout(parts: DataFrame) -> DataFrame:
    """``path, ordinal, p, run, progid, position, width, height, dxa, dya, rel_id, image_id, ratio``: every embedded object and its shell.

    ``position`` is in points; ``ratio`` is its size against the height of the shell, null where either is unknown.
    """

    def rows(root: ET.Element) -> Iterator[tuple]:
        ordinal = 0
        for p, paragraph in _paragraphs(root):
            number = 0
            for node, _ in _own(paragraph):
                number += node.tag == f"{W}r"
                embedded = node.find(f"{W}object") if node.tag == f"{W}r" else None
                ole = None if embedded is None else embedded.find(f".//{O}OLEObject")
                if ole is None:
                    continue
                ordinal += 1
                raised = _whole(_value(node.find(f"{W}rPr/{W}position")))
                position = None if raised is None else raised / 2
                shape, image = embedded.find(f".//{V}shape"), embedded.find(f".//{V}imagedata")
                style = "" if shape is None else shape.get("style") or ""
                width, height = _points(style, "width"), _points(style, "height")
                ratio = abs(position) / height if position is not None and height and height > 0 else None
                yield ordinal, p, number, ole.get("ProgID") or "", position, width, height, _whole(embedded.get(f"{W}dxaOrig")), _whole(embedded.get(f"{W}dyaOrig")), ole.get(f"{R}id"), None if image is None else image.get(f"{R}id"), ratio

    schema = "ordinal bigint, p bigint, run int, progid string, position double, width double, height double, dxa bigint, dya bigint, rel_id string, image_id string, ratio double"
    return _scan(_main(parts), rows, schema).drop("story")


def formula_nodes(parts: DataFrame) -> DataFrame:
    """``path, ordinal, p, sha256, text, tags``: every native formula as a subtree of its own, hashed in canonical form, and the nodes it has by name.

    The canonical form does not depend on prefixes or on the order of attributes; a formula within another is part of it.
    """

    def rows(root: ET.Element) -> Iterator[tuple]:
        ordinal = 0
        for p, paragraph in _paragraphs(root):
            for node, inside in _own(paragraph):
                if node.tag != f"{M}oMath" or f"{M}oMath" in inside:
                    continue
                ordinal += 1
                tail, node.tail = node.tail, None
                canonical = ET.canonicalize(ET.tostring(node, encoding="unicode"), rewrite_prefixes=True)
                node.tail = tail
                tags: dict[str, int] = {}
                for inner in node.iter():
                    name = inner.tag.removeprefix(M)
                    tags[name] = tags.get(name, 0) + 1
                yield ordinal, p, hashlib.sha256(canonical.encode()).hexdigest(), "".join(t.text or "" for t in node.iter(f"{M}t")), sorted(tags.items())

    return _scan(_main(parts), rows, "ordinal bigint, p bigint, sha256 string, text string, tags array<struct<name:string,n:bigint>>").drop("story")
