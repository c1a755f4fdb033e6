"""Packages with edits applied: text of one part is replaced in place, embedded parts are cloned, all else is copied byte by byte."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.sources.packages import by_pieces, MAIN, _root

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_TYPES = "[Content_Types].xml"


class Refused(ValueError):
    """Why a package is not written."""


def text_spans(body: bytes) -> dict[tuple[int, int], tuple[int, int, str]]:
    """Of every text node by (paragraph, place in it), from 1: where its bytes begin and end, and its text.

    Paragraphs count in document order; a text belongs to the innermost paragraph around it.
    """
    if body[:2] in (b"\xff\xfe", b"\xfe\xff") or not re.search(rb'^(?!.*?encoding=)|encoding=["\']utf-8["\']', body[:200], re.I | re.S):
        raise Refused("encoding")
    parser = expat.ParserCreate(namespace_separator=" ")
    spans: dict[tuple[int, int], tuple[int, int, str]] = {}
    around: list[list[int]] = []
    count, text, begin = 0, None, 0

    def start(name: str, attributes: dict) -> None:
        nonlocal count, text, begin
        if name == f"{_W} p":
            count += 1
            around.append([count, 0])
        elif name == f"{_W} t" and around:
            around[-1][1] += 1
            # the tag ends at the first > outside quotes
            begin = parser.CurrentByteIndex + len(re.match(rb"<(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", body[parser.CurrentByteIndex :])[0])
            text = []

    def end(name: str) -> None:
        nonlocal text
        if name == f"{_W} p":
            around.pop()
        elif name == f"{_W} t" and text is not None:
            if body[begin - 2 : begin] != b"/>":
                spans[tuple(around[-1])] = begin, parser.CurrentByteIndex, "".join(text)
            text = None

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: text.append(data) if text is not None else None
    try:
        parser.Parse(body, True)
    except expat.ExpatError:
        raise Refused("not_xml") from None
    return spans


def edited(body: bytes, edits: list[tuple[int, int, str, str]]) -> bytes:
    """A part with texts replaced; each edit (p, t, old, new) must find what it replaces."""
    spans, out, at = text_spans(body), [], 0
    if len({(p, t) for p, t, _, _ in edits}) < len(edits):
        raise Refused("two_edits_of_one_text")
    for p, t, old, new in sorted(edits):
        if (p, t) not in spans:
            raise Refused("text_not_found")
        begin, end, now = spans[p, t]
        if now != old:
            raise Refused("stale_text")
        out += [body[at:begin], escape(new).encode()]
        at = end
    return b"".join([*out, body[at:]])


def _opened(content: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        raise Refused("not_a_package") from None


def _packed(z: zipfile.ZipFile, changed: dict[str, bytes], added: dict[str, bytes]) -> bytes:
    """The entries in their order and with their own dates; only the changed ones have new bytes."""
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as out:
        for entry in z.infolist():
            out.writestr(entry, changed.get(entry.filename, z.read(entry)), entry.compress_type)
        for name, body in added.items():
            out.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body, zipfile.ZIP_DEFLATED)
    return file.getvalue()


def _written(packages: DataFrame, work: DataFrame, column: str, write: Callable[[bytes, list], tuple[bytes, list]], extra: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, todo in zip(batch["path"], batch["content"], batch[column], strict=True):
                made, status, told = content, "copied", []
                if todo is not None and len(todo):
                    try:
                        (made, told), status = write(content, [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in todo]), "written"
                    except Refused as e:
                        status = f"refused:{e}"
                digests = [hashlib.sha256(x).hexdigest() for x in (content, made)]
                yield pd.DataFrame([(path, made, status, *digests, told)], columns=["path", "content", "status", "sha256_before", "sha256_after", column])

    both = packages.select("path", "content").join(work, "path", "left")
    return by_pieces(both, run, f"path string, content binary, status string, sha256_before string, sha256_after string, {column} {extra}")


def rewritten(packages: DataFrame, edits: DataFrame, part: str = MAIN) -> DataFrame:
    """``path, content, status, sha256_before, sha256_after, edits`` of every package, with the edits (path, p, t, old, new) of its texts applied.

    status: ``copied`` where there is no edit (the bytes are those of the input), ``written``, or ``refused:`` with the reason,
    and the input's bytes: all edits of a package are applied, or none.
    """

    def write(content: bytes, todo: list) -> tuple[bytes, list]:
        z = _opened(content)
        if part not in z.namelist():
            raise Refused("part_missing")
        return _packed(z, {part: edited(z.read(part), todo)}, {}), [{"p": p, "t": t, "old": old, "new": new} for p, t, old, new in todo]

    grouped = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.col("p").cast("bigint").alias("p"), F.col("t").cast("bigint").alias("t"), "old", "new"))).alias("edits"))
    return _written(packages, grouped, "edits", write, "array<struct<p:bigint,t:bigint,old:string,new:string>>")


def _attribute(node, name: str) -> str:
    return node.get(name) or ""


def cloned(packages: DataFrame, clones: DataFrame, part: str = MAIN) -> DataFrame:
    """Packages in which what relationships (path, rel_id) of a part lead to is copied under the next free names and numbers.

    A copy is named like its original with the next number of that name; its relationship has the next number of all.
    Refused: a relationship that is missing or leads outside, a part that is missing, a kind without content type.
    ``clones`` of the result lists rel_id, new_id and new_part.
    """
    folder, file = posixpath.split(part)
    rels = f"{folder}/_rels/{file}.rels"

    def write(content: bytes, todo: list) -> tuple[bytes, list]:
        z = _opened(content)
        names = set(z.namelist())
        if rels not in names or _TYPES not in names:
            raise Refused("part_missing")
        roots = {name: _root(z.read(name)) for name in (rels, _TYPES)}
        if None in roots.values():
            raise Refused("not_xml")
        known = {r.get("Id"): r for r in roots[rels]}
        last = max((int(m[1]) for i in known if (m := re.fullmatch(r"rId(\d+)", i or ""))), default=0)
        added, told, relations, types = {}, [], [], []
        for (rel_id,) in todo:
            old = known.get(rel_id)
            if old is None or old.get("TargetMode") == "External":
                raise Refused("relationship_missing_or_external")
            source = posixpath.normpath(posixpath.join(folder, _attribute(old, "Target")))
            if source not in names or not source.startswith(f"{folder}/"):
                raise Refused("part_missing")
            stem, dot, extension = source.rpartition(".")
            stem = re.sub(r"\d+$", "", stem)
            numbers = [int(m[1]) for n in names | set(added) if (m := re.fullmatch(rf"{re.escape(stem)}(\d+)\.{re.escape(extension)}", n))]
            target, last = f"{stem}{max(numbers, default=0) + 1}.{extension}", last + 1
            override = next((_attribute(x, "ContentType") for x in roots[_TYPES] if x.get("PartName") == f"/{source}"), None)
            if not dot or override is None and not any(_attribute(x, "Extension").lower() == extension.lower() for x in roots[_TYPES]):
                raise Refused("no_content_type")
            added[target] = z.read(source)
            relations.append(f'<Relationship Id="rId{last}" Type={quoteattr(_attribute(old, "Type"))} Target={quoteattr(posixpath.relpath(target, folder))}/>')
            types += [f"<Override PartName={quoteattr('/' + target)} ContentType={quoteattr(override)}/>"] if override is not None else []
            told.append({"rel_id": rel_id, "new_id": f"rId{last}", "new_part": target})
        changed = {rels: _inserted(z.read(rels), relations)} | ({_TYPES: _inserted(z.read(_TYPES), types)} if types else {})
        return _packed(z, changed, added), told

    grouped = clones.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rel_id"))).alias("clones"))
    return _written(packages, grouped, "clones", write, "array<struct<rel_id:string,new_id:string,new_part:string>>")


def _inserted(body: bytes, elements: list[str]) -> bytes:
    """New elements before the end of the root."""
    at = body.rindex(b"</")
    return body[:at] + "".join(elements).encode() + body[at:]


def save(packages: DataFrame, source: str, target: str) -> None:
    """Packages as a table of path and content; never in place, never over something."""
    if posixpath.normpath(source) == posixpath.normpath(target):
        raise ValueError("the target is the source")
    packages.select("path", "content").write.mode("errorifexists").parquet(target)
