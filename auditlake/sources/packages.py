"""Document packages (zip of XML parts) as tables.

Packages are read by ``binaryFile`` and opened inside the tasks; a package is the unit of work,
its parts are rows.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import stat
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# XML namespaces of the format and parts that hold a story.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
O = "{urn:schemas-microsoft-com:office:office}"  # noqa: E741
STORY = re.compile(r"word/(document|footnotes|endnotes|comments|header\d+|footer\d+)\.xml")
MAIN = "word/document.xml"
LIMIT_NODES = frozenset(f"{M}{name}" for name in ("limLow", "limUpp", "sSub", "sSup", "sSubSup"))

#: Unpacked bytes of the largest part that is read.
MOST_BYTES = 512 << 20

_PARTS = "path string, doc_sha256 string, part_no int, part_name string, part_sha256 string, content binary"
_TOKENS = "path string, story string, p int, pos int, kind string, text string, in_table boolean, progid string, style_id string, ole_style string, font string, vertical string, width double, height double, math_group int"


#: Bytes and rows of one batch that a function on packages is given; see ``by_pieces``.
PIECE_BYTES, PIECE_ROWS = 4 << 20, 256


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of PIECE_ROWS rows at most, and of one row where rows are large."""
    rows = max(1, min(PIECE_ROWS, PIECE_BYTES * batch.num_rows // max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def by_pieces(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInPandas(function, schema)`` whose function holds a few packages at a time, however many rows Spark puts in a batch."""
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (piece.to_pandas() for batch in batches for piece in _pieces(batch))
        for frame in function(frames):
            found = pa.RecordBatch.from_pandas(frame, schema=wanted, preserve_index=False)
            yield from _pieces(found)

    return df.mapInArrow(run, schema)


def read_packages(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content`` of the packages under a folder; lock files are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(folder)
    return files.where(~F.element_at(F.split("path", "/"), -1).startswith("~$")).select("path", "content")


def safe_entry(name: str) -> bool:
    """No absolute path, drive, or step out of the package."""
    steps = name.replace("\\", "/").split("/")
    return not (name.startswith(("/", "\\")) or ".." in steps or re.match(r"[A-Za-z]:", name))


def parts(packages: DataFrame) -> DataFrame:
    """One row per part, in the order of the package; what cannot be opened, or has no entry that may be read, has a single row without part.

    Packages are opened one after the other; entries that step out of the package, are links, are encrypted,
    unpack to more than ``MOST_BYTES`` or cannot be read are left out.
    """

    def opened(path: str, content: bytes) -> list[tuple]:
        digest = hashlib.sha256(content).hexdigest()
        rows = []
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for n, entry in enumerate(z.infolist(), 1):
                    if not safe_entry(entry.filename) or stat.S_ISLNK(entry.external_attr >> 16) or entry.flag_bits & 1:
                        continue
                    try:
                        with z.open(entry) as stream:
                            body = stream.read(MOST_BYTES + 1)
                        if len(body) > MOST_BYTES:
                            continue
                    except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError):
                        continue
                    rows.append((path, digest, n, entry.filename, hashlib.sha256(body).hexdigest(), body))
        except zipfile.BadZipFile:
            rows = []
        return rows or [(path, digest, None, None, None, None)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(opened(path, content), columns=["path", "doc_sha256", "part_no", "part_name", "part_sha256", "content"])

    return by_pieces(packages, run, _PARTS)


def _root(body: bytes) -> ET.Element | None:
    """The root of a part; null for what is no XML."""
    try:
        return ET.fromstring(body)
    except ET.ParseError:
        return None


def _walk(top: ET.Element, stop: str | None = None) -> Iterator[tuple[ET.Element, frozenset]]:
    """Nodes in document order with the tags around them; what lies below a ``stop`` node within is left out."""
    waiting = [(top, frozenset())]
    while waiting:
        node, inside = waiting.pop()
        yield node, inside
        if node is top or node.tag != stop:
            below = inside | {node.tag}
            waiting.extend((child, below) for child in reversed(node))


def _points(style: str, name: str) -> float | None:
    """A length in points from a list of style declarations."""
    for part in style.split(";"):
        key, _, value = part.partition(":")
        if key.strip().lower() == name and value.strip().endswith("pt"):
            try:
                return float(value.strip()[:-2])
            except ValueError:
                return None
    return None


def _number(value: str) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


def _tokens(story: str, body: bytes) -> Iterator[tuple]:
    """Tokens of every paragraph in document order: text, breaks, tabs, objects, formulas, fields.

    A paragraph within another (a text box) has its own tokens, which the outer one does not repeat.
    """
    simple = {f"{W}br": ("br", "\n"), f"{W}cr": ("br", "\n"), f"{W}tab": ("tab", "\t"), f"{W}drawing": ("drawing", "￼")}
    root = _root(body)
    number = 0
    for paragraph, around in _walk(root) if root is not None else ():
        if paragraph.tag != f"{W}p":
            continue
        number += 1
        style = paragraph.find(f"{W}pPr/{W}pStyle")
        style_id = None if style is None else style.get(f"{W}val")
        position, font, group = 0, None, 0
        for node, inside in _walk(paragraph, f"{W}p"):
            if node.tag == f"{W}p" and node is not paragraph:
                continue
            kind, text, progid, look, size = None, None, None, None, (None, None)
            if node.tag == f"{W}r":
                fonts = node.find(f"{W}rPr/{W}rFonts")
                font = None if fonts is None else fonts.get(f"{W}ascii") or fonts.get(f"{W}hAnsi")
                raised = node.find(f"{W}rPr/{W}vertAlign")
                vertical = None if raised is None else raised.get(f"{W}val")
            elif node.tag == f"{M}oMathPara":
                group += 1
            if node.tag == f"{W}t" and f"{M}oMath" not in inside:
                kind, text = "text", node.text or ""
            elif node.tag in simple and f"{W}pPr" not in inside:
                kind, text = simple[node.tag]
            elif node.tag == f"{M}oMath" and f"{M}oMath" not in inside:
                kind, text = "math", "".join(t.text or "" for t in node.iter(f"{M}t"))
            elif node.tag in LIMIT_NODES:
                base = node.find(f"{M}e")
                kind, text = node.tag[len(M) :], "" if base is None else "".join(t.text or "" for t in base.iter(f"{M}t"))
            elif node.tag == f"{O}OLEObject":
                kind, text, progid = "object", "￼", node.get("ProgID") or ""
            elif node.tag.endswith("}shape") and node.get("style"):
                kind, look = "shape", node.get("style")
                size = _points(look, "width"), _points(look, "height")
            elif node.tag == f"{W}fldChar":
                kind = {"begin": "fldBegin", "end": "fldEnd"}.get(node.get(f"{W}fldCharType", ""))
            elif node.tag == f"{W}instrText":
                kind, text = "instr", node.text or ""
            if kind:
                position += 1
                is_run = f"{W}r" in inside
                yield story, number, position, kind, text, f"{W}tbl" in around, progid, style_id, look, font if is_run else None, vertical if is_run else None, *size, group if f"{M}oMathPara" in inside else None


def tokens(package_parts: DataFrame) -> DataFrame:
    """Paragraph tokens of all stories; a part that is no XML has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _TOKENS.split(", ")]
        for batch in batches:
            for path, name, body in zip(batch["path"], batch["part_name"], batch["content"], strict=True):
                yield pd.DataFrame([(path, *t) for t in _tokens(name, body)], columns=names)

    stories = package_parts.where(F.col("part_name").rlike(f"^{STORY.pattern}$")).select("path", "part_name", "content")
    return by_pieces(stories, run, _TOKENS)


def styles(package_parts: DataFrame) -> DataFrame:
    """``path, style_id, based_on, name, num_id, outline`` of the styles of each package."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, body in zip(batch["path"], batch["content"], strict=True):
                root = _root(body)
                rows = []
                for style in root.iter(f"{W}style") if root is not None else ():
                    found = [style.find(f"{W}{x}") for x in ("basedOn", "name", "pPr/" + W + "numPr/" + W + "numId", "pPr/" + W + "outlineLvl")]
                    rows.append((path, style.get(f"{W}styleId"), *(None if x is None else x.get(f"{W}val") for x in found)))
                yield pd.DataFrame(rows, columns=["path", "style_id", "based_on", "name", "num_id", "outline"])

    return by_pieces(package_parts.where(F.col("part_name") == "word/styles.xml").select("path", "content"), run, "path string, style_id string, based_on string, name string, num_id string, outline string")


def relationships(package_parts: DataFrame) -> DataFrame:
    """``path, part_name, rel_id, kind, target, external`` of every relationship, and the hash of the part it leads to; a target outside stays as it is and has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, name, body in zip(batch["path"], batch["part_name"], batch["content"], strict=True):
                root = _root(body)
                folder, file = name.replace("_rels/", "").removesuffix(".rels").rpartition("/")[::2]
                rows = []
                for r in root if root is not None else ():
                    external, target = r.get("TargetMode") == "External", r.get("Target") or ""
                    inner = posixpath.normpath(posixpath.join("/" + folder, target)).lstrip("/")
                    rows.append((path, f"{folder}/{file}".lstrip("/"), r.get("Id"), (r.get("Type") or "").rpartition("/")[2], target if external else inner, external))
                yield pd.DataFrame(rows, columns=["path", "part_name", "rel_id", "kind", "target", "external"])

    rels = package_parts.where(F.endswith("part_name", F.lit(".rels"))).select("path", "part_name", "content")
    found = by_pieces(rels, run, "path string, part_name string, rel_id string, kind string, target string, external boolean")
    there = package_parts.select("path", F.col("part_name").alias("target"), F.lit(False).alias("external"), F.col("part_sha256").alias("target_sha256"))
    return found.join(there, ["path", "target", "external"], "left")


def sections(package_parts: DataFrame) -> DataFrame:
    """``path, section, text_width`` in points: the page without its margins; null where a size is no number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, body in zip(batch["path"], batch["content"], strict=True):
                root = _root(body)
                rows = []
                for n, section in enumerate(root.iter(f"{W}sectPr") if root is not None else (), 1):
                    page, margin = section.find(f"{W}pgSz"), section.find(f"{W}pgMar")
                    twips = [_number(x.get(f"{W}{k}", "0")) if x is not None else 0.0 for x, k in ((page, "w"), (margin, "left"), (margin, "right"))]
                    rows.append((path, n, None if None in twips or not twips[0] else (twips[0] - twips[1] - twips[2]) / 20))
                yield pd.DataFrame(rows, columns=["path", "section", "text_width"]).astype({"text_width": float})

    return by_pieces(package_parts.where(F.col("part_name") == MAIN).select("path", "content"), run, "path string, section int, text_width double")


def formula_places(found: DataFrame) -> DataFrame:
    """``path, ordinal, p``: the paragraph of each native formula of the main story, numbered through the document."""
    from pyspark.sql import Window

    rows = found.where((F.col("story") == MAIN) & (F.col("kind") == "math"))
    return rows.select("path", F.row_number().over(Window.partitionBy("path").orderBy("p", "pos")).alias("ordinal"), "p", "text", "math_group")


def paragraph_texts(found: DataFrame) -> DataFrame:
    """Two projections of each paragraph: ``plain`` drops objects, ``contract`` keeps a mark where one stood."""
    row = F.struct("pos", "kind", "text")
    lists = found.groupBy("path", "story", "p").agg(F.array_sort(F.collect_list(row)).alias("t"))

    def joined(*kinds: str):
        return F.array_join(F.transform(F.filter("t", lambda x: x["kind"].isin(*kinds)), lambda x: F.when(x["kind"].isin("object", "math", "drawing"), "￼").otherwise(x["text"])), "")

    count = lambda kind: F.size(F.filter("t", lambda x: x["kind"] == kind)).cast("long")
    return lists.select("path", "story", "p", joined("text").alias("plain"), joined("text", "br", "tab", "object", "math", "drawing").alias("contract"), count("math").alias("formulas"), count("object").alias("objects"), count("br").alias("soft_breaks"))


def inventory(found: DataFrame) -> DataFrame:
    """Counts of one package: paragraphs, native formulas, converted and foreign objects, those outside the main story."""
    from auditlake.functions.text import object_kind

    kind = object_kind(F.col("progid"))
    main = F.col("story") == MAIN
    return found.groupBy("path").agg(
        F.countDistinct(F.when(main, F.col("p"))).alias("paragraphs"),
        F.count_if(main & (F.col("kind") == "math")).alias("native"),
        F.count_if(main & (F.col("kind") == "object") & (kind == "axmath")).alias("converted"),
        F.count_if((F.col("kind") == "object") & (kind != "axmath")).alias("foreign"),
        F.count_if(~main & F.col("kind").isin("math", "object")).alias("outside_main"),
    )


def document_states(package_parts: DataFrame, found: DataFrame) -> DataFrame:
    """One row for every package, also those that cannot be opened: its counts (0 where unknown) and its state.

    ``invalid``: no package, or one without an entry that may be read; ``no_document``: its main part is missing or no XML;
    else what its formulas and objects say.
    """
    from auditlake.operators.rules import source_state

    known = package_parts.groupBy("path").agg(F.count("part_name").alias("parts"), F.count_if(F.col("part_name") == MAIN).alias("main"))
    counts = inventory(found)
    names = [c for c in counts.columns if c != "path"]
    readable = found.where(F.col("story") == MAIN).select("path").distinct().withColumn("readable", F.lit(True))
    both = known.join(counts, "path", "left").join(readable, "path", "left")
    zero = F.lit(0).cast("long")
    both = both.select("path", "parts", "main", "readable", *(F.coalesce(c, zero).alias(c) for c in names))
    state = F.when(F.col("parts") == 0, "invalid").when((F.col("main") == 0) | F.col("readable").isNull(), "no_document").otherwise(source_state(F.col("foreign") + F.col("outside_main"), F.col("native"), F.col("converted")))
    return both.select("path", *names, state.alias("state"))


def changed_parts(one: DataFrame, two: DataFrame, key: list[str]) -> DataFrame:
    """Parts that differ between two versions of packages, with both hashes; ``key`` names the package on both sides."""
    a, b = one.select(*key, "part_name", F.col("part_sha256").alias("before")), two.select(*key, "part_name", F.col("part_sha256").alias("after"))
    return a.join(b, [*key, "part_name"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])
