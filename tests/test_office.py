"""Writing packages, cloning parts, images, lists, formula nodes: what is kept, and what is refused."""

import io
import zipfile

import numpy as np
import pytest
from auditlake.operators.lists import list_numbers
from auditlake.plans import office
from auditlake.sources import images, nodes, writer
from auditlake.sources import packages as P

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
BODY = f"""<?xml version='1.0' encoding='UTF-8'?><!-- <w:t>no</w:t> --><w:document {NS}><w:p a="x>y"><w:r><w:t xml:space='preserve' b="1>2">é &amp; ü</w:t></w:r><w:r><w:t/></w:r>
<w:txbx><w:p><w:r><w:t>inner</w:t></w:r></w:p></w:txbx><w:r><w:t>last</w:t></w:r></w:p><w:p><w:r><w:t><![CDATA[a<b]]></w:t></w:r></w:p></w:document>""".encode()


def package(parts, compress=zipfile.ZIP_DEFLATED):
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w", compress) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return file.getvalue()


def entries(content):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {e.filename: (z.read(e), e.date_time, e.compress_type) for e in z.infolist()}


def test_spans_of_texts():
    spans = writer.text_spans(BODY)
    assert {k: v[2] for k, v in spans.items()} == {(1, 1): "é & ü", (2, 1): "inner", (1, 3): "last", (3, 1): "a<b"}
    assert BODY[slice(*spans[1, 1][:2])] == "é &amp; ü".encode()


def test_an_edit_changes_its_bytes_and_no_others():
    made = writer.edited(BODY, [(1, 3, "last", "<&>"), (1, 1, "é & ü", "")])
    assert made == BODY.replace("é &amp; ü".encode(), b"").replace(b">last<", b">&lt;&amp;&gt;<")
    assert writer.edited(BODY, [(3, 1, "a<b", "c")]).count(b"CDATA") == 0


@pytest.mark.parametrize(("reason", "edits", "body"), [("text_not_found", [(9, 1, "", "x")], BODY), ("stale_text", [(1, 3, "first", "x")], BODY), ("two_edits_of_one_text", [(1, 3, "last", "x"), (1, 3, "last", "y")], BODY), ("not_xml", [(1, 1, "", "")], b"<w"), ("encoding", [(1, 1, "", "")], "<a/>".encode("utf-16")), ("encoding", [(1, 1, "", "")], b"<?xml version='1.0' encoding='latin-1'?><a/>"), ("text_not_found", [(1, 2, "", "x")], BODY)])
def test_edits_that_are_refused(reason, edits, body):
    with pytest.raises(writer.Refused, match=reason):
        writer.edited(body, edits)


def test_a_round_trip_changes_one_part(spark):
    whole = package({P.MAIN: BODY, "word/styles.xml": b"<s/>", "stored.bin": b"x" * 1000})
    bare = package({"other.xml": b"<a/>"})
    rows = [("a", whole), ("b", whole), ("c", b"broken"), ("d", bare), ("e", b"broken")]
    packages = spark.createDataFrame(rows, "path string, content binary")
    edits = spark.createDataFrame([("a", 1, 3, "last", "new"), ("c", 1, 1, "x", "y"), ("d", 1, 1, "x", "y")], "path string, p int, t int, old string, new string")
    made = writer.rewritten(packages, edits)
    got = {r.path: r for r in made.collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "written", "b": "copied", "c": "refused:not_a_package", "d": "refused:part_missing", "e": "copied"}
    assert all(bytes(got[k].content) == dict(rows)[k] and got[k].sha256_before == got[k].sha256_after for k in "bcde")
    before, after = entries(whole), entries(bytes(got["a"].content))
    assert list(before) == list(after) and [k for k in before if before[k] != after[k]] == [P.MAIN]
    changed = P.changed_parts(P.parts(packages), P.parts(made), ["path"]).collect()
    assert [(r.path, r.part_name) for r in changed] == [("a", P.MAIN)]


def test_packages_are_saved_neither_in_place_nor_over_others(spark, tmp_path):
    packages = spark.createDataFrame([("a", b"x")], "path string, content binary")
    with pytest.raises(ValueError):
        writer.save(packages, str(tmp_path / "in"), f"{tmp_path}/in/")
    writer.save(packages, str(tmp_path / "in"), str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        writer.save(packages, str(tmp_path / "in"), str(tmp_path / "out"))


def cloned(spark, parts, *ids):
    packages = spark.createDataFrame([("a", package(parts))], "path string, content binary")
    return writer.cloned(packages, spark.createDataFrame([("a", i) for i in ids], "path string, rel_id string")).first()


def test_clones_take_the_next_names_and_numbers(spark):
    rels = '<Relationships xmlns="r"><Relationship Id="rId7" Type="t/image" Target="media/image3.png"/><Relationship Id="x" Type="t/ole" Target="embeddings/oleObject1.bin"/><Relationship Id="rId2" Type="l" Target="http://x" TargetMode="External"/><Relationship Id="rId3" Type="l" Target="media/none.png"/><Relationship Id="rId4" Type="l" Target="media/a.odd"/></Relationships>'
    types = '<Types xmlns="c"><Default Extension="PNG" ContentType="image/png"/><Override PartName="/word/embeddings/oleObject1.bin" ContentType="ole"/></Types>'
    parts = {"[Content_Types].xml": types, P.MAIN: BODY, "word/_rels/document.xml.rels": rels, "word/media/image3.png": b"p", "word/media/image9.png": b"q", "word/media/a.odd": b"o", "word/embeddings/oleObject1.bin": b"o"}
    row = cloned(spark, parts, "rId7", "x")
    assert row.status == "written"
    assert [tuple(x) for x in row.clones] == [("rId7", "rId8", "word/media/image10.png"), ("x", "rId9", "word/embeddings/oleObject2.bin")]
    after = {k: v[0] for k, v in entries(bytes(row.content)).items()}
    assert after["word/media/image10.png"] == b"p" and after["word/embeddings/oleObject2.bin"] == b"o"
    links = {r.rel_id: r.target for r in P.relationships(P.parts(spark.createDataFrame([("a", bytes(row.content))], "path string, content binary"))).collect()}
    assert links["rId8"] == "word/media/image10.png" and links["rId9"] == "word/embeddings/oleObject2.bin" and links["rId2"] == "http://x"
    assert after["[Content_Types].xml"].count(b"oleObject2.bin") == 1
    for ids, reason in (("rId2",), "relationship_missing_or_external"), (("none",), "relationship_missing_or_external"), (("rId3",), "part_missing"), (("rId7", "rId4"), "no_content_type"):
        refused = cloned(spark, parts, *ids)
        assert refused.status == f"refused:{reason}" and refused.sha256_before == refused.sha256_after


def test_grey_levels():
    values = bytes(i * 7 % 256 for i in range(64))
    assert (images.grey(office.png(values)).ravel() == np.frombuffer(values, np.uint8)).all()
    for filters in (0, 1, 2, 3, 4):
        rng = np.random.RandomState(filters)
        pixels = rng.randint(0, 256, (5, 6, 3))
        raw, above = b"", np.zeros(18, int)
        for row in pixels.reshape(5, 18):
            left, corner = np.concatenate([[0] * 3, row[:-3]]), np.concatenate([[0] * 3, above[:-3]])
            near = left + above - corner
            options = np.stack([left, above, corner])
            paeth = options[np.abs(options - near).argmin(axis=0), np.arange(18)]
            guess = [0, left, above, (left + above) // 2, paeth][filters]
            raw += bytes([filters]) + ((row - guess) % 256).astype(np.uint8).tobytes()
            above = row
        chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + b"crc."
        data = images.SIGNATURE + chunk(b"IHDR", (6).to_bytes(4, "big") + (5).to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])) + chunk(b"IDAT", __import__("zlib").compress(raw))
        assert np.allclose(images.grey(data), pixels @ [0.299, 0.587, 0.114])


def test_images_that_cannot_be_read_say_so(spark):
    parts = {"word/media/a.png": office.png(bytes(64)), "word/media/b.emf": b"x", "word/media/c.png": office.png(bytes(64))[:40], "word/x.png": b""}
    got = images.image_statistics(P.parts(spark.createDataFrame([("a", package(parts))], "path string, content binary"))).collect()
    assert {r.part_name: (r.mean, r.dark, r.error is None) for r in got} == {"word/media/a.png": (0.0, 1.0, True), "word/media/b.emf": (None, None, False), "word/media/c.png": (None, None, False)}


def test_nested_levels_start_again(spark):
    levels = spark.createDataFrame([(1, "1", k, 10 * k + 1, "decimal") for k in range(3)], "doc int, num_id string, level int, start long, format string")
    shown = [("1", 0), ("1", 1), ("1", 1), ("0", 1), (None, None), ("1", 2), ("1", 1), ("1", 0), ("1", 1), ("1", 2), ("2", 0), ("1", 5)]
    rows = spark.createDataFrame([(1, p, n, k) for p, (n, k) in enumerate(shown)], "doc int, p long, num_id string, level int")
    got = [(r.p, r.number) for r in list_numbers(rows, levels, ["doc"]).orderBy("p").collect()]
    assert got == [(0, 1), (1, 11), (2, 12), (5, 21), (6, 13), (7, 2), (8, 11), (9, 21)]


def parts_of(spark, body):
    return P.parts(spark.createDataFrame([("a", package({P.MAIN: body}))], "path string, content binary"))


def test_the_hash_of_a_formula_is_that_of_its_meaning(spark):
    inner = "<m:oMath><m:r><m:t>x</m:t></m:r></m:oMath>"
    other = inner.replace("m:", "k:")
    body = f'<w:document {NS} xmlns:k="http://schemas.openxmlformats.org/officeDocument/2006/math"><w:p>{inner}tail{other}<m:oMath><m:r>{inner}<m:t>y</m:t></m:r></m:oMath></w:p></w:document>'
    a, b, c = nodes.formula_nodes(parts_of(spark, body)).orderBy("ordinal").collect()
    assert a.sha256 == b.sha256 != c.sha256 and (a.text, c.text) == ("x", "xy")
    assert [tuple(t) for t in c.tags] == [("oMath", 2), ("r", 2), ("t", 2)]


def test_widths_that_are_no_numbers_and_links_that_lead_outside(spark):
    for size, width in (("11906.4", 451.32), ("x", None), ("", None)):
        body = f'<w:document {NS}><w:sectPr><w:pgSz w:w="{size}"/><w:pgMar w:left="1440" w:right="1440"/></w:sectPr></w:document>'
        assert P.sections(parts_of(spark, body)).first().text_width == (None if width is None else pytest.approx(width))


def test_a_package_without_a_readable_entry_still_has_a_row(spark):
    rows = P.parts(spark.createDataFrame([("a", package({"../x": b""})), ("b", b"no")], "path string, content binary")).collect()
    assert sorted((r.path, r.part_name) for r in rows) == [("a", None), ("b", None)]


def test_runs_and_plain_mathematics(spark):
    body = f'<w:document {NS}><w:p><w:r><w:rPr><w:i/><w:rFonts w:ascii="F"/></w:rPr><w:t>ab</w:t></w:r><m:oMath><w:r><w:t>in</w:t></w:r></m:oMath><w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:t>2</w:t></w:r></w:p></w:document>'
    got = [(r.run, r.text, r.start, r.in_math, r.fonts, r.vertical, r.italic) for r in nodes.runs(parts_of(spark, body)).collect()]
    assert got == [(1, "ab", 0, False, ["F"], None, True), (2, "in", 2, True, [], None, False), (3, "2", 4, False, [], "superscript", False)]


def test_plain_mathematics_of_every_package(spark):
    """The rule on every run, taken from the turns without packages."""
    import re

    from auditlake.functions.tex import plain_math
    from auditlake.plans import catalogue
    from helpers import DATA

    turns = {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, re.sub("[^A-Za-z0-9 .,]", "", r.text).strip(" ")))
    want = []
    for conv, rows in turns.items():
        for p, (turn, x) in enumerate(sorted(rows), 1):
            first = x.split(" ")[0]
            for at, text, vertical in ((0, first, "superscript" if turn % 8 == 3 else None), (len(first), x[len(first) :], None)):
                found, kind = plain_math(text, x, at, vertical) if text else (False, None)
                want += [(str(conv), p, text, at, kind)] if found else []
    got = [(r.path, r.p, r.text, r.start, r.kind) for r in catalogue.queries()["office_plain_math"](spark, DATA).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and want
