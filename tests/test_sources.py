import json
import zipfile

from auditlake.sources import evidence, packages
from pyspark.sql import functions as F

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:o="urn:schemas-microsoft-com:office:office"'
BODY = f"""<w:document {NS}><w:body>
<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>one </w:t></w:r><m:oMath><m:r><m:t>x</m:t></m:r></m:oMath><w:r><w:br/><w:t>two</w:t></w:r></w:p>
<w:p><w:r><w:object><o:OLEObject ProgID="Equation.AxMath"/></w:object></w:r></w:p>
<w:p><w:r><w:object><o:OLEObject ProgID="Equation.3"/></w:object></w:r></w:p></w:body></w:document>"""
HEADER = f"<w:hdr {NS}><w:p><m:oMath><m:r><m:t>y</m:t></m:r></m:oMath></w:p></w:hdr>"


def package(path, body=BODY):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/header1.xml", HEADER)
        z.writestr("../evil.xml", "x")


def test_packages(spark, tmp_path):
    package(tmp_path / "a.docx")
    (tmp_path / "~$a.docx").write_bytes(b"lock")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    found = packages.parts(packages.read_packages(spark, str(tmp_path)))
    assert sorted((r.path.rsplit("/", 1)[1], r.part_name) for r in found.select("path", "part_name").collect() if r.part_name) == [("a.docx", "word/document.xml"), ("a.docx", "word/header1.xml")]
    assert found.where("part_name is null").count() == 1
    tokens = packages.tokens(found)
    texts = {(r.story, r.p): r for r in packages.paragraph_texts(tokens).collect()}
    first = texts["word/document.xml", 1]
    assert (first.plain, first.contract, first.formulas, first.soft_breaks) == ("one two", "one ￼\ntwo", 1, 1)
    row = packages.inventory(tokens).first()
    assert (row.native, row.converted, row.foreign, row.outside_main) == (1, 1, 1, 1)


def test_changed_parts(spark, tmp_path):
    for name, body in (("a", BODY), ("b", BODY.replace("two", "three"))):
        (tmp_path / name).mkdir()
        package(tmp_path / name / "x.docx", body)
    one, two = (packages.parts(packages.read_packages(spark, str(tmp_path / n))) for n in "ab")
    named = [d.withColumn("name", F.element_at(F.split("path", "/"), -1)) for d in (one, two)]
    assert [(r.name, r.part_name) for r in packages.changed_parts(*named, ["name"]).collect()] == [("x.docx", "word/document.xml")]
    # two packages compared with themselves
    assert packages.changed_parts(*(d.unionByName(d.withColumn("name", F.lit("y"))) for d in (named[0], named[0])), ["name"]).count() == 0


def test_parts_that_are_no_xml_and_text_boxes(spark, tmp_path):
    package(tmp_path / "bad.docx", "<w:document")
    inner = BODY.replace("<w:t>two</w:t>", "<w:t>two</w:t><w:p><w:r><w:t>boxed</w:t></w:r></w:p>")
    package(tmp_path / "box.docx", inner)
    texts = packages.paragraph_texts(packages.tokens(packages.parts(packages.read_packages(spark, str(tmp_path)))))
    main = [r.plain for r in texts.where("story = 'word/document.xml'").orderBy("p").collect()]
    assert main[:2] == ["one two", "boxed"]
    deep = "<a>" * 5000 + "</a>" * 5000
    assert sum(1 for _ in packages._walk(packages._root(deep.encode()))) == 5000


def test_evidence(spark, tmp_path):
    (tmp_path / "a.json").write_text("﻿" + json.dumps({"schema": "x-visual-review/v2", "pages": [{"page": 1, "image_sha256": "h", "passed": None}]}))
    (tmp_path / "b.json").write_text(json.dumps({"schema": "other/v1"}))
    good, bad = evidence.read_evidence(spark, str(tmp_path), "visual-review/v2")
    assert good.selectExpr("inline(pages)").collect()[0].passed is None
    assert [r.schema for r in bad.collect()] == ["other/v1"]


def test_functions_on_packages_hold_a_few_rows(spark):
    """However many rows Spark puts into a batch; before, a function got all of them at once."""
    import pandas as pd
    from auditlake.sources import packages as P

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(b)]})

    for width, most in ((10, P.PIECE_ROWS), (100_000, 50)):
        rows = spark.range(0, 1000, 1, 1).selectExpr("id", f"cast(repeat('x', {width}) as binary) as content")
        got = [r.n for r in P.by_pieces(rows, sizes, "n int").collect()]
        assert sum(got) == 1000 and max(got) <= most
