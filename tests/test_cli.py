import pytest
from auditlake import cli


def test_arguments():
    args = cli.parser().parse_args(["cache-analyze", "folder", "--least", "3"])
    assert (args.verb, args.least) == ("cache-analyze", 3)
    for bad in (["cache-analyze", "f", "--least", "0"], ["nothing"], []):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)
    assert cli.tolerance("3.0") == 3.0
    for bad in ("-1", "nan", "inf"):
        with pytest.raises(Exception, match="finite"):
            cli.tolerance(bad)


def test_verbs(spark, tmp_path):
    from test_sources import BODY, package

    for side, body in (("a", BODY), ("b", BODY), ("c", BODY.replace("two", "three"))):
        (tmp_path / side).mkdir()
        package(tmp_path / side / "x.docx", body)
    assert cli.main(["inspect", str(tmp_path / "a")]) == 2  # a foreign object blocks
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "y.docx").write_bytes(b"no package")
    assert cli.main(["inspect", str(tmp_path / "d")]) == 2
    assert cli.main(["compare", str(tmp_path / "a"), str(tmp_path / "b")]) == 2  # equal, but a review is still due
    assert cli.main(["compare", str(tmp_path / "a"), str(tmp_path / "c")]) == 1
    assert cli.main(["cache-analyze", str(tmp_path / "a")]) == 1
    assert cli.main(["query", "page_set_equality", "/root/testdata/sf0.001", "--out", str(tmp_path / "out")]) == 0
