import json
import urllib.error
import urllib.request

import pytest

from quillon import cli
from quillon.plans import ir
from quillon.sources import files
from quillon.streaming.http import HttpScoring

MODEL = "<PMML version='4.1'><DataDictionary><DataField name='v' optype='continuous' dataType='double'/></DataDictionary><BaselineModel functionName='regression'><MiningSchema><MiningField name='v'/></MiningSchema><TestDistributions field='v' testStatistic='zValue'><Baseline><GaussianDistribution mean='10' variance='4'/></Baseline></TestDistributions></BaselineModel></PMML>"


def test_formats_and_headers():
    assert [files.format_of(p) for p in ("a.csv", "b.XML", "c.nab", "d.xtbl", "e.tsv")] == ["csv", "xml", "nab", "parquet", "csv"]
    with pytest.raises(ValueError):
        files.format_of("a.bin")
    assert files.read_header('a [integer],"b", c [category]\n', ",") == [("a", "bigint"), ("b", None), ("c", "string")]
    assert files.sniff(["1", "", "2"]) == "bigint" and files.sniff(["1", "x"]) == "string" and files.sniff([]) == "string"


def test_csv_headers_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("x,z\n1,2\n")
    assert files.read_csv(spark, str(tmp_path / "a.csv")).dtypes == [("x", "bigint"), ("y", "bigint")]
    with pytest.raises(ValueError):
        files.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "in.csv").write_text("k,v\n1,14\n2,\n")
    (tmp_path / "m.pmml").write_text(MODEL)
    assert cli.main(["score", str(tmp_path / "m.pmml"), str(tmp_path / "in.csv"), str(tmp_path / "out.parquet"), "--keep", "k"]) == 0
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out.parquet")).collect())) == [(1, 2.0), (2, None)]
    (tmp_path / "n.pmml").write_text(MODEL.replace("mean='10'", "mean='11'"))
    assert cli.main(["diff", str(tmp_path / "m.pmml"), str(tmp_path / "n.pmml")]) == 1 and "@mean" in capsys.readouterr().out


def test_http(spark, tmp_path):
    served = HttpScoring(spark, ir.load(MODEL), "v double", str(tmp_path))
    try:
        ask = lambda body: json.load(urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{served.port}/", body.encode(), method="POST"), timeout=40))
        assert ask('{"v": 14}') == {"score": 2.0}
        with pytest.raises(urllib.error.HTTPError):
            ask("not json")
    finally:
        served.stop()


def test_lookup_in_a_located_table(spark, tmp_path):
    from quillon.plans import models

    (tmp_path / "t.xml").write_text("<table><row><a>1</a><o>one</o></row><row><a>2</a><o>two</o></row></table>")
    doc = ir.load(f"<PMML><DataDictionary><DataField name='a' optype='categorical' dataType='string'/></DataDictionary><TransformationDictionary><DerivedField name='r'><MapValues outputColumn='o'><FieldColumnPair field='a' column='a'/><TableLocator><Extension name='file' value='{tmp_path}/*.xml'/></TableLocator></MapValues></DerivedField></TransformationDictionary></PMML>")
    df = spark.createDataFrame([("1",), ("2",), ("3",), (None,)], "a string")
    got = [tuple(r) for r in models.transform(df, doc, ("r",), masks=True).collect()]
    assert got == [("one", 0), ("two", 0), (None, 2), (None, 1)]
