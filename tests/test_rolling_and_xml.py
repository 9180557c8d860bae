import datetime as dt

from pyspark.sql import functions as F

from quillon.operators import nested_xml as X
from quillon.operators import rolling as R

SCHEMA = "row_id long, cnt long, sale_date date, automaker string, recorded_at timestamp, entity string, bucket int"
D = dt.date


def rolled(spark, rows):
    df = spark.createDataFrame([(*r, dt.datetime(2020, 1, 1), "clash", 1) for r in rows], SCHEMA)
    return R.trailing(R.daily_totals(df, F.lower(F.trim("automaker")), F.col("sale_date"), F.col("cnt"), F.col("row_id"), F.col("recorded_at")))


def test_trailing_days(spark):
    rows = [(1, 10, D(2020, 1, 1), " X "), (1, 10, D(2020, 1, 1), "x"), (2, 5, D(2020, 2, 15), "x"), (3, None, D(2020, 2, 20), "X"), (4, 7, None, "x"), (5, 3, D(2020, 1, 3), None), (None, 2, D(2020, 1, 1), "x"), (None, 2, D(2020, 1, 1), "x")]
    got = {r.day: r for r in rolled(spark, rows).collect()}
    assert len(got) == 51
    assert got[D(2020, 1, 1)].day_total == 14 and got[D(2020, 1, 30)].total_30 == 14 and got[D(2020, 1, 31)].total_30 == 0
    assert got[D(2020, 1, 31)].mean_30 is None and got[D(2020, 2, 20)].total_7 == 5 and got[D(2020, 2, 20)].day_no == 51
    kinds = {r.day: r.day_kind for r in R.remarkable_days(rolled(spark, rows)).collect()}
    assert kinds[D(2020, 1, 30)] == "quiet" and kinds[D(2020, 2, 20)] == "surge" and D(2020, 1, 31) not in kinds


def test_empty(spark):
    assert rolled(spark, []).count() == 0


def found(spark, origin, text, name="f"):
    col = {"models": "pmmlfile", "configs": "configfile"}[origin]
    df = spark.createDataFrame([(name, text, "clash", "clash")], f"n string, {col} string, tag string, pk string")
    return sorted((r.tag, r.parent_pk, r.pk) for r in X.tagged_rows(df, origin, "n", col).collect())


def test_models(spark):
    text = "<p:PMML xmlns:p='u'><p:Segmentation><p:Segment id='a'><p:Segmentation><p:Segment/><p:Segment id=''><p:FieldValueCount field='f' value='v &lt; 1' count='2'/></p:Segment></p:Segmentation></p:Segment></p:Segmentation><!-- <Segment id='no'/> --><FieldValueCount value='w'/></p:PMML>"
    assert found(spark, "models", text) == [("count", "", "=w"), ("count", "a/", "f=v < 1"), ("segment", "", "a"), ("segment", "a", "a/"), ("segment", "a", "a/#1")]


def test_configs(spark):
    text = "<A><SegmentationSchema><G><EnumeratedDimension field='c'><Selection value='&quot;x&quot;'/></EnumeratedDimension></G><W/><G><PartitionedDimension field='n'><Partition low='1' high='2'/><Partition high='9'/></PartitionedDimension></G></SegmentationSchema></A>"
    assert found(spark, "configs", text) == [("bin", "G#1/c", 'G#1/c/"x"'), ("bin", "G#2/n", "G#2/n/..9"), ("bin", "G#2/n", "G#2/n/1..2"), ("dimension", "G#1", "G#1/c"), ("dimension", "G#2", "G#2/n")]


def test_broken_null_empty_and_repeats(spark):
    for text in ("<a><b></a>", "NULL", "", " <?xml version='1.0'?><a/>", "<a/><b/>"):
        assert found(spark, "models", text) == []
    assert found(spark, "models", "<?xml version='1.0' encoding='ISO-8859-1'?><a><Segment id='é'/></a>") == [("segment", "", "é")]
    df = spark.createDataFrame([("f", None), ("g", "<a><Segment/></a>"), ("g", "<a><Segment/></a>")], "n string, x string")
    assert X.flat_table(X.tagged_rows(df, "models", "n", "x"), "segment").count() == 1
    assert X.tagged_rows(df.limit(0), "models", "n", "x").count() == 0


def test_tagged_write(spark, tmp_path):
    df = spark.createDataFrame([("g", "<a><Segment id='1' weight='0.5'/><FieldValueCount field='a' value='b' count='3'/></a>")], "n string, x string")
    X.write_tables(X.tagged_rows(df, "models", "n", "x"), str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert X.flat_table(back, "count").first().count_count == 3.0 and X.flat_table(back, "segment").first().segment_weight == 0.5


def by_tree(name, text, configs):
    """The links of one file by a plain recursive walk over a tree."""
    import xml.etree.ElementTree as ET

    try:
        root = ET.fromstring(text)
    except (ET.ParseError, ValueError):
        return set()
    tag, out = (lambda e: e.tag.rpartition("}")[2].rpartition(":")[2]), set()

    def model(e, path, inside):
        place = 0
        for child in e:
            down, within = path, inside
            if tag(child) == "Segment":
                place += 1
                key = child.get("id", f"#{place}")
                down, within = (f"{path}/{key}" if inside else key), True
                out.add(("models", name, "segment", path, down))
            elif tag(child) == "FieldValueCount":
                out.add(("models", name, "count", path, f"{child.get('field', '')}={child.get('value', '')}"))
            model(child, down, within)

    def config(schema):
        seen = {}
        for group in schema:
            seen[tag(group)] = seen.get(tag(group), 0) + 1
            path = f"{tag(group)}#{seen[tag(group)]}"
            for dim in group:
                if tag(dim).endswith("Dimension"):
                    at = f"{path}/{dim.get('field', '')}"
                    out.add(("configs", name, "dimension", path, at))
                    for b in dim:
                        if tag(b) in ("Selection", "Partition"):
                            label = b.get("value", "") if tag(b) == "Selection" else f"{b.get('low', '')}..{b.get('high', '')}"
                            out.add(("configs", name, "bin", at, f"{at}/{label}"))

    if configs:
        for e in root.iter():
            if tag(e) == "SegmentationSchema":
                config(e)
    else:
        model(root, "", False)
    return out


def test_links_of_whole_tables_against_a_tree_walk(spark):
    import os

    from quillon.queries import QUERIES

    d = "/root/testdata/sf0.001"
    if not os.path.exists(d):
        return
    want = set()
    for name, key, text in (("models", "model_name", "pmmlfile"), ("configs", "config_name", "configfile")):
        for r in spark.read.parquet(f"{d}/{name}.parquet").collect():
            if r[text]:
                want |= by_tree(r[key], r[text], name == "configs")
    got = [tuple(r[c] for c in ("origin", "file_name", "link_kind", "parent_path", "child_path")) for r in QUERIES["p5_found"](spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert QUERIES["p5_count_table"](spark, d).select("file_name", "parent_pk", "pk").distinct().count() == len({(w[1], w[3], w[4]) for w in want if w[2] == "count"})
    assert QUERIES["p5_bin_table"](spark, d).select("file_name", "parent_pk", "pk").distinct().count() == len({(w[1], w[3], w[4]) for w in want if w[2] == "bin"})
