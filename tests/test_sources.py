"""Files with differing headers, junk numbers and encodings; long logs cut into pieces."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from axonframe.functions import textparse
from axonframe.operators import clean, textlog
from axonframe.sources import files, rasters


@pytest.fixture(scope="module")
def folder():
    root = tempfile.mkdtemp(prefix="axonframe-test-")
    put = {
        "a/merged_mean_peak.csv": ',filename,SliceID,Interval,Actual Peak Value\n0,f1,S1,0.05,1.5\n1,f2,S2,NA,junk\n',
        "b/merged_mean_peak.csv": 'Actual Peak Value,filename,extra\n9.25,"f,3",x\n',
        "b/merged_mean_peak_edited.csv": "filename,Interval\nf4,0.1\n",
        "c/merged_mean_peak_edited.csv": "filename,Interval\nf5,0.2\n",
        "c/2024.08.17.csv": "x\n1\n",
        "c/pic.JPG": "not an image",
    }
    for name, text in put.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)
    return root


def test_mixed_headers_bind_by_name(spark, folder):
    paths = [f"{folder}/a/merged_mean_peak.csv", f"{folder}/b/merged_mean_peak.csv", f"{folder}/c/merged_mean_peak_edited.csv"]
    df = clean.drop_unnamed(files.read_csv_mixed(spark, paths, ["Interval", "Actual Peak Value"]))
    assert "...1" not in df.columns
    got = {r["filename"]: (r["Interval"], r["Actual Peak Value"]) for r in df.collect()}
    assert got == {"f1": (0.05, 1.5), "f2": (None, None), "f,3": (None, 9.25), "f5": (0.2, None)}
    first = df.filter("source_file LIKE '%/a/%'").orderBy("ordinal").select("filename").collect()
    assert [r[0] for r in first] == ["f1", "f2"]


def test_typed_csv_and_sink(spark, folder):
    df = files.read_csv_typed(spark, f"{folder}/a/merged_mean_peak.csv", "i int, filename string, slice string, interval double, peak double")
    assert [(r["interval"], r["peak"]) for r in df.orderBy("i").collect()] == [(0.05, 1.5), (None, None)]
    out = tempfile.mkdtemp(prefix="axonframe-test-") + "/out"
    files.write_csv(df, out)
    assert spark.read.option("header", True).csv(out).count() == 2
    files.write_text_list(df, "filename", out + "_t")
    assert {r[0] for r in spark.read.text(out + "_t").collect()} == {'"f1",', '"f2",'}


def test_catalogue(spark, folder):
    cat = files.catalogue(spark, folder)
    assert cat.count() == 6
    names = lambda d: sorted("/".join(r["path"].split("/")[-2:]) for r in d.collect())
    csvs = cat.filter(F.col("path").contains("merged"))
    assert names(files.one_per_folder(csvs)) == ["a/merged_mean_peak.csv", "b/merged_mean_peak_edited.csv", "c/merged_mean_peak_edited.csv"]
    assert names(files.prefer_edited(csvs)) == ["a/merged_mean_peak.csv", "b/merged_mean_peak_edited.csv"]
    anchor = files.find_by_name(cat, "pic.JPG")
    assert [r["sibling"].split("/")[-1] for r in files.siblings(anchor, cat, files.DATED_CSV).collect()] == ["2024.08.17.csv"]
    assert files.find_by_pattern(cat, files.JPG).count() == 1
    assert files.find_by_name(cat, "missing.abf").count() == 0


def test_log_lines_and_charsets(spark):
    root = tempfile.mkdtemp(prefix="axonframe-test-")
    lines = ["# Slice1", "## Cell1", "x_1.abf started at 10:00", "", "## PVneuron-2", "x_2.abf started at 11:00"]
    for name, enc in (("u8", "utf-8"), ("u16", "utf-16"), ("l1", "latin-1")):
        with open(f"{root}/{name}.md", "wb") as f:
            f.write("\n".join([*lines, "µ"]).encode(enc))
    any_set = files.read_log_lines_any_charset(spark, root)
    for name in ("u8", "u16", "l1"):
        got = [r["line"] for r in any_set.filter(F.col("path").contains(f"/{name}.md")).orderBy("line_no").collect()]
        assert got == [*lines, "µ"]
    big = tempfile.mkdtemp(prefix="axonframe-test-") + "/big.md"
    with open(big, "w") as f:
        f.write("\n".join(f"line {i}" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        numbered = files.read_log_lines(spark, big)
        assert numbered.rdd.getNumPartitions() > 1
        assert all(r["line"] == f"line {r['line_no']}" for r in numbered.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("pieces", [textlog.CHUNK_LINES, 4, 1])
def test_headings_do_not_depend_on_pieces(spark, pieces):
    lines = ["x", "## Cell1", "a", "b", "## PVneuron-2", "c", "not ## Cell9", "d", "e", "f"]
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(lines)], "path string, n long, line string").repartition(3)
    got = textlog.heading_before(df, textparse.CELL_HEADING, "h", ["path"], "n", "line", pieces).orderBy("n").collect()
    assert [r["h"] for r in got] == [None, None, "## Cell1", "## Cell1", "## Cell1", *["## PVneuron-2"] * 5]


def test_name_hygiene(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Actual Peak Value", "SliceID", "cell_id"])
    assert clean.clean_names(df).columns == ["actual_peak_value", "slice_id", "cell_id"]
    t = clean.any_of(df, {"SliceID": "bigint", "gone": "string"})
    assert t.columns == ["SliceID", "gone"] and t.first()["gone"] is None


def test_strips_round_trip(spark):
    out = tempfile.mkdtemp(prefix="axonframe-test-") + "/strips"
    df = spark.createDataFrame([(0, 0, [1.0, 0.2]), (0, 1, [0.7, 255.0])], rasters.STRIP_SCHEMA)
    rasters.write_strips(df, out)
    back = rasters.read_strips(spark, out)
    assert rasters.image_sizes(back).first().asDict() == {"image_id": 0, "h": 2, "w": 2}
    assert sorted(r["v"] for r in rasters.long_view(rasters.binarise(back, "pixels", equals=255.0)).collect()) == [0, 0, 0, 1]


def test_headers_read_only_the_head(spark, tmp_path):
    big = tmp_path / "big file.csv"
    big.write_text("a,b\n" + "1,2\n" * 200_000)
    (tmp_path / "long.csv").write_text("x" * 200_000 + ",y\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "no_end.csv").write_text("a,b")
    got = {r.path.rpartition("/")[2]: r.value for r in files.head_lines(spark, [str(tmp_path)]).collect()}
    assert got == {"big file.csv": "a,b", "long.csv": "x" * 200_000 + ",y", "no_end.csv": "a,b"}
    assert files.read_csv_mixed(spark, [str(big)]).count() == 200_000
