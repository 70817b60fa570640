from pyspark.sql import functions as F

from corpusloom.sources import nlp_format

FILE = """## NLPTextDocument Title T
## NLPTextDocument Uri https://a.example.org/
## NLPTextDocument Timestamp 01/02/2020 03:04:05
## NLPTextDocument Metadata a=b=c

one\\ntwo
## 1 Section Start S
. ## marked
## 2 List Items L >> x || y
## 1 Section End <<S>>
## 1 NavigationList Items >> 
"""

ROWS = [
    ("Document", "Start", 1, "f"), ("Document", "Title", 1, "T"), ("Document", "Uri", 1, "https://a.example.org/"), ("TextBlock", "Text", 1, "one\ntwo"),
    ("Section", "Start", 1, "S"), ("TextBlock", "Text", 1, ". ## marked"), ("List", "Start", 2, "L"), ("ListItem", "Text", 3, "x"), ("ListItem", "Text", 3, "y"),
    ("List", "End", 2, None), ("Section", "End", 1, None), ("NavigationList", "Start", 1, None), ("NavigationList", "End", 1, None), ("Document", "End", 1, "f"),
]


def rows_of(df):
    return [tuple(r)[2:6] for r in df.orderBy("pos").collect()]


def test_parse(spark):
    assert rows_of(nlp_format.parse_documents(spark.createDataFrame([("f", FILE)], "doc string, value string"))) == ROWS


def test_reader_agrees_with_the_expressions():
    assert list(nlp_format.element_rows("f", FILE.splitlines())) == ROWS


def test_source(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.nlp.txt").write_text(FILE)
    spark.dataSource.register(nlp_format.StructuredTextSource)
    got = spark.read.format("structured_text").option("path", str(tmp_path)).load().orderBy("pos").collect()
    assert [(r.docelttype, r.doceltcmd) for r in got] == [r[:2] for r in ROWS]


def test_metadata(spark):
    m = nlp_format.document_metadata(spark.createDataFrame([("f", FILE)], "doc string, value string")).first()
    assert (m.title, m.timestamp, m.metadata) == ("T", "01/02/2020 03:04:05", {"a": "b=c"})


def test_malformed_delimiter(spark):
    bad = spark.createDataFrame([("f", "## 1 Nonsense Start x\ntext")], "doc string, value string")
    assert [r[0] for r in rows_of(nlp_format.parse_documents(bad, strict=False))] == ["Document", "TextBlock", "Document"]
    try:
        nlp_format.parse_documents(bad).collect()
        raise AssertionError("no error")
    except Exception as e:
        assert "File format error" in str(e)


def test_round_trip(spark):
    df = spark.createDataFrame([("f", i, *r) for i, r in enumerate(ROWS)], nlp_format.SCHEMA)
    back = nlp_format.parse_documents(nlp_format.render_documents(df))
    got = [(k, c, n, t) for k, c, n, t in rows_of(back)]
    assert [(k, c, t) for k, c, _, t in got] == [(k, c, t) for k, c, _, t in ROWS]


def test_empty(spark):
    df = spark.createDataFrame([], nlp_format.SCHEMA)
    assert nlp_format.parse_documents(nlp_format.render_documents(df)).count() == 0
    assert F is not None


def rendered(spark, html, compact=True):
    from corpusloom.html.convert import convert_page

    rows = [("f", i, *r) for i, r in enumerate(convert_page(html, "u"))]
    return nlp_format.render_documents(spark.createDataFrame(rows, nlp_format.SCHEMA), compact).first().value.split("\n")


def test_short_lists_take_one_line(spark):
    assert rendered(spark, "<title>t</title><ol><li>a</li><li>b</li></ol>")[2:] == ["## 1 List Items >> a || b"]
    long = rendered(spark, f"<ol><li>a</li><li>{'x' * 60}</li></ol>")
    assert long[2] == "## 1 List Start " and long[-1] == "## 1 List End"


def test_empty_groups_go_but_navigation_stays(spark):
    assert rendered(spark, "<ol></ol><p>x</p>")[2:] == ["x"]
    assert rendered(spark, "<ul><li><a href=a></a></li></ul>")[2] == "## 1 NavigationList Items >> "


def test_end_carries_the_title(spark):
    lines = rendered(spark, f"<h1>{'t' * 60}</h1><p>x</p>")
    assert lines[-1] == "## 1 Section End <<" + "t" * 47 + "...>>"


def test_file_names():
    names = {"a/b": "a/b.nlp.txt", "file:///x/y.nlp.txt": "x/y.nlp.txt", "../../etc/x": "etc/x.nlp.txt", "": "_default_.nlp.txt", "/": "_default_.nlp.txt"}
    assert {d: nlp_format.file_name(d) for d in names} == names


def test_written_files_are_read_again(spark, tmp_path):
    df = spark.createDataFrame([("one", i, *r) for i, r in enumerate(ROWS)] + [("two/x", i, *r) for i, r in enumerate(ROWS[:4])], nlp_format.SCHEMA)
    nlp_format.write_documents(df, str(tmp_path))
    assert sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*.nlp.txt")) == ["one.nlp.txt", "two/x.nlp.txt"]
    back = nlp_format.load_documents(spark, str(tmp_path))
    nlp_format.write_documents(back, str(tmp_path / "again"))  # their names now are whole paths
    assert back.count() == nlp_format.load_documents(spark, str(tmp_path / "again")).count()
