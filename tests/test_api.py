from pyspark.sql import functions as F

from millrace import api
from tests_support import PAGE

HTML = "<title>T</title><body><nav>menu</nav><h1>Head</h1><p>Some text.</p></body>"


def test_names_resolve():
    assert all(callable(getattr(api, n)) for n in api.__all__)


def test_html_to_markdown(spark):
    df = spark.createDataFrame([(HTML,), (None,), ("",)], "h string")
    assert [r[0] for r in df.select(api.html_to_markdown(F.col("h"))).collect()] == ["# Head\n\nSome text.", "", ""]


def test_extract_content(spark):
    pages = spark.createDataFrame([("j", 1, "https://a.test/", HTML, False, "", 0, 2, 1)], PAGE)
    assert tuple(api.extract_content(pages).first()) == ("T", "", "Head Some text.", "# Head\n\nSome text.", [])
