import hashlib

from pyspark.sql import functions as F

from millrace.functions import text


def test_fingerprint_is_unsigned(col):
    values = ["a", "hello world", "x" * 1000]
    want = [str(int.from_bytes(hashlib.sha256(v.encode()).digest()[:8], "big")) for v in values]
    assert col(values, "string", text.fingerprint) == want


def test_normal_form(col):
    got = col([" A  b\tC\n", "\x1cx\x1f", "", None], "string", text.normal)
    assert got == ["a b c", "x", "", None]


def test_tokens(col):
    assert col(["", "abc", "abcd" * 5, "é" * 8, None], "string", text.estimated_tokens) == [0, 1, 5, 2, 0]


def test_savings(spark):
    df = spark.createDataFrame([(10, 100), (200, 100), (5, 0)], "md long, raw long")
    assert [r[0] for r in df.select(text.savings_pct(F.col("md"), F.col("raw"))).collect()] == [90.0, -100.0, -400.0]
    one = df.agg(text.cluster_savings_pct(F.sum("md"), F.sum("raw"))).first()[0]
    assert one == -7.5
    assert spark.range(1).select(text.cluster_savings_pct(F.lit(0), F.lit(0))).first()[0] == 0.0


def test_clean_markdown(col):
    given = ["a\n - \nb  c\t d , e .\n\n\n\nf", "  x  ", "", None]
    assert col(given, "string", text.clean_markdown) == ["a\n\nb c d, e.\n\nf", "x", "", None]


def test_script_language(col):
    given = ["سلام دنیا", "привет мир", "hello", "123", "привет hello"]
    assert col(given, "string", text.script_language_col) == [text.script_language(g) for g in given] == ["fa", "ru", "en", "en", "ru"]


def test_digits_and_sizes(col):
    assert col(["۱۲۳x"], "string", text.ascii_digits) == ["123x"]
    assert col([5, 2048, 3 * 1024 * 1024, 16384000], "long", text.human_bytes) == ["5 B", "2.0 KB", "3.00 MB", "15.62 MB"]


def test_front_matter(spark):
    got = spark.range(1).select(text.front_matter([("url", F.lit("u"), False), ("title", F.lit('a "b"'), True)])).first()[0]
    assert got == '---\nurl: u\ntitle: "a \\"b\\""\n---\n\n'
