"""URLs without a scheme, by a full table of domains."""

import time

import pytest
from pyspark.sql import functions as F

from credsieve.functions import clean
from credsieve.functions.domains import DomainTable
from credsieve.plans import scan
from credsieve.sources import lists

TABLE = DomainTable.of(["COM", "co.uk", "рф", "münchen.example", "", None, "museum"])


def changed(spark, text, table=TABLE):
    c = F.col("t")
    frame = spark.createDataFrame([(text,)], "t string")
    return tuple(
        frame.select(clean.strip_bare_urls(c, table), clean.bare_url_count(c, table)).first()
    )


@pytest.mark.parametrize(
    "text, left, n",
    [
        ("see Foo.COM/a?b=c.d now", "see   now", 1),
        ("shop.co.uk co.uk shop.uk", "  co.uk shop.uk", 1),
        ("пример.рф xn--e1afmkfd.xn--p1ai x.xn--mnchen-3ya.example", "     ", 3),
        ("a.museum:8080/x b.museums main.py self.com_x", "  b.museums main.py self.com_x", 1),
        ("foo.com.", " ", 1),
        (".com ..com a..com", ".com ..com a..com", 0),
        ("x.com/y.com z.com", "   ", 2),
        ("one.com\ntwo.net\nthree.com", " \ntwo.net\n ", 2),
        ("odd﷐mark a.com", "odd�mark  ", 1),
        ("", "", 0),
        (None, None, None),
    ],
)
def test_hosts_of_the_table(spark, text, left, n):
    assert changed(spark, text) == (left, n)


def test_an_empty_table_knows_no_host(spark):
    assert changed(spark, "a.com b.co.uk", DomainTable.of([])) == ("a.com b.co.uk", 0)


def test_names_are_looked_up_by_hash(spark):
    """Thousands of suffixes cost a text no more than a few, and the plan holds a set."""
    many = DomainTable.of([f"d{k}" for k in range(3000)] + ["com"])
    text = "word.com and d9.d17 but.not " * 20_000 + "." * 300_000 + "a" * 300_000
    start = time.time()
    left, n = changed(spark, text, many)
    assert n == 40_000 and "d17" not in left and "but.not" in left
    assert time.time() - start < 60
    frame = spark.range(1).select(F.col("id").cast("string").alias("t"))
    plan = frame.select(clean.bare_url_count(F.col("t"), many))._jdf.queryExecution().optimizedPlan()
    assert " INSET " in plan.toString()


def test_tables_are_read_from_files(spark, tmp_path):
    path = tmp_path / "suffixes.dat"
    path.write_text("// list\n# note\nCOM\n\n*.ck\n!www.ck\nco.uk // note\n公司.cn\n")
    table = lists.domain_table(lists.read_domains(spark, str(path)))
    assert set(table.names) == {"com", "ck", "co.uk", "公司.cn", "xn--55qx5d.cn"}


def test_scans_take_a_table(spark):
    body = 'x = 1\ny = 2\npassword = "abcdefgh1"\n' + "see a.museum/b\n" * 31
    files = spark.createDataFrame(
        [(1, "https://github.com/o/r/blob/m/a.py", "2024-01-01 00:00:00", body)],
        "file_id long, html_url string, indexed_at string, content string",
    )
    short = scan.ScanConfig(keywords=("password",), extensions=("py",))
    full = scan.ScanConfig(keywords=("password",), extensions=("py",), tlds=TABLE)
    assert scan.file_candidates(files, short).count() == 1
    assert scan.file_candidates(files, full).count() == 0  # too many URLs
    assert scan.search_id(short) != scan.search_id(full)
