import stat

import pytest
from pyspark.sql import functions as F

from treescan.functions import modes, template, text


@pytest.mark.parametrize("mode", [0o100644, 0o104755, 0o104644, 0o041777, 0o041776, 0o120777, 0o010644, 0o140755, 0o020666, 0o060660, 0o102755, 0o102655, 0o100000])
def test_mode_string_like_the_systems(spark, mode):
    assert spark.range(1).select(modes.mode_string(F.lit(mode))).first()[0] == stat.filemode(mode)


def test_modes_of_nothing(spark):
    m = F.lit(0)
    row = spark.range(1).select(modes.mode_string(m), modes.mode_octal(m), modes.type_label(m), modes.d_type(m)).first()
    assert tuple(row) == ("?---------", "00", "UNKNOWN", 0)


@pytest.mark.parametrize(("mode", "label", "dt"), [(0o100644, "FILE", 8), (0o040755, "DIR", 4), (0o120777, "LINK", 10), (0o020666, "CHR", 2), (0o060660, "BLK", 6), (0o010644, "FIFO", 1), (0o140755, "SOCK", 12)])
def test_types(spark, mode, label, dt):
    m = F.lit(mode)
    row = spark.range(1).select(modes.type_label(m), modes.d_type(m), modes.type_bits(modes.d_type(m)), modes.mode_octal(m)).first()
    assert tuple(row) == (label, dt, stat.S_IFMT(mode), "0" + oct(mode & 0o777)[2:])


@pytest.mark.parametrize(("form", "parts"), [
    ("", []),
    ("%p|%s", [("field", "p"), ("text", "|"), ("field", "s")]),
    ("%%", [("text", "%%")]),
    ("%z", [("text", "%z")]),
    ("a%", [("text", "a")]),
    ("%%p", [("text", "%%p")]),
    (r"\t%i", [("text", r"\t"), ("field", "i")]),
])
def test_template_parts(form, parts):
    assert template.parts_of(form) == parts


def test_switches():
    assert template.from_switches() == "%p|%s|%m"
    assert template.from_switches(mtime=True, size=True, user=True) == "%p|%s|%u|%m"
    with pytest.raises(ValueError):
        template.from_switches(colour=True)


def test_csv_and_quote(spark):
    df = spark.createDataFrame([('/d/He said "hi",x', 1)], "path string, size bigint")
    row = df.select(template.compiled("%p,%s", csv=True), template.compiled("%p,%s", quote=True), template.compiled("%p,%s", csv=True, quote=True), template.compiled("")).first()
    assert tuple(row) == ('"/d/He said ""hi"",x","1"', '"/d/He said "hi",x","1"', '"/d/He said ""hi"",x","1"', "")


@pytest.mark.parametrize(("path", "want"), [("/public2/hw/a", "/***2/***w/a"), ("//x/yz/", "//x/***z/"), ("", ""), ("a", "a")])
def test_mask(spark, path, want):
    assert spark.range(1).select(text.masked(F.lit(path))).first()[0] == want


def test_small_texts(spark):
    row = spark.range(1).select(
        text.elapsed(F.lit(93784)), text.shortened(F.lit("x" * 25)), text.shortened(F.lit("x" * 20)), text.owner(F.lit(None).cast("string"), F.lit(99999)),
        text.owner(F.lit("root"), F.lit(0)), text.joined_path(F.lit("/"), F.lit("x")), text.clock(F.lit(0)), text.file_name("slice", F.lit("p"), F.lit(7)),
    ).first()
    assert tuple(row) == ("1d 02:03:04", "..." + "x" * 20, "x" * 20, "99999", "root(0)", "//x", "1970-01-01 00:00:00", "p_000007.pbin")


def test_backoff(spark):
    assert [r[0] for r in spark.range(9).select(text.backoff(F.col("id"))).collect()] == [5, 10, 20, 40, 80, 160, 300, 300, 300]


def test_a_bounded_copy_keeps_characters_whole(spark):
    for value in ("", "abc", "aé", "éé", "日本語", "a🌳b", "🌳🌳", "x" * 40):
        for size in (1, 2, 3, 4, 5, 6, 7, 8, 9, 40, 41):
            wanted = value.encode()[: size - 1].decode("utf-8", "ignore")
            assert spark.range(1).select(text.bounded(F.lit(value), size)).first()[0] == wanted, (value, size)
    assert spark.range(1).select(text.bounded(F.lit(None).cast("string"), 4)).first()[0] is None
    with pytest.raises(ValueError):
        text.bounded(F.lit("a"), 0)


def test_local_times(spark):
    row = spark.createDataFrame([(1_700_000_000,)], "mtime bigint")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert row.select(template.compiled("%m"), template.compiled("%m", local=True)).first()[:] == ("2023-11-14 22:13:20", "2023-11-15 07:13:20")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
