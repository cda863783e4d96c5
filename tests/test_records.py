"""Malformed lines and repeated dimension keys."""

import gzip
import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F
from sample_rows import day
from shelfline.operators import quality
from shelfline.plans import job
from shelfline.plans import sample_model as sample
from shelfline.sources import files, records, schemas, sinks
from shelfline.sources.files import Location

RUN = day("1998-09-02")
HEADER = ",".join(schemas.columns("product"))
TAIL = "1.0,2.0,b,1,s,1,c,2,d"

LINES = [
    (f"1,a,{TAIL}", None, "a"),
    (f'2,"a,b",{TAIL}', None, "a,b"),
    ("3,a", "too few fields", None),
    (f"4,a,{TAIL},e", "too many fields", None),
    (f'5,"a,{TAIL}', "unclosed quote", None),
    ('6,a,1.0,2.0,b,1,s,1,c,2,"d', "unclosed quote", None),
    (f'7,"a ""x"", y",{TAIL}', "text after a quote", None),
    (f'8,"a \\"x\\", y",{TAIL}', None, 'a "x", y'),
    (f'9,"a"b,{TAIL}', "text after a quote", None),
    (f'10,"",{TAIL}', None, None),
    (f'11,5" pipe,{TAIL}', None, '5" pipe'),
    ("12,,,,,,,,,,", None, None),
    (f"13,é�,{TAIL}", None, "é�"),
    (f'14,"a\\\\",{TAIL}', None, "a\\"),
    (f'15,"a,b,c,{TAIL[:-2]}"', "too few fields", None),
    ('"', "unclosed quote", None),
    (",", "too few fields", None),
    (f'16,{"x" * 100_000},{TAIL}', None, "x" * 100_000),
    (f'17,"{chr(92) + chr(34)}{"," * 20_000}",{TAIL}', None, '"' + "," * 20_000),
]


def write(path, *lines, ending="\n"):
    with open(path, "wb") as f:
        f.write(b"".join(x if isinstance(x, bytes) else (x + ending).encode() for x in lines))
    return str(path)


def read(spark, path, **options):
    return records.read_records(spark, str(path), "product", {**files.CSV_PROFILE, **options})


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_each_line_is_a_record_or_a_reject(spark, tmp_path, ending):
    path = write(tmp_path / "p.csv", HEADER.upper(), "", *[line for line, _, _ in LINES], ending=ending)
    got = {r[records.LINE]: (r[records.BROKEN], r.prod_name) for r in read(spark, path).collect()}
    assert got == {line: (broken, name) for line, broken, name in LINES}


def test_bytes_that_are_no_utf8(spark, tmp_path):
    path = write(tmp_path / "p.csv", "﻿" + HEADER, b"1,caf\xe9," + TAIL.encode() + b"\n", f"2,café,{TAIL}")
    rows = {r.prod_key: r for r in read(spark, path).collect()}
    assert rows["2"].prod_name == "café" and rows["2"][records.BROKEN] is None
    assert rows[None][records.BROKEN] == "undecodable bytes" and rows[None][records.LINE].startswith("1,caf�,")


def test_doubled_quotes_if_they_are_the_escape(spark, tmp_path):
    path = write(tmp_path / "p.csv", HEADER, f'1,"a ""x"", y",{TAIL}', f'2,"a"",b",{TAIL}', f'3,"""",{TAIL}', f'4,""",{TAIL}')
    rows = read(spark, path, escape='"').collect()
    assert {(r.prod_key, r.prod_name, r[records.BROKEN]) for r in rows} == {
        ("1", 'a "x", y', None), ("2", 'a",b', None), ("3", '"', None), (None, None, "unclosed quote"),
    }


def test_other_separators_and_nulls(spark, tmp_path):
    path = write(tmp_path / "p.csv", HEADER.replace(",", "|"), "1|\\N|" + TAIL.replace(",", "|"), f"2,a,{TAIL}")
    rows = read(spark, path, sep="|", nullValue="\\N").collect()
    assert {(r.prod_key, r.prod_name, r[records.BROKEN]) for r in rows} == {("1", None, None), (None, None, "too few fields")}


def test_files_of_a_folder_are_judged_one_by_one(spark, tmp_path):
    """Each part has its header; one has none, one has its columns in another order, one is gzipped."""
    names = HEADER.split(",")
    folder = tmp_path / "parts"
    os.mkdir(folder)
    write(folder / "a.csv", HEADER, f"1,a,{TAIL}", "2,b")
    write(folder / "b.csv", f"3,c,{TAIL}", "4,d")
    write(folder / "c.csv", ",".join([names[1], names[0], *names[2:]]), f"5,e,{TAIL}")
    with gzip.open(folder / "d.csv.gz", "wt") as f:
        f.write(f"{HEADER}\n6,f,{TAIL}\n")
    rows = {(os.path.basename(r[records.FILE]), r[records.LINE][0], r[records.BROKEN]) for r in read(spark, folder).collect()}
    assert rows == {
        ("a.csv", "1", None), ("a.csv", "2", "too few fields"), ("b.csv", "3", "no header"), ("b.csv", "4", "too few fields"),
        ("c.csv", "p", "no header"), ("c.csv", "5", "no header"), ("d.csv.gz", "6", None),
    }


def test_broken_lines_keep_file_and_line_when_coerced(spark, tmp_path):
    path = write(tmp_path / "p.csv", HEADER, "3,a", f"x,a,{TAIL}", f"1,a,{TAIL}")
    checked = quality.coerce(read(spark, path), "product")
    bad = {(r[quality.REASON], r[records.LINE], os.path.basename(r[records.FILE])) for r in quality.rejected(checked).collect()}
    assert bad == {("too few fields", "3,a", "p.csv"), ("prod_key", f"x,a,{TAIL}", "p.csv")}
    good = quality.accepted(checked)
    assert good.columns == schemas.columns("product") and [r.prod_key for r in good.collect()] == [1]


def test_plain_lines_need_no_pattern_and_no_fold(spark, tmp_path):
    """Patterns and folds are for pieces with quotes; the header is told by comparing columns."""
    path = write(tmp_path / "p.csv", HEADER, f'1,"a,b,\\",c",{TAIL}', f"2,a,{TAIL}", f'3,a,"{TAIL}', f'4,"a,,b"x,{TAIL}')
    rows = {r[records.LINE][0]: (r[records.BROKEN], r.prod_name) for r in read(spark, path).collect()}
    assert rows == {"1": (None, 'a,b,",c'), "2": (None, "a"), "3": ("unclosed quote", None), "4": ("text after a quote", None)}
    lines = spark.read.text(path).withColumn(records.FILE, F.lit("p"))
    plan = records.split_lines(lines, "product", files.CSV_PROFILE)._jdf.queryExecution().optimizedPlan().toString()
    plain = re.sub(r"CASE WHEN Contains\(_text.*? AS _quoted", "", plan)
    assert "_quoted" in plan and not re.search(r"forall\(|regexp_replace\(|split\(|aggregate\(", plain)


def test_empty_drop(spark, tmp_path):
    assert read(spark, write(tmp_path / "p.csv", HEADER)).count() == 0
    assert read(spark, write(tmp_path / "q.csv")).count() == 0


def test_no_record_moves_to_learn_of_its_header(spark, tmp_path, capsys):
    """Files with a header are few, so the join is no shuffle even of records over the broadcast threshold."""
    path = write(tmp_path / "p.csv", HEADER, *[f"{i},{hashlib.sha256(str(i).encode()).hexdigest()},{TAIL}" for i in range(5_000)])
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "64k")
    try:
        rows = read(spark, path)
        capsys.readouterr()
        rows.explain()
        plan = capsys.readouterr().out
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert rows.where(f"{records.BROKEN} is null").count() == 5_000
        spark.conf.set(key, "-1")  # a list of files over the threshold
        assert read(spark, path).where(f"{records.BROKEN} is null").count() == 5_000
    finally:
        spark.conf.set(key, before)


def test_a_line_that_its_fields_spell_out_is_stored_once(spark, tmp_path):
    """Others are kept as they came: quotes, white space, nulls that are written out, broken lines."""
    plain = [f"1,a,{TAIL}", f"2,,{TAIL}", ",,,,,,,,,,", f"3, a ,{TAIL}"]
    other = [f'4,"a",{TAIL}', f'5,"",{TAIL}', f"6,\\N,{TAIL}", "7,a", f"8,a,{TAIL},", f'9,"a,{TAIL}', ","]
    rows = read(spark, write(tmp_path / "p.csv", HEADER, *plain, *other), nullValue="\\N")
    assert sorted(r[records.LINE] for r in rows.collect()) == sorted(plain + other)
    stored = spark.read.parquet(*[f for f in rows.inputFiles() if "product-records" in f])
    assert {r[records.LINE] for r in stored.collect()} == {None, *other}


@pytest.fixture
def landed(spark, tmp_path, sample_dir):
    """A whole landing with the product file given as text."""
    tables = sample.tables(spark, sample_dir)
    place = Location(str(tmp_path / "landed"))
    sinks.export_snapshot({t: df.limit(50) if t in job.FACTS else df for t, df in tables.items() if t != "product"}, place, RUN)
    rows = [f"{i},a,1.0,2.0,Brand#{i},1,s,1,c,2,d" for i in range(1, 60)]
    return place, rows, lambda *more: write(place.path("product", RUN).removesuffix(".gz"), HEADER, *rows, *more)


def test_repeated_dimension_key_stops_the_job(spark, landed, tmp_path):
    place, rows, product = landed
    path = product(rows[6], "8,other,1.0,2.0,b,1,s,1,c,2,d")
    with gzip.open(path + ".gz", "wb") as f, open(path, "rb") as plain:
        f.write(plain.read())
    config = job.JobConfig(RUN, place.base, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="product has keys more than once: prod_key=7 .2 rows.; prod_key=8 .2 rows."):
        job.run(spark, config)

    saved = job.run(spark, job.JobConfig(RUN, place.base, str(tmp_path / "out"), rejects=True))
    rejects = files.read_saved(spark, saved[job.REJECTS]).select("table_name", quality.REASON, records.LINE).collect()
    assert {tuple(r) for r in rejects} == {
        ("product", quality.REPEATED_KEY, rows[6]),
        ("product", quality.REPEATED_KEY, "8,other,1.0,2.0,b,1,s,1,c,2,d"),
    }
    assert files.read_saved(spark, saved["product"]).count() == 59


def test_rerun_in_append_mode_holds_each_dimension_once(spark, landed, tmp_path):
    place, _, product = landed
    path = product()
    with gzip.open(path + ".gz", "wb") as f, open(path, "rb") as plain:
        f.write(plain.read())
    for _ in range(2):
        saved = job.run(spark, job.JobConfig(RUN, place.base, str(tmp_path / "out"), mode="append"))
    assert files.read_saved(spark, saved["product"]).count() == 59
    mart = files.read_saved(spark, saved[job.MART])
    assert mart.count() == 2 * mart.distinct().count()


def test_many_rejects_of_one_file_are_written_by_several_tasks(spark, landed, tmp_path):
    """Rejects of a table are one partition of the write, which splits no finer than the task that found them."""
    place, _, product = landed
    broken = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(60_000)]
    path = product(*broken)
    with gzip.open(path + ".gz", "wb") as f, open(path, "rb") as plain:
        f.write(plain.read())
    saved = job.run(spark, job.JobConfig(RUN, place.base, str(tmp_path / "out"), rejects=True))
    rejects = files.read_saved(spark, saved[job.REJECTS])
    assert sorted(r[records.LINE] for r in rejects.collect()) == sorted(broken)
    assert rejects.columns[-1] == "table_name" and len(rejects.inputFiles()) > 1
