import random

import pytest

from quaver.sources import readers as R
from quaver.sources.csv_ranges import LineStates

CELLS = ('plain', '"two\nlines"', '"a ""quoted"" word"', '""', '', '"comma, inside"', '5" disk', '"ends"then more', '"\n\n,\n"""', "x" * 40, '" "', 'é✓', '"""\n"', '"crlf\r\nin"')


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "16"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def by_multiline(spark, path, sep=","):
    return R.missing_as_null(spark.read.options(header=True, multiLine=True, quote='"', escape='"', sep=sep).csv(path))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("seed", "sep", "end"), [(1, ",", "\n"), (2, ";", "\n"), (3, "\t", "\n"), (4, ",", "\r\n")])
def test_ranges_equal_the_whole_file_reader(spark, tmp_path, small_ranges, seed, sep, end):
    rng = random.Random(seed)
    cells = [c.replace(",", sep) for c in CELLS if end == "\n" or "\n" not in c]
    rows = [sep.join(["id", '"te""xt"', "c"])] + [sep.join([str(i), rng.choice(cells), rng.choice(cells)]) for i in range(400)]
    path = tmp_path / "one.csv"
    path.write_bytes((end.join(rows) + (end if seed % 2 else "")).encode())
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 8
    got = R.read_csv(spark, str(path), sep=sep)
    assert got.columns == ["id", 'te"xt', "c"]
    assert got.count() == 400 and rows_of(got) == rows_of(by_multiline(spark, str(path), sep))


def test_a_record_over_many_ranges_and_one_never_closed(spark, tmp_path, small_ranges):
    path = tmp_path / "long.csv"
    long = "\n".join(f"line {i}, with a comma" for i in range(400))
    path.write_text(f'id,text\n1,"{long}"\n2,short\n3,"{long}\n')
    got = {r.id: r.text for r in R.read_csv(spark, str(path)).collect()}
    assert got["1"] == long and got["2"] == "short" and got["3"].startswith(long)
    # The scan of lines cannot tell whether the last line was ended.
    assert got == {r.id: r.text.removesuffix("\n") for r in by_multiline(spark, str(path)).collect()}


def test_empty_files_blank_lines_and_long_headers(spark, tmp_path, small_ranges):
    (tmp_path / "none.csv").write_text("")
    assert R.read_csv(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "head.csv").write_text("a,b\n")
    assert R.read_csv(spark, str(tmp_path / "head.csv")).columns == ["a", "b"]
    assert R.read_csv(spark, str(tmp_path / "head.csv")).count() == 0
    (tmp_path / "gaps.csv").write_text("\n\na,b\n\n1,2\n\n\n3,4")
    assert rows_of(R.read_csv(spark, str(tmp_path / "gaps.csv"))) == [("1", "2"), ("3", "4")]
    name = "\n".join("w" * 50 for _ in range(60))
    (tmp_path / "wide.csv").write_text(f'a,"{name}"\n1,2\n')
    assert rows_of(R.read_csv(spark, str(tmp_path / "wide.csv"))) == [("1", "2")]


def test_many_files_and_partition_columns(spark, tmp_path, small_ranges):
    for kind in ("train", "test"):
        folder = tmp_path / f"split={kind}"
        folder.mkdir()
        for part in range(2):
            (folder / f"{part}.csv").write_text("id,text\n" + "".join(f'{i},"{kind}\n{part}"\n' for i in range(100)))
    got = R.read_csv(spark, str(tmp_path))
    assert got.columns == ["id", "text", "split"]
    assert {(r.split, r.text): r["count"] for r in got.groupBy("split", "text").count().collect()} == {
        (kind, f"{kind}\n{part}"): 100 for kind in ("train", "test") for part in range(2)
    }


def test_bytes_that_are_no_text_and_long_lines_take_linear_time():
    states = LineStates(",")
    assert states.after(b'\xff"', 0) == 0 and states.after(b'\xff,"', 0) == 1 and states.after(b'"\xff', 1) == 0
    assert states.after(b'"' * 2_000_001, 0) == 1
    assert states.after(b'a,"b",' * 500_000, 0) == 0 and states.after(b'a,"b' * 500_000, 0) == 0


def test_plan_moves_no_lines(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    plan = R.read_csv(spark, str(tmp_path / "x.csv"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
