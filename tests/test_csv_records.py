"""Multi-line CSV read by splits equals the reader that takes a file in one task."""

import csv
import random

import pytest

from souk.sources.csv_records import csv_records, load_csv
from souk.sources.loads import IdentityKeys


@pytest.fixture()
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _write(path, rows, header=("a", "b", "c d"), end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(header)
        out.writerows(rows)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_records_of_many_splits(spark, small_splits, tmp_path):
    rng = random.Random(1)
    every = []
    for f, end in (("x", "\n"), ("y", "\r\n"), ("z", "\n")):
        rows = [[f"{f}{i}", "".join(rng.choice(['x', '"', "\n", "\r\n", ",", "é", " "]) for _ in range(rng.randrange(12))),
                 rng.choice(["", "plain", '"q"', "\n" * 300])] for i in range(400)]
        every += rows
        _write(tmp_path / f"{f}.csv", rows, end=end)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20     # several tasks per file
    want = sorted(([x if x != "" else None for x in r] for r in every), key=lambda r: str(tuple(r)))
    for columns in (None, ["a", "b", "c d"]):
        got = load_csv(spark, str(tmp_path), columns)
        assert got.columns == ["a", "b", "c d"]
        assert [list(r) for r in _rows(got)] == want
    one_task = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    plain, other = ([tuple(x and x.replace("\r", "") for x in r) for r in _rows(df)]     # that reader changes some
                    for df in (load_csv(spark, str(tmp_path)), one_task))
    assert sorted(plain, key=str) == sorted(other, key=str)


def test_awkward_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,"b ""x"", y"\n1,"open\nto the end\n')       # no closing quote
    got = load_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["a", 'b "x", y'] and _rows(got) == [("1", "open\nto the end")]
    (tmp_path / "b.csv").write_text("\n\na,b\n\n1,2\n\n")                               # blank lines are no records
    assert _rows(load_csv(spark, str(tmp_path / "b.csv"))) == [("1", "2")]
    (tmp_path / "c.csv").write_text("a,b\n")
    assert load_csv(spark, str(tmp_path / "c.csv")).collect() == []
    assert csv_records(spark, str(tmp_path / "b.csv")).where("first").first()["record"] == "a,b"


def test_identity_keys_stay(spark, tmp_path):
    keys = IdentityKeys(spark, str(tmp_path))

    def assign(rows):
        df = spark.createDataFrame(rows, "k string, n long, v string")
        got = keys.assign(df, ["k", "n"], "sk", buckets=7)
        assert got.columns == ["k", "n", "v", "sk"] and got.count() == len(rows)
        return {(r.k, r.n): r.sk for r in got.collect()}

    first = assign([("b", 1, "x"), ("a", 2, "x"), ("a", 1, "x"), (None, 1, "x"), ("a", 1, "again")])
    assert first == {(None, 1): 1, ("a", 1): 2, ("a", 2): 3, ("b", 1): 4}
    second = assign([("a", 0, "y"), ("a", 2, "y"), (None, 1, "y"), ("c", None, "y")])
    assert second == {("a", 0): 5, ("a", 2): 3, (None, 1): 1, ("c", None): 6}
    keys.write(spark.createDataFrame([("z", 1, 99)], "k string, n long, __key long"), "keys", 3)    # broke off
    assert keys.last_load() == 2 and assign([("z", 1, "x"), ("b", 1, "x")]) == {("z", 1): 7, ("b", 1): 4}
    assert assign([]) == {} and assign([("q", 1, "x")]) == {("q", 1): 8}
