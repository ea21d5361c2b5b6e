"""Rejected CSV rows: which, where and why; and that none is lost."""

from datetime import date
from decimal import Decimal

from pyspark.sql import types as T

from spendlens.schemas import MONEY
from spendlens.sources.quarantine import read_checked, write_checked

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("day", T.DateType()), T.StructField("paid", MONEY), T.StructField("absent", T.StringType())])
GOOD = 'note,id,day,paid\n"a, ""b""",1,2024-01-02,3.5\n,2.0,,NA\nx,3,2024-02-30,1\ny,4\nz,5,2024-01-01,7,8,9\nw,1.5,bad,1e2x\n'


def test_rows_are_kept_apart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(GOOD)
    (tmp_path / "in" / "b.csv").write_text("note,id,day,paid\n,x,2024-01-01,1\n")
    checked = read_checked(spark, str(tmp_path / "in"), SCHEMA)
    parsed, rejected = write_checked(checked, str(tmp_path / "out"))
    assert parsed.columns == ["id", "day", "paid", "absent"]
    assert sorted(map(tuple, parsed.collect())) == [(1, date(2024, 1, 2), Decimal("3.5000"), None), (2, None, None, None)]
    reasons = {tuple(r.reasons): r for r in rejected.collect()}
    assert set(reasons) == {
        ("day: 2024-02-30",), ("row: y,4",), ("row: z,5,2024-01-01,7,8,9",), ("id: 1.5", "day: bad", "paid: 1e2x"), ("id: x",),
    }
    assert reasons["day: 2024-02-30",].id == 3 and reasons["row: y,4",].id is None
    assert reasons["id: x",].source_file.endswith("b.csv") and reasons["row: y,4",].source_file.endswith("a.csv")
    rows = [reasons[k].source_row for k in (("day: 2024-02-30",), ("row: y,4",), ("row: z,5,2024-01-01,7,8,9",))]
    assert rows == sorted(rows) and all(r.source_block == 0 for r in reasons.values())


def test_all_good_or_nothing(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,day,paid\n1,2024-01-01,2\n")
    parsed, rejected = write_checked(read_checked(spark, str(tmp_path / "in.csv"), SCHEMA), str(tmp_path / "out"))
    assert parsed.count() == 1 and rejected.count() == 0
    (tmp_path / "empty.csv").write_text("id,day,paid\n")
    parsed, rejected = write_checked(read_checked(spark, str(tmp_path / "empty.csv"), SCHEMA), str(tmp_path / "out2"))
    assert parsed.count() == 0 and rejected.count() == 0
