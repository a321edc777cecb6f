from hypothesis import given, settings, strategies as st

from folioflow.operators.records import RecordReader, parse_records, split_dates

GOOD = 'kx000000012,1999,May,11,Tuesday,Title,"a, ""b""\nc",Sports'


def reason(spark, *lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "row_no int, line_text string")
    return {r.row_no: r.reason for r in parse_records(df, "line_text").collect()}


def test_reasons_in_order(spark):
    lines = [
        GOOD, GOOD.replace('c",', "c,"), GOOD.replace("Sports", 'Sp"orts'), GOOD + ",more", "", GOOD.replace("1999", "19999"), GOOD.replace("1999", " 1999 "),
        GOOD.replace("May", "Mai"), GOOD.replace("May", "mAY"), GOOD.replace(",11,", ",32,"), GOOD.replace("May,11", "February,29"), GOOD.replace("1999,May,11", "2000,February,29"),
        GOOD.replace("1999,May", "x,y"), GOOD.replace("1999", '"1999"'), GOOD.replace("1999", ""), GOOD + "\r\n", None, GOOD.replace('"a, ', '"a" '),
    ]
    want = [None, "quoting", "quoting", "column_count", "column_count", "year", None, "month", None, "day", "day", None, "year", None, "year", None, "column_count", "quoting"]
    assert [reason(spark, *lines)[i] for i in range(len(lines))] == want


def test_record_and_place(spark):
    df = spark.createDataFrame([(1, GOOD, "x"), (2, GOOD.replace("Sports", 'Sp"orts'), "y")], "row_no int, line_text string, reason string")
    a, b = parse_records(df, "line_text").orderBy("row_no").collect()
    assert a.record.text == 'a, "b"\nc' and a.reason is None and a.n_fields == 8
    assert b.record is None and b.reason_at == GOOD.index("Sports") + 2


def test_recovery_at_anchor(spark):
    broken = 'kx000000013,1999,May,12,Wed,"open, text'
    file = "\n".join([GOOD, broken, GOOD, "", GOOD])
    df = spark.createDataFrame([(file,)], "t string")
    got = [(r.reason, r.record is None) for r in parse_records(df, "t", whole=False).collect()]
    assert got.count((None, False)) == 3 and ("quoting", True) in got and ("column_count", True) in got


def test_empty_table_and_dates(spark):
    empty = spark.createDataFrame([], "row_no int, line_text string")
    assert parse_records(empty, "line_text").count() == 0
    df = spark.createDataFrame([(" 2002", "JULY", "04"), ("2001.0", "May", "1"), (None, "May", "1"), ("2000", "Sept", "1"), ("2000", "April", "31"), ("2000", "April", "3rd")], "year string, month string, num_day string")
    assert [r.reason for r in split_dates(df).collect()] == [None, "year", "year", "month", "day", "day"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab,"\n ', max_size=8), min_size=1, max_size=6))
def test_round_trip(fields):
    line = ",".join('"' + f.replace('"', '""') + '"' for f in fields)
    (record,) = RecordReader(line, whole=True).records()
    assert record.fields == fields and record.error is None


def test_records_glued_to_a_broken_line(spark):
    broken = 'kx000000013,1999,May,12,Wed,"open, text'
    df = spark.createDataFrame([(1, broken + "\n" + GOOD), (2, broken + "\nno record, this"), (3, broken + "\r\n" + GOOD + "\n" + GOOD)], "row_no int, line_text string")
    rows = parse_records(df, "line_text").collect()
    assert [(r.row_no, r.record_no, r.reason) for r in rows] == [(1, 0, "quoting"), (1, 1, None), (2, 0, "quoting"), (3, 0, "quoting"), (3, 1, None), (3, 2, None)]


def test_an_anchor_is_a_whole_record():
    reader = RecordReader("a,b\n" + GOOD + "\nc,d,e,f,g,h,i,j", whole=False)
    assert not reader.anchored(0) and reader.anchored(4) and reader.anchored(len(GOOD) + 5)
