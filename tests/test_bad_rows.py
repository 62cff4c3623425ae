import re
import time

import pytest

from pathweave.operators.bad_rows import Grammar, failing_lines, parse_lines, parse_texts

LINES = [
    ("1\tX1", None), ('"1"\t"X1"', None), (' "1" \t X1 \r', None), ('"1\t2"', "column_count"), ("", "column_count"), (None, "column_count"), (" \r", "column_count"), ("1\tX1\t", "column_count"),
    ("1", "column_count"), ('"1\tX1', "quoting"), ('1"\tX1', "quoting"), ('"1"x\tX1', "quoting"), ('"1""\tX1', "quoting"), ("a\tX1", "invalid_value"), ("1\tY1", "invalid_value"), ('"1\t"\tX1', "invalid_value"),
    ("1\tX1\n", "column_count"), ("1\tX1" + "1" * 100000, "invalid_value"),
]


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame([("A", "[0-9]+"), ("B", "X[0-9]")], "db_name string, id_pattern string")


def test_reasons(spark, registry):
    df = spark.createDataFrame([(i, "A", "B", r, "clash") for i, (r, _) in enumerate(LINES)], "line_id bigint, src_db string, dst_db string, raw_line string, reason string")
    got = {r.line_id: r.reason for r in failing_lines(df, registry).collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(LINES) if reason}
    ok = parse_lines(df, registry).filter("reason is null").collect()
    assert {(r.src_id, r.dst_id) for r in ok} == {("1", "X1")}


def test_unknown_database_and_empty(spark, registry):
    schema = "line_id bigint, src_db string, dst_db string, raw_line string"
    assert failing_lines(spark.createDataFrame([(1, None, "B", "1\tX1")], schema), registry).first().reason == "invalid_value"
    assert failing_lines(spark.createDataFrame([], schema), registry).count() == 0


def test_recovery_at_anchors():
    text = '1\tX1\n"2\tX2\nrest of it\n3\tX3\n4\n5\tX5'
    valid = lambda k, v: re.fullmatch(("[0-9]+", "X[0-9]")[k], v) is not None
    records = list(Grammar(text, valid).file())
    assert [(r.values, r.reason) for r in records] == [(["1", "X1"], None), ([], "quoting"), (["3", "X3"], None), (["4"], "column_count"), (["5", "X5"], None)]
    assert text[records[1].error_at] == '"'


def valid(k, v):
    return re.fullmatch(("[0-9]+", "X[0-9]")[k], v) is not None


def test_record_that_closes_a_broken_quote_is_kept():
    records = list(Grammar('"1\tX1\n"2"\tX2\n3\tX3', valid).file())
    assert [(r.values, r.reason) for r in records] == [([], "quoting"), (["2", "X2"], None), (["3", "X3"], None)]


def test_values_over_lines():
    long = lambda k, v: k == 1 or v.startswith("a")
    assert [r.values for r in Grammar('"a\n""b"""\tX1\na\tX2', long).file()] == [['a\n"b"', "X1"], ["a", "X2"]]


def test_many_open_quotes_take_linear_time():
    n = 60_000
    text = '"1\tX1 x\n' * (2 * n + 1) + "5\tX5"
    began = time.process_time()
    records = list(Grammar(text, valid).file())
    assert records[-1].values == ["5", "X5"] and records[0].reason == "quoting" and time.process_time() - began < 20


def test_texts(spark, registry):
    schema = "text_id bigint, src_db string, dst_db string, text string, reason string"
    df = spark.createDataFrame([(1, "A", "B", '1\tX1\n"2\tX2\n3\tX3\n4\n', "x"), (2, "A", "B", "", "x"), (3, "A", "B", None, "x"), (4, None, "B", "1\tX1", "x")], schema)
    rows = {(r.text_id, r.record_no): (r.src_id, r.dst_id, r.reason, r.error_at) for r in parse_texts(df, registry).collect()}
    assert rows == {(1, 0): ("1", "X1", None, None), (1, 1): (None, None, "quoting", 5), (1, 2): ("3", "X3", None, None), (1, 3): (None, None, "column_count", 16), (4, 0): (None, None, "invalid_value", 0)}
