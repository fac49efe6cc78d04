import pytest
from pyspark.sql import functions as F

from chronosift.functions.jsonpath import json_cell, json_found, json_value

DEEP = '{"a":{"b":[{"c":1},{"c":"x"},{"d":[1,2]}],"e":{"f":1,"g":2}},"odd key":{"it\'s":5}}'


@pytest.mark.parametrize("cell,path,value,cell_shown", [
    ('{"name":"Alice"}', "$.name", "Alice", "Alice"), ('{"count":42}', "$.count", "42", "42"),
    ('{"price":19.99}', "$.price", "19.99", "19.99"), ('{"active":true}', "$.active", "true", "true"),
    ('{"active":false}', "$.active", "false", "false"), ('{"a":{"b":{"c":"deep"}}}', "$.a.b.c", "deep", "deep"),
    ('{"name":"Alice"}', "$.age", None, ""), ("not json", "$.name", None, "not json"), ("{}", "$.name", None, ""),
    ('{"name":null}', "$.name", "", ""), ('{"d":3600.0}', "$.d", "3600", "3600"),
    ('{"tags":["x","y"]}', "$.tags", '["x","y"]', '["x","y"]'), ("", "$.key", None, ""), (None, "$.key", None, ""),
    (DEEP, "$.a.b[*].c", "1", '[1,"x"]'), (DEEP, "$.a.b[2].d[1]", "2", "2"), (DEEP, "$.a.b[9]", None, ""),
    (DEEP, "$.a.e.*", "1", "[1,2]"), (DEEP, "$.a.b[*].d", "[1,2]", "[1,2]"), (DEEP, "$['odd key'].*", "5", "5"),
    (DEEP, "$.a.b[-1].d", "[1,2]", "[1,2]"), (DEEP, "$.a.b[-9]", None, ""), (DEEP, "$.a.b[0:2].c", "1", '[1,"x"]'),
    (DEEP, "$.a.b[-2:].c", "x", "x"), (DEEP, "$.a.b[:-2].c", "1", "1"), (DEEP, "$.a.b[2:1]", None, ""),
    (DEEP, "$..c", "1", '[1,"x"]'), (DEEP, "$.a..d[0]", "1", "1"), (DEEP, "$..f", "1", "1"), (DEEP, "$..zz", None, ""),
    (DEEP, "$.a.b[?(@.c == 'x')].c", "x", "x"), (DEEP, "$.a.b[?(@.c != 'x')].c", "1", "1"),
    (DEEP, "$.a.b[?(@.c >= 1)].c", "1", "1"), (DEEP, "$.a.b[?(@.c < 1)]", None, ""), (DEEP, "$.a.b[?(@.d)].d[1]", "2", "2"),
    (DEEP, "$..[?(@.c == '1')]", None, ""), ("not json", "$..a", None, "not json"), (None, "$..a", None, ""),
    ('{"a":[{"b":null},{"b":true}]}', "$.a[?(@.b == true)].b", "true", "true"),
    ('{"a":[{"b":null},{"b":true}]}', "$.a[?(@.b == null)].b", "", ""),
    ('[{"id":7}]', "$[0].id", "7", "7"), ('{"x":1}', "$", '{"x":1}', '{"x":1}')])
def test_values(spark, cell, path, value, cell_shown):
    df = spark.createDataFrame([(cell,)], "v string")
    row = df.select(json_value(F.col("v"), path), json_found(F.col("v"), path), json_cell(F.col("v"), path)).first()
    assert list(row) == [value, value is not None, cell_shown]


@pytest.mark.parametrize("path", ["$.a[*]..b", "$..", "$.a[?(@.b==x y)]", "$.a[?(@..b==1)]", "$[1:2:3]", "$.a b"])
def test_unsupported_paths_are_named(spark, path):
    with pytest.raises(ValueError):
        json_value(F.col("v"), path)
