from __future__ import annotations

import pytest
from pyspark.sql import types as T

from fieldform.contracts import ContractError
from fieldform.sources.records import read_records, write_records

ROUTES = T.StructType(
    [
        T.StructField("surface", T.StringType()),
        T.StructField("default", T.StringType()),
        T.StructField("bands", T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("model", T.StringType())]))),
        T.StructField("through", T.DateType()),
    ]
)
GOOD = '{"surface": "turf", "default": "m1", "bands": [{"lo": 1000, "model": "m2"}], "through": "2001-02-03"}'


def lines(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "no int, value string").repartition(3)


def test_every_line_is_a_record_or_has_a_reason(spark):
    texts = {
        GOOD: None,
        '{"surface": "dirt", "default": null, "bands": null, "through": null}': ("missing_field", "default"),
        '{"default": "m1"}': ("missing_field", "surface"),
        '{"surface": "turf", "default": "m1", "colour": 1, "size": 2}': ("unknown_field", "colour"),
        '{"surface": "turf", "default": "m1", "bands": 7}': ("wrong_type", None),
        '{"surface": "turf", "default": "m1", "through": "yesterday"}': ("wrong_type", None),
        '{"surface": "turf", "default"': ("not_an_object", None),
        '["turf"]': ("not_an_object", None),
        "7": ("not_an_object", None),
        "turf": ("not_an_object", None),
        " \t": ("empty", None),
        "": ("empty", None),
        None: ("empty", None),
        '{"surface": "turf", "default": "' + "x" * 200_000 + '"}': None,
    }
    good, bad = read_records(lines(spark, *texts), ROUTES, ["surface", "default"])
    got = {r["no"]: (r["reason"], r["field"]) for r in bad.collect()}
    assert got == {i: why for i, why in enumerate(texts.values()) if why}
    assert sorted(r["no"] for r in good.collect()) == [0, 13]
    row = good.filter("no = 0").first()
    assert row["bands"][0]["model"] == "m2" and str(row["through"]) == "2001-02-03"


def test_unknown_fields_are_let_through_on_request(spark):
    good, bad = read_records(lines(spark, '{"surface": "turf", "colour": 1}'), ROUTES, strict=False)
    assert good.count() == 1 and bad.count() == 0


def test_records_come_back_from_their_text(spark):
    texts = [GOOD, GOOD, '{"surface": "a\\"b\\n\\u00e9", "bands": []}', "{}"]
    good, bad = read_records(lines(spark, *texts), ROUTES)
    again, broken = read_records(write_records(good, ROUTES.names), ROUTES)
    key = lambda r: repr(tuple(r))
    assert bad.count() == broken.count() == 0
    assert sorted(map(key, good.drop("no").collect())) == sorted(map(key, again.collect()))


def test_good_records_are_written_while_broken_lines_stand_beside_them(spark):
    good, _ = read_records(lines(spark, GOOD, None, "", "x", "[]", '{"surface": 1', '{"bands": 7}').drop("no"), ROUTES)
    again, broken = read_records(write_records(good), ROUTES)
    assert [r["surface"] for r in again.collect()] == ["turf"] and broken.count() == 0


def test_empty_table_and_clashing_names(spark):
    good, bad = read_records(lines(spark, GOOD).filter("false"), ROUTES)
    assert good.count() == bad.count() == 0 and good.columns == ["no", *ROUTES.names]
    with pytest.raises(ContractError, match="surface"):
        read_records(lines(spark, GOOD).withColumnRenamed("no", "Surface"), ROUTES)
    with pytest.raises(ContractError, match="colour"):
        read_records(lines(spark, GOOD), ROUTES, ["colour"])
