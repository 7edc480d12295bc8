import pytest

from strandline.operators import junctions

JUN = "junction_key string, c string, c2 string, pos_a long, pos_b long, length long, rep_low long, rep_high long"
PANEL = "c string, p long, c2 string, q long, ci int"


@pytest.mark.parametrize(
    "junction, record, found",
    [
        ((5000, 5300, 300, None, None), ("1", 5900, "1", 6200, 0), True),  # same length, 900 apart
        ((5000, 5300, 300, None, None), ("1", 6000, "1", 6300, 0), True),
        ((5000, 5300, 300, None, None), ("1", 6001, "1", 6301, 0), False),
        ((5000, 5300, 300, None, None), ("1", 5090, "1", 5450, 0), True),  # sum of 150
        ((5000, 5300, 300, None, None), ("1", 5091, "1", 5451, 0), False),
        ((5000, 5300, 300, None, None), ("1", 5091, "1", 5451, 1), True),
        ((5000, 5300, 300, 4000, 7000), ("1", 5800, "1", 6300, 0), True),  # sum of 1000 in a repeat
        ((5000, 5300, 300, 4000, 7000), ("1", 5800, "1", 6301, 0), False),
        ((5000, 5300, 300, 4000, 5500), ("1", 5525, "1", 5825, 0), True),
        ((5000, 5300, 300, 4000, 5500), ("1", 5526, "1", 5826, 0), False),
        ((5000, None, 300, None, None), ("1", 5100, "1", 5450, 0), True),  # insertions by length: 300 and 350
        ((5000, None, 300, None, None), ("1", 5100, "1", 8100, 0), False),
    ],
)
def test_bounds_of_panel_records(spark, junction, record, found):
    rows = spark.createDataFrame([("k", "1", "1", *junction)], JUN)
    assert junctions.in_panel(rows, spark.createDataFrame([record], PANEL)).count() == found


def test_two_contigs_in_either_order(spark):
    rows = spark.createDataFrame([("near", "1", "2", 5000, 900, 0, None, None), ("far", "1", "2", 5000, 1200, 0, None, None)], JUN)
    got = junctions.in_panel(rows, spark.createDataFrame([("2", 910, "1", 5100, 0)], PANEL))
    assert [x[0] for x in got.collect()] == ["near"]
