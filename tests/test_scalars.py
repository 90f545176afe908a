"""Scalar functions on small literals, with the values of the fixtures."""

import pytest
from pyspark.sql import functions as F

from camwatch.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("make", "expected"),
    [
        (lambda: S.sanitize_camera(F.lit("Front Door!")), "front_door"),
        (lambda: S.sanitize_camera(F.lit("?")), "unknown"),
        (lambda: S.normalize_sub_label(F.lit('["Bob ", 0.9]')), "Bob"),
        (lambda: S.normalize_sub_label(F.lit(None).cast("string")), None),
        (lambda: S.folder_ts(F.lit("1700_ab_c")), 1700),
        (lambda: S.folder_ts(F.lit("x_ab")), None),
        (lambda: S.folder_id(F.lit("1700_ab_c")), "ab_c"),
        (lambda: S.strip_canceled(F.lit("a-canceled")), "a"),
        (lambda: S.cancel_name(F.lit("a-canceled")), "a-canceled"),
        (lambda: S.parse_summary(F.lit("A: 1\nnone\nA: b: c"))["A"], "b: c"),
        (lambda: S.format_size(F.lit(0)), "0 KB"),
        (lambda: S.format_size(F.lit(1536)), "1.50 KB"),
        (lambda: S.format_size(F.lit(5 * 2**30)), "5.00 GB"),
        (lambda: S.default_title(F.lit("person"), F.lit("front_door")), "Person detected at Front Door"),
        (lambda: S.strip_code_fence(F.lit("```json\n{}\n```")), "{}"),
        (lambda: S.parse_analysis(F.lit("[1]")), None),
        (lambda: S.parse_analysis(F.lit("{bad")), None),
        (lambda: S.format_duration(F.lit(None).cast("double")), "—"),
        (lambda: S.format_duration(F.lit(3725.0)), "1h 2m 5s"),
        (lambda: S.redact_url(F.lit("rtsp://u:p@h:1/x")), "rtsp://u:***@h:1/x"),
        (lambda: S.safe_relative_path(F.lit("../x")), False),
        (lambda: S.safe_relative_path(F.lit("a/../b")), True),
        (lambda: S.safe_relative_path(F.lit(None).cast("string")), False),
        (lambda: S.coerce_bool(F.lit("On")), True),
        (lambda: S.is_no_concerns(F.lit(" No Concerns. ")), True),
        (lambda: S.is_test_run(F.lit("test12")), True),
    ],
)
def test_value(spark, make, expected):
    assert one(spark, make()) == expected


def test_box(spark):
    box = S.normalize_box(F.lit(100.0), F.lit(200.0), F.lit(300.0), F.lit(400.0), F.lit(1000), F.lit(800))
    assert tuple(one(spark, box)) == (0.25, 0.1, 0.5, 0.3)
    assert one(spark, S.normalize_box(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(0), F.lit(0))) is None
