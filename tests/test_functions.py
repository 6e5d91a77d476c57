from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from lakejobs.functions import casts, naming, timekeys


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(("raw", "name"), [("EventId", "event_id"), ("HTTPResponse", "http_response"), ("BEGIN_YEARMONTH", "begin_yearmonth"), ("kebab-case", "kebab_case"), ("two words", "two_words"), ('"quoted"', "quoted"), ("__meta", "__meta"), ("a..b", "a_b"), ("x2Y", "x2_y")])
def test_snake_names(spark, raw, name):
    assert naming.snake(raw) == name
    assert one(spark, naming.snake_column(F.lit(raw))) == (name,)


def test_naming_reaches_structs_and_refuses_collisions(spark):
    df = spark.sql("select 1 as OrderId, array(named_struct('LineNo', 1, 'tax-rate', 0.5D)) as LineItems")
    assert naming.apply_naming(df).schema.simpleString() == "struct<order_id:int,line_items:array<struct<line_no:int,tax_rate:double>>>"
    with pytest.raises(ValueError, match="collision"):
        naming.apply_naming(spark.sql("select 1 as orderId, 2 as order_id"))
    with pytest.raises(ValueError, match=r"x\[\]"):
        naming.apply_naming(spark.sql("select array(named_struct('aB', 1, 'a_b', 2)) as x"))
    assert naming.apply_naming(df, "identity").columns == df.columns


def test_rename_if_present(spark):
    df = spark.sql("select 1 as severity")
    assert naming.rename_if_present(df, "severity", "level").columns == ["level"]
    both = spark.sql("select 1 as severity, 2 as level")
    assert naming.rename_if_present(both, "severity", "level").columns == ["severity", "level"]


@pytest.mark.parametrize(("text", "iso"), [("2026-08-06", "2026-08-06T00:00:00+00:00"), ("2026-08-06T12:00:00+02:00", "2026-08-06T10:00:00+00:00"), ("20260806T231344Z", "2026-08-06T23:13:44+00:00"), ("20260806T231344", "2026-08-06T23:13:44+00:00"), ("2026-08-06T12:00:00.5Z", "2026-08-06T12:00:00.500000+00:00"), ("nonsense", None)])
def test_instants(spark, text, iso):
    assert one(spark, timekeys.iso(timekeys.instant(F.lit(text)))) == (iso,)


def test_keys_and_intervals(spark):
    start = F.lit("2026-08-06T23:13:44Z").cast("timestamp")
    assert one(spark, timekeys.to_key(start), timekeys.text_to_key(F.lit("2026/08/06 23:13:44.1")), timekeys.text_to_key(F.lit("2026-08-06"))) == ("20260806T231344Z", "20260806T231344", "20260806T000000Z")
    assert one(spark, timekeys.iso(timekeys.interval_end(start, F.lit(None).cast("timestamp")))) == ("2026-08-07T23:13:44+00:00",)
    with pytest.raises(Exception, match="must be after"):
        spark.range(1).select(timekeys.checked_end(start, start)).collect()


def test_attempt_window():
    now = datetime(2026, 8, 10, 5, tzinfo=UTC)
    assert timekeys.attempt_window(now=now) == (date(2026, 8, 4), date(2026, 8, 11))
    with pytest.raises(ValueError, match="after"):
        timekeys.attempt_window("2026-08-10", "2026-08-10", now)


def test_identifiers():
    assert timekeys.dataset_id("Severe Weather", 2) == "severe_weather_v2"
    assert timekeys.source_slug("weather", "storm-events") == "weather__storm_events"
    assert timekeys.bronze_schema("Book Index") == "bronze_book_index"


@pytest.mark.parametrize(("text", "number"), [("5.5", 6), ("5.0", 5), ("1e3", 1000), ("1_000", 1000), ("2.5", 3), ("-0.5", -1), ("2147483647.6", None), ("", None), ("x", None), ("5d", None), (" 7 ", 7)])
def test_integer_casts(spark, text, number):
    assert one(spark, casts.integer(F.lit(text))) == (number,)


@pytest.mark.parametrize(("text", "amount"), [("10.00K", 10000.0), ("1.00M", 1e6), ("2B", 2e9), ("3h", 300.0), ("K", 0.0), ("", 0.0), (None, 0.0), ("25", 25.0), ("1e3K", 13000.0), ("5x", 5.0)])
def test_damage(spark, text, amount):
    assert one(spark, casts.damage_amount(F.lit(text).cast("string"))) == (amount,)


def test_small_functions(spark):
    c = F.col("c")
    df = spark.sql("select 'NA' as c")
    assert df.select(casts.null_sentinels(c, ["NA", None]), casts.value_map(c, {"NA": "none"}), casts.boolean(F.lit("t")), casts.double(F.lit("5f"))).first()[:] == (None, "none", True, None)
    assert one(spark, casts.scrub(F.lit("s3://u:p@h/x?token=abc&n=1")), casts.scrub(F.lit("plain ?token=abc")), F.length(casts.scrub(F.lit("a" * 600)))) == ("s3://***@h/x?token=***&n=1", "plain ?token=abc", 500)
    assert one(spark, casts.array_length(F.lit("[1,2]")), casts.array_length(F.lit(None).cast("string")), casts.array_length(F.lit("{}"))) == (2, 0, None)
    assert one(spark, timekeys.duration_ms(F.lit("2026-01-01 00:00:01").cast("timestamp"), F.lit("2026-01-01").cast("timestamp"))) == (0,)


def test_plain_numbers_are_read_as_all_others_are(spark):
    texts = ["7", "+7", "-7", " 7 ", "7.", ".5", "7.5", "-7.5", "1_0", "1__0", "_1", "007", "1e3", "7d", "7f", "", " ", None, "inf", "-NaN", "x", "999999999", "2147483647", "2147483648", "-2147483648.4", "123456789012345678.123456789012345678", "1234567890123456789", "0.1", "2.5", "-2.5", "1.5e9", "7 7", "0x7", "7\n"]
    number, special = r"^[+-]?(\d+(_\d+)*\.?(\d+)?|\.\d+)([eE][+-]?\d+)?$", r"(?i)^[+-]?(inf|infinity|nan)$"
    bare = F.regexp_replace(F.nullif(F.trim("t"), F.lit("")), r"(?<=\d)_(?=\d)", "")
    all_doubles = F.when(bare.rlike(number) | bare.rlike(special), bare.try_cast("double"))
    rounded = F.round(F.when(F.trim("t").rlike(number), all_doubles), 0)
    all_whole = F.when(F.trim("t").rlike(r"^[+-]?\d{1,9}$"), F.trim("t").try_cast("int")).otherwise(F.when(rounded.between(-2147483648.0, 2147483647.0), rounded).cast("int"))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", casts.double(F.col("t")).alias("d"), casts.integer(F.col("t")).alias("i"), all_doubles.alias("all_d"), all_whole.alias("all_i")).collect():
        assert (str(r["d"]), r["i"]) == (str(r["all_d"]), r["all_i"]), r["t"]


def test_casts_of_whole_numbers_stay_small(spark, capsys):
    """Patterns are repeated by every use of a value within the next; it was 20 before values were bound."""
    spark.createDataFrame([("7",)], "t string").select(casts.integer(F.col("t"))).explain()
    assert 0 < capsys.readouterr().out.count("RLIKE") <= 12
