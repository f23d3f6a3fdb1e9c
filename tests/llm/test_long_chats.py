"""Chat records with texts beyond the JSON parser's usual length."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rigspark.llm import chat_format


def long_records(spark, start: str, end: str, length: int):
    return spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.concat(F.lit(start), F.repeat(F.lit("x"), F.lit(length) + F.col("id").cast("int")), F.lit(end)).alias("record"))


@pytest.mark.parametrize("record", [('{"role": "assistant", "text": "', '"}'), ('{"role": null, "text": "', '"}'), ('{"messages": [{"role": "assistant", "content": "', '"}]}')])
def test_long_turn_stays(spark, record):
    formatted = chat_format.format_chats(chat_format.canonical_turns(long_records(spark, *record, 21_000_000)))
    back = chat_format.read_back(formatted).select(F.size("turns").alias("n"), F.col("turns")[0]["role"].alias("role"), F.char_length(F.col("turns")[0]["text"]).alias("chars"), F.char_length("formatted").alias("all")).first()
    role = "" if "null" in record[0] else "assistant"
    assert tuple(back) == (1, role, 21_000_000, 21_000_013 + len(role))


def test_long_text_that_is_no_record(spark):
    assert chat_format.canonical_turns(long_records(spark, "no json ", "", 21_000_000)).first()["turns"] == []


def test_too_large_a_record_is_an_error(spark):
    with pytest.raises(PySparkException):
        chat_format.canonical_turns(long_records(spark, '{"role": "user", "text": "', '"}', 140_000_000)).select(F.size("turns")).collect()
