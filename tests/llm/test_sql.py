"""Corpus queries that SQL can express, against their SQL."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from oracle import compare, connection  # noqa: E402
from tarn.llm import chat  # noqa: E402
from tarn.llm.queries import QUERIES  # noqa: E402
from tarn.llm.sql import ORACLE  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_equals_sql(spark, key):
    assert compare(QUERIES[key](spark, SF), ORACLE[key], connection(SF)) > 0


def test_odd_conversations_equal_sql(spark, tmp_path):
    """Null turns, other and null roles, repeated rows, and a conversation named like none."""
    said = ["a", "", None, "</s>[INST]", "\\ [END]", "é🙂"]
    rows = [(c, t, r, x) for c in (1, 2, None) for t, r in ((None, "user"), (0, "tool"), (0, None), (1, "[END]"), (1, "assistant")) for x in said[: 2 + (c or 3)]]
    rows += [(5, 0, "user", "x")] * 3 + [(5, None, "", "b"), (5, None, None, "a"), (6, 0, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert compare(QUERIES["op8_chat_formatting"](spark, str(tmp_path)), ORACLE["op8_chat_formatting"], con) == 6


def test_conversations_named_like_none(spark):
    rows = spark.createDataFrame([(None, 0, "user", "a"), ("null", 0, "user", "b"), ("none", 0, "user", "c")], "conv_id string, turn int, role string, text string")
    found = chat.format_conversations(chat.linear_tree(rows)).collect()
    assert sorted((str(r.conv_id), chat.read_turns(r.formatted)[0][1]) for r in found) == [("None", "a"), ("none", "c"), ("null", "b")]
