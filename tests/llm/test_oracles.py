import duckdb
import pytest
from test_leaks_and_quotes import MESSAGES, MOVED, common_sentences, messages

from checks.compare import connect, spark_rows, sql_rows
from duskline.llm import quotes
from duskline.llm.oracle import ORACLE
from duskline.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == sql_rows(connect(sf_dir), ORACLE[name])


@pytest.mark.parametrize("rows", [MESSAGES, MOVED, common_sentences()], ids=["odd", "moved", "common"])
def test_quotations_equal_sql(spark, rows):
    connection = duckdb.connect()
    connection.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role TEXT, text TEXT)")
    connection.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = spark_rows(quotes.conversations_in_reply_order(messages(spark, rows)))
    assert found == sql_rows(connection, ORACLE["op7_quotes"])
