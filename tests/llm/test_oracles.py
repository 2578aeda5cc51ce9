"""Registered queries with SQL against DuckDB."""

import pytest
from compare import connection, same
from samples import DATA

from lakequill.llm import queries


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query(spark, name):
    same(queries.queries()[name](spark, f"{DATA}/sf0.001"), connection(f"{DATA}/sf0.001"), queries.oracle_sql()[name])


def test_quotes_on_threads(spark):
    """The registered table may hold no quotation; these rows do."""
    import duckdb
    import pandas as pd
    from test_quotes import COLUMNS, ROWS, threads

    from lakequill.llm import oracles, quotes

    rows = ROWS + threads(300, 8, 8)[0]
    con, conversations = duckdb.connect(), pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    con.register("conversations", conversations)
    same(quotes.linked_conversations(spark.createDataFrame(rows, COLUMNS)), con, oracles.QUOTES)


def test_archives_with_revisits(spark, tmp_path):
    import duckdb
    import pandas as pd
    from test_warc import ROWS

    from lakequill.llm import oracles, warc

    con, pages = duckdb.connect(), pd.DataFrame([r for r in ROWS if r[0] is not None], columns=["page_id", "url", "html"])
    con.register("pages", pages)
    df = spark.createDataFrame([r for r in ROWS if r[0] is not None], "page_id long, url string, html string")
    same(warc.round_trip(df, f"file://{tmp_path}/w").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), con, oracles.WARC)
