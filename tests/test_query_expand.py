"""query_expand over whole tables; names of the vocabulary met in blocks."""

import __spark_entry__ as driver
from corvane.queries.base import relation

SF = "/root/testdata/sf0.001"


def test_every_message_is_expanded(spark):
    asked = {f"m{r['conv_id']}-{r['turn']}": r["text"] for r in relation(spark, SF, "messages").collect()}
    about = {f"q{r['query_id']}" for r in relation(spark, SF, "graph_queries").collect()}
    df = driver.queries()["query_expand"](spark, SF)
    got = {r["query_id"]: r["query"] for r in df.collect()}
    assert got.keys() == asked.keys() | about
    assert all(got[i].startswith(t) for i, t in asked.items())
