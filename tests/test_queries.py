"""Every query of the library against its SQL."""

import pytest
from oracle import same_rows

from hopweave import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_sql(spark, sf, name):
    same_rows(catalog.queries()[name](spark, sf), catalog.oracle_sql()[name], sf)


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) <= set(entry.queries())
    out = entry.entry(spark)
    assert out.columns == ["qid", "rank", "id", "label", "depth", "score", "best_path"]
    assert out.select("qid").distinct().count() == 40


def test_page_ranks_of_all_questions(spark, sf):
    rows = catalog.queries()["page_rank"](spark, sf).toPandas()
    assert rows.groupby("qid")["ppr"].agg(["min", "max"]).eq([0, 1]).all().all()


def test_clusters_cover_each_title(spark, sf):
    rows = catalog.queries()["clusters"](spark, sf).toPandas()
    assert rows["chunk_id"].is_unique
    for _, g in rows.groupby("title"):
        k = max(1, min(len(g) // 3, 5))
        assert g["cluster"].between(0, k - 1).all()
