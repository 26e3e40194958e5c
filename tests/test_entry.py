import __spark_entry__ as E
import pytest


def test_every_query_has_sql():
    from touchline.plans import registry

    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)
    assert set(registry.QUERIES) <= set(E.queries()) and set(registry.ORACLE_SQL) <= set(E.oracle_sql())


def test_entry(spark):
    assert E.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["league_table", "natural_level", "sequence_outcomes", "finance_rank", "storyline_score", "theme_events", "movement_sections", "stat_cards", "facts_panel", "history_sentences", "seed_finances", "published_seasons", "seed_changes", "seed_published", "file_refresh", "nearest_grounds", "order_ranks", "order_tiles", "cheaper_above", "name_searches", "account_spells", "shared_spells", "rule_intervals", "top_yo_yo_sql", "career_refresh", "outspender", "single_tier_rank", "metric_catalogue", "timeline", "name_key_cases", "division_names", "rules_lookup"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = E.queries()[name](spark, sf)
    cols = sorted(got.columns)
    view = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({E.oracle_sql()[name]})").fetchall()
    assert view(got.select(*(f"`{c}`" for c in cols)).collect()) == view(want) and want
