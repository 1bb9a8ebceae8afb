import pytest

from docuflux import registry

from .compare import TINY, same

#: Queries that SQL does not express; other tests hold them or their operators against plain versions.
BRUTE = {"w20_split_rows", "w8_paragraphs", "w13_linked_lists", "w14_label_lists", "j8_vector_index", "b19_layout_run", "f9_mask_pii", "r2_mmr", "g1_chunks", "s4_html_text", "f10_sanitize", "t8_reading_order", "x7_breaker", "g5_two_levels", "r5_hierarchical", "w11_page_edges", "w14_lists", "w15_levels"}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, TINY)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert name in BRUTE and df.count() > 0
    else:
        same(df, sql)
        assert not df.isEmpty()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert e.entry(spark).count() > 0
