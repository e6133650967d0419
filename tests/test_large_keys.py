"""Call sites whose seq is beyond a BIGINT: order keys from a million on, as larger copies of the tables have."""

import os
from decimal import Decimal

import duckdb
import pytest

from graphloom.plans import answers, catalog, code, projects  # noqa: F401 - each registers its queries in catalog

QUERIES = ["resolve_calls", "extension_containers", "graph_fingerprint", "candidate_fan_out", "ambiguous_callers", "audit", "admitted_sites", "audit_of_sound_tables", "call_candidates", "build_report", "build_report_by_symbols", "candidate_groups", "own_candidates", "degradations", "running_candidates", "indexing_status", "syntax_callers"]


@pytest.fixture(scope="module")
def large(sf, tmp_path_factory):
    """The tables with order keys from 1 000 000 on."""
    at = tmp_path_factory.mktemp("large")
    c = duckdb.connect()
    for name in os.listdir(sf):
        t = name.removesuffix(".parquet")
        key = {"orders": "o_orderkey", "lineitem": "l_orderkey"}.get(t)
        if key:
            c.execute(f"COPY (SELECT * REPLACE ({key} + 1000000 AS {key}) FROM '{sf}/{name}') TO '{at}/{name}' (FORMAT parquet)")
        else:
            (at / name).symlink_to(f"{sf}/{name}")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{name}'")
    return str(at), c


@pytest.mark.parametrize("name", QUERIES)
def test_query_beyond_bigint(spark, large, name):
    at, duck = large
    # DuckDB's own BIGINT overflows here as well, so its seq is a HUGEINT for this comparison.
    assert "l_orderkey * 10000000000000 " in catalog.ORACLE[name] or name == "audit_of_sound_tables"
    r = duck.execute(catalog.ORACLE[name].replace("l_orderkey * 10000000000000 ", "l_orderkey::HUGEINT * 10000000000000 "))
    df = catalog.QUERIES[name](spark, at)
    cols = [d[0] for d in r.description]
    plain = lambda row: repr(tuple(int(x) if isinstance(x, Decimal) else x for x in row))
    assert sorted(plain(x) for x in df.select(*cols).collect()) == sorted(plain(x) for x in r.fetchall())


def test_seq_is_a_long_where_it_fits(spark, sf, large):
    from graphloom.sources.facts import Facts

    assert dict(Facts(spark, sf).call_sites().dtypes)["seq"] == "bigint"
    assert dict(Facts(spark, large[0]).call_sites().dtypes)["seq"] == "decimal(38,0)"
