"""Every catalogued query against its independent SQL."""

import pytest
from conftest import SF

from tidelog.plans import catalogue, oracles

SQL = oracles.oracle_sql()


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    q = duck.execute(SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert found == ordered(tuple(plain(r[i]) for i in at) for r in q.fetchall())


def test_what_has_no_sql_is_known():
    assert set(catalogue.queries()) - set(SQL) == {"log_checksums"}


def test_log_checksums(spark):
    import zlib

    from tidelog.sources.logs import events_log

    log = {r["pos"]: r for r in events_log(spark, SF).collect()}
    for r in catalogue.queries()["log_checksums"](spark, SF).collect():
        m = log[r["pos"]]
        head = f"{m['op']}|{len(m['key'].encode())}|{len(m['value'].encode())}"
        assert r["crc32"] == zlib.crc32((head + m["key"] + m["value"]).encode())
