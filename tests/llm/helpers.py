import duckdb


def oracle(sf, sql, *tables):
    con = duckdb.connect()
    for t in tables or ("documents", "embeddings", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(sql)
    return [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]


def same_rows(df, rows):
    """Column by column, whatever the order."""
    got = [r.asDict() for r in df.collect()]
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted(got, key=key) == sorted(rows, key=key)
