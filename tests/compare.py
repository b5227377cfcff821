"""Row-for-row comparison of a Spark result with DuckDB SQL."""


def canonical(frame):
    names = sorted(frame.columns)
    rows = frame[names].astype(object).where(frame[names].notna(), None).values.tolist()
    return names, sorted(map(repr, rows))


def same(spark_df, con, sql):
    got, want = canonical(spark_df.toPandas()), canonical(con.sql(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1], [(a, b) for a, b in zip(got[1], want[1]) if a != b][:3]
