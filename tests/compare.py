"""Compare a Spark result with a DuckDB result: names, type families, values."""

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf_dir, name)}.parquet'")
    return con


def _family(type_name):
    t = type_name.lower()
    if t in ("bigint", "int", "integer", "smallint", "tinyint"):
        return "int"
    if t in ("double", "float"):
        return "float"
    if t in ("string", "varchar"):
        return "text"
    return t


def _sort_key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def differences(spark_df, con, sql):
    """List of what differs; empty when the results agree exactly."""
    result = con.execute(sql)
    duck_types = {d[0]: _family(str(d[1])) for d in result.description}
    duck_rows = result.fetchall()
    duck_names = [d[0] for d in result.description]
    spark_types = {f.name: _family(f.dataType.simpleString()) for f in spark_df.schema.fields}
    found = []
    if duck_types != spark_types:
        found.append(f"columns: spark {spark_types} duckdb {duck_types}")
        if set(duck_types) != set(spark_types):
            return found
    names = sorted(spark_types)
    left = sorted((tuple(r[n] for n in names) for r in spark_df.collect()), key=_sort_key)
    right = sorted((tuple(r[duck_names.index(n)] for n in names) for r in duck_rows), key=_sort_key)
    if len(left) != len(right):
        return found + [f"rows: spark {len(left)} duckdb {len(right)}"]
    if not left:
        found.append("no rows")
    bad = [(a, b) for a, b in zip(left, right)
           if any(x != y and not (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y))
                  for x, y in zip(a, b))]
    if bad:
        found.append(f"values: {len(bad)} rows differ, e.g. spark {str(bad[0][0])[:300]} duckdb {str(bad[0][1])[:300]}")
    return found
