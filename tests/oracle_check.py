"""Run catalogue queries next to their SQL twins: ``python tests/oracle_check.py <sf dir> [names...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=lambda r: tuple((v is None, str(v)) for v in r)
    )


def _plain(value):
    if isinstance(value, float):
        return float(repr(value))
    return value


def compare(spark, con, folder: str, query, sql: str) -> tuple[str, int]:
    frame = query(spark, folder)
    ours = frame.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} vs {sorted(names)}", len(ours)
    a, b = canonical(ours, frame.columns), canonical(theirs, names)
    if len(a) != len(b):
        extra = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"rows {len(a)} vs {len(b)}; {str(extra)[:700]}", len(ours)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} rows differ, first {str(wrong[0])[:700]}", len(ours)
    types = [(str(d[1]), f.dataType.simpleString(), f.name) for d, f in zip(
        sorted(cursor.description, key=lambda d: d[0]), sorted(frame.schema.fields, key=lambda f: f.name))]
    return "ok " + " ".join(f"{n}:{s}/{d}" for d, s, n in types if TYPE_NAMES.get(s, s) != d.lower()), len(ours)


TYPE_NAMES = {"int": "integer", "string": "varchar"}


def main() -> None:
    import __spark_entry__ as contract
    from opinionloom.session import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session("oracle-check", "local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(folder)
    queries, oracles = contract.queries(), contract.oracle_sql()
    for name in names or queries:
        started = time.time()
        try:
            if name in oracles:
                verdict, rows = compare(spark, con, folder, queries[name], oracles[name])
            else:
                verdict, rows = "rows only", len(queries[name](spark, folder).collect())
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            verdict, rows = "FAILED " + str(error)[:900], -1
        print(f"CHECK {name} {rows} {time.time() - started:.1f}s {verdict}", flush=True)


if __name__ == "__main__":
    main()
