"""Named relations: each is one SQL statement over others, in the common ground of Spark SQL and DuckDB.

A relation is planned by Catalyst as part of the query that uses it. Any of them can be replaced by a DataFrame, so
that an analyst's own tables take the place of the ones derived here. What the two engines spell differently is
written as a macro.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RELATIONS: dict[str, str] = {}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

#: Macro: (Spark, DuckDB), with the arguments as {0}, {1}.
MACROS = {
    "SET": ("array_join(array_sort(collect_set({0})), '|')", "coalesce(array_to_string(list_sort(list(DISTINCT {0}) FILTER ({0} IS NOT NULL)), '|'), '')"),
    "LIST": ("array_join(array_sort(collect_list({0})), '|')", "coalesce(array_to_string(list_sort(list({0}) FILTER ({0} IS NOT NULL)), '|'), '')"),
    "PATH": ("array_join(transform(array_sort(collect_list(struct({1} AS p, {0} AS v))), x -> x.v), '|')", "string_agg({0}, '|' ORDER BY {1}, {0})"),
    "EPOCH": ("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {0})", "CAST(floor(epoch({0})) AS BIGINT)"),
    "DAY": ("date_format(date_add(DATE'1970-01-01', CAST(floor({0} / 86400) AS INT)), 'yyyy-MM-dd')", "strftime(DATE '1970-01-01' + CAST(floor({0} / 86400) AS INTEGER), '%Y-%m-%d')"),
    "LIKE": ("{0} RLIKE '{1}'", "regexp_matches({0}, '{1}')"),
    "INT": ("CAST({0} AS BIGINT)", "CAST(trunc({0}) AS BIGINT)"),
    "DOT": ("aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (a, x) -> a + x)", "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"),
    "PERCENTILE": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    # amounts have two decimals: their sum as decimals doesn't depend on the order of adding
    "EXACT": ("CAST(sum(CAST({0} AS DECIMAL(18, 2))) AS DOUBLE)", "CAST(sum(CAST({0} AS DECIMAL(18, 2))) AS DOUBLE)"),
    "STEPS": ("explode(sequence({0}, {1}))", "unnest(generate_series({0}, {1}))"),
    "JSON": ("to_json(named_struct({0}))", "CAST(json_object({0}) AS VARCHAR)"),
    "OBJECT": ("named_struct({0})", "json_object({0})"),
    "SHA": ("sha2({0}, 256)", "sha256({0})"),
}
_MACRO = re.compile(r"\$([A-Z]+)\[((?:[^\[\]]|\[[^\[\]]*\])*)\]")


#: Relations that the oracle works out once; other engines decide by themselves.
KEPT = ("rank_", "restarts", "transition", "seeds", "chain_steps", "legs", "components", "transfers", "read_")


def relation(name: str, sql: str) -> None:
    if name in RELATIONS or name in BASE:
        raise ValueError(f"{name} is defined already")
    RELATIONS[name] = counted(sql)


def counted(sql: str) -> str:
    """count_if(x) as count(CASE WHEN x THEN 1 END), which is a BIGINT in both engines."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + 9 : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def dialect(sql: str, engine: int) -> str:
    """Macros in arguments are expanded first."""
    while found := _MACRO.search(sql):
        inner = dialect(found[2], engine) if "$" in found[2] else found[2]
        sql = sql[: found.start()] + MACROS[found[1]][engine].format(*[a.strip() for a in inner.split(" ;; ")]) + sql[found.end() :]
    return sql


def needed(name: str, given: frozenset[str] = frozenset()) -> list[str]:
    """The relations that ``name`` rests on, each after its own, itself last."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order or n in given:
            return
        for other in dict.fromkeys(re.findall(r"\b[a-z_][a-z_0-9]*\b", RELATIONS[n])):
            if other != n and other in RELATIONS:
                visit(other)
        order.append(n)

    visit(name)
    return order


def reached(name: str, given: frozenset[str] = frozenset()) -> list[str]:
    """Those of ``needed`` that are read: a column of a relation's name isn't one."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order or n in given:
            return
        for other in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_][a-z_0-9]*)\b", RELATIONS[n])):
            if other != n and other in RELATIONS:
                visit(other)
        order.append(n)

    visit(name)
    return order


def statement(name: str, engine: int, given: frozenset[str] = frozenset()) -> str:
    order = needed(name, given)
    recursive = "RECURSIVE " if any(re.search(rf"\b{n}\b", RELATIONS[n]) for n in order) else ""
    hint = "MATERIALIZED " if engine else ""
    parts = [f"{n} AS {hint if n.startswith(KEPT) else ""}(\n{dialect(RELATIONS[n], engine).strip()}\n)" for n in order]
    return f"WITH {recursive}" + ",\n".join(parts) + f"\nSELECT * FROM {name}"


def duckdb_sql(name: str) -> str:
    return statement(name, 1)


def query(spark: SparkSession, name: str, sf_dir: str | None = None, **given: DataFrame) -> DataFrame:
    """The relation as a DataFrame. ``given`` DataFrames stand in for relations or base tables of their names; base
    tables that aren't given are read from ``sf_dir``, only those and only the columns that the query uses."""
    text = statement(name, 0, frozenset(given))
    tables = dict(given)
    for t in BASE:
        if t not in tables and re.search(rf"\b(FROM|JOIN)\s+{t}\b", text, re.I):
            if sf_dir is None:
                raise ValueError(f"{name} needs the table {t}")
            tables[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    used = {t: df for t, df in tables.items() if re.search(rf"\b(FROM|JOIN)\s+{t}\b", text, re.I)}
    text = re.sub(r"[{}]", lambda m: m[0] * 2, text)
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN)(\s+){t}\b", rf"\1\2{{{t}}}", text, flags=re.I)
    return spark.sql(text, **used)
