"""Queries and their SQL on rows that tell two readings of a rule apart."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

WIDE = ["ß", "Ö ß", "ẞ", "ŉ", "ǰ", "ẖ", "ẗ", "ẘ", "ẙ", "ẚ", "ﬀ", "ﬁ", "ﬂ", "ﬃ", "ﬄ", "ﬅ", "ﬆ", "ı", "ſ", "İ", "É", "日本", "bo", "", None]


def compared(spark, folder, tables, name):
    """Sorted rows of a query and of its SQL over the given DuckDB tables."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"CREATE TABLE {table} AS {sql}")
        con.execute(f"COPY {table} TO '{os.path.join(folder, table)}.parquet'")
    df = entry.queries()[name](spark, str(folder))
    columns = ", ".join(df.columns)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    expected = con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted((tuple(x) for x in df.collect()), key=key), sorted(expected, key=key)


@pytest.mark.parametrize("name", ["audit_rows", "audit_export", "audit_exclusions", "audit_resolvability"])
def test_audit_takes_letters_with_wide_capitals(spark, tmp_path, name):
    texts = ", ".join("NULL" if t is None else f"'{t}'" for t in WIDE)
    tables = {
        "documents": f"""SELECT row_number() OVER () AS doc_id, t AS text, 'en' AS lang, 'src0' AS source, n AS n_chars
            FROM (SELECT unnest([{texts}]) AS t), (SELECT unnest([1, 2, 3, NULL]::BIGINT[]) AS n)""",
        "labels": "SELECT doc_id, 1 AS quality, 0 AS toxic FROM documents",
    }
    got, expected = compared(spark, tmp_path, tables, name)
    assert got == expected


@pytest.mark.parametrize("name", ["converted_samples", "conversion_errors", "provenance_fields", "samples_with_raw_rows"])
def test_sample_ids_of_more_than_six_digits(spark, tmp_path, name):
    tables = {
        "part": """SELECT unnest([7, 999999, 1000000, 1234567, 12345678])::BIGINT AS p_partkey, 'name' AS p_name, 'B' AS p_brand,
            unnest(['ECONOMY', 'PROMO', 'SMALL', 'LARGE', 'MEDIUM']) AS p_type, unnest([4, 5, 10, 17, 8])::INTEGER AS p_size,
            1.0 AS p_retailprice"""
    }
    got, expected = compared(spark, tmp_path, tables, name)
    assert got == expected


@pytest.mark.parametrize(
    "name", ["audit_examples", "audit_exclusions", "audit_export", "audit_funnel", "audit_metrics", "audit_resolvability"]
)
def test_audit_reads_every_letter_as_its_sql(spark, tmp_path, name):
    """Every code point is a text of its own."""
    tables = {
        "documents": """SELECT i AS doc_id, chr(i::INTEGER) AS text, 'en' AS lang, 'src' || (i % 5) AS source, i % 9973 + 1 AS n_chars
            FROM range(1, 1114112) t(i) WHERE i NOT BETWEEN 55296 AND 57343""",
        "labels": "SELECT doc_id, (doc_id % 2)::INTEGER AS quality, 0 AS toxic FROM documents WHERE doc_id % 3 = 0",
    }
    got, expected = compared(spark, tmp_path, tables, name)
    assert got == expected


@pytest.mark.parametrize("name", ["converted_samples", "provenance_fields"])
def test_parts_of_seven_digits_as_in_sql(spark, tmp_path, name):
    """Part keys on both sides of a million, in all shapes, types and sizes."""
    tables = {
        "part": """SELECT i::BIGINT AS p_partkey, 'name' AS p_name, 'B' || i % 3 AS p_brand,
            ['ECONOMY', 'PROMO', 'SMALL', 'LARGE', 'MEDIUM', 'STANDARD'][i % 6 + 1] AS p_type, (i % 50 + 1)::INTEGER AS p_size,
            1.0::DOUBLE AS p_retailprice FROM range(999500, 1000500) t(i)"""
    }
    got, expected = compared(spark, tmp_path, tables, name)
    assert got == expected


def test_annotation_types_come_from_lines_alone(spark):
    from annoframe.plans import samples

    sf = "/root/testdata/sf0.001"
    whole = samples.samples(spark, sf).filter("size(edits) > 0").selectExpr("id", "array_sort(array_distinct(edits.edit_type)) AS types")
    got = samples.edit_types(spark, sf).selectExpr("id", "array_sort(types) AS types")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
