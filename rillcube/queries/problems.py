"""The queries of the general problems 1, 2, 3 and 6, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillcube.operators import lateness, logs, records, weighted
from rillcube.queries import log_sql
from rillcube.session import load

FREQUENT_PERCENT = 1


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    _, failed = records.split_records(load(spark, d, "csv_elements"), "s_val", records.ACCESS_LOG, keep=["tuple_id"])
    return failed.select("tuple_id", "reason")


def p1_typed_rows(spark: SparkSession, d: str) -> DataFrame:
    sound, _ = records.split_records(load(spark, d, "csv_elements"), "s_val", records.ACCESS_LOG, keep=["tuple_id"])
    return sound


def p1_rejected_rows(spark: SparkSession, d: str) -> DataFrame:
    _, failed = records.split_records(load(spark, d, "csv_elements"), "s_val", records.ACCESS_LOG, keep=["tuple_id", "site", "version"])
    return failed


def _url_counts(requests: DataFrame) -> DataFrame:
    return weighted.value_counts(requests, {"url": F.col("url")}, F.coalesce("count", F.lit(1)), {"sizes": F.col("avg_size_sum")})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The urls of at least 1 % of all rows, from the value counts that p2_url_totals reports in full."""
    counts = weighted.value_counts(load(spark, d, "web_requests"), {"url": F.col("url")}, F.coalesce("count", F.lit(1)))
    totals = weighted.key_totals(counts)
    everything = totals.agg(F.sum("rows").alias("n"))
    # nulls go in one condition with the sums, after the shuffles: so both uses of the counts are alike, and one is made
    return totals.where(F.when(F.col("url").isNotNull(), F.col("rows")) * 100 >= FREQUENT_PERCENT * everything.scalar()).select("url")


def p2_url_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals per url over all rows as delivered, repeats included, as for p2_found."""
    totals = weighted.key_totals(_url_counts(load(spark, d, "web_requests")), value_sum="count_total")
    return totals.select("url", F.col("rows").alias("requests"), "count_total", F.col("sizes").alias("size_total"), F.col("distinct_values").alias("distinct_counts"), F.col("mode_value").cast("long").alias("mode_count"))


def p2_count_median(spark: SparkSession, d: str) -> DataFrame:
    counts = weighted.value_counts(load(spark, d, "web_requests"), {"url": F.col("url")}, F.coalesce("count", F.lit(1)))
    return weighted.percentiles(counts, [0.5, 0.9]).select("url", "p", "value", F.col("rows").alias("requests"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    entries = logs.log_entries(load(spark, d, "log_elements"))
    return entries.select("log_file", "first_version", "last_version", "ts", "level", "component")


def p3_log_entries(spark: SparkSession, d: str) -> DataFrame:
    return logs.log_entries(load(spark, d, "log_elements"))


def _corrected(spark: SparkSession, d: str) -> lateness.CorrectedPeriods:
    rows = load(spark, d, "web_requests").select("tuple_id", "site", "time", "arrival_time", "count", "avg_size_sum")
    return lateness.corrected_periods(rows, F.coalesce("count", F.lit(1)), F.col("avg_size_sum"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The rows that come too late to correct their period."""
    return _corrected(spark, d).beyond.select("tuple_id")


def p6_period_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals per period, as late rows have corrected them, over all rows as delivered, repeats included, as the order of arrival of p6_found has them."""
    results = lateness.period_results(_corrected(spark, d).corrected, [0.5])
    return results.select("period", "rows", F.col("total").alias("size_total"), "distinct_values", "min_value", "max_value", "p50")


def p6_corrected_totals(spark: SparkSession, d: str) -> DataFrame:
    """Period totals and medians from the rows that came before their period's end, and after those that came later, within the cut-off, corrected them."""
    results = _corrected(spark, d).results([0.5])
    return results.select("period", "rows", F.col("total").alias("size_total"), "p50", "rows_before", F.col("total_before").alias("size_before"), "p50_before")


QUERIES = {f.__name__: f for f in (p1_found, p1_typed_rows, p1_rejected_rows, p2_found, p2_url_totals, p2_count_median, p3_found, p3_log_entries, p6_found, p6_period_totals, p6_corrected_totals)}

_LATE = """
usable AS (SELECT *, time IS NOT NULL AND time <= arrival_time AS usable FROM web_requests),
marked AS (SELECT *, max(CASE WHEN usable THEN time END) OVER (PARTITION BY site ORDER BY arrival_time, tuple_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM usable),
judged AS (SELECT *, floor(epoch_us(time) / 300000000.0)::BIGINT * 300 AS period, usable AND m IS NOT NULL AND ((floor(epoch_us(time) / 300000000.0)::BIGINT * 300 + 900) * 1000000 <= epoch_us(m)) AS beyond FROM marked)
"""

# the record grammar as regular expressions: any field, and enclosed or bare numbers with one group each
_FIELD = r'''[ \t]*(?:"(?:[^"\\]|\\["\\n])*"[ \t]*|[^ \t",][^",]*)?'''
_I = r'''[ \t]*"?(-?[0-9]+)"?[ \t]*'''
_D = r'''[ \t]*"?([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"?[ \t]*'''
_TYPED = ",".join({"I": _I, "D": _D, "S": _FIELD}[t] for t in records.ACCESS_LOG.types)
_INTEGERS = [1, *range(3, 10)]  # the groups of _TYPED that are integers; the second is the double



def _typed_sql() -> str:
    """The valid records by one match with a group for each field."""
    form = records.ACCESS_LOG
    names = [f"f{i}" for i in range(len(form.types))]
    whole = ",".join({"I": _I, "D": _D, "S": r'[ \t]*("(?:[^"\\]|\\["\\n])*"|(?:[^ \t",][^",]*)?)[ \t]*'}[t] for t in form.types)
    plain = lambda f: f"replace(replace(replace(replace(x.{f}[2:length(x.{f}) - 1], '\\\\', chr(1)), '\\\"', '\"'), '\\n', chr(10)), chr(1), '\\')"
    typed = {"I": lambda f: f"try_cast(x.{f} AS INTEGER)", "D": lambda f: f"try_cast(x.{f} AS DOUBLE)", "S": lambda f: f"CASE WHEN x.{f} LIKE '\"%' THEN {plain(f)} ELSE rtrim(x.{f}, ' ' || chr(9)) END"}
    columns = ", ".join(f'{typed[t](f)} AS "{n}"' for t, f, n in zip(form.types, names, form.names))
    sound = " AND ".join(f'"{n}" IS NOT NULL' for t, n in zip(form.types, form.names) if t != "S") + f' AND isfinite("{form.names[1]}")'
    return f"""WITH m AS (SELECT tuple_id, regexp_extract(s_val, '(?s)^{whole}$', {names!r}) AS x FROM csv_elements WHERE regexp_full_match(s_val, '(?s){whole}')),
        t AS (SELECT tuple_id, {columns} FROM m) SELECT * FROM t WHERE {sound}"""


def _rejected_sql() -> str:
    """The rejected records with the byte at which they fail: the end of the longest begin that can still become a record, the first surplus separator, or the start of the wrong field."""
    form, sound = records.ACCESS_LOG, SQL["p1_found"]
    part = r'(?:[ \t]*"(?:[^"\\]|\\["\\n])*"[ \t]*|[ \t]*"(?:[^"\\]|\\["\\n])*\\?|[ \t]*[^ \t",][^",]*|[ \t]*)'
    begin, width = f"(?s)^(?:{_FIELD},)*{part}", len(form.types)
    wrong = {"I": lambda f: f"coalesce(try_cast(regexp_extract({f}, '^{_I}$', 1) AS INTEGER) IS NULL, true)", "D": lambda f: f"NOT isfinite(coalesce(try_cast(regexp_extract({f}, '^{_D}$', 1) AS DOUBLE), 'inf'::DOUBLE))"}
    cases, before = [], "0"
    for i, t in enumerate(form.types):
        if t != "S":
            cases.append(f"WHEN {wrong[t](f'x.f{i}')} THEN {before}")
        before += f" + strlen(x.f{i}) + 1"
    fields = ",".join([f"({_FIELD})"] * width)
    return f"""WITH r AS ({sound}), c AS (SELECT tuple_id, site, version, s_val, reason, regexp_extract(s_val, '(?s)^{fields}$', {[f"f{i}" for i in range(width)]!r}) AS x FROM csv_elements JOIN r USING (tuple_id))
        SELECT tuple_id, site, version, s_val, reason, CASE reason WHEN 'quoting' THEN strlen(regexp_extract(s_val, '{begin}'))
            WHEN 'column_count' THEN CASE WHEN regexp_matches(s_val, '(?s)^{_FIELD}(?:,{_FIELD}){{{width - 1}}},') THEN strlen(regexp_extract(s_val, '(?s)^{_FIELD}(?:,{_FIELD}){{{width - 1}}}')) ELSE coalesce(strlen(s_val), 0) END
            ELSE CASE {" ".join(cases)} END END::INTEGER AS error_at FROM c"""


SQL = {
    "p1_typed_rows": _typed_sql(),
    "p1_found": f"""
        WITH j AS (SELECT tuple_id, CASE
            WHEN s_val IS NULL OR trim(s_val, ' ' || chr(9)) = '' THEN 'column_count'
            WHEN NOT regexp_full_match(s_val, '(?s){_FIELD}(?:,{_FIELD})*') THEN 'quoting'
            WHEN NOT regexp_full_match(s_val, '(?s){_FIELD}(?:,{_FIELD}){{16}}') THEN 'column_count'
            WHEN NOT regexp_full_match(s_val, '(?s){_TYPED}') THEN 'value'
            WHEN NOT isfinite(coalesce(try_cast(regexp_extract(s_val, '(?s)^{_TYPED}$', 2) AS DOUBLE), 'inf'::DOUBLE)) THEN 'value'
            WHEN {" OR ".join(f"try_cast(regexp_extract(s_val, '(?s)^{_TYPED}$', {g}) AS INTEGER) IS NULL" for g in _INTEGERS)} THEN 'value' END AS reason
        FROM csv_elements) SELECT * FROM j WHERE reason IS NOT NULL""",
    "p2_found": "SELECT url FROM web_requests WHERE url IS NOT NULL GROUP BY url HAVING count(*) >= 0.01 * (SELECT count(*) FROM web_requests)",
    "p2_url_totals": """
        WITH v AS (SELECT url, coalesce(count, 1) AS v, count(*) AS n, sum(avg_size_sum) AS s FROM web_requests GROUP BY 1, 2)
        SELECT url, sum(n)::BIGINT AS requests, sum(v * n)::BIGINT AS count_total, sum(s)::BIGINT AS size_total, count(*)::BIGINT AS distinct_counts,
               first(v ORDER BY n DESC, v)::BIGINT AS mode_count FROM v GROUP BY url""",
    "p2_count_median": """
        WITH v AS (SELECT url, coalesce(count, 1) AS v, count(*) AS n FROM web_requests GROUP BY 1, 2),
        c AS (SELECT *, sum(n) OVER (PARTITION BY url ORDER BY v) AS cum, sum(n) OVER (PARTITION BY url) AS total FROM v),
        p AS (SELECT unnest([0.5, 0.9])::DOUBLE AS p)
        SELECT url, p, v::BIGINT AS value, total::BIGINT AS requests FROM c, p
        WHERE greatest(1, ceil(p * total)) <= cum AND greatest(1, ceil(p * total)) > cum - n""",
    "p3_found": log_sql.ENTRIES,
    "p3_log_entries": log_sql.MESSAGES,
    "p6_found": f"WITH {_LATE} SELECT tuple_id FROM judged WHERE beyond",
    "p6_period_totals": f"""
        WITH {_LATE}, v AS (SELECT period, coalesce(count, 1) AS v, count(*) AS n, sum(avg_size_sum) AS s FROM judged WHERE usable AND NOT beyond GROUP BY 1, 2),
        c AS (SELECT *, sum(n) OVER (PARTITION BY period ORDER BY v) AS cum, sum(n) OVER (PARTITION BY period) AS total FROM v)
        SELECT period, sum(n)::BIGINT AS rows, sum(s)::BIGINT AS size_total, count(*)::BIGINT AS distinct_values, min(v)::BIGINT AS min_value, max(v)::BIGINT AS max_value,
               min(CASE WHEN cum >= ceil(0.5 * total) THEN v END)::BIGINT AS p50 FROM c GROUP BY period""",
    "p6_corrected_totals": f"""
        WITH {_LATE}, j AS (SELECT period, coalesce(count, 1) AS v, avg_size_sum AS s, epoch_us(arrival_time) < (period + 300) * 1000000 AS early FROM judged WHERE usable AND NOT beyond),
        v AS (SELECT b AS corrected, period, v, count(*) AS n, sum(s) AS s FROM j, (VALUES (false), (true)) x(b) WHERE b OR early GROUP BY ALL),
        c AS (SELECT *, sum(n) OVER (PARTITION BY corrected, period ORDER BY v) AS cum, sum(n) OVER (PARTITION BY corrected, period) AS total FROM v),
        r AS (SELECT corrected, period, sum(n)::BIGINT AS rows, sum(s)::BIGINT AS size, min(CASE WHEN cum >= ceil(0.5 * total) THEN v END)::BIGINT AS p50 FROM c GROUP BY 1, 2)
        SELECT a.period, a.rows, a.size AS size_total, a.p50, b.rows AS rows_before, b.size AS size_before, b.p50 AS p50_before
        FROM (SELECT * FROM r WHERE corrected) a LEFT JOIN (SELECT * FROM r WHERE NOT corrected) b USING (period)""",
}
SQL["p1_rejected_rows"] = _rejected_sql()
