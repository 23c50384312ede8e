"""SQL for the log entries, written for the layouts of ``log_elements`` by themselves: one select for each layout.

It shares no pattern with ``rillcube.operators.logs``: clocks are read by ``try_strptime``, objects by the JSON functions, and
entries are found by windows over whole files.
"""

from __future__ import annotations

_LINES = """
l AS (SELECT log_file, version, coalesce(any_value(s_val), '') AS s, any_value(t_val) AS t FROM log_elements WHERE log_file IS NOT NULL AND version IS NOT NULL GROUP BY 1, 2),
near AS (SELECT log_file, version, s, coalesce(t, last_value(t IGNORE NULLS) OVER (PARTITION BY log_file ORDER BY version), first_value(t IGNORE NULLS) OVER (PARTITION BY log_file ORDER BY version ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS t FROM l)"""

# day: date and clock; zone: offset from UTC; number: epoch in some unit; late: month, day and clock without a year
_NAMES = "log_file, version, t, layout, day, zone, number, late, level, component, said"
_LAYOUTS = r"""
a1 AS (SELECT *, regexp_extract(s, '^\[[A-Za-z]+ ([A-Z][a-z][a-z]) +([0-9]+) ([0-9]{2}:[0-9]{2}:[0-9]{2})[.0-9]* ([0-9]{4})\] \[([^:\]]+):([a-zA-Z]+)\](?: \[pid [^\]]*\])? ?(.*)$', ['m', 'd', 'c', 'y', 'component', 'level', 'said']) AS x FROM near WHERE s LIKE '[%'),
a2 AS (SELECT *, regexp_extract(s, '^([DIWEF])([0-9]{2})([0-9]{2}) ([0-9]{2}:[0-9]{2}:[0-9]{2})[.0-9]* +[0-9]+ ([^:\] ]+):[0-9]+\] ?(.*)$', ['level', 'm', 'd', 'c', 'component', 'said']) AS x FROM near WHERE regexp_matches(s, '^[DIWEF][0-9]{4} ')),
a3 AS (SELECT *, regexp_extract(s, '^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})[,.0-9]* \[[^\]]*\] +([A-Za-z]+) +([^ ]+) +- ?(.*)$', ['day', 'level', 'component', 'said']) AS x FROM near WHERE s LIKE '____-__-__ %'),
a4 AS (SELECT *, regexp_extract(s, '^([0-9]{9,13})(?:\.[0-9]+)? ([^ /]+)/([A-Za-z]+): ?(.*)$', ['number', 'component', 'level', 'said']) AS x FROM near WHERE regexp_matches(s, '^[0-9]{9}')),
a5 AS (SELECT *, regexp_extract(s, '^([0-9]+)/([A-Z][a-z][a-z])/([0-9]{4}):([0-9]{2}:[0-9]{2}:[0-9]{2}) ([-+][0-9]{4}) ?\| ?([A-Za-z]+) ?\| ?([^| ]+) ?\| ?(.*)$', ['d', 'm', 'y', 'c', 'zone', 'level', 'component', 'said']) AS x FROM near WHERE s LIKE '%/___/____:%'),
a6 AS (SELECT *, regexp_extract(s, '^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}:[0-9]{2}:[0-9]{2})(?:[.,][0-9]+)?(Z|[-+][0-9]{2}:?[0-9]{2})? ([^ ]+) ([A-Za-z]+): ?(.*)$', ['d', 'c', 'zone', 'component', 'level', 'said']) AS x FROM near WHERE s LIKE '____-__-__T%'),
a7 AS (SELECT *, regexp_extract(s, '^([A-Z][a-z][a-z]) +([0-9]+) ([0-9]{2}:[0-9]{2}:[0-9]{2}) [^ ]+ ([^ :\[]+)(?:\[[0-9]+\])?: (?:<([a-z]+)> ?)?(.*)$', ['m', 'd', 'c', 'component', 'level', 'said']) AS x FROM near WHERE regexp_matches(s, '^[A-Z][a-z][a-z] +[0-9]+ [0-9]{2}:')),
k AS (SELECT *, {'time': regexp_extract(s, '(?:^|\s)(?:time|ts|t|timestamp)=("(?:[^"\\]|\\.)*"|[^\s"]*)', 1), 'level': regexp_extract(s, '(?:^|\s)(?:level|lvl|severity)=("(?:[^"\\]|\\.)*"|[^\s"]*)', 1),
      'component': regexp_extract(s, '(?:^|\s)(?:component|comp|logger)=("(?:[^"\\]|\\.)*"|[^\s"]*)', 1), 'said': regexp_extract(s, '(?:^|\s)(?:message|msg|text)=("(?:[^"\\]|\\.)*"|[^\s"]*)', 1)} AS x FROM near WHERE regexp_matches(s, '^[a-zA-Z_.$-]+=')),
j AS (SELECT *, {'time': coalesce(s ->> 'time', s ->> 'ts', s ->> 't', s ->> 'timestamp'), 'level': coalesce(s ->> 'level', s ->> 'lvl', s ->> 'severity', ''),
      'component': coalesce(s ->> 'component', s ->> 'comp', s ->> 'logger', ''), 'said': coalesce(s ->> 'message', s ->> 'msg', s ->> 'text', '')} AS x FROM near WHERE s LIKE '{%"%' AND CASE WHEN s LIKE '{%"%' THEN json_valid(s) END)"""
_BARE = "replace(replace(trim(x.{0}, '\"'), '\\\"', '\"'), '\\\\', '\\')"
_HEADS = f"""
keyed AS (SELECT log_file, version, t, 'pairs' AS layout, trim(x.time, '"') AS clock, {_BARE.format("level")} AS level, {_BARE.format("component")} AS component, {_BARE.format("said")} AS said FROM k
          UNION ALL SELECT log_file, version, t, 'object', x.time, x.level, x.component, x.said FROM j),
parts({_NAMES}) AS (
  SELECT log_file, version, t, 'bracket', x.y || '-' || x.m || '-' || x.d || ' ' || x.c, '', '', '', x.level, x.component, x.said FROM a1
  UNION ALL SELECT log_file, version, t, 'letter', '', '', '', x.m || '-' || x.d || ' ' || x.c, x.level, x.component, x.said FROM a2
  UNION ALL SELECT log_file, version, t, 'thread', x.day, '', '', '', x.level, x.component, x.said FROM a3
  UNION ALL SELECT log_file, version, t, 'epoch', '', '', x.number, '', x.level, x.component, x.said FROM a4
  UNION ALL SELECT log_file, version, t, 'pipe', x.y || '-' || x.m || '-' || x.d || ' ' || x.c, x.zone, '', '', x.level, x.component, x.said FROM a5
  UNION ALL SELECT log_file, version, t, 'zoned', x.d || ' ' || x.c, x.zone, '', '', x.level, x.component, x.said FROM a6
  UNION ALL SELECT log_file, version, t, 'syslog', '', '', '', x.m || '-' || x.d || ' ' || x.c, x.level, x.component, x.said FROM a7
  UNION ALL SELECT log_file, version, t, layout, replace(regexp_extract(clock, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})', 1), 'T', ' '), regexp_extract(clock, '^[0-9-]+[T ][0-9:]+(?:[.,][0-9]+)? ?(Z|[-+][0-9]{{2}}:?[0-9]{{2}})$', 1),
            CASE WHEN regexp_matches(clock, '^[0-9]{{9,19}}([.][0-9]+)?$') THEN string_split(clock, '.')[1] ELSE '' END, '', level, component, said FROM keyed),
timed AS (SELECT *, CASE
    WHEN number <> '' THEN substr(number, 1, CASE WHEN length(number) > 17 THEN length(number) - 9 WHEN length(number) > 14 THEN length(number) - 6 WHEN length(number) > 11 THEN length(number) - 3 ELSE length(number) END)::BIGINT
    WHEN day <> '' THEN epoch(coalesce(try_strptime(day, '%Y-%m-%d %H:%M:%S'), try_strptime(day, '%Y-%b-%d %H:%M:%S')))::BIGINT
         - CASE WHEN zone IN ('', 'Z') THEN 0 ELSE (zone[1] || '1')::BIGINT * (zone[2:3]::BIGINT * 3600 + right(zone, 2)::BIGINT * 60) END
    WHEN late <> '' THEN (SELECT arg_min(clock, abs(clock - t)) FROM (SELECT epoch(coalesce(try_strptime(y || '-' || late, '%Y-%m-%d %H:%M:%S'), try_strptime(y || '-' || late, '%Y-%b-%d %H:%M:%S')))::BIGINT AS clock
         FROM (SELECT unnest([year(make_timestamp(t * 1000000)) - 1, year(make_timestamp(t * 1000000)), year(make_timestamp(t * 1000000)) + 1]) AS y)) WHERE clock IS NOT NULL) END AS ts FROM parts),
heads AS (SELECT *, CASE WHEN upper(level) IN ('D', 'DEBUG', 'TRACE') THEN 'DEBUG' WHEN upper(level) IN ('I', 'INFO', 'NOTICE') THEN 'INFO' WHEN upper(level) IN ('W', 'WARN', 'WARNING') THEN 'WARN'
    WHEN upper(level) IN ('E', 'ERR', 'ERROR') THEN 'ERROR' WHEN upper(level) IN ('F', 'FATAL', 'CRIT', 'CRITICAL', 'EMERG', 'EMERGENCY', 'ALERT', 'PANIC') THEN 'FATAL' ELSE 'NONE' END AS graded FROM timed WHERE ts IS NOT NULL)"""

ENTRIES = f"""
WITH {_LINES}, {_LAYOUTS}, {_HEADS},
e AS (SELECT *, lead(version) OVER (PARTITION BY log_file ORDER BY version) AS next FROM heads), m AS (SELECT log_file, max(version) AS last FROM l GROUP BY 1)
SELECT log_file, version AS first_version, coalesce(next - 1, last) AS last_version, ts, graded AS level, component FROM e JOIN m USING (log_file)"""

MESSAGES = f"""
WITH {_LINES}, {_LAYOUTS}, {_HEADS},
owned AS (SELECT l.log_file, l.version, max(h.version) OVER (PARTITION BY l.log_file ORDER BY l.version) AS first_version, coalesce(h.said, l.s) AS said FROM l LEFT JOIN heads h USING (log_file, version)),
told AS (SELECT log_file, first_version, max(version) AS last_version, string_agg(said, chr(10) ORDER BY version) AS message FROM owned WHERE first_version IS NOT NULL GROUP BY 1, 2)
SELECT told.log_file, first_version, last_version, ts, graded AS level, component, message, layout FROM told JOIN heads ON told.log_file = heads.log_file AND first_version = heads.version"""
