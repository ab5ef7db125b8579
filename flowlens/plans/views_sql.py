"""ANSI-SQL text of the flow views, for the DuckDB twins of ``oracle_sql()``.

The same text runs in Spark SQL and DuckDB; the Spark side of every query is built with
the DataFrame API in ``flowlens.sources.tables``.
"""

from __future__ import annotations

FLOWS_SQL = """
SELECT
  event_id AS flow_id, ts,
  concat('10.0.0.', cast(user_id % 250 AS string)) AS src_ip,
  concat('192.168.1.', cast(event_id % 50 AS string)) AS dst_ip,
  cast((event_id * 7919) % 1024 AS int) AS dst_port,
  CASE event_id % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' ELSE 'icmp' END AS protocol_type,
  event_type AS service,
  CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'S0' ELSE 'SF' END AS flag,
  value / 10 AS duration,
  cast(floor(value * 100) AS bigint) AS src_bytes,
  cast(floor(value * (event_id % 7)) AS bigint) AS dst_bytes,
  cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS conn_count,
  cast(user_id % 20 + 1 AS int) AS srv_count,
  cast(event_id % 11 AS double) / 10 AS serror_rate,
  cast(event_id % 6 AS double) / 5 AS srv_serror_rate,
  cast(event_id % 5 AS double) / 4 AS same_srv_rate,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE cast(event_id % 9 AS double) / 8 END AS diff_srv_rate,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE cast(32 + event_id % 200 AS int) END AS ttl,
  CASE WHEN event_id % 101 = 0 THEN cast('inf' AS double) WHEN event_id % 103 = 0 THEN cast('nan' AS double)
       ELSE value END AS flow_rate,
  CASE WHEN event_type = 'error' AND value > 50 THEN 'neptune'
       WHEN event_type = 'error' THEN ' Smurf '
       WHEN event_type = 'signup' AND value > 100 THEN 'portsweep'
       WHEN event_type = 'purchase' AND value > 150 THEN 'guess_passwd'
       WHEN event_type = 'view' AND value > 200 THEN 'rootkit'
       WHEN event_type = 'click' AND value > 300 THEN 'zero_day'
       ELSE 'normal' END AS target
FROM events
"""

FLOWS_UNSW_SQL = """
SELECT
  l_orderkey AS id, l_discount AS dur, cast(floor(l_extendedprice) AS bigint) AS sbytes,
  cast(floor(l_quantity * 3) AS bigint) AS dbytes, l_tax AS rate, l_linenumber AS spkts,
  CASE l_partkey % 12 WHEN 0 THEN 'Exploits' WHEN 1 THEN 'Generic' WHEN 2 THEN 'Fuzzers'
       WHEN 3 THEN 'Reconnaissance' WHEN 4 THEN 'DoS' WHEN 5 THEN 'Worms' ELSE 'Normal' END AS attack_cat,
  CASE WHEN l_partkey % 12 < 6 THEN 1 ELSE 0 END AS label
FROM lineitem
"""

FLOWS_CIC_SQL = """
SELECT
  o_orderkey AS flow_no, o_totalprice / 100 AS flow_duration, cast(o_custkey % 500 AS int) AS packet_count,
  CASE o_orderkey % 20 WHEN 0 THEN 'DDoS' WHEN 1 THEN 'PortScan' WHEN 2 THEN 'FTP-Patator'
       WHEN 3 THEN 'Web Attack - XSS' WHEN 4 THEN 'Web Attack - Brute Force' WHEN 5 THEN 'Bot'
       WHEN 6 THEN 'Infiltration' WHEN 7 THEN 'DoS Hulk' WHEN 8 THEN 'Heartbleed' ELSE 'BENIGN' END AS Label
FROM orders
"""

SCORES_SQL = """
SELECT
  flow_id, ts, service, src_ip, dst_ip,
  CASE WHEN lower(trim(target)) = 'normal' THEN 0 ELSE 1 END AS y,
  cast((flow_id * 37) % 101 AS double) / 100 AS p_a,
  cast((flow_id * 53 + user_k) % 21 AS double) / 20 AS p_b,
  CASE WHEN lower(trim(target)) = 'normal' THEN cast(flow_id % 60 AS double) / 100
       ELSE cast(40 + flow_id % 60 AS double) / 100 END AS p_c
FROM (SELECT *, srv_count AS user_k FROM flows) f
"""

SCORED_FLOWS_SQL = """
SELECT
  f.*,
  CASE WHEN lower(trim(target)) = 'normal' THEN 0 ELSE 1 END AS y,
  cast((flow_id * 37) % 101 AS double) / 100 AS p_a,
  cast((flow_id * 53 + srv_count) % 21 AS double) / 20 AS p_b,
  CASE WHEN lower(trim(target)) = 'normal' THEN cast(flow_id % 60 AS double) / 100
       ELSE cast(40 + flow_id % 60 AS double) / 100 END AS p_c
FROM flows f
"""

VIEW_SQL = {"flows": FLOWS_SQL, "flows_unsw": FLOWS_UNSW_SQL, "flows_cic": FLOWS_CIC_SQL, "scores": SCORES_SQL,
            "scored_flows": SCORED_FLOWS_SQL}
# scores and scored_flows read flows, so flows must precede them in a WITH list.
VIEW_ORDER = ["flows", "flows_unsw", "flows_cic", "scores", "scored_flows"]
VIEW_DEPS = {"scores": ["flows"], "scored_flows": ["flows"]}


def with_views(body: str) -> str:
    """Prefix ``body`` with the CTEs of every flow view it mentions."""
    import re

    needed = {v for v in VIEW_SQL if re.search(rf"\b{v}\b", body)}
    for v in list(needed):
        needed.update(VIEW_DEPS.get(v, []))
    ctes = [f"{v} AS ({VIEW_SQL[v]})" for v in VIEW_ORDER if v in needed]
    if not ctes:
        return body
    stripped = body.lstrip()
    if stripped[:4].upper() == "WITH":
        return "WITH " + ",\n".join(ctes) + ",\n" + stripped[4:].lstrip()
    return "WITH " + ",\n".join(ctes) + "\n" + body
