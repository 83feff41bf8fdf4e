"""Common table expressions of the SQL counterparts.

They derive the engine's inputs from the driver's tables without going through
frames, documents or any code of the operators.
"""

from __future__ import annotations

import re

FLUSH_US = 3_600_000_000

VARIANT = """CASE WHEN seq % 23 = 5 THEN 'cut' WHEN seq % 29 = 7 THEN 'tagged' WHEN seq % 31 = 3 THEN 'other_port'
  WHEN seq % 37 = 11 AND family = 'ipv4' THEN 'fragment' WHEN seq % 41 = 2 THEN 'short'
  WHEN seq % 43 = 9 AND family = 'ipv4' THEN 'options' WHEN seq % 47 = 4 THEN 'both_ports' ELSE 'plain' END"""

CTES: dict[str, str] = {
    "ev": """SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value, props FROM events""",
    # Streams: the flushes that are closed when all events have come, at a lateness bound of 13 hours.
    "closed": """SELECT ((max(us) // 1000000 - 46800) // 3600) * 3600 AS until FROM ev""",
    # In which of four micro-batches an event comes, up to 12 hours late, and the first flush open by then, at a bound of one hour.
    "arrival": """SELECT unnest(seqs) AS seq, since, last FROM (SELECT seqs, lag(until) OVER (ORDER BY part) AS since, max(until) OVER () AS last FROM (
          SELECT part, list(event_id) AS seqs, ((max(max(us)) OVER (ORDER BY part) // 1000000 - 3600) // 3600) * 3600 AS until FROM (
            SELECT event_id, us, CAST(least(3, (us + event_id % 5 * 10800000000 - lo) * 4 // (hi - lo + 1)) AS INTEGER) AS part
            FROM ev, (SELECT min(us) AS lo, max(us) AS hi FROM ev)) GROUP BY part))""",
    "raw0": """SELECT event_id AS seq, us, us * 1000 AS ts_ns, (us // 3600000000) * 3600 AS flush,
        CASE WHEN event_type IN ('click','view','signup') THEN 'request' ELSE 'response' END AS direction,
        CASE WHEN user_id % 5 = 0 THEN 'ipv6' ELSE 'ipv4' END AS family,
        CASE WHEN user_id % 5 <> 0 THEN (user_id * 2654435761) % 4294967296 END AS num,
        user_id + 1 AS host_no, event_id % 11 <> 0 AS is_client,
        CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 <= 4 THEN CAST(event_id % 7 AS VARCHAR) ELSE 'other' END AS version,
        CASE WHEN event_id % 7 <> 0 THEN printf('%016X', event_id % 2) END AS xid
        FROM ev""",
    "raw": """SELECT *,
        CASE WHEN is_client = (direction = 'request') THEN client_ip ELSE server_ip END AS src_ip,
        CASE WHEN is_client = (direction = 'request') THEN server_ip ELSE client_ip END AS dst_ip,
        CASE WHEN is_client = (direction = 'request') THEN client_hex ELSE server_hex END AS src_hex,
        CASE WHEN is_client = (direction = 'request') THEN server_hex ELSE client_hex END AS dst_hex
        FROM (SELECT *,
          CASE WHEN family = 'ipv4' THEN concat(num >> 24, '.', (num >> 16) & 255, '.', (num >> 8) & 255, '.', num & 255)
               WHEN host_no < 65536 THEN '2001:db8::' || printf('%x', host_no)
               ELSE '2001:db8::' || printf('%x', host_no >> 16) || ':' || printf('%x', host_no % 65536) END AS client_ip,
          CASE WHEN family = 'ipv4' THEN printf('%08X', num) ELSE '20010DB8' || printf('%024X', host_no) END AS client_hex,
          CASE WHEN family = 'ipv4' THEN '198.51.100.1' ELSE '2001:db8:ffff::1' END AS server_ip,
          CASE WHEN family = 'ipv4' THEN 'C6336401' ELSE '20010DB8FFFF00000000000000000001' END AS server_hex
          FROM raw0)""",
    "pk": "SELECT * FROM raw WHERE is_client",
    "fr": f"SELECT *, {VARIANT} AS variant FROM raw",
    # What each frame decodes to, by the irregularity it was given.
    "dec": """SELECT *, CASE WHEN dir = 'request' THEN src_ip WHEN dir = 'response' THEN dst_ip END AS dec_client_ip,
          CASE WHEN dir = 'request' THEN src_hex WHEN dir = 'response' THEN dst_hex END AS dec_client_hex,
          CASE WHEN parsed THEN version END AS dec_version,
          CASE WHEN parsed AND xid IS NOT NULL THEN
            CASE WHEN variant = 'both_ports' AND direction = 'response' THEN 'FFFFFFFFFFFFFFFF' ELSE xid END END AS dec_xid
        FROM (SELECT *, variant NOT IN ('cut','other_port','short') AS parsed,
          variant IN ('plain','cut','options','both_ports') AS captured,
          CASE WHEN variant IN ('cut','other_port','short') THEN NULL WHEN variant = 'both_ports' THEN 'request' ELSE direction END AS dir
          FROM fr)""",
    "gc": """SELECT CAST(n_nationkey AS BIGINT) * 134217728 AS lo, CAST(n_nationkey AS BIGINT) * 134217728 + 134217727 AS hi,
        CASE WHEN n_nationkey = 7 THEN 'unknown' ELSE n_name END AS country, r_name AS continent
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "ga": """SELECT s_suppkey * w AS lo, s_suppkey * w + w - 1 AS hi,
        CASE WHEN s_suppkey % 17 = 3 THEN NULL ELSE 64500 + s_suppkey END AS asn,
        CASE WHEN s_suppkey % 17 = 3 OR s_suppkey % 13 = 5 THEN 'unknown' ELSE s_name END AS as_org
        FROM supplier, (SELECT CAST(floor(4294967296.0 / (count(*) * 1.25)) AS BIGINT) AS w FROM supplier)""",
    "pc": """SELECT pk.*, coalesce(gc.country, 'unknown') AS country, coalesce(gc.continent, 'unknown') AS continent
        FROM pk LEFT JOIN gc ON pk.num BETWEEN gc.lo AND gc.hi""",
    "pa": """SELECT pk.*, ga.asn AS asn, coalesce(ga.as_org, 'unknown') AS as_org
        FROM pk LEFT JOIN ga ON pk.num BETWEEN ga.lo AND ga.hi""",
    "asn_counts": """SELECT flush, asn, as_org, count(*) AS requests FROM pa WHERE direction = 'request' GROUP BY ALL""",
    "asn_top": """SELECT flush, asn, CAST(total AS BIGINT) AS total, rank FROM (
          SELECT flush, asn, total, row_number() OVER (PARTITION BY flush ORDER BY total DESC, CAST(asn AS VARCHAR)) AS rank
          FROM (SELECT f.flush, a.asn, sum(coalesce(c.n, 0)) OVER (PARTITION BY a.asn ORDER BY f.flush) AS total
                FROM (SELECT DISTINCT flush FROM asn_counts WHERE asn IS NOT NULL) f
                CROSS JOIN (SELECT DISTINCT asn FROM asn_counts WHERE asn IS NOT NULL) a
                LEFT JOIN (SELECT flush, asn, sum(requests) AS n FROM asn_counts GROUP BY ALL) c
                  ON c.flush = f.flush AND c.asn = a.asn)
          WHERE total > 0) WHERE rank <= 10""",
    "asn_folded": """SELECT flush, asn, as_org, CAST(sum(requests) AS BIGINT) AS requests FROM (
          SELECT c.flush, c.requests,
            CASE WHEN c.asn IS NULL THEN 'unknown' WHEN t.asn IS NOT NULL THEN CAST(c.asn AS VARCHAR) ELSE 'other' END AS asn,
            CASE WHEN c.asn IS NULL THEN 'unknown' WHEN t.asn IS NOT NULL THEN c.as_org ELSE 'other' END AS as_org
          FROM asn_counts c LEFT JOIN asn_top t ON t.flush = c.flush AND t.asn = c.asn) GROUP BY ALL""",
    "drop_counts": """SELECT flush, country, continent, req - resp AS drops FROM (
          SELECT flush, country, continent, count(*) FILTER (direction = 'request') AS req,
            count(*) FILTER (direction = 'response') AS resp FROM pc GROUP BY ALL) WHERE req > resp""",
    # Pairing and intervals.
    "ordered": """SELECT seq, us, direction, client_ip, xid,
          lag(direction) OVER w AS prev_dir, lag(us) OVER w AS prev_us,
          lead(us) OVER w AS next_us
        FROM pk WHERE xid IS NOT NULL WINDOW w AS (PARTITION BY client_ip, xid ORDER BY us, seq)""",
    "pairs": """SELECT seq, us * 1000 AS ts_ns, client_ip, xid, prev_us * 1000 AS request_ns,
          ((us - prev_us) * 1000) / 1e9 AS seconds
        FROM ordered WHERE direction = 'response' AND prev_dir = 'request' AND us - prev_us <= 43200000000""",
    "gaps": """SELECT seq, us * 1000 AS ts_ns, client_ip, ((us - prev) * 1000) / 1e9 AS seconds
        FROM (SELECT seq, us, client_ip, lag(us) OVER (PARTITION BY client_ip ORDER BY us, seq) AS prev
              FROM pk WHERE direction = 'request')
        WHERE prev >= (us // 3600000000) * 3600000000 - 86400000000""",
    "active": """SELECT t.tick, count(DISTINCT p.client_ip) AS active
        FROM (SELECT unnest(generate_series(lo, hi, 3600)) AS tick FROM (
                SELECT min(((us + 3599999999) // 3600000000) * 3600) AS lo,
                       max(((us + 86400000000) // 3600000000) * 3600) + 3600 AS hi FROM pk WHERE direction = 'request')) t
        LEFT JOIN (SELECT client_ip, us FROM pk WHERE direction = 'request') p
          ON p.us BETWEEN (t.tick - 86400) * 1000000 AND t.tick * 1000000 GROUP BY t.tick""",
    # Sketch.
    "reg": """SELECT hour, idx, CAST(max(CASE WHEN w = 0 THEN 51 ELSE 51 - length(bin(w)) END) AS INTEGER) AS rho
        FROM (SELECT flush AS hour, CAST(v >> 50 AS INTEGER) AS idx, CAST(v & 1125899906842623 AS BIGINT) AS w
              FROM (SELECT flush, CAST('0x' || substr(sha1(client_ip), 1, 16) AS UBIGINT) AS v
                    FROM pk WHERE direction = 'request')) GROUP BY ALL""",
    "daily": """SELECT r.hour + h.k * 3600 AS hour, idx, max(rho) AS rho
        FROM reg r CROSS JOIN (SELECT unnest(generate_series(0, 23)) AS k) h GROUP BY ALL""",
    # Score documents.
    "pe": """SELECT event_id // 16 AS poll, event_id, us, (us // 300000000) * 300 AS coarse, value,
          CASE WHEN event_id % 17 = 0 THEN 1 ELSE 2 END AS ts_rank,
          CASE WHEN event_id % 19 <> 0 THEN value END AS score,
          CASE WHEN event_id % 13 <> 0 THEN user_id % 7 END AS monitor_id FROM ev""",
    "pd": """SELECT poll, max(us) AS us, '198.51.100.' || CAST(poll % 3 AS VARCHAR) AS ip,
          poll % 29 <> 0 AND poll % 31 <> 0 AS monitors_ok, poll % 37 <> 5 AS has_overall FROM pe GROUP BY poll""",
    "newest": """SELECT poll, score FROM (SELECT *, row_number() OVER (
          PARTITION BY poll ORDER BY ts_rank DESC, coarse DESC, event_id) AS rn FROM pe) WHERE rn = 1""",
    "latest": """SELECT * FROM (SELECT *, row_number() OVER (
          PARTITION BY poll, monitor_id ORDER BY ts_rank DESC, coarse DESC, event_id) AS rn
          FROM pe WHERE monitor_id IS NOT NULL) WHERE rn = 1""",
    "monitor_rows": """SELECT d.ip, d.us AS poll_us, l.poll,
          CASE WHEN monitor_id <= 4 THEN 'mon-' || CAST(monitor_id AS VARCHAR) ELSE CAST(monitor_id AS VARCHAR) END AS monitor,
          monitor_id, score, value AS offset_s, value / 1000.0 AS rtt_s
        FROM latest l JOIN pd d ON d.poll = l.poll WHERE d.monitors_ok""",
    "polls": """SELECT d.poll, d.ip, d.us, monitors_ok AND has_overall AS success,
          CASE WHEN monitors_ok AND has_overall THEN n.score END AS score
        FROM pd d JOIN newest n ON n.poll = d.poll""",
    "gauges": """SELECT ip, us, 'ntppool_score' AS metric, '' AS monitor, score AS value FROM polls WHERE score IS NOT NULL
        UNION ALL SELECT '', us, 'ntppool_scrape_success', '', CAST(success AS DOUBLE) FROM polls
        UNION ALL SELECT m.ip, p.us, 'ntppool_monitor_score', m.monitor, m.score FROM monitor_rows m JOIN polls p ON p.poll = m.poll WHERE p.success AND m.score IS NOT NULL
        UNION ALL SELECT m.ip, p.us, 'ntppool_monitor_offset_seconds', m.monitor, m.offset_s FROM monitor_rows m JOIN polls p ON p.poll = m.poll WHERE p.success
        UNION ALL SELECT m.ip, p.us, 'ntppool_monitor_rtt_seconds', m.monitor, m.rtt_s FROM monitor_rows m JOIN polls p ON p.poll = m.poll WHERE p.success""",
    "ticks": """SELECT unnest(generate_series(lo, hi, 3600)) AS tick FROM (
          SELECT min(((us + 3599999999) // 3600000000) * 3600) AS lo, max(((us + 3599999999) // 3600000000) * 3600) AS hi FROM ev)""",
    "retained": """SELECT s.ip, s.metric, s.monitor, t.tick, g.value
        FROM (SELECT DISTINCT ip, metric, monitor FROM gauges) s CROSS JOIN ticks t
        ASOF JOIN gauges g ON g.ip = s.ip AND g.metric = s.metric AND g.monitor = s.monitor AND t.tick * 1000000 >= g.us""",
    # Metric samples.
    "sm": """SELECT event_id, us, event_type AS metric, 'h' || CAST(user_id % 4 AS VARCHAR) AS host,
          CASE user_id % 3 WHEN 0 THEN 'cpu_thermal' WHEN 1 THEN 'nvme' ELSE 'wifi' END AS chip_name,
          'c' || CAST(user_id % 9 AS VARCHAR) AS country, value FROM ev""",
    "sms": """SELECT *, 'chip_name=' || chip_name || ',country=' || country || ',host=' || host AS series FROM sm""",
    "ctr": """SELECT event_id, us, event_type, 'host=h' || CAST(user_id % 4 AS VARCHAR) AS series,
          CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY event_type, user_id % 4, us // 86400000000 ORDER BY us, event_id) AS DOUBLE) AS value
        FROM ev""",
    "ctr_steps": """SELECT event_type AS metric, series, us, CASE WHEN value >= prev THEN value - prev ELSE value END AS step
        FROM (SELECT *, lag(value) OVER (PARTITION BY event_type, series ORDER BY us, event_id) AS prev FROM ctr)
        WHERE prev IS NOT NULL""",
    # Alert inputs: (metric, series, us, value).
    "al": """SELECT 'chrony_up' AS metric, 'host=h' || CAST(user_id % 3 AS VARCHAR) AS series, us, CASE WHEN value < 70 THEN 0.0::DOUBLE ELSE 1.0 END AS value FROM ev WHERE event_type = 'click'
        UNION ALL SELECT 'ntp_clients_scrape_success', 'job=ntp-clients', us, CASE WHEN value < 80 THEN 0.0::DOUBLE ELSE 1.0 END FROM ev WHERE event_type = 'click'
        UNION ALL SELECT 'chrony_tracking_system_time_seconds', 'host=h' || CAST(user_id % 3 AS VARCHAR), us, (12.0::DOUBLE - value) / 1000 FROM ev WHERE event_type = 'view'
        UNION ALL SELECT 'ntppool_score', 'ip=h' || CAST(user_id % 3 AS VARCHAR), us, 20.0::DOUBLE - value / 5 FROM ev WHERE event_type = 'view'
        UNION ALL SELECT 'chrony_sources_reachability_ratio', 'host=h' || CAST(user_id % 3 AS VARCHAR), us, CASE WHEN value < 95 THEN 0.0::DOUBLE ELSE 1.0 END FROM ev WHERE event_type = 'purchase'
        UNION ALL SELECT 'ntp_geoip_database_loaded', 'db=' || CASE WHEN user_id % 2 = 0 THEN 'country' ELSE 'asn' END, us, CASE WHEN value < 60 THEN 0.0::DOUBLE ELSE 1.0 END FROM ev WHERE event_type = 'signup'""",
    "al_instant": """SELECT metric, series, tick, value FROM (
          SELECT s.metric, s.series, t.tick, a.value, a.us
          FROM (SELECT DISTINCT metric, series FROM al) s CROSS JOIN ticks t
          ASOF JOIN al a ON a.metric = s.metric AND a.series = s.series AND t.tick * 1000000 >= a.us)
        WHERE us > (tick - 10800) * 1000000""",
    "al_rate": """SELECT s.series, t.tick, sum(s.step) / 7200.0 AS value FROM ctr_steps s JOIN ticks t
          ON s.us > (t.tick - 7200) * 1000000 AND s.us <= t.tick * 1000000 WHERE s.metric = 'error' GROUP BY ALL""",
    "lg": """SELECT event_id, us, '/c-' || event_type AS container_name, 'h' || CAST(user_id % 4 AS VARCHAR) AS host, props AS msg FROM ev""",
    "sd": """SELECT CAST(user_id % 8 AS INTEGER) AS worker, event_id AS cookie, us * 1000 AS sent_ns FROM ev""",
    "rp": """SELECT CAST(user_id % 8 AS INTEGER) AS worker, event_id AS cookie,
          us * 1000 + CAST(round(value * 1000) AS BIGINT) * 1000 AS recv_ns FROM ev WHERE event_id % 50 <> 0""",
    "matched": """SELECT s.worker, s.cookie, s.sent_ns, r.recv_ns, (r.recv_ns - s.sent_ns) // 1000 AS rtt_us
        FROM sd s LEFT JOIN rp r ON r.worker = s.worker AND r.cookie = s.cookie""",
    "landings": """SELECT db, us // 1000000 AS seen_at, day % 3 AS version, day % 7 <> 3 AS present,
          CASE WHEN db = 'country' THEN day % 5 <> 0 ELSE day % 4 <> 1 END AS readable
        FROM (SELECT us // 86400000000 AS day, min(us) AS us FROM ev GROUP BY 1) CROSS JOIN (VALUES ('country'), ('asn')) d(db)""",
    "timeline": """SELECT db, version, readable, valid_from, lead(valid_from) OVER (PARTITION BY db ORDER BY valid_from) AS valid_to
        FROM (SELECT *, ((seen_at + 29) // 30) * 30 AS valid_from FROM landings WHERE present)""",
}


def complete(sql: str) -> str:
    """Put the expressions the text needs, in order, in front of it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    if not needed:
        return sql.strip()
    parts = [f"{name} AS ({body})" for name, body in CTES.items() if name in needed]
    return "WITH " + ",\n".join(parts) + "\n" + sql.strip()
