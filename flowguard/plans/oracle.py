"""The registered queries in plain SQL for DuckDB, written from the definitions, not the plans."""

from __future__ import annotations

# Views on the driver's tables; each may use the ones before it.
VIEWS = {
    "packets": r"""
        SELECT event_id AS pkt_no, 'edge-' || (event_id % 3) AS sensor, ts AS sniff_ts, value / 100 AS time_delta,
          CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
          '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS src_ip,
          '192.168.1.' || (CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 3) AS dst_ip,
          CASE event_type WHEN 'click' THEN 'HTTP' WHEN 'view' THEN 'TLS' WHEN 'signup' THEN 'DNS'
            WHEN 'purchase' THEN 'FTP' ELSE 'ARP' END AS highest_layer,
          CASE event_type WHEN 'signup' THEN 'UDP' WHEN 'error' THEN NULL ELSE 'TCP' END AS transport_layer,
          CAST(1024 + user_id AS INT) AS src_port, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS dst_port,
          CAST(event_id * 7 % 100000 AS VARCHAR) AS tcp_seq, CAST(event_id * 3 % 1000 AS VARCHAR) AS tcp_ack,
          60 + CAST(floor(value) AS INT) AS length
        FROM events""",
    "mixed": r"""
        SELECT * REPLACE (
          CASE WHEN transport_layer IS NOT NULL AND pkt_no % 13 = 0 THEN NULL
            WHEN transport_layer IS NOT NULL AND pkt_no % 11 = 0 THEN 'fd00::' || src_ip ELSE src_ip END AS src_ip,
          CASE WHEN transport_layer IS NOT NULL AND pkt_no % 13 = 0 THEN NULL
            WHEN transport_layer IS NOT NULL AND pkt_no % 11 = 0 THEN 'fd00::' || dst_ip ELSE dst_ip END AS dst_ip),
          CASE WHEN transport_layer IS NULL OR pkt_no % 13 = 0 THEN 'none' WHEN pkt_no % 11 = 0 THEN 'ipv6'
            ELSE 'ip' END AS ip_layer
        FROM packets""",
    "windowed": r"""
        SELECT *, idx // 100 AS batch_id, idx % 100 AS i, least(100, n - idx // 100 * 100) AS batch_size FROM (
          SELECT *, row_number() OVER (ORDER BY pkt_no) - 1 AS idx, count(*) OVER () AS n FROM packets)""",
    "rates": r"""
        SELECT *, coalesce(round(i / nullif((epoch_us(sniff_ts) - epoch_us(first_ts)) / 1e6, 0), 6), 0.0) AS packet_rate
        FROM (SELECT *, first_value(sniff_ts) OVER (PARTITION BY batch_id ORDER BY i) AS first_ts FROM windowed)""",
    "mixed_rates": r"""
        SELECT m.*, r.batch_id, r.i, r.packet_rate FROM rates r JOIN mixed m USING (pkt_no)""",
    "ratios": r"""
        SELECT batch_id, count(*) FILTER (WHERE length >= 70) AS hostile, count(*) AS decodable,
          count(*) FILTER (WHERE length >= 70) / CAST(count(*) AS DOUBLE) AS ratio
        FROM windowed GROUP BY batch_id""",
    "per_target": r"""
        SELECT batch_id, dst_ip, count(*) AS packets, max(batch_size) AS batch_size,
          '[' || string_agg(CAST(pkt_no AS VARCHAR), ',' ORDER BY pkt_no) || ']' AS evidence
        FROM windowed GROUP BY batch_id, dst_ip""",
    "ddos": r"""
        SELECT 0 AS type, t.batch_id, dst_ip, evidence, last_ts
        FROM per_target t JOIN ratios r USING (batch_id)
          JOIN (SELECT batch_id, max(sniff_ts) AS last_ts FROM windowed GROUP BY batch_id) USING (batch_id)
        WHERE ratio > CAST(0.8 AS DOUBLE) AND packets > CAST(0.3 AS DOUBLE) * batch_size""",
    "ddos_followed": r"""
        SELECT * FROM ddos WHERE (batch_id + 1) * 100 < (SELECT count(*) FROM packets)""",
    "bots": r"""
        SELECT 2 AS type, src_ip, dst_ip, '{"pkt_no":' || pkt_no || '}' AS detail, sniff_ts, pkt_no
        FROM packets WHERE transport_layer = 'TCP' AND dst_port < 50 AND length >= 70""",
    "http": r"""
        SELECT page_id AS pkt_no, '10.1.0.' || (page_id % 256) AS src_ip, '192.168.2.1' AS dst_ip, 0 AS item,
          TIMESTAMP '2024-01-01' + to_seconds(page_id) AS sniff_ts,
          CASE page_id % 5 WHEN 0 THEN 'uri' WHEN 1 THEN 'referer' WHEN 2 THEN 'cookie' WHEN 3 THEN 'user-agent'
            ELSE 'form' END AS field,
          CASE page_id % 5 WHEN 0 THEN regexp_extract('<b>x</b>+1%' || html, '<[^\n]*>') WHEN 1 THEN regexp_extract(url, '<[^\n]*>')
            WHEN 2 THEN regexp_extract(html, '<[^\n]*>') WHEN 3 THEN regexp_extract(html, '<[^\n]*>')
            ELSE regexp_replace(url, '^.*:', '') END AS text
        FROM pages UNION ALL
        SELECT page_id, '10.1.0.' || (page_id % 256), '192.168.2.1', 1, TIMESTAMP '2024-01-01' + to_seconds(page_id), 'form',
          regexp_replace(regexp_replace('Value: x ' || replace(html, chr(10), ' '), '^.*:', ''), '^\s+|\s+$', '', 'g')
        FROM pages WHERE page_id % 5 = 4""",
    "http_codes": r"""
        SELECT pkt_no, src_ip, dst_ip, sniff_ts, item, c, row_number() OVER (PARTITION BY pkt_no, item ORDER BY p) - 1 AS place FROM (
          SELECT pkt_no, src_ip, dst_ip, sniff_ts, item, unnest(string_split(text, '')) AS c,
            generate_subscripts(string_split(text, ''), 1) AS p FROM http)
        WHERE c <> '' AND (unicode(c) <= 128)""",
    "xss": r"""
        SELECT DISTINCT 8 AS type, src_ip, dst_ip, '{"pkt_no":' || pkt_no || '}' AS detail, pkt_no, sniff_ts FROM (
          SELECT pkt_no, src_ip, dst_ip, sniff_ts, item, place // 10000 AS frame, count(*) AS n,
            count(*) FILTER (WHERE c IN ('<', '>')) AS tags FROM http_codes GROUP BY ALL)
        WHERE tags * 20 > n""",
    "payloads": r"""
        SELECT doc_id AS pkt_no, '10.2.0.' || (doc_id % 256) AS src_ip, '192.168.3.1' AS dst_ip,
          TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS sniff_ts,
          CASE WHEN doc_id % 7 = 0 THEN concat_ws(' ', upper(lang), text) ELSE text END AS payload
        FROM documents WHERE length(CASE WHEN doc_id % 7 = 0 THEN concat_ws(' ', upper(lang), text) ELSE text END) > 0""",
    "terms": r"""
        SELECT pkt_no, term, count(*) AS tf FROM (
          SELECT pkt_no, unnest(regexp_extract_all(lower(payload), '[\p{L}\p{N}_]{2,}')) AS term FROM payloads)
        GROUP BY pkt_no, term""",
    "weights": r"""
        SELECT pkt_no, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY pkt_no)) AS tfidf FROM (
          SELECT t.pkt_no, t.term, tf, tf * (ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1) AS w
          FROM terms t JOIN (SELECT term, count(*) AS df FROM terms GROUP BY term) USING (term),
            (SELECT count(*) AS n FROM payloads))""",
    "shells": r"""
        SELECT 1 AS type, src_ip, dst_ip, '{"pkt_no":' || pkt_no || '}' AS detail, pkt_no, sniff_ts FROM payloads
        WHERE pkt_no IN (SELECT pkt_no FROM weights GROUP BY pkt_no HAVING -1.0 + sum(tfidf * CASE term
          WHEN 'de' THEN 3.0 WHEN 'the' THEN 2.0 WHEN 'la' THEN -2.5 WHEN 'el' THEN 1.5 ELSE 0 END) > 0)""",
    "ids": r"""
        SELECT event_id AS line_no, CAST(event_id AS VARCHAR) AS stamp, '10.0.0.1:' || user_id AS src_ap,
          '192.168.1.1:80' AS dst_ap,
          CASE event_type WHEN 'click' THEN '(x) Port Scan' WHEN 'view' THEN 'SQL Inject y'
            WHEN 'purchase' THEN 'XML Inject' ELSE 'ICMP ping' END AS msg,
          CASE event_type WHEN 'click' THEN 9 WHEN 'view' THEN 6 WHEN 'purchase' THEN 7 END AS type
        FROM events""",
    "alarms": r"""
        SELECT event_id AS seq, '10.0.0.' || (user_id % 256) AS ip, '[新报警]' || props AS info,
          date_trunc('day', ts) AS datetime
        FROM events WHERE event_type = 'error'""",
    "assets": r"""
        SELECT ip, sum(copies) AS n, count(*) AS n_names,
          string_agg(asset_name || 'x' || copies, ',' ORDER BY asset_name) AS names
        FROM (SELECT '10.0.0.' || (c_custkey % 100) AS ip, c_name AS asset_name, count(*) AS copies
          FROM customer WHERE c_custkey % 3 = 0 GROUP BY ALL)
        GROUP BY ip""",
    "runs": r"""
        SELECT *, row_number() OVER (PARTITION BY ip, run ORDER BY seq) - 1 AS place FROM (
          SELECT *, CAST(sum(starts) OVER (PARTITION BY ip ORDER BY seq) AS BIGINT) AS run FROM (
            SELECT *, CASE WHEN lag(datetime) OVER (PARTITION BY ip ORDER BY seq) = datetime THEN 0 ELSE 1 END
              AS starts FROM alarms))""",
    "host_rows": r"""
        SELECT r.ip, run, 0 AS part, string_agg(info, '' ORDER BY seq) AS detail, min(datetime) AS time,
          count(*) AS alarms, coalesce(max(names), 'none') AS names, coalesce(max(n_names), 0) AS n_names
        FROM runs r LEFT JOIN assets a ON r.ip = a.ip GROUP BY r.ip, run""",
    "ftp": r"""
        SELECT conv_id AS flow, turn AS seq, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60 + turn) AS sniff_ts, '10.3.0.' || (conv_id % 256) AS src_ip,
          CASE WHEN role = 'user' THEN 'f' || turn || '.TXT' END AS command_file,
          CASE WHEN role = 'assistant' THEN text END AS text_lines,
          CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 1 ELSE 0 END AS fin
        FROM conversations""",
    "all_packets": r"""
        SELECT *, idx // 100 AS batch_id, least(100, n - idx // 100 * 100) AS batch_size FROM (
          SELECT *, row_number() OVER (ORDER BY number) - 1 AS idx, count(*) OVER () AS n FROM (
            SELECT pkt_no * 4 AS number, dst_ip, length, sniff_ts FROM packets UNION ALL
            SELECT DISTINCT pkt_no * 4 + 1, dst_ip, NULL, sniff_ts FROM http UNION ALL
            SELECT doc_id * 4 + 2, '192.168.3.1', NULL, TIMESTAMP '2024-01-01' + to_seconds(doc_id) FROM documents UNION ALL
            SELECT (flow * 1000 + seq) * 4 + 3, '192.168.4.1', NULL, sniff_ts FROM ftp))""",
    "all_floods": r"""
        SELECT t.*, last_ts FROM (
          SELECT batch_id, dst_ip, count(*) AS packets, max(batch_size) AS batch_size,
            '[' || string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) || ']' AS evidence FROM all_packets GROUP BY ALL) t
        JOIN (SELECT batch_id, max(sniff_ts) AS last_ts, count(*) FILTER (WHERE length >= 70) / CAST(count(*) AS DOUBLE) AS ratio
          FROM all_packets GROUP BY batch_id) USING (batch_id)
        WHERE ratio > CAST(0.8 AS DOUBLE) AND packets > CAST(0.3 AS DOUBLE) * batch_size
          AND (batch_id + 1) * 100 < (SELECT count(*) FROM all_packets)""",
    "ftp_rows": r"""
        SELECT *, max(fin) OVER (PARTITION BY flow, sess) AS ends,
          last_value(CASE WHEN command_file IS NOT NULL THEN seq END IGNORE NULLS) OVER (PARTITION BY flow, sess ORDER BY seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS file_no,
          last_value(command_file IGNORE NULLS) OVER (PARTITION BY flow, sess ORDER BY seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS file_name FROM (
          SELECT *, CAST(coalesce(sum(fin) OVER (PARTITION BY flow ORDER BY seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sess FROM ftp)""",
    "ftp_pieces": r"""
        SELECT *, coalesce(array_to_string(list_transform(
            regexp_extract_all(text_lines, '[^\n]*\n|[^\n]+$')[2:],
            lambda line, i: left(regexp_replace(CASE WHEN i = 1 THEN line[2:] ELSE line END, '^\t+|\t+$', '', 'g'),
              CAST(greatest(length(regexp_replace(CASE WHEN i = 1 THEN line[2:] ELSE line END, '^\t+|\t+$', '', 'g')) - 6,
                0) AS BIGINT)) || chr(10)), ''), '') AS piece
        FROM ftp_rows WHERE file_name IS NOT NULL""",
    "transfers": r"""
        SELECT flow, sess, file_no, any_value(file_name) AS file_name, max(src_ip) AS src_ip, max(ends) = 1 AS closed,
          max(sniff_ts) AS last_ts, max(max(sniff_ts)) OVER (PARTITION BY flow) AS last_of_flow,
          CAST(sum(octet_length(encode(piece))) AS BIGINT) AS size, string_agg(piece, '' ORDER BY seq) AS content
        FROM ftp_pieces GROUP BY flow, sess, file_no""",
    "programs": r"""
        SELECT doc_id, 'doc' || doc_id || '.bin' AS file_name, octet_length(encode(text)) AS text_size,
          doc_id % 10 <> 9 AND doc_id % 20 <> 0 AS readable, doc_id % 2 = 0 AS is64, doc_id // 2 % 2 = 0 AS little,
          doc_id % 4 AS n_seg, 3 + (doc_id % 3 <> 0)::INT + (doc_id % 4 IN (1, 2))::INT AS n_sec,
          CASE WHEN doc_id % 2 = 0 THEN 64 + 56 * (doc_id % 4) ELSE 52 + 32 * (doc_id % 4) END AS text_at
        FROM documents""",
    "arches": r"""
        SELECT *, ['x86', 'x64', 'ARM', 'MIPS'][doc_id % 4 + 1] AS arch,
          ['EM_386', 'EM_X86_64', 'EM_ARM', 'EM_MIPS'][doc_id % 4 + 1] AS machine,
          ['ET_REL', 'ET_EXEC', 'ET_DYN'][doc_id % 3 + 1] AS file_type,
          CASE WHEN n_seg > 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'PT_INTERP' ELSE 'PT_LOAD' END ELSE 'none' END AS seg1,
          CASE WHEN n_seg > 2 THEN CASE WHEN doc_id % 5 = 0 THEN 'PT_DYNAMIC' ELSE 'PT_GNU_STACK' END ELSE 'none' END
            AS seg2
        FROM programs WHERE readable""",
    "hostile_files": r"""
        SELECT doc_id FROM arches WHERE n_sec >= 4 AND text_size > 1500""",
    "bad_transfers": r"""
        SELECT t.* FROM transfers t WHERE closed AND flow % 2 = 0 AND flow IN (SELECT doc_id FROM hostile_files)""",
    "carried": r"""
        SELECT kind AS type, src_ip, '192.168.4.1' AS dst_ip, '{"flow":' || flow || ',"sess":' || sess
          || ',"file_name":"' || file_name || '","size":' || size || '}' AS detail, last_ts
        FROM (SELECT 3 AS kind, * FROM bad_transfers UNION ALL SELECT 4, * FROM bad_transfers
          UNION ALL SELECT 5, * FROM transfers WHERE closed)""",
}


def _needs(sql: str) -> list[str]:
    """The views a statement uses, directly or through others, in definition order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(todo.pop().replace("(", " ").replace(")", " ").replace(",", " ").split())
        fresh = (words & set(VIEWS)) - found
        found |= fresh
        todo += [VIEWS[v] for v in fresh]
    return [v for v in VIEWS if v in found]


def _statement(body: str) -> str:
    views = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in _needs(body))
    return f"WITH {views}\n{body.strip()}" if views else body.strip()


#: Rows that are kept from training.
HELD = "CAST('0x' || left(md5(CAST({0} AS VARCHAR)), 7) AS BIGINT) % 5 = 0"
STAMP = "'%Y-%m-%d %H:%M:%S.%f'"

_BODIES = {
    "scan_packets": f"SELECT pkt_no, sensor, highest_layer, length, strftime(sniff_ts, {STAMP}) AS sniffed FROM packets",
    "decode_packets": """
        SELECT pkt_no AS sent_no, pkt_no % 50 <> 0 AS accepted, CASE WHEN pkt_no % 50 = 0 THEN -1 ELSE pkt_no END AS pkt_no,
          CASE WHEN pkt_no % 50 = 0 THEN 'rejected' WHEN transport_layer = 'TCP' THEN tcp_seq ELSE 'none' END AS tcp_seq
        FROM packets""",
    "land_packets": """
        SELECT strftime(sniff_ts, '%Y-%m-%d') AS day, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes
        FROM packets WHERE transport_layer = 'TCP' GROUP BY 1""",
    "event_sink": """
        SELECT 0 AS message, type AS kind, count(*) AS events, count(DISTINCT src_ap) AS sources
        FROM ids WHERE type IS NOT NULL GROUP BY type""",
    "scan_ids_alerts": 'SELECT msg, stamp AS "timestamp", src_ap, dst_ap FROM ids',
    "tail_ids_alerts": 'SELECT msg, stamp AS "timestamp", src_ap, dst_ap FROM ids',
    "scan_alarms": f"SELECT seq, ip, info, strftime(datetime, {STAMP}) AS datetime FROM alarms",
    "host_result_ids": """
        SELECT append, count(*) AS rows, count(*) AS ids, CASE append WHEN 1 THEN 1 ELSE any_value(n) + 1 END AS lowest,
          CASE append WHEN 1 THEN count(*) ELSE any_value(n) + count(*) END AS highest
        FROM (SELECT ip, count(*) OVER () AS n FROM host_rows WHERE n_names > 0), (SELECT unnest([1, 2]) AS append)
        WHERE append = 1 OR length(ip) % 2 = 0 GROUP BY append""",
    "scan_files": """
        SELECT 'upload' AS name, CAST(octet_length(encode(body)) AS BIGINT) AS file_size, md5(body) AS digest FROM (
        SELECT string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS body FROM documents GROUP BY doc_id // 100)""",
    "ddos_evidence_packets": f"""
        SELECT w.batch_id, w.dst_ip, w.pkt_no, w.src_ip, w.length, strftime(w.sniff_ts, {STAMP}) AS sniff_ts
        FROM windowed w JOIN ddos USING (batch_id, dst_ip)""",
    "host_sink": """
        SELECT n_names > 0 AS kept, ip, count(*) AS rows, CAST(sum(length(detail)) AS BIGINT) AS characters
        FROM host_rows GROUP BY 1, 2""",
    "filter_tcp": "SELECT pkt_no, highest_layer FROM packets WHERE transport_layer = 'TCP'",
    "ip_layer": """
        SELECT pkt_no, ip_layer, CASE WHEN ip_layer = 'none' THEN 'none' ELSE src_ip END AS src_ip,
          CASE WHEN ip_layer = 'none' THEN 'none' ELSE dst_ip END AS dst_ip FROM mixed""",
    "ddos_features": """
        SELECT pkt_no, batch_id, i, highest_layer, coalesce(transport_layer, 'None') AS transport_layer, src_ip, dst_ip,
          CASE WHEN transport_layer IS NULL THEN 0 ELSE src_port END AS src_port,
          CASE WHEN transport_layer IS NULL THEN 0 ELSE dst_port END AS dst_port, length, packet_rate,
          CASE WHEN src_ip IN ('10.0.0.8', '10.0.0.46', '10.0.0.7') THEN 0 ELSE 1 END AS source_flag
        FROM mixed_rates WHERE src_ip IS NOT NULL""",
    "allowlist_flag": """
        SELECT pkt_no, CASE WHEN src_ip IN ('10.0.0.8', '10.0.0.46', '10.0.0.7') THEN 0 ELSE 1 END AS source_flag
        FROM packets""",
    "allowlist_antijoin": """
        SELECT pkt_no, src_ip FROM packets WHERE src_ip NOT IN
          (SELECT '10.0.0.' || (c_custkey % 256) FROM customer WHERE c_custkey % 7 = 0)""",
    "botnet_filter": "SELECT pkt_no, src_port, dst_port FROM packets WHERE transport_layer = 'TCP'",
    "botnet_features": """
        SELECT pkt_no, round(time_delta, 6) AS duration, 0 AS protocol, src_port AS source_port, dst_port AS dest_port,
          167772160 + (CAST(split_part(src_ip, '.', 3) AS BIGINT) * 256) + CAST(split_part(src_ip, '.', 4) AS BIGINT)
            AS source_u32,
          3232235776 + CAST(split_part(dst_ip, '.', 4) AS BIGINT) AS dest_u32,
          CAST(CAST(tcp_seq AS BIGINT) + CAST(tcp_ack AS BIGINT) AS DOUBLE) AS total_packets, length AS total_bytes,
          30 AS state
        FROM mixed WHERE transport_layer = 'TCP' AND ip_layer = 'ip'""",
    "webshell_payload": "SELECT pkt_no, length(payload) AS characters, md5(payload) AS digest FROM payloads",
    "xss_field": "SELECT pkt_no, field, md5(text) AS digest FROM http",
    "xss_field_any": r"""
        SELECT pkt_no, field, md5(text) AS digest FROM http UNION ALL
        SELECT page_id, 'cookie', md5(regexp_extract(html, '<[^\n]*>')) FROM pages WHERE page_id % 5 = 1""",
    "ids_classify": "SELECT line_no, type, src_ap FROM ids WHERE type IS NOT NULL",
    "ftp_commands": "SELECT flow, seq, coalesce(command_file, 'none') AS file_name FROM ftp",
    "ftp_data_filter": """
        SELECT flow * 1000 + seq AS pkt_no, length(text_lines) AS characters FROM ftp WHERE text_lines IS NOT NULL""",
    "conform_columns": """
        SELECT p_name AS file_name, CAST(p_size AS BIGINT) AS file_size, p_brand AS section_text, 3 AS known,
          212 AS columns FROM part""",
    "host_asset_join": """
        SELECT seq, a.ip, coalesce(names, 'none') AS names, coalesce(n_names, 0) AS n_names
        FROM alarms a LEFT JOIN assets s ON a.ip = s.ip""",
    "ftp_asof": """
        SELECT flow, seq, file_name, src_ip FROM ftp_rows WHERE text_lines IS NOT NULL AND file_name IS NOT NULL""",
    "code_lookup": """
        SELECT pkt_no, CASE transport_layer WHEN 'TCP' THEN 0 WHEN 'UDP' THEN 1 ELSE -1 END AS protocol,
          CASE WHEN highest_layer = 'HTTP' THEN 30 ELSE 1 END AS state FROM packets""",
    "count_window": "SELECT pkt_no, batch_id, i, batch_size FROM windowed",
    "count_window_by_sensor": """
        SELECT sensor, pkt_no, idx // 100 AS batch_id, idx % 100 AS i, least(100, n - idx // 100 * 100) AS batch_size
        FROM (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY pkt_no) - 1 AS idx,
          count(*) OVER (PARTITION BY sensor) AS n FROM packets)""",
    "ddos_batch_ratio": """
        SELECT batch_id, hostile, decodable, round(ratio, 6) AS ratio, ratio > CAST(0.8 AS DOUBLE) AS alarm FROM ratios""",
    "ddos_targets": """
        SELECT batch_id, dst_ip, packets, round(ratio, 6) AS ratio FROM per_target t JOIN ratios r USING (batch_id)
        WHERE packets > CAST(0.3 AS DOUBLE) * batch_size""",
    "ddos_evidence": "SELECT batch_id, dst_ip, evidence FROM per_target",
    "ddos_events": f"""
        SELECT type, strftime(last_ts, {STAMP}) AS time, TRUE AS detected, '' AS src_ip, dst_ip, evidence AS detail, batch_id FROM ddos""",
    "host_events": f"""
        SELECT ip, run, part, detail, strftime(time, {STAMP}) AS time, TRUE AS detected, alarms, names, n_names FROM host_rows""",
    "host_takeover": f"""
        SELECT run, coalesce(lead(first_ip) OVER (ORDER BY run), last_ip) AS event_ip, strftime(time, {STAMP}) AS time,
          alarms
        FROM (SELECT run, arg_min(ip, seq) AS first_ip, arg_max(ip, seq) AS last_ip, min(datetime) AS time,
            count(*) AS alarms
          FROM (SELECT *, CAST(sum(starts) OVER (ORDER BY seq) AS BIGINT) AS run FROM
            (SELECT *, CASE WHEN lag(datetime) OVER (ORDER BY seq) = datetime THEN 0 ELSE 1 END AS starts FROM alarms))
          GROUP BY run)""",
    "any_positive": """
        SELECT src_ip, CAST(bool_or(length >= 150) AS INT) AS prediction FROM packets GROUP BY src_ip""",
    "elf_dedup": "SELECT DISTINCT p_type, p_brand, p_size FROM part",
    "packet_rate": "SELECT pkt_no, packet_rate FROM rates",
    "label_encode": """
        SELECT pkt_no, dense_rank() OVER (PARTITION BY batch_id ORDER BY highest_layer) - 1 AS highest_layer_code,
          dense_rank() OVER (PARTITION BY batch_id ORDER BY coalesce(transport_layer, 'None')) - 1
            AS transport_layer_code,
          dense_rank() OVER (PARTITION BY batch_id ORDER BY dst_ip) - 1 AS dst_ip_code FROM windowed""",
    "host_runs": "SELECT seq, ip, run, place FROM runs",
    "ftp_sessions": "SELECT flow, seq, sess, coalesce(file_name, 'none') AS file_name FROM ftp_rows",
    "argmax_class": """
        SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS class FROM embeddings""",
    "skip_lines": """
        SELECT line_no, '{"msg":"' || msg || '","timestamp":"' || stamp || '","src_ap":"' || src_ap || '","dst_ap":"'
          || dst_ap || '"}' AS line FROM ids QUALIFY row_number() OVER (ORDER BY line_no) > 500""",
    "xss_extract": r"""
        SELECT page_id, length(regexp_extract(html, '<[^\n]*>')) AS characters,
          md5(regexp_extract(html, '<[^\n]*>')) AS digest FROM pages""",
    "ipv4_to_int": """
        SELECT pkt_no, CASE WHEN ip_layer <> 'ip' THEN -1 ELSE
            167772160 + (CAST(split_part(src_ip, '.', 3) AS BIGINT) * 256) + CAST(split_part(src_ip, '.', 4) AS BIGINT)
          END AS src_u32,
          CASE WHEN ip_layer <> 'ip' THEN -1 ELSE 3232235776 + CAST(split_part(dst_ip, '.', 4) AS BIGINT) END AS dst_u32
        FROM mixed""",
    "tcp_totp": """
        SELECT pkt_no, CAST(CAST(tcp_seq AS BIGINT) + CAST(tcp_ack AS BIGINT) AS DOUBLE) AS summed,
          CAST(tcp_seq || tcp_ack AS DOUBLE) AS joined FROM packets WHERE transport_layer = 'TCP'""",
    "url_unquote": "SELECT page_id, url || '&q=<b>x</b>+你+1%' AS url FROM pages",
    "form_values": "SELECT page_id, regexp_replace(url, '^.*:', '') || '|x y|' AS form_values FROM pages",
    "char_codes": """
        SELECT page_id, len(codes) AS n_codes, md5(array_to_string(codes, ',')) AS digest FROM (
          SELECT page_id, list_concat(list_filter(list_transform(list_filter(string_split(html, ''), lambda c: c <> ''),
            lambda c: unicode(c)), lambda u: u <= 128), [134, 132, 130, 129, 131, 133, 128]) AS codes FROM pages)""",
    "xss_vector": """
        SELECT page_id, frame_no, 10000 AS places, count(*) AS n_codes,
          round(CAST(sum(u * (place - frame_no * 10000 + 1)) AS DOUBLE), 3) AS weighted
        FROM (SELECT *, place // 10000 AS frame_no FROM (
          SELECT page_id, unicode(c) AS u, row_number() OVER (PARTITION BY page_id ORDER BY p) - 1 AS place FROM (
            SELECT page_id, unnest(string_split(html, '')) AS c, generate_subscripts(string_split(html, ''), 1) AS p
            FROM pages) WHERE c <> '' AND unicode(c) <= 128))
        GROUP BY page_id, frame_no""",
    "hex_payload": """
        SELECT doc_id, CASE WHEN doc_id % 9 = 0 OR doc_id % 11 = 0 THEN 'rejected' ELSE md5(text) END AS digest
        FROM documents""",
    "term_counts": "SELECT pkt_no, term, tf FROM terms",
    "tfidf": "SELECT pkt_no, term, tf, round(tfidf, 6) AS tfidf FROM weights",
    "ftp_text_trim": """
        SELECT flow, seq, length(piece) AS characters, md5(piece) AS digest FROM ftp_pieces WHERE text_lines IS NOT NULL""",
    "bool_to_int": """
        SELECT p_partkey, CAST(p_size % 4 <> 0 AND p_size % 3 <> 0 AS INT) AS truthy, CAST(p_size > 20 AS INT) AS flag
        FROM part""",
    "dense_code": """
        SELECT p_partkey, p_size % 3 AS scan, dense_rank() OVER (PARTITION BY p_size % 3 ORDER BY p_brand) AS p_brand,
          CASE WHEN p_size % 4 = 0 THEN -1 ELSE dense_rank() OVER (PARTITION BY p_size % 3
            ORDER BY CASE WHEN p_size % 4 <> 0 THEN p_type END NULLS LAST) END AS p_type FROM part""",
    "null_fill": """
        SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 2 ELSE p_size END AS section_rodata_sh_entsize,
          CASE WHEN p_size % 4 = 0 THEN 1 ELSE p_size END AS section_init_sh_link,
          CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size END AS "seg0_PT_LOAD_p_offset",
          CASE WHEN p_size % 4 = 0 THEN -1 ELSE p_size END AS elf_head_e_entry FROM part""",
    "value_map": """
        SELECT p_partkey, ['1', '4', 'PT_TLS', '.init', '1'][p_size % 5 + 1] AS seg1_head_p_type,
          ['3', 'PT_PHDR', '6', '.init', '1'][p_size % 5 + 1] AS seg2_head_p_type,
          ['PT_INTERP', 'PT_PHDR', 'PT_TLS', '1', '0'][p_size % 5 + 1] AS section_init FROM part""",
    "elf_features": """
        SELECT file_name, n_seg = 1 AS has_dwarf_info, n_seg = 2 AS has_ehabi_info,
          little AS dwarf_info_config_little_endian,
          text_at + text_size + 46 + n_sec * CASE WHEN is64 THEN 64 ELSE 40 END AS file_size,
          n_sec AS num_sections, n_seg AS num_segments,
          CASE WHEN is64 THEN 8 ELSE 4 END AS dwarf_info_config_default_address_size,
          CASE WHEN n_seg = 1 THEN text_at ELSE -1 END AS dwarf_info_debug_info_sec_global_offset,
          CASE WHEN n_seg = 1 THEN text_size ELSE -1 END AS dwarf_info_debug_info_sec_size,
          n_sec - 1 AS shstrndx, text_at + text_size AS sec_header_sh_offset, doc_id + 4096 AS elf_head_e_entry,
          text_at + text_size + 46 AS elf_head_e_shoff, n_seg AS elf_head_e_phnum,
          CASE WHEN n_seg > 0 THEN 5 ELSE -1 END AS "seg0_PT_LOAD_p_flags",
          CASE WHEN seg1 = 'PT_LOAD' THEN doc_id ELSE -1 END AS "seg1_PT_LOAD_p_vaddr",
          CASE WHEN seg2 = 'PT_GNU_STACK' THEN 4096 ELSE -1 END AS "seg2_PT_GNU_STACK_p_align",
          text_size AS section_text_sh_size, doc_id + 4096 AS section_text_sh_addr,
          CASE WHEN doc_id % 3 <> 0 THEN 8 ELSE -1 END AS section_data_sh_addralign,
          text_at + text_size AS section_shstrtab_sh_offset,
          arch AS dwarf_info_config_machine_arch,
          CASE WHEN is64 THEN 'ELFCLASS64' ELSE 'ELFCLASS32' END AS "elf_head_ident_EI_CLASS",
          CASE WHEN little THEN 'ELFDATA2LSB' ELSE 'ELFDATA2MSB' END AS "elf_head_ident_EI_DATA",
          CASE WHEN doc_id % 3 = 0 THEN 'ELFOSABI_LINUX' ELSE 'ELFOSABI_SYSV' END AS "elf_head_ident_EI_OSABI",
          file_type AS elf_head_e_type, machine AS elf_head_e_machine, seg1 AS seg1_head_p_type,
          'SHT_PROGBITS' AS section_text_sh_type,
          CASE WHEN doc_id % 3 <> 0 THEN '.data' ELSE 'none' END AS section_data,
          CASE WHEN n_seg = 1 THEN '.debug_info' ELSE 'none' END AS dwarf_info_debug_info_sec_name
        FROM arches""",
    "elf_pivot": """
        SELECT file_name, n_seg * 8 + n_sec * 11 AS n_features, CAST(text_size AS VARCHAR) AS text_size,
          seg1 AS second_segment,
          CASE WHEN seg2 = 'PT_DYNAMIC' THEN CAST(text_size AS VARCHAR) ELSE 'none' END AS dynamic_size FROM arches""",
    "elf_rejects": """
        SELECT file_name, CASE WHEN doc_id % 10 = 9 THEN text_size ELSE text_size // 2 + 20 END AS file_size,
          CASE WHEN doc_id % 10 = 9 THEN 'not an ELF file'
            WHEN text_size // 2 + 20 < 64 THEN 'truncated header' ELSE 'truncated tables' END AS error
        FROM programs WHERE NOT readable""",
    "elf_clean": """
        SELECT file_name, CAST(CAST(n_seg = 1 AS INT) AS VARCHAR) AS has_dwarf_info,
          CAST(dense_rank() OVER (ORDER BY arch) AS VARCHAR) AS machine_arch,
          CAST(dense_rank() OVER (ORDER BY is64) AS VARCHAR) AS "elf_head_ident_EI_CLASS",
          CAST(dense_rank() OVER (ORDER BY file_type) AS VARCHAR) AS elf_head_e_type,
          CAST(dense_rank() OVER (ORDER BY machine) AS VARCHAR) AS elf_head_e_machine,
          CASE WHEN n_seg > 0 THEN '1' ELSE 'none' END AS seg0_head_p_type,
          CASE seg1 WHEN 'none' THEN '0' WHEN 'PT_INTERP' THEN '1' ELSE '2' END AS seg1_head_p_type,
          CASE seg2 WHEN 'none' THEN '0' WHEN 'PT_DYNAMIC' THEN '1' ELSE '2' END AS seg2_head_p_type,
          '0' AS section_init, '1' AS section_text, CASE WHEN doc_id % 3 <> 0 THEN '1' ELSE '0' END AS section_data,
          CASE WHEN doc_id % 3 <> 0 THEN '2' ELSE '0' END AS section_data_sh_type, '2' AS section_rodata_sh_entsize,
          CASE WHEN n_seg = 1 THEN '1' ELSE '0' END AS dwarf_info_debug_info_sec_name,
          CASE WHEN n_seg = 1 THEN '0' ELSE '1' END AS dwarf_info_debug_info_sec_address,
          CASE WHEN n_seg = 2 THEN '1' ELSE '0' END AS ehabi_infos, '1' AS section_shstrtab_sh_type
        FROM arches""",
    "elf_clean_table": """
        SELECT dense_rank() OVER (ORDER BY arch) AS machine_arch, count(*) AS rows FROM arches GROUP BY arch""",
    "elf_select": """
        SELECT file_name, 62 AS inputs, CAST(n_sec AS DOUBLE) AS num_sections,
          CAST(doc_id + 4096 AS DOUBLE) AS elf_head_e_entry, CAST(1 AS DOUBLE) AS section_text_sh_name,
          CAST(CASE WHEN doc_id % 3 <> 0 THEN 8 ELSE 0 END AS DOUBLE) AS section_data_sh_addralign,
          CAST(CASE WHEN seg1 = 'PT_LOAD' THEN doc_id + 1 ELSE 0 END AS DOUBLE) AS "seg1_PT_LOAD_p_paddr",
          CAST(dense_rank() OVER (ORDER BY arch) AS DOUBLE) AS machine_arch FROM arches""",
    "elf_rule_verdicts": """
        SELECT file_name, CAST(doc_id IN (SELECT doc_id FROM hostile_files) AS INT) AS prediction FROM programs""",
    "file_events": f"SELECT type, strftime(last_ts, {STAMP}) AS time, TRUE AS detected, src_ip, dst_ip, detail FROM carried",
    "botnet_events": f"SELECT type, strftime(sniff_ts, {STAMP}) AS time, TRUE AS detected, src_ip, dst_ip, detail FROM bots",
    "webshell_events": f"SELECT type, strftime(sniff_ts, {STAMP}) AS time, TRUE AS detected, src_ip, dst_ip, detail FROM shells",
    "xss_events": f"SELECT type, strftime(sniff_ts, {STAMP}) AS time, TRUE AS detected, src_ip, dst_ip, detail FROM xss",
    "all_events": f"""
        SELECT message, kind, source, target, detail, coalesce(strftime(time, {STAMP}), 'none') AS time, TRUE AS detected FROM (
        SELECT 0 AS message, type AS kind, '' AS source, dst_ip AS target, evidence AS detail, last_ts AS time FROM ddos UNION ALL
        SELECT 0, type, src_ip, dst_ip, detail, sniff_ts FROM bots UNION ALL
        SELECT 0, type, src_ip, dst_ip, detail, sniff_ts FROM shells UNION ALL
        SELECT 0, type, src_ip, dst_ip, detail, sniff_ts FROM xss UNION ALL
        SELECT 0, type, src_ap, dst_ap, stamp, NULL FROM ids WHERE type IS NOT NULL UNION ALL
        SELECT 0, type, src_ip, dst_ip, detail, last_ts FROM carried UNION ALL
        SELECT 1, -1, ip, 'none', detail, time FROM host_rows)""",
    "ddos_events_followed": f"""
        SELECT type, strftime(last_ts, {STAMP}) AS time, TRUE AS detected, '' AS src_ip, dst_ip, evidence AS detail, batch_id FROM ddos_followed""",
    "ddos_score": f"""
        SELECT count(*) AS rows, count(*) FILTER (WHERE length >= 70) AS positives, TRUE AS good FROM packets WHERE {HELD.format("pkt_no")}""",
    "botnet_score": f"""
        SELECT count(*) AS rows, count(*) FILTER (WHERE dst_port < 50 AND length >= 70) AS positives, TRUE AS good
        FROM packets WHERE transport_layer = 'TCP' AND {HELD.format("pkt_no")}""",
    "webshell_train_score": f"""
        SELECT count(*) AS rows, count(*) FILTER (WHERE toxic = 1) AS positives, TRUE AS good
        FROM labels JOIN payloads ON doc_id = pkt_no WHERE toxic IS NOT NULL AND {HELD.format("pkt_no")}""",
    "xss_score": f"""
        SELECT count(*) AS rows, count(*) FILTER (WHERE pkt_no IN (SELECT pkt_no FROM xss)) AS positives, TRUE AS good
        FROM (SELECT DISTINCT pkt_no FROM http) WHERE {HELD.format("pkt_no")}""",
    "elf_verdicts": f"""
        SELECT count(*) AS rows, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM hostile_files)) AS positives, TRUE AS good
        FROM arches WHERE {HELD.format("file_name")}""",
    "half_threshold": """
        SELECT vec_id, CASE WHEN CAST(embedding[1] AS DOUBLE) + 0.5 > 0.5 THEN 1 ELSE 0 END AS prediction FROM embeddings""",
    "stream_count_window": f"""
        SELECT type, strftime(last_ts, {STAMP}) AS time, TRUE AS detected, '' AS src_ip, dst_ip, evidence AS detail, batch_id FROM ddos_followed""",
    "stream_ftp": """
        SELECT '10.3.' || (flow // 256) || '.' || (flow % 256) AS src_ip, file_name, size, md5(content) AS digest
        FROM transfers WHERE closed""",
    "stream_ids": "SELECT type, 'none' AS time, TRUE AS detected, src_ap AS src_ip, dst_ap AS dst_ip, stamp AS detail FROM ids WHERE type IS NOT NULL",
    "stream_ftp_idle": f"""
        SELECT '10.3.' || (flow // 256) || '.' || (flow % 256) AS src_ip, file_name, size, md5(content) AS digest
        FROM transfers WHERE flow % 3 <> 0 AND closed
          OR flow % 3 = 0 AND last_of_flow + INTERVAL 600 SECOND < (SELECT max(sniff_ts) FROM ftp)""",
    "stream_all": f"""
        SELECT type, strftime(sniff_ts, {STAMP}) AS time, TRUE AS detected, src_ip, dst_ip, detail FROM (
        SELECT type, sniff_ts, src_ip, dst_ip, '{{"pkt_no":' || (pkt_no * 3) || '}}' AS detail FROM bots UNION ALL
        SELECT type, sniff_ts, src_ip, dst_ip, '{{"pkt_no":' || (pkt_no * 3 + 1) || '}}' FROM xss UNION ALL
        SELECT type, sniff_ts, src_ip, dst_ip, '{{"pkt_no":' || (pkt_no * 3 + 2) || '}}' FROM shells)""",
    "stream_watch": f"""
        SELECT message, kind, source, target, detail, coalesce(strftime(time, {STAMP}), 'none') AS time, TRUE AS detected FROM (
        SELECT 0 AS message, 0 AS kind, '' AS source, dst_ip AS target, evidence AS detail, last_ts AS time FROM all_floods UNION ALL
        SELECT 0, type, src_ip, dst_ip, '{{"pkt_no":' || (pkt_no * 4) || '}}', sniff_ts FROM bots UNION ALL
        SELECT 0, type, src_ip, dst_ip, '{{"pkt_no":' || (pkt_no * 4 + 1) || '}}', sniff_ts FROM xss UNION ALL
        SELECT 0, type, src_ip, dst_ip, '{{"pkt_no":' || (pkt_no * 4 + 2) || '}}', sniff_ts FROM shells UNION ALL
        SELECT 0, type, src_ap, dst_ap, stamp, NULL FROM ids WHERE type IS NOT NULL UNION ALL
        SELECT 0, kind, '10.3.' || (flow // 256) || '.' || (flow % 256), '192.168.4.1',
          '{{"flow":"' || least('10.3.' || (flow // 256) || '.' || (flow % 256), '192.168.4.1') || '-192.168.4.1","file_name":"'
            || file_name || '","size":' || size || '}}', last_ts
        FROM transfers, (SELECT unnest([3, 4, 5]) AS kind) WHERE closed AND (kind = 5 OR size % 3 = 0) UNION ALL
        SELECT 1, -1, ip, 'none', detail, time FROM host_rows
        QUALIFY run < max(run) OVER (PARTITION BY ip))""",
}

ORACLE = {name: _statement(body) for name, body in _BODIES.items()}
