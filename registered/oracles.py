"""The registered queries as DuckDB SQL, written on their own and not from the Spark plans."""

from __future__ import annotations

_SEARCHES = """
searches AS (
  SELECT e.event_id AS seq,
         p.p_name || ' ' || p.p_brand AS query,
         'user_' || e.user_id AS user_id,
         CASE WHEN e.event_id % 17 = 0 THEN ''
              WHEN e.event_id % 3 = 0 THEN '203.0.113.7'
              ELSE '10.0.' || (e.user_id // 256) || '.' || (e.user_id % 256) END AS ip,
         epoch_us(e.ts) // 1000000 AS arrival,
         epoch_us(e.ts) // 1000 AS arrival_ms,
         epoch_us(e.ts) // 1000000
           - CASE e.event_id % 10 WHEN 0 THEN 200000 WHEN 1 THEN 4000 ELSE 0 END AS timestamp
  FROM (SELECT *, event_id % (SELECT count(*) FROM part) AS turn FROM events) e JOIN part p ON p.p_partkey = e.turn
),
latest AS (SELECT max(arrival) AS as_of FROM searches)
"""

_SNAPSHOT = """
snapshot AS (
  SELECT query, count(*) AS count FROM searches, latest
  WHERE timestamp // 3600 * 3600 > as_of - 86400 GROUP BY query
)
"""

_HOURLY = """
hourly AS (
  SELECT timestamp // 3600 * 3600 AS bucket_start, query, count(*) AS count FROM searches GROUP BY ALL
)
"""


def _rate(source: str, ttl: int, limit: int, clock: str = "arrival") -> str:
    """CTEs up to `rated`: the rows of `source` with rate_ok, by walking each address from anchor to anchor."""
    return f"""
ticks AS (SELECT DISTINCT ip, {clock} AS t FROM {source} WHERE ip <> ''),
anchors AS (
  SELECT ip, min(t) AS anchor FROM ticks GROUP BY ip
  UNION ALL
  SELECT t.ip, min(t.t) AS anchor FROM anchors a JOIN ticks t ON t.ip = a.ip AND t.t > a.anchor + {ttl}
  GROUP BY t.ip
),
numbered AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.ip, a.anchor ORDER BY s.{clock}, s.seq) AS n
  FROM {source} s ASOF LEFT JOIN anchors a ON s.ip = a.ip AND s.{clock} >= a.anchor
),
rated AS (SELECT * EXCLUDE (n), ip = '' OR n <= {limit} AS rate_ok FROM numbered)
"""


_STOPPED = "(contains(lower(query), 'red') OR contains(lower(query), 'hot plate'))"

_REASONS = f"""
reasons AS (
  SELECT *, CASE WHEN NOT rate_ok THEN 'antifraud' WHEN {_STOPPED} THEN 'stoplist' END AS drop_reason FROM rated
)
"""

_CHAIN = f"WITH RECURSIVE {_SEARCHES}, {_rate('searches', 86400, 3)}, {_REASONS}"
_LIVE_CHAIN = f"WITH RECURSIVE {_SEARCHES}, {_rate('searches', 86400000, 3, 'arrival_ms')}, {_REASONS}"

_TOP_KEPT = """
SELECT query, count(*) AS count FROM reasons, latest
WHERE drop_reason IS NULL AND timestamp // 3600 * 3600 > as_of - 86400
GROUP BY query ORDER BY count DESC, query LIMIT 10
"""

# How each kind of message decodes: (kind, query, user_id, ip, timestamp); other kinds are as the event.
_DECODED = """
decoded AS (
  SELECT seq,
         CASE seq % 50 WHEN 3 THEN '5' WHEN 6 THEN 'only a query' WHEN 7 THEN '' ELSE query END AS query,
         CASE seq % 50 WHEN 3 THEN '' WHEN 6 THEN '' WHEN 7 THEN 'u' ELSE user_id END AS user_id,
         CASE seq % 50 WHEN 3 THEN '10.9.9.9' WHEN 6 THEN '' WHEN 7 THEN '' ELSE ip END AS ip,
         CASE seq % 50 WHEN 3 THEN 7 WHEN 6 THEN 0 WHEN 7 THEN 0 ELSE timestamp END AS timestamp
  FROM searches
)
"""

_PAYLOADS = """
payloads AS (
  SELECT seq, CASE seq % 50
    WHEN 1 THEN '' WHEN 2 THEN 'not json' WHEN 3 THEN '{"query":5,"ip":"10.9.9.9","timestamp":7}'
    WHEN 4 THEN '{"query":"half","timestamp":1.5}' WHEN 5 THEN 'null'
    WHEN 8 THEN '{"query":"before time","timestamp":-1}'
    WHEN 9 THEN to_json({query: query, user_id: user_id, ip: ip, timestamp: timestamp})::VARCHAR || ' and more'
    WHEN 10 THEN repeat(to_json({query: query, user_id: user_id, ip: ip, timestamp: timestamp})::VARCHAR, 2)
    WHEN 11 THEN concat_ws(' ', to_json({query: query, user_id: user_id, ip: ip, timestamp: timestamp})::VARCHAR,
                           to_json({query: query, user_id: user_id, ip: ip, timestamp: timestamp})::VARCHAR)
    WHEN 12 THEN '{"query":"a"},{"b":1}' WHEN 13 THEN '{"query":"a"}}'
    END AS value
  FROM searches
)
"""

_EDGES = "'^[\\s\\x{00a0}]+|[\\s\\x{00a0}]+$'"

ORACLES = {
    "decode_events": f"""
WITH {_SEARCHES}, {_DECODED}
SELECT * FROM decoded WHERE seq % 50 NOT IN (1, 2, 4, 5, 8, 9, 10, 11, 12, 13)
""",
    "decode_events_strict": f"""
WITH {_SEARCHES}, {_DECODED}
SELECT * FROM decoded WHERE seq % 50 NOT IN (1, 2, 3, 4, 5, 8, 9, 10, 11, 12, 13)
""",
    "quarantine_events": f"""
WITH {_SEARCHES}, {_PAYLOADS}
SELECT seq, value, CASE seq % 50 WHEN 8 THEN 'negative_timestamp' ELSE 'not_an_event' END AS bad_reason
FROM payloads WHERE seq % 50 IN (1, 2, 4, 5, 8, 9, 10, 11, 12, 13)
""",
    "quarantine_events_strict": f"""
WITH {_SEARCHES}, {_PAYLOADS}
SELECT seq, value, CASE WHEN seq % 50 = 8 THEN 'negative_timestamp' WHEN seq % 50 = 3 THEN 'wrong_type'
                        ELSE 'not_an_event' END AS bad_reason
FROM payloads WHERE seq % 50 IN (1, 2, 3, 4, 5, 8, 9, 10, 11, 12, 13)
""",
    "encode_events": f"""
WITH {_SEARCHES}
SELECT ip AS key, to_json({{query: query, user_id: user_id, ip: ip, timestamp: timestamp}})::VARCHAR AS value
FROM searches
""",
    "published_top": f"""
WITH {_SEARCHES}, {_SNAPSHOT}
SELECT query, count FROM snapshot ORDER BY count DESC, query LIMIT 50
""",
    "stopwords_normalised": "SELECT DISTINCT p_name AS word FROM part WHERE p_partkey % 7 <> 0",
    "stopwords_added": """
SELECT lower(p_name) AS word FROM part WHERE p_size <= 10 UNION SELECT lower(p_type) FROM part
""",
    "stopwords_deleted": """
SELECT p_name AS word FROM part EXCEPT SELECT p_name FROM part WHERE starts_with(p_name, 'red ') OR p_size = 1
""",
    "stopwords_unknown_deleted": "SELECT DISTINCT p_name AS word FROM part",
    "stoplist_empty": f"WITH {_SEARCHES} SELECT seq, query FROM searches",
    "top_words_of_documents": """
WITH words AS (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS query FROM documents)
SELECT query, count(*) AS count FROM words WHERE regexp_matches(query, '[^\\x00-\\x7F]')
GROUP BY query ORDER BY count DESC, query LIMIT 1000
""",
    "stoplist_pass": f"WITH {_SEARCHES} SELECT seq, query FROM searches WHERE NOT {_STOPPED}",
    "stoplist_documents": f"""
WITH passages AS (SELECT DISTINCT lower(regexp_replace(text, {_EDGES}, '', 'g')) AS word FROM benchmark)
SELECT doc_id, NOT EXISTS (SELECT 1 FROM passages WHERE word <> '' AND contains(lower(text), word)) AS stop_ok
FROM documents
""",
    "stoplist_conversations": """
WITH words AS (
  SELECT DISTINCT lower(word) AS word
  FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM benchmark) WHERE word <> ''
)
SELECT conv_id, turn, NOT EXISTS (SELECT 1 FROM words WHERE contains(lower(text), word)) AS stop_ok
FROM conversations
""",
    "stoplist_documents_words": """
WITH words AS (
  SELECT DISTINCT lower(word) AS word
  FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM benchmark) WHERE word <> ''
)
SELECT doc_id, NOT EXISTS (SELECT 1 FROM words WHERE contains(lower(text), word)) AS stop_ok
FROM documents
""",
    "antifraud_verdicts": f"""
WITH RECURSIVE {_SEARCHES}, {_rate('searches', 86400, 3)} SELECT seq, rate_ok FROM rated
""",
    "antifraud_coarse_clock": f"""
WITH RECURSIVE {_SEARCHES}, coarse AS (SELECT seq, ip, arrival // 3600 AS arrival FROM searches),
{_rate('coarse', 36, 5)} SELECT seq, rate_ok FROM rated
""",
    "chain_reasons": f"{_CHAIN} SELECT seq, drop_reason FROM reasons",
    "chain_with_own_filter": f"""
WITH RECURSIVE {_SEARCHES}, wanted AS (SELECT * FROM searches WHERE NOT ends_with(query, '1')),
{_rate('wanted', 86400, 3)}, {_REASONS}
SELECT seq, drop_reason FROM reasons
UNION ALL SELECT seq, 'brand' FROM searches WHERE ends_with(query, '1')
""",
    "kept_events": f"{_CHAIN} SELECT seq, query, timestamp FROM reasons WHERE drop_reason IS NULL",
    "messages_read": "SELECT count(*) AS messages_read FROM events",
    "drop_counts": f"""
{_CHAIN} SELECT drop_reason, count(*) AS dropped FROM reasons WHERE drop_reason IS NOT NULL GROUP BY drop_reason
""",
    "drop_rate": f"""
{_CHAIN} SELECT count(*) AS messages_read, count(drop_reason) AS dropped,
                count(drop_reason) / count(*) AS share_dropped FROM reasons
""",
    "reason_bucket_counts": f"""
{_CHAIN}
SELECT drop_reason, CASE WHEN rate_ok THEN timestamp // 3600 * 3600 END AS bucket_start,
       CASE WHEN rate_ok THEN query END AS query, count(*) AS count
FROM reasons GROUP BY ALL
""",
    "bucket_counts": f"WITH {_SEARCHES}, {_HOURLY} SELECT * FROM hourly",
    "window_snapshot": f"""
WITH {_SEARCHES}
SELECT query, count(*) AS count FROM searches, latest
WHERE timestamp // 3600 * 3600 > as_of - 6 * 86400 AND timestamp // 3600 * 3600 <= as_of - 5 * 86400
GROUP BY query
""",
    "window_snapshot_of_events": f"WITH {_SEARCHES}, {_SNAPSHOT} SELECT * FROM snapshot",
    # The running greatest bucket of a slot, written with a window over arrivals.
    "ring_counts": f"""
WITH {_SEARCHES}, placed AS (
  SELECT seq, query, timestamp // 3600 * 3600 AS start, timestamp // 3600 % 24 AS slot FROM searches
), aged AS (
  SELECT *, max(start) OVER (PARTITION BY slot ORDER BY seq ROWS UNBOUNDED PRECEDING) AS held,
         max(start) OVER (PARTITION BY slot) AS last FROM placed
)
SELECT query, count(*) AS count FROM aged, latest WHERE held = last AND held >= as_of - 86400 GROUP BY query
""",
    "top_k": f"""
WITH {_SEARCHES}, {_SNAPSHOT} SELECT query, count FROM snapshot ORDER BY count DESC, query LIMIT 20
""",
    "top_n_all": f"""
WITH {_SEARCHES}, {_SNAPSHOT} SELECT query, count FROM snapshot ORDER BY count DESC, query LIMIT 1000
""",
    "top_n_5": f"""
WITH {_SEARCHES}, {_SNAPSHOT} SELECT query, count FROM snapshot ORDER BY count DESC, query LIMIT 5
""",
    "sliding_series": f"""
WITH {_SEARCHES}, {_HOURLY},
exploded AS (SELECT unnest(range(bucket_start, bucket_start + 86400, 3600)) AS tick, query, count FROM hourly)
SELECT tick, query, sum(count)::BIGINT AS count FROM exploded GROUP BY tick, query
""",
    "tick_top3": f"""
WITH {_SEARCHES}, {_HOURLY},
exploded AS (SELECT unnest(range(bucket_start, bucket_start + 86400, 1800)) AS tick, query, count FROM hourly),
summed AS (SELECT tick, query, sum(count)::BIGINT AS count FROM exploded GROUP BY tick, query)
SELECT tick, row_number() OVER (PARTITION BY tick ORDER BY count DESC, query) AS rank, query, count
FROM summed QUALIFY rank <= 3
""",
    "top_envelope_json": f"""
WITH {_SEARCHES}, {_SNAPSHOT},
top AS (SELECT query, count FROM snapshot ORDER BY count DESC, query LIMIT 10)
SELECT to_json({{data: list({{query: query, count: count}} ORDER BY count DESC, query),
                 updated_at: strftime(make_timestamp((SELECT as_of FROM latest) * 1000000), '%Y-%m-%dT%H:%M:%SZ')
               }})::VARCHAR AS body
FROM top
""",
    "scalar_functions": f"""
WITH {_SEARCHES}
SELECT seq, lower(query) AS lowered, lower(query) AS word, contains(lower(query), 'red') AS has_red,
       timestamp // 300 * 300 AS bucket_start, timestamp // 300 % 7 AS slot, timestamp AS seconds,
       strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS event_time
FROM searches
""",
    "trending_searches": f"{_CHAIN} {_TOP_KEPT}",
    "trending_from_counts": f"{_CHAIN} {_TOP_KEPT}",
    "stream_trending": f"{_LIVE_CHAIN} {_TOP_KEPT}",
    "stream_drop_counts": f"""
{_LIVE_CHAIN}
SELECT drop_reason, count(*) AS dropped FROM reasons WHERE drop_reason IS NOT NULL GROUP BY drop_reason
""",
    "stream_compacted_counts": f"""
{_LIVE_CHAIN}
SELECT timestamp // 3600 * 3600 AS bucket_start, query, count(*) AS count FROM reasons, latest
WHERE drop_reason IS NULL AND timestamp // 3600 * 3600 > as_of - 86400 GROUP BY ALL
""",
    "stream_rate_verdicts": f"""
WITH RECURSIVE {_SEARCHES}, {_rate('searches', 86400, 3)} SELECT seq, rate_ok FROM rated
""",
    "stopwords_two_editors": """
SELECT p_name AS word FROM part WHERE p_size <= 10
EXCEPT SELECT p_name FROM part WHERE p_size <= 10 AND regexp_matches(p_brand, '[123]$')
UNION SELECT lower(p_name) FROM part WHERE p_size BETWEEN 11 AND 40
""",
    "published_before_the_first_list": f"""
WITH {_SEARCHES}
SELECT '{{"data":[],"updated_at":"' || strftime(make_timestamp(as_of * 1000000), '%Y-%m-%dT%H:%M:%SZ') || '"}}' AS body
FROM latest
""",
    "top_requests": f"""
WITH {_SEARCHES}, {_SNAPSHOT}, n AS (SELECT count(*) AS n FROM snapshot),
requests AS (SELECT unnest([NULL, -1, 0, 1, 7, 100, 101])::INTEGER AS requested)
SELECT requested, CASE WHEN coalesce(requested, 50) BETWEEN 1 AND 100
                       THEN least(n, coalesce(requested, 50)) ELSE 0 END AS rows
FROM requests, n
""",
    "top_n_beyond_the_limit": """
WITH words AS (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS query FROM conversations)
SELECT query, count(*) AS count FROM words WHERE query <> ''
GROUP BY query ORDER BY count DESC, query LIMIT 1000
""",
    "stream_resumed_counts": """
SELECT (event_id % 3)::INTEGER AS partition, count(*) AS messages, sum(event_id)::BIGINT AS offsets
FROM events GROUP BY ALL
""",
    "stream_metrics": f"""
{_LIVE_CHAIN}
SELECT 'messages_read' AS metric, count(*) AS value FROM events
UNION ALL SELECT 'antifraud', count(*) FROM reasons WHERE drop_reason = 'antifraud'
UNION ALL SELECT 'stoplist', count(*) FROM reasons WHERE drop_reason = 'stoplist'
""",
    # Closed once the latest event time, less a day for late events, has passed the end.
    "stream_closed_buckets": f"""
WITH {_SEARCHES}, {_HOURLY}
SELECT * FROM hourly WHERE bucket_start + 3600 <= (SELECT max(timestamp) - 86400 FROM searches)
""",
    "stream_closed_windows": f"""
WITH {_SEARCHES}, {_HOURLY},
ends AS (
  SELECT unnest(range(bucket_start + 3600, bucket_start + 86400 + 3600, 3600)) AS window_end, query, count FROM hourly
)
SELECT window_end, query, sum(count)::BIGINT AS count FROM ends
WHERE window_end <= (SELECT max(timestamp) - 86400 FROM searches) GROUP BY window_end, query
""",
}
ORACLES["stream_ring_counts"] = ORACLES["ring_counts"]
