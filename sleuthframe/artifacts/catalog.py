"""Artifacts by kind of statement. Each says what a table of an app's database means; see Android's and the apps' own schemas."""

from __future__ import annotations

from .registry import Artifact, register

UTC = "date_format(timestamp_seconds(CAST({} AS BIGINT)), 'yyyy-MM-dd HH:mm:ss')"
MS = "date_format(timestamp_millis(CAST({} AS BIGINT)), 'yyyy-MM-dd HH:mm:ss')"
WEBKIT = "date_format(timestamp_seconds(CAST({} AS BIGINT) div 1000000 - 11644473600), 'yyyy-MM-dd HH:mm:ss')"

register(Artifact("sms", "messages", ("*/mmssms.db",), {"sms": ("_id", "thread_id", "address", "date", "date_sent", "read", "type", "body", "service_center", "error_code")}, f"""
SELECT {MS.format("date")} AS timestamp, _id AS message_id, thread_id, address, {MS.format("NULLIF(date_sent, '0')")} AS sent, IF(read = '1', 'Read', 'Unread') AS read,
  CASE type WHEN '1' THEN 'Received' WHEN '2' THEN 'Sent' WHEN '3' THEN 'Draft' WHEN '4' THEN 'Outbox' WHEN '5' THEN 'Failed' WHEN '6' THEN 'Queued' ELSE type END AS direction, body, service_center, error_code
FROM {{sms}}"""))

register(Artifact("mms", "messages", ("*/mmssms.db",), {"pdu": ("_id", "thread_id", "date", "date_sent", "read", "msg_box"), "addr": ("_id", "msg_id", "address", "type"), "part": ("_id", "mid", "ct", "_data", "text")}, f"""
WITH parties AS (
  SELECT msg_id, MIN_BY(address, rowid) FILTER (WHERE type = '137') AS sender, MIN_BY(address, rowid) FILTER (WHERE type = '151') AS receiver FROM {{addr}} GROUP BY msg_id
)
SELECT {UTC.format("p.date")} AS timestamp, p._id AS message_id, p.thread_id, a.sender, a.receiver, CASE p.msg_box WHEN '1' THEN 'Received' WHEN '2' THEN 'Sent' WHEN '3' THEN 'Draft' WHEN '4' THEN 'Outbox' ELSE p.msg_box END AS direction,
  t._id AS part_id, t.ct AS content_type, t._data AS data_file, t.text AS body
FROM {{pdu}} p LEFT JOIN parties a ON a.msg_id = p._id LEFT JOIN {{part}} t ON t.mid = p._id"""))

register(Artifact("call_log", "calls", ("*/calllog.db", "*/contacts2.db"), {"calls": ("_id", "number", "date", "duration", "type", "name", "geocoded_location", "countryiso", "deleted")}, f"""
SELECT {MS.format("date")} AS timestamp, number, name, CAST(duration AS BIGINT) AS seconds, format_string('%02d:%02d:%02d', CAST(duration AS BIGINT) div 3600, CAST(duration AS BIGINT) % 3600 div 60, CAST(duration AS BIGINT) % 60) AS duration,
  CASE type WHEN '1' THEN 'Incoming' WHEN '2' THEN 'Outgoing' WHEN '3' THEN 'Missed' WHEN '4' THEN 'Voicemail' WHEN '5' THEN 'Rejected' WHEN '6' THEN 'Blocked' WHEN '7' THEN 'Answered elsewhere' ELSE 'Unknown' END AS direction,
  geocoded_location AS location, countryiso AS country, COALESCE(deleted, '0') = '1' AS deleted
FROM {{calls}}"""))

register(Artifact("contacts", "contacts", ("*/contacts2.db",), {"raw_contacts": ("_id", "display_name", "times_contacted", "last_time_contacted", "deleted"), "data": ("_id", "raw_contact_id", "mimetype_id", "data1"), "mimetypes": ("_id", "mimetype")}, f"""
SELECT r.display_name AS name, LISTAGG(d.data1, ', ') WITHIN GROUP (ORDER BY d.rowid) FILTER (WHERE m.mimetype = 'vnd.android.cursor.item/phone_v2') AS numbers,
  LISTAGG(d.data1, ', ') WITHIN GROUP (ORDER BY d.rowid) FILTER (WHERE m.mimetype = 'vnd.android.cursor.item/email_v2') AS emails, ANY_VALUE(CAST(r.times_contacted AS BIGINT)) AS times_contacted
FROM {{raw_contacts}} r LEFT JOIN {{data}} d ON d.raw_contact_id = r._id LEFT JOIN {{mimetypes}} m ON m._id = d.mimetype_id GROUP BY r._id, r.display_name"""))

register(Artifact("browser_history", "browser", ("*/History",), {"urls": ("id", "url", "title", "visit_count", "typed_count", "last_visit_time", "hidden")}, f"""
SELECT {WEBKIT.format("last_visit_time")} AS last_visit, url, title, CAST(visit_count AS BIGINT) AS visits, CAST(typed_count AS BIGINT) AS typed, IF(hidden = '1', 'Yes', '') AS hidden
FROM {{urls}}"""))

register(Artifact("browser_visits", "browser", ("*/History",), {"urls": ("id", "url", "title"), "visits": ("id", "url", "visit_time", "from_visit", "transition", "visit_duration")}, f"""
SELECT {WEBKIT.format("v.visit_time")} AS visited, u.url, u.title, CAST(v.visit_duration AS BIGINT) div 1000000 AS seconds, f.url AS from_url,
  CASE CAST(v.transition AS BIGINT) & 255 WHEN 0 THEN 'Link' WHEN 1 THEN 'Typed' WHEN 2 THEN 'Bookmark' WHEN 3 THEN 'Subframe' WHEN 4 THEN 'Manual subframe' WHEN 5 THEN 'Generated' WHEN 6 THEN 'Top level' WHEN 7 THEN 'Form' WHEN 8 THEN 'Reload' WHEN 9 THEN 'Keyword' WHEN 10 THEN 'Keyword generated' ELSE 'Other' END AS transition,
  CONCAT_WS(', ', IF(CAST(v.transition AS BIGINT) & 8388608 != 0, 'Blocked', NULL), IF(CAST(v.transition AS BIGINT) & 16777216 != 0, 'Forward or back', NULL), IF(CAST(v.transition AS BIGINT) & 33554432 != 0, 'From address bar', NULL), IF(CAST(v.transition AS BIGINT) & 67108864 != 0, 'Home page', NULL), IF(CAST(v.transition AS BIGINT) & 268435456 != 0, 'Chain start', NULL), IF(CAST(v.transition AS BIGINT) & 536870912 != 0, 'Chain end', NULL), IF(CAST(v.transition AS BIGINT) & 1073741824 != 0, 'Client redirect', NULL)) AS qualifiers
FROM {{visits}} v JOIN {{urls}} u ON u.id = v.url LEFT JOIN {{visits}} w ON w.id = v.from_visit AND v.from_visit <> '0' LEFT JOIN {{urls}} f ON f.id = w.url"""))

register(Artifact("browser_searches", "browser", ("*/History",), {"urls": ("id", "url", "title", "last_visit_time"), "keyword_search_terms": ("keyword_id", "url_id", "term")}, f"""
SELECT {WEBKIT.format("u.last_visit_time")} AS searched, k.term, u.url FROM {{keyword_search_terms}} k JOIN {{urls}} u ON u.id = k.url_id"""))

register(Artifact("browser_downloads", "browser", ("*/History",), {"downloads": ("id", "target_path", "start_time", "end_time", "received_bytes", "total_bytes", "state", "interrupt_reason", "opened", "referrer"), "downloads_url_chains": ("id", "chain_index", "url")}, f"""
SELECT {WEBKIT.format("d.start_time")} AS started, {WEBKIT.format("d.end_time")} AS ended, d.target_path, MIN_BY(c.url, CAST(c.chain_index AS BIGINT)) AS url, CAST(d.received_bytes AS BIGINT) AS received, CAST(d.total_bytes AS BIGINT) AS total,
  CASE d.state WHEN '0' THEN 'In progress' WHEN '1' THEN 'Complete' WHEN '2' THEN 'Cancelled' WHEN '4' THEN 'Interrupted' ELSE d.state END AS state, IF(d.opened = '1', 'Yes', 'No') AS opened
FROM {{downloads}} d LEFT JOIN {{downloads_url_chains}} c ON c.id = d.id GROUP BY ALL"""))

register(Artifact("browser_cookies", "browser", ("*/Cookies",), {"cookies": ("host_key", "name", "path", "creation_utc", "expires_utc", "last_access_utc", "is_secure", "is_httponly")}, f"""
SELECT {WEBKIT.format("last_access_utc")} AS last_access, host_key AS host, name, path, {WEBKIT.format("creation_utc")} AS created, IF(expires_utc = '0', NULL, {WEBKIT.format("expires_utc")}) AS expires, is_secure = '1' AS secure, is_httponly = '1' AS http_only
FROM {{cookies}}"""))

register(Artifact("browser_logins", "browser", ("*/Login Data",), {"logins": ("origin_url", "username_value", "date_created", "times_used", "blacklisted_by_user")}, f"""
SELECT {WEBKIT.format("date_created")} AS created, origin_url AS site, username_value AS username, CAST(times_used AS BIGINT) AS used, blacklisted_by_user = '1' AS never_saved FROM {{logins}}"""))

register(Artifact("bookmark_folders", "browser", ("*/bookmarks.db",), {"entities": ("entityId", "type", "title", "url", "lastModified", "deleted"), "relations": ("folderId", "entityId")}, f"""
WITH RECURSIVE tree(entityId, title, path, depth) MAX RECURSION LEVEL 200 AS (
  SELECT e.entityId, e.title, CAST(e.title AS STRING), 0 FROM {{entities}} e LEFT ANTI JOIN {{relations}} r ON r.entityId = e.entityId WHERE e.type = 'FOLDER'
  UNION ALL
  SELECT e.entityId, e.title, t.path || '/' || e.title, t.depth + 1 FROM tree t JOIN {{relations}} r ON r.folderId = t.entityId JOIN {{entities}} e ON e.entityId = r.entityId WHERE e.type = 'FOLDER'
)
SELECT b.lastModified AS modified, b.title, b.url, MIN(t.path) AS folder, IF(b.deleted = '1', 'Yes', 'No') AS deleted
FROM {{entities}} b LEFT JOIN {{relations}} r ON r.entityId = b.entityId LEFT JOIN tree t ON t.entityId = r.folderId WHERE b.type = 'BOOKMARK' GROUP BY b.entityId, b.lastModified, b.title, b.url, b.deleted"""))

register(Artifact("group_chats", "messages", ("*/naver_line",), {"membership": ("id", "m_id"), "contacts": ("m_id", "name"), "chat_history": ("chat_id", "from_mid", "content", "created_time", "status")}, f"""
WITH rooms AS (
  SELECT m.id, LISTAGG(c.name, ', ') WITHIN GROUP (ORDER BY c.name) AS members FROM {{membership}} m LEFT JOIN {{contacts}} c ON c.m_id = m.m_id GROUP BY m.id
  UNION
  SELECT c.m_id, c.name FROM {{contacts}} c LEFT ANTI JOIN {{membership}} m ON m.id = c.m_id
)
SELECT {MS.format("h.created_time")} AS timestamp, h.chat_id, r.members, s.name AS sender, IF(h.from_mid IS NULL, 'Outgoing', 'Incoming') AS direction, h.content
FROM {{chat_history}} h LEFT JOIN rooms r ON r.id = h.chat_id LEFT JOIN {{contacts}} s ON s.m_id = h.from_mid"""))

register(Artifact("conversation_messages", "messages", ("*/viber_messages",), {"messages": ("_id", "conversation_id", "participant_id", "msg_date", "body", "send_type"), "participants": ("_id", "conversation_id", "participant_info_id"), "participants_info": ("_id", "number", "contact_name")}, f"""
WITH everyone AS (
  SELECT p._id, p.conversation_id, i.number, COALESCE(i.contact_name, i.number) AS name FROM {{participants}} p JOIN {{participants_info}} i ON i._id = p.participant_info_id
), own AS (
  SELECT *, COUNT(*) OVER (PARTITION BY _id) AS times FROM everyone WHERE _id IS NOT NULL
), placed AS (
  SELECT *, CASE WHEN name IS NOT NULL THEN OCTET_LENGTH(name) + 2 ELSE 0 END AS size,
    COALESCE(SUM(CASE WHEN name IS NOT NULL THEN OCTET_LENGTH(name) + 2 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY name, _id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM own WHERE conversation_id IS NOT NULL
), listed AS (
  SELECT conversation_id, ENCODE(CONCAT(ARRAY_JOIN(TRANSFORM(ARRAY_SORT(COLLECT_LIST(IF(name IS NOT NULL, STRUCT(name, _id), NULL))), x -> x.name), ', '), ', '), 'UTF-8') AS names FROM placed GROUP BY conversation_id
), several AS (
  SELECT a._id AS sender_id, LISTAGG(b.name, ', ') WITHIN GROUP (ORDER BY b.name) AS names FROM own a JOIN own b ON a.conversation_id = b.conversation_id AND a._id <> b._id WHERE a.times > 1 GROUP BY a._id
), addressed AS (
  SELECT m.*, s.name AS sender, p.conversation_id AS own_conversation, p.start, p.size, v.names AS several_names
  FROM {{messages}} m LEFT JOIN everyone s ON s._id = m.participant_id LEFT JOIN placed p ON p._id = m.participant_id AND p.times = 1 LEFT JOIN several v ON v.sender_id = m.participant_id
), cut AS (
  SELECT a.*, CAST(CONCAT(SUBSTRING(l.names, 1, CAST(a.start AS INT)), SUBSTRING(l.names, CAST(a.start + a.size + 1 AS INT))) AS STRING) AS others
  FROM addressed a LEFT JOIN listed l ON l.conversation_id = a.own_conversation
)
SELECT {MS.format("m.msg_date")} AS timestamp, m.conversation_id, m.sender, COALESCE(m.several_names, IF(OCTET_LENGTH(m.others) > 2, LEFT(m.others, LENGTH(m.others) - 2), NULL)) AS recipients, IF(m.send_type = '0', 'Incoming', 'Outgoing') AS direction, m.body
FROM cut m"""))

register(Artifact("payments", "finance", ("*/cash_money.db",), {"payment": ("sender_id", "recipient_id", "render_data", "display_date", "state"), "customer": ("customer_id", "customer_display_name", "cashtag")}, f"""
SELECT {MS.format("p.display_date")} AS timestamp, s.customer_display_name AS sender, s.cashtag AS sender_tag, r.customer_display_name AS recipient, r.cashtag AS recipient_tag,
  format_string('$%.2f', CAST(get_json_object(p.render_data, '$.amount.amount') AS DOUBLE) / 100) AS amount, get_json_object(p.render_data, '$.note') AS note, p.state
FROM {{payment}} p LEFT JOIN {{customer}} s ON s.customer_id = p.sender_id LEFT JOIN {{customer}} r ON r.customer_id = p.recipient_id"""))

register(Artifact("direct_messages", "messages", ("*/db_im_xx",), {"msg": ("created_time", "sender", "content", "read_status"), "SIMPLE_USER": ("UID", "UNIQUE_ID", "NICK_NAME")}, f"""
SELECT {MS.format("m.created_time")} AS timestamp, u.UID AS user_id, u.UNIQUE_ID AS unique_id, u.NICK_NAME AS nickname, get_json_object(m.content, '$.text') AS message, get_json_object(m.content, '$.display_name') AS display_name, CASE m.read_status WHEN '0' THEN 'Not read' WHEN '1' THEN 'Read' ELSE m.read_status END AS read
FROM {{msg}} m JOIN {{SIMPLE_USER}} u ON u.UID = m.sender WHERE try_parse_json(m.content) IS NOT NULL"""))

register(Artifact("activities", "health", ("*/cache-database",), {"activity_summaries": ("activity_id", "activity_name", "start_time", "distance", "duration"), "activity_details": ("activity_id", "calories", "average_hr")}, f"""
SELECT COALESCE(s.activity_id, d.activity_id) AS activity_id, s.activity_name AS name, {MS.format("s.start_time")} AS started, ROUND(TRY_CAST(s.distance AS DOUBLE) / 1000, 2) AS kilometres, ROUND(TRY_CAST(s.duration AS DOUBLE) / 60, 1) AS minutes, TRY_CAST(d.calories AS DOUBLE) AS calories, TRY_CAST(d.average_hr AS DOUBLE) AS heart_rate
FROM {{activity_summaries}} s FULL OUTER JOIN {{activity_details}} d ON d.activity_id = s.activity_id"""))

register(Artifact("app_usage", "device", ("*/app_usage", "*/digitalwellbeing*"), {"events": ("_id", "package_id", "timestamp", "type"), "packages": ("_id", "package_name")}, f"""
SELECT {MS.format("e.timestamp")} AS timestamp, p.package_name AS package, CASE e.type WHEN '1' THEN 'Activity resumed' WHEN '2' THEN 'Activity paused' WHEN '12' THEN 'Notification' WHEN '18' THEN 'Keyguard hidden' WHEN '19' THEN 'Foreground service start' WHEN '20' THEN 'Foreground service stop' WHEN '23' THEN 'Activity stopped' WHEN '26' THEN 'Device shutdown' WHEN '27' THEN 'Device startup' ELSE e.type END AS event
FROM {{events}} e JOIN {{packages}} p ON p._id = e.package_id"""))

register(Artifact("installed_apps", "device", ("*/localappstate.db",), {"appstate": ("package_name", "title", "first_download_ms", "install_reason", "last_update_timestamp_ms", "auto_update", "account")}, f"""
SELECT DISTINCT {MS.format("first_download_ms")} AS first_download, package_name AS package, title, install_reason AS reason, {MS.format("last_update_timestamp_ms")} AS last_update, IF(auto_update = '1', 'Yes', 'No') AS auto_update, account FROM {{appstate}}"""))

register(Artifact("downloads", "device", ("*/downloads.db",), {"downloads": ("_id", "uri", "_data", "title", "mimetype", "lastmod", "total_bytes", "status", "deleted")}, f"""
SELECT {MS.format("lastmod")} AS modified, title, uri, _data AS stored_at, mimetype, TRY_CAST(total_bytes AS BIGINT) AS bytes, CASE WHEN status = '200' THEN 'Complete' WHEN status BETWEEN '190' AND '199' THEN 'In progress' ELSE status END AS status, deleted = '1' AS deleted FROM {{downloads}}"""))

register(Artifact("accounts", "device", ("*/accounts_ce.db",), {"accounts": ("_id", "name", "type"), "authtokens": ("accounts_id", "type")}, """
SELECT a.name, a.type, COUNT(t.type) AS tokens FROM {accounts} a LEFT JOIN {authtokens} t ON t.accounts_id = a._id GROUP BY a._id, a.name, a.type"""))

register(Artifact("calendar_events", "calendar", ("*/calendar.db",), {"Events": ("_id", "calendar_id", "title", "description", "eventLocation", "dtstart", "dtend", "allDay"), "Calendars": ("_id", "account_name", "calendar_displayName")}, f"""
SELECT {MS.format("e.dtstart")} AS starts, {MS.format("e.dtend")} AS ends, e.title, e.description, e.eventLocation AS location, e.allDay = '1' AS all_day, c.account_name AS account, c.calendar_displayName AS calendar
FROM {{Events}} e LEFT JOIN {{Calendars}} c ON c._id = e.calendar_id"""))

register(Artifact("wifi_scans", "network", ("*/herrevad",), {"lru_table": ("network_type", "ssid", "security_type", "bssid", "timestamp_millis", "latency_millis")}, f"""
SELECT {MS.format("timestamp_millis")} AS timestamp, ssid, bssid, security_type, TRY_CAST(latency_millis AS BIGINT) AS latency FROM {{lru_table}}"""))

register(Artifact("photo_places", "media", ("*/gphotos0.db",), {"local_media": ("dedup_key", "filename", "filepath", "utc_timestamp", "latitude", "longitude", "size_bytes")}, f"""
SELECT {MS.format("utc_timestamp")} AS timestamp, filename, regexp_replace(filepath, '[^/]*$', '') AS folder, TRY_CAST(latitude AS DOUBLE) AS latitude, TRY_CAST(longitude AS DOUBLE) AS longitude, TRY_CAST(size_bytes AS BIGINT) AS bytes FROM {{local_media}}""", outputs=("tsv", "timeline", "table", "places")))

register(Artifact("media_images", "media", ("*/external.db",), {"files": ("_id", "_data", "title", "mime_type", "date_added", "_size")}, """
SELECT date_format(from_utc_timestamp(timestamp_seconds(CAST(date_added AS BIGINT)), '{tz}'), 'yyyy-MM-dd HH:mm:ss') AS added_local, date_format(timestamp_seconds(CAST(date_added AS BIGINT)), 'yyyy-MM-dd') AS day, date_format(timestamp_seconds(CAST(date_added AS BIGINT)), 'HH:mm:ss') AS time,
  _data AS path, title, mime_type, TRY_CAST(_size AS BIGINT) AS bytes
FROM {files} WHERE mime_type ILIKE 'image/%' ORDER BY CAST(date_added AS BIGINT) DESC, _data"""))

# A column that SQLite lets stand beside an aggregate without grouping by it has the value of the row that holds the maximum or minimum, of equal
# rows the first; without such an aggregate that of the last row.

register(Artifact("latest_of_threads", "messages", ("*/mmssms.db",), {"sms": ("_id", "thread_id", "address", "date", "body")}, f"""
WITH last AS (SELECT thread_id, COUNT(*) AS messages, MAX_BY(STRUCT(date, address, body), STRUCT(CAST(date AS BIGINT), -rowid)) AS m FROM {{sms}} GROUP BY thread_id)
SELECT {MS.format("m.date")} AS timestamp, thread_id, messages, m.address, m.body FROM last ORDER BY CAST(m.date AS BIGINT) DESC, thread_id"""))

register(Artifact("bookmarks", "browser", ("*/bookmarks.db",), {"entities": ("entityId", "type", "title", "url", "lastModified", "deleted"), "relations": ("folderId", "entityId")}, """
WITH listed AS (
  SELECT e.entityId, MAX_BY(STRUCT(e.title, e.url, e.lastModified, e.deleted, r.folderId), STRUCT(e.rowid, r.rowid)) AS x FROM {entities} e LEFT JOIN {relations} r ON r.entityId = e.entityId
  WHERE e.type ILIKE 'BOOKMARK' GROUP BY e.entityId
)
SELECT SUBSTRING(REPLACE(REPLACE(x.lastModified, 'T', ' '), 'Z', ''), 1, 19) AS modified, entityId, x.title, x.url, x.folderId AS folder_id, CASE x.deleted WHEN '1' THEN 'YES' ELSE 'NO' END AS deleted FROM listed"""))

register(Artifact("named_calls", "calls", ("*/calllog.db",), {"calls": ("_id", "number", "date", "duration"), "names": ("number", "name")}, f"""
SELECT {MS.format("c.date")} AS timestamp, c.number, n.name, CAST(c.duration AS BIGINT) AS seconds FROM {{calls}} c, {{names}} n WHERE n.number = c.number AND CAST(c.duration AS BIGINT) > 0"""))

register(Artifact("cached_activities", "health", ("*/gcm_cache.db",), {"json_activities": ("concept_id", "data_type", "cached_val")}, """
SELECT REPLACE(TRIM(BOTH '.0' FROM get_json_object(cached_val, '$.summaryDTO.startTimeGMT')), 'T', ' ') AS started, concept_id, get_json_object(cached_val, '$.activityName') AS name, get_json_object(cached_val, '$.activityTypeDTO.typeKey') AS kind,
  TRY_CAST(get_json_object(cached_val, '$.summaryDTO.duration') AS DOUBLE) AS seconds, ROUND(TRY_CAST(get_json_object(cached_val, '$.summaryDTO.distance') AS DOUBLE) / 1000, 3) AS kilometres,
  INSTR(get_json_object(cached_val, '$.activityName'), ' ') AS first_space, COALESCE(json_array_length(get_json_object(cached_val, '$.splits')), 0) AS splits
FROM {json_activities} WHERE data_type = 'ACTIVITY_DETAILS' AND try_parse_json(cached_val) IS NOT NULL"""))
