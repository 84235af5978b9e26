"""DuckDB SQL for the registered queries, written over the flat columns and apart from the Spark expressions."""

from __future__ import annotations

import json

from .functions.ages import DAY_MS, WINDOWS
from .sources.demo import AS_OF, DUCKDB_MS, FLAT

#: 2024-02-01 00:00:00 UTC.
EVENTS_AS_OF = 1_706_745_600_000

#: An upload for each event, with defects; valid in Spark and DuckDB.
UPLOAD_TEXT = """
CASE event_id % 9 WHEN 0 THEN 'not json' WHEN 1 THEN '[]' WHEN 2 THEN '{"a": 1}' WHEN 3 THEN '{"uuid": "dev ' || CAST(user_id AS STRING) || '"}'
  WHEN 4 THEN '{"uuid": ""}' WHEN 5 THEN '{"uuid": "big-' || CAST(user_id AS STRING) || '", "x": "' || repeat('y', 100000) || '"}' WHEN 6 THEN '5'
  ELSE '{"uuid": "dev-' || CAST(user_id AS STRING) || '", "systemInfo": []}' END
"""

CURRENT = f"""
WITH reports AS ({FLAT.replace("{EPOCH_MS}", DUCKDB_MS)}),
current AS (
  SELECT *, {AS_OF} - ts AS age, (coalesce(platform, '') = 'Docker' OR coalesce(variant, '') = 'Docker') AS docker
  FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY ts DESC, report_id DESC) AS rn FROM reports) WHERE rn = 1),
"""
COUNTS = ", ".join(f'count(*) AS "{w}"' if d is None else f'count(*) FILTER (WHERE age < {d * DAY_MS}) AS "{w}"' for w, d in WINDOWS.items())
EVENT_MS = "(epoch_us(ts) // 1000)"


# Bins once more, apart from the engine's: conditions on x in the order in which they are tried, so that the last bin that holds a value comes first.
AGE_DAYS = ["x >= 365: > 1 year", "x >= 180 AND x < 365: 180-365 days", "x >= 90 AND x < 180: 90-180 days", "x >= 30 AND x < 90: 30-90 days", "x >= 14 AND x < 30: 14-30 days", "x >= 5 AND x < 14: 5-14 days", "x >= 1 AND x < 5: 1-5 days", "x >= 0 AND x < 1: < 24 hrs", "true: > 1 year"]
MEMORY = ["x BETWEEN 4194305 AND 8388608: 4.1-8GB", "x BETWEEN 2097153 AND 4194304: 2.1-4GB", "x BETWEEN 1048577 AND 2097152: 1.1-2GB", "x BETWEEN 524289 AND 1048576: 1GB", "x BETWEEN 100 AND 524288: 512M", "true: Unknown"]
STORAGE = [
    "x >= 262145: >256GB", "x BETWEEN 131073 AND 262144: 128.1-256GB", "x BETWEEN 65537 AND 131072: 64.1-128GB", "x BETWEEN 32769 AND 65536: 32.1-64GB", "x BETWEEN 16385 AND 32768: 16.1-32GB",
    "x BETWEEN 8193 AND 16384: 8.1-16GB", "x BETWEEN 4097 AND 8192: 4.1-8GB", "x BETWEEN 2 AND 4096: 4GB", "true: Unknown",
]
PEERS = ["x >= 101: 101+", "x BETWEEN 51 AND 100: 51-100", "x BETWEEN 21 AND 50: 21-50", "x BETWEEN 11 AND 20: 11-20", "x BETWEEN 6 AND 10: 6-10", "x BETWEEN 4 AND 5: 4-5", "x BETWEEN 2 AND 3: 2-3", "x = 1: 1", "x BETWEEN -1 AND 0: None", "true: Unknown"]
PIXELS = ["x >= 20000: 20k+", "x BETWEEN 10000 AND 19999: 10k-20k", "x BETWEEN 5000 AND 9999: 5k-10k", "x BETWEEN 1000 AND 4999: 1k-5k", "x BETWEEN 500 AND 999: 500-1k", "x BETWEEN 1 AND 499: 1-499", "true: Zero"]
UNIVERSES = ["x >= 500: 500+", "x BETWEEN 249 AND 499: 249-500", "x BETWEEN 100 AND 249: 100-249", "x BETWEEN 50 AND 99: 50-99", "x BETWEEN 1 AND 49: 1-49", "true: Zero"]
CHANNELS = ["x >= 1000000: 1M+", "x BETWEEN 500000 AND 999999: 500k-1M", "x BETWEEN 100000 AND 499999: 100k-500k", "x BETWEEN 10000 AND 99999: 10k-100k", "x BETWEEN 1 AND 9999: 1k-10k", "true: Zero"]
PANELS = ["x >= 65: 65+", "x BETWEEN 33 AND 64: 33-64", "x BETWEEN 17 AND 32: 17-32", "x BETWEEN 9 AND 16: 9-16", "x BETWEEN 5 AND 8: 5-8", "x BETWEEN 1 AND 4: 1-4", "true: Zero"]


def bin_sql(value: str, table: list[str]) -> str:
    """The first of ``table`` that holds, its condition before the colon and its label after it."""
    parts = (line.split(": ", 1) for line in table)
    return "CASE " + " ".join(f"WHEN {condition.replace('x', f'({value})')} THEN '{label}'" for condition, label in parts) + " END"


_TRIM = "(CASE WHEN strpos(version, '-master-') > 1 THEN substr(version, 1, strpos(version, '-master-') + 6) ELSE version END)"
_HEAD = f"(CASE WHEN strpos({_TRIM}, '-') > 1 THEN substr({_TRIM}, 1, strpos({_TRIM}, '-') - 1) ELSE {_TRIM} END)"
_NUMBER = rf"regexp_extract({_HEAD}, '^([0-9]+)\.[0-9]+', 1)"
_SHORT = f"(CASE WHEN {_NUMBER} <> '' THEN {_NUMBER} ELSE {_HEAD} END)"
_LONG = f"(CASE WHEN {_SHORT} = 'Unknown' THEN 'Unknown' ELSE {_SHORT} || '.x' END)"
_MAJOR = rf"CASE WHEN regexp_matches({_LONG}, '^[0-9]+\.x\.x') THEN regexp_extract({_LONG}, '^([0-9]+)\.x\.x', 1) || '.x' ELSE {_LONG} END"
_DIRTY = "CASE WHEN strpos(version, '-dirty') > 0 THEN substr(version, 1, strpos(version, '-dirty') - 1) || substr(version, strpos(version, '-dirty') + 6) ELSE version END"
_MODE = "CASE fppd_mode WHEN 'bridge' THEN 'player' WHEN 'master' THEN 'player' ELSE fppd_mode END"
_ON = "coalesce(panel_enabled, '1') NOT IN ('0', 'false')"
_IN = "CASE WHEN in_enabled IN ('1', 'true') THEN {} END"
_AGE_BIN = bin_sql(f"coalesce(age, 0) / {DAY_MS}.0", AGE_DAYS)

#: (series, key, condition) of each statistic, in SQL.
ROWS: dict[str, list[tuple[str, str, str]]] = {
    "Instances": [("''", "''", "true")],
    "platform": [("''", "CASE WHEN platform = 'BeagleBone Black' THEN 'BeagleBone32' ELSE platform END", "true")],
    "platformVariant": [("''", "coalesce(variant, 'Not Defined')", "true")],
    "platformVariantBreakout": [
        (
            "CASE WHEN platform IN ('BeagleBone 64', 'BeagleBone Black') THEN 'BeagleBone' WHEN platform IN ('BeagleBone', 'Raspberry Pi', 'Docker') THEN platform ELSE 'Generic' END",
            "coalesce(variant, 'Unknown')", "platform IS NOT NULL",
        )
    ],
    "version": [("''", _MAJOR, "true")],
    "versionDetailed": [("''", _DIRTY, "true")],
    "versionWithOS": [("''", f"{_TRIM} || '/' || coalesce(os_version, 'Unknown')", "true")],
    "capeInstalled": [("''", "CASE WHEN coalesce(cape_name, 'None') = 'None' THEN 'No' ELSE 'Yes' END", "true")],
    "capeType": [("''", "cape_name", "cape_name NOT IN ('None', 'Unknown')")],
    "capeReleaseVersion": [("''", f"cape_name || '-' || coalesce({_TRIM}, 'unknown')", "true")],
    "fppMode": [("''", f"CASE WHEN fppd_mode IS NULL THEN 'fppd Stopped' ELSE ({_MODE}) || CASE WHEN set_multisync = '1' THEN '-MultiSync Enabled' ELSE '-MultiSync Disabled' END END", "true")],
    "mqttEnabled": [("''", "CASE WHEN mqtt_configured = 'true' THEN 'Yes' WHEN mqtt_configured = 'false' THEN 'No' WHEN fppd_status = 'Not Running' THEN 'fppd Stopped' ELSE 'No' END", "true")],
    "uiLevel": [("''", "CASE coalesce(set_ui_level, '0') WHEN '0' THEN 'Basic' WHEN '1' THEN 'Advanced' WHEN '2' THEN 'Experimental' WHEN '3' THEN 'Developer' WHEN '' THEN 'undefined' ELSE 'Undefined' END", "true")],
    "timeZone": [("''", "CASE WHEN timezone IS NULL THEN 'Not Reported' WHEN timezone = '+0000 GMT' THEN '+0000 UTC' ELSE timezone END", "true")],
    "lastReported": [("''", _AGE_BIN, "true")],
    "deviceMemory": [("''", bin_sql("mem_total", MEMORY), "true")],
    "deviceStorage": [("'storage'", bin_sql("media_total / 1048576.0", STORAGE), "true"), ("'usedStorage'", bin_sql("(media_total - media_free) / 1048576.0", STORAGE), "true")],
    "multisyncPeers": [("''", bin_sql("coalesce(multisync_n - 1, 0)", PEERS), "true")],
    "outputLocalPixels": [("''", bin_sql("coalesce(pi_pixels, 0) + coalesce(bbb_pixels, 0)", PIXELS), "true")],
    "outputUniverses": [("'universe'", bin_sql("e131_universes", UNIVERSES), "true"), ("'channel'", bin_sql("e131_channels", CHANNELS), "true")],
    "inputUniverses": [("'universe'", bin_sql(_IN.format("in_universes"), UNIVERSES), "true"), ("'channel'", bin_sql(_IN.format("in_channels"), CHANNELS), "true")],
    "outputPanels": [
        ("'panels'", bin_sql("panel_count", PANELS), f"{_ON} AND {bin_sql('panel_count', PANELS)} <> 'Zero'"),
        ("'channel'", bin_sql("panel_channels", CHANNELS), f"{_ON} AND {bin_sql('panel_channels', CHANNELS)} <> 'Zero'"),
        ("'panelType'", "panel_type", _ON),
        ("'panelSubType'", "CASE panel_subtype WHEN 'LEDscapeMatrix' THEN 'BeagleBone' WHEN 'RGBMatrix' THEN 'RGBMatrix(Pi)' ELSE coalesce(panel_subtype, panel_type) END", _ON),
        ("'panelSize'", "CAST(panel_width AS VARCHAR) || 'x' || CAST(panel_height AS VARCHAR)", _ON),
    ],
    "outputOther": [("''", "other_1", "true"), ("''", "other_2", "other_1 IS NULL OR other_1 <> other_2")],
    "outputProcessors": [("''", "'Remap'", "remap_active > 0"), ("''", "'Brightness'", "brightness_active > 0")],
    "settingsPopular": [("''", "'MultiSyncEnabled'", "set_multisync IS NOT NULL"), ("''", "'uiLevel'", "set_ui_level IS NOT NULL"), ("''", "'volume'", "set_volume IS NOT NULL")],
    "settingsValues": [("'MultiSyncEnabled'", "set_multisync", "true"), ("'uiLevel'", "set_ui_level", "true"), ("'volume'", "set_volume", "true"), ("'FPP_UUID'", "uuid", "true")],
    "topPlugins": [("''", f"plugin_{i}", f"age <= {365 * DAY_MS}") for i in (1, 2, 3)],
}


def stat_rows(name: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS stat, {series} AS series, {key} AS key, docker, age FROM current WHERE {where}" for series, key, where in ROWS[name])


def summary_sql(names: list[str]) -> str:
    rows = " UNION ALL ".join(map(stat_rows, names))
    return f"""{CURRENT}
keyed AS ({rows}),
both_populations AS (SELECT 'all' AS population, * FROM keyed UNION ALL SELECT 'noDocker', * FROM keyed WHERE NOT docker),
summary AS (SELECT population, stat, series, key, {COUNTS} FROM both_populations WHERE key IS NOT NULL GROUP BY population, stat, series, key)
"""


def view_sql(stat: str, time: str = "last365Days", population: str = "all") -> str:
    return summary_sql([stat]) + f", v AS (SELECT key AS label, \"{time}\" AS n FROM summary WHERE population = '{population}' AND series = '')"


def _values(labels: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels)) + ") AS o(pos, label)"


#: Fixed values of the published documents, once more: fields by series, and the lists of labels in order.
_BINNED = {
    "lastReported": {"": ("data", "order")}, "deviceMemory": {"": ("memory", "memoryOrder")}, "multisyncPeers": {"": ("peers", "peerOrder")}, "outputLocalPixels": {"": ("pixels", "pixelOrder")},
    "deviceStorage": {"storage": ("storage", "storageOrder"), "usedStorage": ("usedStorage", "usedStorageOrder")},
    "outputUniverses": {"universe": ("universe", "universeOrder"), "channel": ("channel", "channelOrder")},
    "inputUniverses": {"universe": ("universe", "universeOrder"), "channel": ("channel", "channelOrder")},
    "outputPanels": {"panels": ("panels", "panelOrder"), "channel": ("channel", "channelOrder"), "panelType": ("panelType", None), "panelSubType": ("panelSubType", None), "panelSize": ("panelSize", None)},
}
_LABELS = {
    "order": ["< 24 hrs", "1-5 days", "5-14 days", "14-30 days", "30-90 days", "90-180 days", "180-365 days", "> 1 year"],
    "memoryOrder": ["Unknown", "512M", "1GB", "1.1-2GB", "2.1-4GB", "4.1-8GB", ">8GB"],
    "storageOrder": ["Unknown", "4GB", "4.1-8GB", "8.1-16GB", "16.1-32GB", "32.1-64GB", "64.1-128GB", "128.1-256GB", ">256GB"],
    "peerOrder": ["None", "1", "2-3", "4-5", "6-10", "11-20", "21-50", "51-100", "101+"],
    "pixelOrder": ["Zero", "1-499", "500-1k", "1k-5k", "5k-10k", "10k-20k", "20k+"],
    "universeOrder": ["Zero", "1-49", "50-99", "100-249", "249-500", "500+"],
    "channelOrder": ["Zero", "1-999", "1k-10k", "10k-100k", "100k-500k", "500k-1M", "1M+"],
    "panelOrder": ["Zero", "1-4", "5-8", "9-16", "17-32", "33-64", "65+"],
}
_LABELS["usedStorageOrder"] = _LABELS["storageOrder"]


def documents_sql(months: str, descriptions: dict[str, str], keys: int) -> str:
    def values(rows: list[tuple], names: str) -> str:
        return "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows) + f") AS {names}"

    fields = [(stat, series, field) for stat, named in _BINNED.items() for series, (field, _) in named.items()]
    spine = [*((stat, field) for stat, _, field in fields), *(("topPlugins", w) for w in WINDOWS), *((stat, None) for stat in ROWS if stat not in _BINNED and stat != "topPlugins")]
    orders = [(stat, ",".join(f'"{o}":{json.dumps(_LABELS[o], separators=(",", ":"))}' for _, o in _BINNED.get(stat, {}).values() if o)) for stat in ROWS]
    counts = " || ',' || ".join(f"'\"{w}\":' || \"{w}\"" for w in WINDOWS)
    plugins = " UNION ALL ".join(f"SELECT population, stat, series, key, '{w}' AS field, CAST(\"{w}\" AS VARCHAR) AS value FROM summary WHERE stat = 'topPlugins' AND \"{w}\" > 0" for w in WINDOWS)
    return summary_sql(list(ROWS)) + f""",
fields AS (SELECT * FROM {values(fields, "f(stat, series, field)")}),
spine AS (SELECT population, stat, field FROM {values(spine, "x(stat, field)")} CROSS JOIN (VALUES ('all'), ('noDocker')) AS p(population)),
lists AS (SELECT * FROM {values(orders, "o(stat, orders)")}),
descriptions AS (SELECT * FROM {values(list(descriptions.items()), "d(stat, description)")}),
valued AS (
  SELECT population, s.stat, s.series, key, coalesce(f.field, nullif(s.series, '')) AS field, '{{' || {counts} || '}}' AS value
  FROM summary s LEFT JOIN fields f ON f.stat = s.stat AND f.series = s.series WHERE s.stat <> 'topPlugins' UNION ALL {plugins}),
sized AS (SELECT population, stat, (count(*) + {keys - 1}) // {keys} AS parts FROM summary GROUP BY population, stat),
entries AS (
  SELECT population, stat, CAST(CAST('0x' || substr(md5(series || '/' || key), 1, 7) AS BIGINT) % parts AS INTEGER) AS part, field,
    CASE WHEN stat = 'Instances' THEN value ELSE CAST(to_json(key) AS VARCHAR) || ':' || value END AS entry FROM valued JOIN sized USING (population, stat)
  UNION ALL SELECT population, stat, CAST(unnest(range(coalesce(parts, 1))) AS INTEGER), field, NULL FROM spine LEFT JOIN sized USING (population, stat)),
inners AS (SELECT population, stat, part, field, coalesce(string_agg(entry, ',' ORDER BY entry), '') AS inn FROM entries GROUP BY population, stat, part, field),
bodies AS (
  SELECT population, stat, part, nullif(CASE WHEN field IS NULL THEN inn WHEN stat = 'platformVariantBreakout'
    THEN CAST(to_json(field) AS VARCHAR) || ':{{"data":{{' || inn || '}},"description":' || CAST(to_json('Platform Variant for ' || field) AS VARCHAR) || '}}'
    ELSE CAST(to_json(field) AS VARCHAR) || ':{{' || inn || '}}' END, '') AS body FROM inners),
wholes AS (SELECT population, stat, part, coalesce(string_agg(body, ',' ORDER BY body), '') AS body FROM bodies GROUP BY population, stat, part),
datas AS (
  SELECT population, stat, part, CASE WHEN stat = 'Instances' AND body <> '' THEN body ELSE '{{' || concat_ws(',', nullif(body, ''), nullif(orders, '')) || '}}' END AS data
  FROM wholes JOIN lists USING (stat)
  UNION ALL SELECT population, 'uniqueByMonth', 0, '{{"data":{{' || string_agg('"' || month || '":' || devices, ',' ORDER BY pos) || '}},"order":[' || string_agg('"' || month || '"', ',' ORDER BY pos) || ']}}'
  FROM ({months}) GROUP BY population)
SELECT population, stat, part, '{{"ts":{AS_OF},"description":' || CAST(to_json(description) AS VARCHAR) || ',"data":' || data || '}}' AS document FROM datas JOIN descriptions USING (stat)"""


#: Views once more: (view, statistic, series) by kind, with the list of labels or the most rows.
_BARS = [
    ("lastReportDays", "lastReported", "", "order"), ("memory", "deviceMemory", "", "memoryOrder"), ("storage", "deviceStorage", "storage", "storageOrder"),
    ("usedStorage", "deviceStorage", "usedStorage", "storageOrder"), ("peers", "multisyncPeers", "", "peerOrder"), ("outUniverse", "outputUniverses", "universe", "universeOrder"),
    ("outChannel", "outputUniverses", "channel", "channelOrder"), ("inUniverse", "inputUniverses", "universe", "universeOrder"), ("inChannel", "inputUniverses", "channel", "channelOrder"),
    ("localPixels", "outputLocalPixels", "", "pixelOrder"), ("panelChannel", "outputPanels", "channel", "channelOrder"), ("panelCounts", "outputPanels", "panels", "panelOrder"),
]
_NO_ZERO = ("localPixels", "panelChannel", "panelCounts")
_RANKED = [
    ("timezones", "zones", "timeZone", "", None), ("platforms", "table", "platform", "", 49), ("genericVariants", "table", "platformVariantBreakout", "Generic", 49),
    ("piVariants", "table", "platformVariantBreakout", "Raspberry Pi", 49), ("beagleVariants", "table", "platformVariantBreakout", "BeagleBone", 49), ("otherOutputs", "table", "outputOther", "", 49),
    ("versionDetail", "table", "versionDetailed", "", 49), ("allPlugins", "table", "topPlugins", "", 1999), ("allCapes", "table", "capeType", "", 1999), ("modes", "pie", "fppMode", "", None),
    ("versions", "pie", "version", "", None), ("mqtt", "pie", "mqttEnabled", "", None), ("uiLevels", "pie", "uiLevel", "", None), ("capes", "pie", "capeInstalled", "", None),
    ("panelSubType", "pie", "outputPanels", "panelSubType", None), ("panelSize", "pie", "outputPanels", "panelSize", None), ("releases", "topk", "versionWithOS", "", 15),
    ("topCapes", "topk", "capeType", "", 15), ("plugins", "topk", "topPlugins", "", 10), ("processors", "topk", "outputProcessors", "", 10), ("popularSettings", "topk", "settingsPopular", "", 12),
]


def dashboard_sql(months: str) -> str:
    asked = ", ".join(f"('{v}', '{kind}', '{stat}', '{series}', {most or 'NULL'})" for v, kind, stat, series, most in _RANKED)
    kept = [(v, stat, series, [x for x in _LABELS[o] if not (x == "Zero" and v in _NO_ZERO)]) for v, stat, series, o in _BARS]
    bars = ", ".join(f"('{v}', '{stat}', '{series}', {i}, '{x}')" for v, stat, series, labels in kept for i, x in enumerate(labels))
    return summary_sql(list(ROWS)) + f""",
own AS (SELECT stat, series, key, last365Days AS n FROM summary WHERE population = 'all' AND (stat <> 'topPlugins' OR last365Days > 0)),
asked AS (SELECT * FROM (VALUES {asked}) AS a(view, kind, stat, series, most)),
rows AS (
  SELECT view, kind, most, CASE WHEN kind = 'table' AND key = '' THEN 'Unknown' ELSE key END AS label, n, CAST(sum(n) OVER (PARTITION BY view) AS BIGINT) AS t,
    CASE WHEN kind <> 'zones' THEN -n WHEN key = 'Not Reported' THEN 99999999 WHEN starts_with(key, '+') THEN CAST(substr(key, 2, 4) AS INTEGER) ELSE -CAST(substr(key, 2, 4) AS INTEGER) END AS place
  FROM own JOIN asked USING (stat, series)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY view ORDER BY place, label) - 1 AS INTEGER) AS pos FROM rows)
SELECT view, kind, pos, label, n, CASE WHEN kind = 'table' AND t > 0 THEN ((2000 * n + t) // (2 * t)) / 10.0::DOUBLE END AS pct FROM ranked WHERE most IS NULL OR pos < most
UNION ALL SELECT view, 'dense', pos, label, coalesce(n, 0), NULL FROM (VALUES {bars}) AS b(view, stat, series, pos, label) LEFT JOIN own ON own.stat = b.stat AND own.series = b.series AND own.key = b.label
UNION ALL SELECT 'months', 'monthly', pos, month, devices, NULL FROM ({months}) WHERE population = 'all'"""


def build(stat_keys: dict[str, str], descriptions: dict[str, str], keys: int) -> dict[str, str]:
    out = {key: summary_sql([name]) + "SELECT * FROM summary" for key, name in stat_keys.items()}
    out["summary_all"] = summary_sql(list(ROWS)) + "SELECT * FROM summary"
    out["summary_population"] = summary_sql(list(ROWS)) + "SELECT * FROM summary WHERE population = 'noDocker'"
    out["summary_incremental"] = out["summary_all"]
    out["top_settings"] = summary_sql(["settingsValues"]) + """
SELECT series, CAST(rank AS INTEGER) AS rank, key, n FROM (
  SELECT series, key, "totalCount" AS n, row_number() OVER (PARTITION BY series ORDER BY "totalCount" DESC, key) AS rank FROM summary WHERE population = 'all') WHERE rank <= 10"""
    out["latest_report"] = CURRENT.rstrip().rstrip(",") + " SELECT uuid, ts, report_id, platform, version FROM current"
    out["current_kept"] = out["latest_report"]
    out["latest_event"] = f"SELECT user_id, event_id, {EVENT_MS} AS ts_ms, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"
    out["not_docker_filter"] = CURRENT.rstrip().rstrip(",") + " SELECT uuid, platform, variant FROM current WHERE NOT docker"
    out["upload_status"] = """
SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'Not JSON' WHEN 1 THEN 'Invalid Record' WHEN 2 THEN 'Invalid Record' WHEN 3 THEN 'Invalid UUID Format'
    WHEN 5 THEN 'Payload too large' WHEN 6 THEN 'Not JSON Object' ELSE 'OK' END AS status,
  CASE WHEN event_id % 9 = 5 THEN 'big-' || user_id WHEN event_id % 9 IN (7, 8) THEN 'dev-' || user_id ELSE '' END AS uuid FROM events"""
    out["stream_ingest"] = f"SELECT status, CASE WHEN status = 'OK' THEN uuid ELSE '' END AS uuid, count(*) AS n FROM ({out['upload_status']}) GROUP BY ALL"
    out["count_by_age"] = f"SELECT event_type, {COUNTS} FROM (SELECT event_type, {EVENTS_AS_OF} - {EVENT_MS} AS age FROM events) GROUP BY event_type"
    out["bin_case"] = f"SELECT quantity, price, count(*) AS n FROM (SELECT {bin_sql('l_quantity', PEERS)} AS quantity, {bin_sql('l_extendedprice', CHANNELS)} AS price FROM lineitem) GROUP BY quantity, price"
    out["bin_range_join"] = f"SELECT label, count(*) AS n FROM (SELECT {bin_sql('o_totalprice', CHANNELS)} AS label FROM orders) GROUP BY label"
    out["bin_join_many"] = """
WITH ranges AS (SELECT p_partkey AS pos, p_brand || '-' || p_size AS label, p_partkey * 37 % 100000 + p_retailprice AS least, p_partkey * 37 % 100000 + p_retailprice + p_size * 20 AS most FROM part),
prices AS (SELECT l_extendedprice AS x, count(*) AS k FROM lineitem GROUP BY x),
found AS (SELECT x, k, arg_max(label, pos) AS label FROM prices LEFT JOIN ranges ON x >= least AND x <= most GROUP BY x, k)
SELECT coalesce(label, 'none') AS label, CAST(sum(k) AS BIGINT) AS n FROM found GROUP BY 1"""
    out["unique_by_month"] = f"""{CURRENT}
months AS (SELECT CAST(i AS INTEGER) AS pos, CAST(DATE '2001-08-01' - to_months(CAST(i AS INTEGER)) AS DATE) AS first FROM (SELECT unnest(range(0, 15)) AS i)),
populations AS (SELECT * FROM (VALUES ('all'), ('noDocker')) AS p(population)),
seen AS (SELECT DISTINCT r.uuid, c.docker, date_trunc('month', make_timestamp(r.ts * 1000)) AS first
  FROM reports r JOIN current c ON c.uuid = r.uuid WHERE r.ts > epoch_ms(TIMESTAMP '2000-05-01 00:00:00')),
counted AS (SELECT population, first, count(*) AS n FROM seen, populations WHERE population = 'all' OR NOT docker GROUP BY population, first)
SELECT p.population, pos, strftime(m.first, '%b-%Y') AS month, coalesce(n, 0) AS devices
FROM months m CROSS JOIN populations p LEFT JOIN counted c ON c.population = p.population AND c.first = m.first"""
    out |= {k: out["unique_by_month"] for k in ("unique_by_month_stream", "unique_by_month_laid_out", "approx_unique_by_month")}
    out["history_summary"] = f"SELECT population, 'uniqueByMonth' AS stat, pos, month AS label, devices AS n FROM ({out['unique_by_month']})"
    out["summary_json"] = documents_sql(out["unique_by_month"], descriptions, keys)
    out["dashboard"] = dashboard_sql(out["unique_by_month"])
    out["interarrival"] = f"""
WITH g AS (SELECT event_id, user_id, ({EVENT_MS} - (SELECT max(epoch_us(p.ts) // 1000) FROM events p WHERE p.user_id = events.user_id AND epoch_us(p.ts) // 1000 < {EVENT_MS.replace("(ts)", "(events.ts)")})) / 1000.0::DOUBLE AS s FROM events)
SELECT event_id, user_id, s AS gap_seconds, CASE WHEN s IS NULL THEN 'First Record'
  WHEN s <= 120 THEN CAST(CAST(floor(s + 0.5) AS BIGINT) AS VARCHAR) || ' Seconds Ago'
  WHEN s / 60 <= 48 THEN CAST(CAST(floor(s / 60 + 0.5) AS BIGINT) AS VARCHAR) || ' Minutes Ago'
  WHEN s / 60 <= 120 THEN CAST(CAST(floor(s / 60 / 24 + 0.5) AS BIGINT) AS VARCHAR) || ' Days Ago'
  WHEN s / 3600 <= 48 THEN CAST(CAST(floor(s / 3600 + 0.5) AS BIGINT) AS VARCHAR) || ' Hours Ago'
  ELSE CAST(CAST(floor(s / 3600 / 24 + 0.5) AS BIGINT) AS VARCHAR) || ' Days Ago' END AS label_ref FROM g"""
    out["freshness"] = f"""
SELECT last_ms, age_s, CASE WHEN age_s > 500 THEN 'WARNING' ELSE 'OK' END AS status
FROM (SELECT last_ms, CAST(floor(({EVENTS_AS_OF} - last_ms) / 1000) AS BIGINT) AS age_s FROM (SELECT max({EVENT_MS}) AS last_ms FROM events))"""
    out["topk_view"] = view_sql("versionWithOS") + " SELECT label, n FROM v ORDER BY n DESC, label LIMIT 15"
    out["topk_plugins"] = view_sql("topPlugins", "last180Days") + " SELECT label, n FROM v WHERE n > 0 ORDER BY n DESC, label LIMIT 10"
    out["pie_view"] = view_sql("fppMode") + " SELECT label, n FROM v"
    labels = [x for x in _LABELS["pixelOrder"] if x != "Zero"]
    out["dense_bar"] = view_sql("outputLocalPixels", population="noDocker") + f" SELECT o.pos, o.label, coalesce(n, 0) AS n FROM {_values(labels)} LEFT JOIN v ON v.label = o.label"
    out["table_pct"] = view_sql("platformVariant", "totalCount") + """
SELECT CASE WHEN label = '' THEN 'Unknown' ELSE label END AS label, n, ((2000 * n + t) // (2 * t)) / 10.0::DOUBLE AS pct
FROM (SELECT label, n, CAST(sum(n) OVER () AS BIGINT) AS t FROM v) ORDER BY n DESC, 1 LIMIT 5"""
    out["timezone_order"] = view_sql("timeZone", "totalCount") + r"""
SELECT label, n, CASE WHEN label = 'Not Reported' THEN 99999999 WHEN starts_with(label, '+') THEN CAST(substr(label, 2, 4) AS INTEGER) ELSE -CAST(substr(label, 2, 4) AS INTEGER) END AS place FROM v"""
    pairs = " UNION ALL ".join(f"SELECT '{w}' AS period, \"{w}\" AS n FROM summary WHERE population = 'all'" for w in WINDOWS)
    out["period_options"] = summary_sql(["Instances"]) + f" SELECT period, n, period || ' - ' || CAST(n AS VARCHAR) || '  devices' AS text FROM ({pairs})"
    out["format_date"] = "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS shown FROM events"
    heads = "(SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY o_custkey)"
    out["branch_details"] = f"""
SELECT md5(CAST(k AS VARCHAR)) AS sha, 'branch-' || o_custkey AS name, o_custkey % 2 = 0 AS protected, CASE WHEN o_orderkey IS NOT NULL THEN 'commits/' || md5(CAST(k AS VARCHAR)) END AS url,
  o_orderpriority AS message, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS date, epoch_us(o_orderdate) // 1000000 AS date_epoch
FROM {heads} b LEFT JOIN (SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderkey % 5 <> 0) c ON c.o_orderkey = b.k"""
    out["branch_details_pages"] = out["branch_details"]
    out["missing_commits"] = f"SELECT md5(CAST(k AS VARCHAR)) AS sha FROM {heads} WHERE k % 5 = 0"
    out["release_summary"] = "SELECT p_partkey AS id, p_name AS name, p_brand AS tag_name, p_size % 2 = 0 AS draft, CAST(p_size % 7 + 1 AS INTEGER) AS asset_cnt FROM part"
    return out
