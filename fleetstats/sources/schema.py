"""The report's schema. Scalar leaves are strings, so that 1, "1" and true all survive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field names of a report.
REPORT_DDL = """
uuid STRING, ts BIGINT,
systemInfo STRUCT<platform:STRING, platformVariant:STRING, version:STRING, osVersion:STRING, fppdMode:STRING, fppdStatus:STRING,
  mqtt:STRUCT<configured:VARIANT>, utilization:STRUCT<Disk:STRUCT<Media:STRUCT<Total:STRING, Free:STRING>>>>,
memory STRUCT<MemTotal:STRING>,
multisync ARRAY<STRING>,
settings MAP<STRING,STRING>,
capeInfo STRUCT<name:STRING>,
timezone STRING,
plugins MAP<STRING,STRING>,
outputProcessors MAP<STRING,STRUCT<activeCnt:STRING>>,
output_other STRUCT<types:ARRAY<STRING>>,
output_pixel_pi STRUCT<pixelCount:STRING>, output_pixel_bbb STRUCT<pixelCount:STRING>,
output_e131 STRUCT<universeCount:STRING, channelCount:STRING>,
universe_input STRUCT<enabled:STRING, universeCount:STRING, channelCount:STRING>,
output_panel STRUCT<enabled:STRING, panelCount:STRING, channelCount:STRING, panelWidth:STRING, panelHeight:STRING, type:STRING, subType:STRING>
"""


def parse_report(payload: Column) -> Column:
    """The report in a JSON text; fields of an unexpected shape are null."""
    return F.from_json(payload, REPORT_DDL)
