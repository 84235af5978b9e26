"""The statistics of latest reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import bins
from ..functions.bins import Bins
from ..functions.compat import js_num, key_text, loose_eq, truthy
from ..functions.versions import drop_dirty, major, trim_master
from .registry import Stat, register

col = F.col


def number(path: str) -> Column:
    return js_num(col(path))


def _flat(name: str, description: str, key, drop: tuple[str, ...] = (), **more) -> None:
    register(Stat(name, description, fixed=lambda: [("", key())], drop={"": drop} if drop else {}, **more))


def _or(path: str, default: str) -> Column:
    return F.coalesce(col(path), F.lit(default))


def renamed(c: Column, names: dict[str, str]) -> Column:
    for old, new in names.items():
        c = F.when(c == old, new).otherwise(c)
    return c


# Names, labels and defaults of the statistics.
_flat("Instances", "The number of devices reporting", lambda: F.lit(""))
_flat("platform", "Platform of each device", lambda: F.when(col("systemInfo.platform") == "BeagleBone Black", "BeagleBone32").otherwise(col("systemInfo.platform")))
_flat("platformVariant", "Hardware variant", lambda: _or("systemInfo.platformVariant", "Not Defined"))


def _breakout_series() -> Column:
    p = col("systemInfo.platform")
    return F.when(p.isin("BeagleBone 64", "BeagleBone Black", "BeagleBone"), "BeagleBone").when(p.isin("Raspberry Pi", "Docker"), p).otherwise("Generic")


register(Stat("platformVariantBreakout", "Hardware variants of each platform", fixed=lambda: [(_breakout_series(), F.when(col("systemInfo.platform").isNotNull(), _or("systemInfo.platformVariant", "Unknown")))]))
_flat("version", "Major releases", lambda: major(trim_master(col("systemInfo.version"))), weight=3)
_flat("versionDetailed", "Detailed releases", lambda: drop_dirty(col("systemInfo.version")))
_flat("versionWithOS", "Releases with their OS", lambda: F.concat(trim_master(col("systemInfo.version")), F.lit("/"), _or("systemInfo.osVersion", "Unknown")), weight=3)
_flat("capeInstalled", "Whether a cape is installed", lambda: F.when(col("capeInfo.name") != "None", "Yes").otherwise("No"))
_flat("capeType", "Cape types", lambda: _or("capeInfo.name", "None"), drop=("None", "Unknown"))
_flat("capeReleaseVersion", "Capes with their release", lambda: F.coalesce(F.concat("capeInfo.name", F.lit("-"), F.coalesce(trim_master(col("systemInfo.version")), F.lit("unknown"))), F.lit("None")), drop=("None", "Unknown"), weight=3)


def _mode() -> Column:
    mode = renamed(_or("systemInfo.fppdMode", "fppd Stopped"), {"bridge": "player", "master": "player"})
    multi = F.when(loose_eq(F.try_element_at("settings", F.lit("MultiSyncEnabled")), 1), "-MultiSync Enabled").otherwise("-MultiSync Disabled")
    return F.when(mode == "fppd Stopped", mode).otherwise(F.concat(mode, multi))


def _mqtt() -> Column:
    configured = truthy(col("systemInfo.mqtt.configured"))
    stopped = col("systemInfo").isNull() | (configured.isNull() & (F.coalesce(col("systemInfo.fppdStatus"), F.lit("")) == "Not Running"))
    return F.when(stopped, "fppd Stopped").when(configured, "Yes").otherwise("No")


LEVELS = ("Basic", "Advanced", "Experimental", "Developer")


def _ui_level() -> Column:
    raw = F.try_element_at("settings", F.lit("uiLevel"))
    n = F.coalesce(js_num(raw), F.when(raw.isNull(), 0.0))
    named = F.get(F.array(*map(F.lit, LEVELS)), n.cast("int"))
    # In range but not written as one of the numbers ('1.0', 'true', ''): an index that the list of names doesn't have.
    index = F.coalesce(raw, F.lit("0")).isin(*map(str, range(len(LEVELS))))
    return F.when((n >= 0) & (n < len(LEVELS)), F.when(index, named).otherwise("undefined")).otherwise("Undefined")


_flat("fppMode", "Player modes", _mode, weight=3)
_flat("mqttEnabled", "Whether MQTT is configured", _mqtt, weight=3)
_flat("uiLevel", "User interface levels", _ui_level, weight=3)
_flat("timeZone", "Time zones", lambda: renamed(_or("timezone", "Not Reported"), {"+0000 GMT": "+0000 UTC"}))


def _binned(name: str, description: str, drop: dict[str, tuple[str, ...]] | None = None, of_age: bool = False, **series: tuple[Bins, object]) -> None:
    register(
        Stat(
            name, description, fixed=lambda: [("" if s == "_" else s, value(), table) for s, (table, value) in series.items()],
            orders={"" if s == "_" else s: table.labels for s, (table, _) in series.items()}, weight=2, drop=drop or {}, of_age=of_age,
        )
    )


#: Age in days needs ``age_ms``, which the engine adds.
_binned("lastReported", "Time since the last report", of_age=True, _=(bins.AGE_DAYS, lambda: F.coalesce(col("age_ms"), F.lit(0)) / 86_400_000))
_binned("deviceMemory", "Memory of the devices", _=(bins.MEMORY, lambda: number("memory.MemTotal")))
_MEDIA = "systemInfo.utilization.Disk.Media."
_binned(
    "deviceStorage", "Media storage of the devices",
    storage=(bins.STORAGE, lambda: number(_MEDIA + "Total") / 1048576), usedStorage=(bins.STORAGE, lambda: (number(_MEDIA + "Total") - number(_MEDIA + "Free")) / 1048576),
)
_binned("multisyncPeers", "Multisync peers", _=(bins.PEERS, lambda: F.when(col("multisync").isNull(), 0).otherwise(F.size("multisync") - 1)))
_binned("outputLocalPixels", "Local pixels", _=(bins.PIXELS, lambda: F.coalesce(number("output_pixel_pi.pixelCount"), F.lit(0)) + F.coalesce(number("output_pixel_bbb.pixelCount"), F.lit(0))))
_binned("outputUniverses", "Output universes", universe=(bins.UNIVERSES, lambda: number("output_e131.universeCount")), channel=(bins.CHANNELS, lambda: number("output_e131.channelCount")))


def _if_enabled(path: str) -> Column:
    return F.when(loose_eq(col("universe_input.enabled"), 1), number(path))


_binned("inputUniverses", "Input universes", universe=(bins.UNIVERSES, lambda: _if_enabled("universe_input.universeCount")), channel=(bins.CHANNELS, lambda: _if_enabled("universe_input.channelCount")))


def _panels() -> list[tuple]:
    on = ~loose_eq(col("output_panel.enabled"), 0)
    kind = col("output_panel.type")
    sub = renamed(col("output_panel.subType"), {"LEDscapeMatrix": "BeagleBone", "RGBMatrix": "RGBMatrix(Pi)"})
    size = F.concat(key_text(col("output_panel.panelWidth")), F.lit("x"), key_text(col("output_panel.panelHeight")))
    # Of a disabled panel the counts are null, so their bin is one that is dropped.
    counts = [("panels", F.when(on, number("output_panel.panelCount")), bins.PANELS), ("channel", F.when(on, number("output_panel.channelCount")), bins.CHANNELS)]
    return [*counts, *((s, F.when(on, k)) for s, k in (("panelType", kind), ("panelSubType", F.coalesce(sub, kind)), ("panelSize", size)))]


register(Stat(
    "outputPanels", "Panels", fixed=_panels, weight=2, drop={"panels": ("Zero",), "channel": ("Zero",), "panelType": ("None",), "panelSubType": ("None",), "panelSize": ("None",)},
    orders={"panels": bins.PANELS.labels, "channel": bins.CHANNELS.labels},
))
register(Stat("outputOther", "Other outputs", each=lambda: F.array_distinct("output_other.types")))
register(Stat("outputProcessors", "Active output processors", each=lambda: F.map_keys(F.map_filter("outputProcessors", lambda _, v: js_num(v["activeCnt"]) > 0))))
register(Stat("settingsPopular", "Settings in use", each=lambda: F.map_keys("settings"), drop={"": ("FPP_UUID",)}))
register(Stat("settingsValues", "Values of each setting", each=lambda: F.transform(F.map_entries("settings"), lambda e: F.struct(e["key"].alias("series"), key_text(e["value"]).alias("key")))))
register(Stat("topPlugins", "Plugins in use", each=lambda: F.map_keys("plugins"), max_age_days=365))
