"""Configurations and bundles: read with defaults and limits, written without secrets."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraline.functions.payoff import DEFAULTS

#: Settings and results that may be read or written (a key for a service is none of them), members that a
#: bundle must have, and its limit.
SETTINGS = (
    "map_style_name", "travel_mode", "time_intervals", "show_dol", "show_cityplan", "cityplan_opacity", "show_population", "show_traffic", "colors", "show_betweenness",
    "show_closeness", "show_railway", "show_golden_spots", "rent_samples", "rent_unit_label", "show_rent_rings", "show_rent_nodes",
)
RESULTS = ("isochrone_data", "intersection_data", "network_data", "rent_gradient_data")
MEMBERS = ("manifest.json", "config/config.json", "cache/cache.zip", "checksums.sha256")
#: Versions of payoff configurations that are known, the newest first, limits of their numbers, and the
#: series that can be shown.
PAYOFF_VERSIONS = ("1.2.0", "1.1.1", "1.1.0")
LIMITS = {
    "x0_1": (0.1, 50.0), "constant1": (100.0, 10000.0), "b1": (-5000.0, 5000.0), "b1_add_option": (-5000.0, 5000.0), "x0_2": (0.1, 50.0), "constant2": (100.0, 10000.0),
    "b2": (-5000.0, 5000.0), "b2_add_option": (-5000.0, 5000.0), "anchorY6": (0.1, 50.0), "refConst": (100.0, 10000.0), "callContracts": (0, 10000), "premiumCall": (0.0, 1000.0),
    "putContracts": (0, 10000), "premiumPut": (0.0, 1000.0), "longEntryPrice": (0.0, 50.0), "longShares": (0, 10000000), "shortEntryPrice": (0.0, 50.0), "shortShares": (0, 10000000),
    "delta1": (0.01, 2.0), "delta2": (0.01, 2.0),
}
TOGGLES = tuple(f"showY{k}" for k in range(1, 12))
BUNDLE_VERSION, MAX_CACHE_BYTES = "1.0", 150 * 1024 * 1024


def number(text: Column, path: str, default: float, lo: float | None = None, hi: float | None = None, whole: bool = False) -> Column:
    """A JSON number with a default where it is missing or no number, rounded half to even if whole, kept in limits."""
    v = F.coalesce(F.get_json_object(text, path).try_cast("double"), F.lit(float(default)))
    v = F.bround(v) if whole else v
    v = v if lo is None else F.greatest(F.lit(float(lo)), v)
    return v if hi is None else F.least(F.lit(float(hi)), v)


def payoff_scenarios(configs: DataFrame, text: str = "value") -> DataFrame:
    """A parameter row for each payoff configuration, in the limits; unknown versions are read all the same and marked."""
    t = F.col(text)
    cols = {}
    for k, v in DEFAULTS.items():
        if isinstance(v, bool):
            cols[k] = F.coalesce(F.get_json_object(t, f"$.params.{k}").try_cast("boolean"), F.lit(v))
        elif k == "biasMode":
            said = F.get_json_object(t, "$.params.biasMode")
            cols[k] = F.when(said.isin("real", "add_option"), said).otherwise(v)
        elif k in ("lo", "hi"):
            cols[k] = number(t, f"$.params.x1Range[{0 if k == 'lo' else 1}]", v)
        else:
            cols[k] = number(t, f"$.params.{k}", v, *LIMITS.get(k, (None, None)), whole=isinstance(v, int))
    version = F.get_json_object(t, "$.version")
    return configs.withColumns(cols | {"version": version, "known_version": F.coalesce(version.isin(*PAYOFF_VERSIONS), F.lit(False))})


def payoff_toggles(configs: DataFrame, text: str = "value", default: tuple[str, ...] = ("showY1", "showY6", "showY7", "showY8", "showY9")) -> DataFrame:
    """Adds the columns showY1 to showY11; those in ``default`` are on where a configuration says nothing."""
    return configs.withColumns({k: F.coalesce(F.get_json_object(text, f"$.toggles.{k}").try_cast("boolean"), F.lit(k in default)) for k in TOGGLES})


def payoff_config(scenarios: DataFrame, exported_at: str) -> DataFrame:
    """Adds ``value``, the configuration's JSON of a row with the parameters and toggles; the caller gives the time."""
    params = F.struct(*[k for k in DEFAULTS if k not in ("lo", "hi")], F.array("lo", "hi").alias("x1Range"))
    return scenarios.withColumn("value", F.to_json(F.struct(F.lit(PAYOFF_VERSIONS[0]).alias("version"), F.lit(exported_at).alias("exported_at"), params.alias("params"), F.struct(*TOGGLES).alias("toggles"))))


def json_status(text: Column) -> Column:
    """"empty", "invalid" or "ok" """
    return F.when(text.isNull() | (F.trim(text) == ""), "empty").when(F.try_parse_json(text).isNull(), "invalid").otherwise("ok")


def app_config(spark, markers: DataFrame, settings: dict, results: dict | None = None) -> DataFrame:
    """One row ``value``: the configuration's JSON. Settings and results of the lists only, so no key leaves; values keep
    their kinds."""
    kept = {k: v for k, v in settings.items() if k in SETTINGS}
    done = {k: (results or {}).get(k) for k in RESULTS}
    rows = markers.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("idx", "lat", "lng", "active"))), lambda m: F.struct(m["lat"].alias("lat"), m["lng"].alias("lng"), m["active"].alias("active")))).alias("m"))
    dumped = lambda x: F.lit(json.dumps(x, ensure_ascii=False, separators=(",", ":")))
    return rows.select(F.concat(F.lit('{"format_version":2,"markers":'), "m", F.lit(',"settings":'), dumped(kept), F.lit(',"precomputed_results":'), dumped(done), F.lit("}")).alias("value"))


def app_config_from(markers: DataFrame, settings: DataFrame, results: DataFrame) -> DataFrame:
    """The same row from tables: settings and results (key, value: JSON text), as layers keep them. Keys outside of the lists
    don't leave; a result that isn't there is null; of a key that comes twice the larger text counts."""

    def members(table: DataFrame, keys: tuple[str, ...], all_of_them: bool) -> DataFrame:
        row = table.agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])
        member = lambda k: F.concat(F.lit(f"{json.dumps(k)}:"), F.coalesce(k, F.lit("null")))
        return row.select(F.array_join(F.array_compact(F.array(*[member(k) if all_of_them else F.when(F.col(k).isNotNull(), member(k)) for k in keys])), ",").alias("members"))

    row = markers.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("idx", "lat", "lng", "active"))), lambda m: F.struct(m["lat"].alias("lat"), m["lng"].alias("lng"), m["active"].alias("active")))).alias("m"))
    kept, done = members(settings, SETTINGS, False).withColumnRenamed("members", "s"), members(results, RESULTS, True).withColumnRenamed("members", "r")
    whole = row.join(F.broadcast(kept)).join(F.broadcast(done))
    return whole.select(F.concat(F.lit('{"format_version":2,"markers":'), "m", F.lit(',"settings":{'), "s", F.lit('},"precomputed_results":{'), "r", F.lit("}}")).alias("value"))


def read_app_config(configs: DataFrame, text: str = "value") -> DataFrame:
    """Adds status, markers (array<struct<lat, lng, active>>; null if none are given), settings and results, maps of the
    lists' keys to JSON texts: results of the old flat form stand before those in ``precomputed_results``."""
    raw = F.map_from_entries(F.filter(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: e["value"].isNotNull()))
    inner = lambda k: F.coalesce(F.from_json(F.get_json_object(text, f"$.{k}"), "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    keep = lambda m, names: F.map_filter(m, lambda k, v: k.isin(*names) & v.isNotNull())
    flat = keep(F.coalesce(raw, F.from_json(F.lit("{}"), "map<string,string>")), RESULTS)
    nested = keep(inner("precomputed_results"), RESULTS)
    results = F.map_concat(F.map_filter(nested, lambda k, v: ~F.map_contains_key(flat, k)), flat)
    return configs.withColumns({"status": json_status(F.col(text)), "markers": F.from_json(F.get_json_object(text, "$.markers"), "array<struct<lat:double,lng:double,active:boolean>>"), "settings": keep(inner("settings"), SETTINGS), "results": results})


def bundle(config: str, cache: bytes, created: str) -> bytes:
    """A zip of configuration and cache with its checksums; the caller gives the time."""
    sums = {"config/config.json": hashlib.sha256(config.encode()).hexdigest(), "cache/cache.zip": hashlib.sha256(cache).hexdigest()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", json.dumps({"bundle_version": BUNDLE_VERSION, "config_schema_version": 2, "created_at_utc": created, "cache_present": bool(cache), "integrity_checksums": sums}))
        z.writestr("config/config.json", config)
        z.writestr("cache/cache.zip", cache)
        z.writestr("checksums.sha256", "".join(f"{h}  {n}\n" for n, h in sums.items()))
    return out.getvalue()


def bundle_status(data: bytes) -> tuple[str, list[str]]:
    """("ok", "config only" or "refused", reasons) of a bundle."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if lost := sorted(set(MEMBERS) - set(z.namelist())):
                return "refused", [f"missing {m}" for m in lost]
            large = z.getinfo("cache/cache.zip").file_size > MAX_CACHE_BYTES  # looked at before it is unpacked
            manifest, cache = json.loads(z.read("manifest.json")), b"" if large else z.read("cache/cache.zip")
            config = z.read("config/config.json")
    except (zipfile.BadZipFile, ValueError) as e:
        return "refused", [str(e)]
    if manifest.get("bundle_version") != BUNDLE_VERSION or manifest.get("config_schema_version") != 2:
        return "refused", ["another version"]
    sums, reasons = manifest.get("integrity_checksums", {}), []
    if sums.get("config/config.json") != hashlib.sha256(config).hexdigest():
        return "refused", ["the configuration doesn't match its checksum"]
    if large:
        reasons = ["the cache is too large"]
    if sums.get("cache/cache.zip") != hashlib.sha256(cache).hexdigest():
        reasons.append("the cache doesn't match its checksum")
    return ("config only" if reasons else "ok"), reasons
