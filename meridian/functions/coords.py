"""Positions in addresses and texts: degrees, minutes and seconds, map links, labelled pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts of map links, and the patterns of the positions in them.
MAP_HOSTS = r"(?i)google\.|goo\.gl/maps|maps\.google"
GRID_HOSTS = r"(?i)streetmap\.co\.uk"
_NUMBER = r"(-?\d+(?:\.\d+)?)"
_DMS = r"(\d{1,3})[^0-9A-Z]+(\d{1,2})[^0-9A-Z]+([0-9.]+)[^A-Z0-9]*([NSEW])"


def unplussed(u: Column) -> Column:
    """An address with its escapes and plus signs resolved; where it can't be, as it is."""
    return F.coalesce(F.try_url_decode(u), u)


def _double(x: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(x, pattern, group).try_cast("double")


def dms_pair(x: Column) -> Column:
    """(lat, lon) of the first two angles in degrees, minutes and seconds, if one is north or south and the other east or west; else null."""
    found = F.regexp_extract_all(F.upper(x), F.lit(_DMS), F.lit(0))

    def angle(i: int) -> tuple[Column, Column]:
        one = F.get(found, F.lit(i))
        value = _double(one, _DMS, 1) + _double(one, _DMS, 2) / 60 + _double(one, _DMS, 3) / 3600
        way = F.regexp_extract(one, _DMS, 4)
        return F.when(way.isin("S", "W"), -value).otherwise(value), way

    (a, wa), (b, wb) = angle(0), angle(1)
    # The later of two angles of one kind counts.
    lat = F.coalesce(F.when(wb == "N", b), F.when(wa == "N", a), F.when(wb == "S", b), F.when(wa == "S", a))
    lon = F.coalesce(F.when(wb == "E", b), F.when(wa == "E", a), F.when(wb == "W", b), F.when(wa == "W", a))
    return F.when((F.size(found) >= 2) & lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def _parameter(u: Column, name: str) -> Column:
    """The first value of a query parameter, resolved; the empty string where there is none."""
    return unplussed(F.regexp_extract(F.regexp_extract(u, r"\?([^#]*)", 1), rf"(?:^|&){name}=([^&]*)", 1))


def map_link(u: Column) -> Column:
    """(lat, lon, method, uncertainty_m) of a link to a map, null where it is none or tells no position.

    In order: an angle pair, a place's own position, the query's position, the centre of a view in
    metres, the centre of a view at a zoom.
    """
    plain = unplussed(u)
    pair, dms = rf"{_NUMBER}\s*,\s*{_NUMBER}", dms_pair(plain)
    target, view = rf"!3d{_NUMBER}!4d{_NUMBER}", rf"@{_NUMBER},{_NUMBER},([0-9.]+)([mz])"
    size = _double(plain, view, 3)
    metres = F.greatest(F.lit(25), F.least(F.lit(500), F.floor(size / 4).cast("int")))
    zoom = F.when(size >= 17, 100).when(size >= 14, 1000).otherwise(5000)

    def out(when: Column, lat: Column, lon: Column, method: str | Column, uncertainty: Column) -> Column:
        name = F.lit(method) if isinstance(method, str) else method
        return F.when(when, F.struct(lat.alias("lat"), lon.alias("lon"), name.alias("method"), uncertainty.cast("int").alias("uncertainty_m")))

    asked = [out(_parameter(u, k).rlike(pair), _double(_parameter(u, k), pair, 1), _double(_parameter(u, k), pair, 2), "google_maps_query_coordinate", F.lit(25)) for k in ("q", "ll")]
    in_metres = F.regexp_extract(plain, view, 4) == "m"
    found = F.coalesce(
        out(dms.isNotNull(), dms["lat"], dms["lon"], "google_maps_dms_target", F.lit(25)), out(plain.rlike(target), _double(plain, target, 1), _double(plain, target, 2), "google_maps_place_target", F.lit(25)), *asked,
        out(plain.rlike(view) & size.isNotNull(), _double(plain, view, 1), _double(plain, view, 2), F.when(in_metres, "google_maps_satellite_view_center").otherwise("google_maps_view_center_review_needed"), F.when(in_metres, metres).otherwise(zoom)),
    )
    return F.when(plain.rlike(MAP_HOSTS), found)


def grid_link(u: Column) -> Column:
    """(easting, northing, reference) of a link to a British map: its pointer in metres, or else its grid reference."""
    x, y, ref = _parameter(u, "x").try_cast("double"), _parameter(u, "y").try_cast("double"), F.upper(_parameter(u, "sv"))
    pointer = (x != 0) & (y != 0)
    return F.when(unplussed(u).rlike(GRID_HOSTS), F.coalesce(F.when(pointer, F.struct(x.alias("easting"), y.alias("northing"), ref.alias("reference"))), F.when(ref != "", F.struct(F.lit(None).cast("double").alias("easting"), F.lit(None).cast("double").alias("northing"), ref.alias("reference")))))


def text_position(x: Column) -> Column:
    """(lat, lon, method) of a text's labelled decimal degrees, or else of its degrees and decimal minutes; null without or out of range."""
    lat_, lon_ = r"(?i)\blat(?:itude)?\b\s*[:=]?\s*([-+]?\d{1,2}(?:\.\d+)?)\s*(?:degrees?|[°º])?\s*([NS])?", r"(?i)\blon(?:gitude)?\b\s*[:=]?\s*([-+]?\d{1,3}(?:\.\d+)?)\s*(?:degrees?|[°º])?\s*([EW])?"
    way = lambda value, pattern, minus: F.when(F.upper(F.regexp_extract(x, pattern, 2)) == minus, -F.abs(value)).otherwise(value)
    lat, lon = way(_double(x, lat_, 1), lat_, "S"), way(_double(x, lon_, 1), lon_, "W")
    sound = lambda a, b: F.abs(a).between(0, 90) & F.abs(b).between(0, 180)
    pair = lambda a, b, method: F.struct(a.alias("lat"), b.alias("lon"), F.lit(method).alias("method"))
    dlat, dlon = r"(?i)\b(\d{1,2})\s*[°ºo?]\s*(\d{1,2}(?:\.\d+)?)\s*(?:m|['′])?\s*([NS])\b", r"(?i)\b(\d{1,3})\s*[°ºo?]\s*(\d{1,2}(?:\.\d+)?)\s*(?:m|['′])?\s*([EW])\b"
    minutes = lambda p: _double(x, p, 2)
    signed = lambda p, minus: (_double(x, p, 1) + minutes(p) / 60) * F.when(F.upper(F.regexp_extract(x, p, 3)) == minus, -1.0).otherwise(1.0)
    y, z = signed(dlat, "S"), signed(dlon, "W")
    return F.coalesce(F.when(sound(lat, lon), pair(lat, lon, "source_decimal_degrees")), F.when((minutes(dlat) < 60) & (minutes(dlon) < 60) & sound(y, z), pair(y, z, "source_degree_decimal_minutes_converted")))


def distinct_positions(rows, keys: list[str], lat: str, lon: str, order: list[Column], cell: float = 1e-5):
    """The first row, by ``order``, of each key's positions that are the same to ``cell`` degrees, cell by cell of a grid."""
    spot = [F.round(F.col(c) / cell).cast("long") for c in (lat, lon)]
    names = [f"__o{i}" for i in range(len(order))]
    best = rows.groupBy(*keys, spot[0].alias("__y"), spot[1].alias("__x")).agg(F.min(F.struct(*(o.alias(n) for o, n in zip(order, names)), *(c for c in rows.columns if c not in keys))).alias("__b"))
    return best.select(*keys, *(F.col(f"__b.`{c}`").alias(c) for c in rows.columns if c not in keys))
