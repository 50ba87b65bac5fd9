"""Geographic column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in the atan2 form; null if a coordinate is."""
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def valid_coords(lat: Column, lng: Column) -> Column:
    """In range and not the (0, 0) that stands for unknown."""
    return F.coalesce(lat.between(-90, 90) & lng.between(-180, 180) & ~((lat == 0) & (lng == 0)), F.lit(False))


def bounding_box(lat: Column, lng: Column, radius_km: Column | float) -> dict[str, Column]:
    """Box that holds the circle; the longitude span widens towards the poles."""
    r = radius_km if isinstance(radius_km, Column) else F.lit(float(radius_km))
    dlat = r / KM_PER_DEGREE
    dlng = r / (KM_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))
    return {"min_lat": lat - dlat, "max_lat": lat + dlat, "min_lng": lng - dlng, "max_lng": lng + dlng}


def distance_tier(km: Column) -> Column:
    return F.when(km <= 10, "nearby").when(km <= 25, "area").when(km.isNotNull(), "drive")


def snap_radius(km: Column, tiers: tuple[int, ...] = (10, 25, 50, 100, 250)) -> Column:
    """The tier nearest to a radius, the smaller of two as near."""
    options = F.array(*(F.struct(F.abs(km - t).alias("d"), F.lit(t).alias("t")) for t in tiers))
    return F.array_min(options)["t"]


def coords_key(lat: Column, lng: Column, places: int = 1) -> Column:
    scale = 10**places
    cell = lambda c: F.floor(c * scale + 0.5) / scale
    return F.concat_ws(",", cell(lat).cast("string"), cell(lng).cast("string"))


def coords_from_map_url(url: Column) -> dict[str, Column]:
    """Latitude and longitude of a map link: the place pin, then the view centre, then the parameters q, ll and query
    where these are coordinates as a whole; the first valid pair counts."""
    number = r"(-?\d+\.?\d*)"
    decoded = F.regexp_replace(url, "(?i)%2C", ",")
    patterns = [rf"!3d{number}!4d{number}", rf"@{number},{number}", *(rf"[?&]{p}={number},{number}(?:[&#]|$)" for p in ("q", "ll", "query"))]
    pairs = F.array(*(F.struct(F.regexp_extract(decoded, p, 1).try_cast("double").alias("lat"), F.regexp_extract(decoded, p, 2).try_cast("double").alias("lng")) for p in patterns))
    first = F.get(F.filter(pairs, lambda x: valid_coords(x["lat"], x["lng"])), F.lit(0))
    return {"latitude": first["lat"], "longitude": first["lng"]}


def coords_from_dms(text: Column) -> dict[str, Column]:
    """Latitude and longitude of degrees, minutes and seconds in a text, to six places."""
    pattern = r"(\d{1,3})°(\d{1,2})'([\d.]+)\"([NS]),?\s+(\d{1,3})°(\d{1,2})'([\d.]+)\"([EW])"
    part = lambda k: F.regexp_extract(text, pattern, k)

    def value(k: int, negative: str) -> Column:
        degrees = part(k).try_cast("double") + part(k + 1).try_cast("double") / 60 + part(k + 2).try_cast("double") / 3600
        return F.floor(F.when(part(k + 3) == negative, -degrees).otherwise(degrees) * 1000000 + 0.5) / 1000000

    lat, lng = value(1, "S"), value(5, "W")
    ok = valid_coords(lat, lng)
    return {"latitude": F.when(ok, lat), "longitude": F.when(ok, lng)}


def viewport(lat: Column, lng: Column, half: float) -> dict[str, Column]:
    """Box of a half width in degrees around a point, within the world."""
    return {"south": F.greatest(F.lit(-90.0), lat - half), "west": F.greatest(F.lit(-180.0), lng - half), "north": F.least(F.lit(90.0), lat + half), "east": F.least(F.lit(180.0), lng + half)}


def chosen_coords(raw: tuple[Column, Column], cached: tuple[Column, Column], same_url: Column, resolved: tuple[Column, Column], coded: tuple[Column, Column], bias: tuple[Column, Column], max_km: float = 200.0) -> dict[str, Column]:
    """The first of: the row's own pair, the cached one if the link is the same, that of the resolved short link, the
    geocoded one unless it is over ``max_km`` from the organiser. Pairs are taken whole."""
    near = F.coalesce(haversine_km(*coded, *bias) <= max_km, F.lit(True))
    pair = lambda p, ok=F.lit(True): F.when(p[0].isNotNull() & p[1].isNotNull() & ok, F.struct(p[0].alias("lat"), p[1].alias("lng")))
    first = F.coalesce(pair(raw), pair(cached, F.coalesce(same_url, F.lit(False))), pair(resolved), pair(coded, near))
    return {"latitude": first["lat"], "longitude": first["lng"]}
