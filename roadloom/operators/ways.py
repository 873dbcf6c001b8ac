"""Road segments from raw ways: cut where roads meet, with access, direction and speed by their tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.plans.staging import staged

# Kinds of roads with the usual speed of a car in km/h, and values of tags.
SPEEDS = {
    "motorway": 100, "motorway_link": 70, "motorroad": 90, "trunk": 70, "trunk_link": 65, "primary": 65, "primary_link": 60, "secondary": 60, "secondary_link": 50, "tertiary": 50,
    "tertiary_link": 40, "unclassified": 30, "residential": 30, "living_street": 6, "service": 20, "road": 20, "track": 15,
}
IGNORED = ("footway", "construction", "cycleway", "path", "steps")
FERRIES = ("ferry", "shuttle_train")
CLOSED = ("no", "restricted", "military", "emergency", "private", "permit")
ACCESS = ("motorcar", "motor_vehicle", "vehicle", "access")
FORWARD, BACKWARD = ("yes", "true", "1"), ("-1", "reverse")
#: The speed of a ferry, how much of a limit is driven, and a mile in kilometres.
FERRY_KMH, OF_LIMIT, MILE_KM = 6.0, 0.9, 1.609344
#: Segments of one way have ids from its own times this on.
PER_WAY = 1 << 16


def _tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))


def roads(ways: DataFrame) -> DataFrame:
    """(way_id, refs, car_fwd, car_bwd, road_env, speed_kmh) of the ways (id, tags, refs) that are roads or ferries.

    A kind of road that is ignored, or no road at all, goes; one that isn't for cars stays, closed. The first access
    tag there is, of :data:`ACCESS`, decides. One-way: by tag or at a roundabout. A limit counts for the speed with
    :data:`OF_LIMIT` of it. Ways of fewer than two points, without an id or with null tags go; of ways that repeat an
    id, one stays.
    """
    kind, ferry = _tag("highway"), F.coalesce(_tag("route").isin(*FERRIES), F.lit(False))
    usual = F.coalesce(*[F.when(kind == k, F.lit(float(v))) for k, v in SPEEDS.items()])
    access = F.coalesce(*[_tag(a) for a in ACCESS])
    opened = F.when(ferry, F.coalesce(~access.isin(*CLOSED), F.lit(True))).otherwise(usual.isNotNull() & F.coalesce(~access.isin(*CLOSED), F.lit(True)))
    one = F.coalesce(_tag("oneway"), F.when(_tag("junction").isin("roundabout", "circular"), F.lit("yes")), F.lit("no"))
    limit = F.regexp_extract(_tag("maxspeed"), r"^\s*(\d+(?:\.\d+)?)\s*(?:km/h|kmh|kph|mph)?\s*$", 1)
    limit = F.when(limit != "", limit.cast("double") * F.when(_tag("maxspeed").contains("mph"), MILE_KM).otherwise(1.0) * OF_LIMIT)
    speed = F.when(ferry, F.lit(FERRY_KMH)).otherwise(F.coalesce(F.when(limit > 0, limit), usual, F.lit(float(SPEEDS["road"]))))
    is_set = lambda t: F.coalesce(~_tag(t).isin("no"), F.lit(False))
    env = F.when(ferry, "FERRY").when(is_set("tunnel"), "TUNNEL").when(is_set("bridge"), "BRIDGE").when(is_set("ford"), "FORD").otherwise("ROAD")
    kept = ways.where(F.col("id").isNotNull() & (F.size("refs") > 1) & (ferry | (kind.isNotNull() & ~kind.isin(*IGNORED))))
    return kept.dropDuplicates(["id"]).select(
        F.col("id").alias("way_id"), "refs", (opened & ~one.isin(*BACKWARD)).alias("car_fwd"), (opened & ~one.isin(*FORWARD)).alias("car_bwd"), env.alias("road_env"), speed.alias("speed_kmh")
    )


def segments_of(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(edge_id, base, adj, car_fwd, car_bwd, road_env, geometry, speed_kmh) from ``nodes`` (id, lat, lon) and ``ways``
    (id, tags, refs).

    A point that two roads use, or one road twice, or that ends a road, is a junction; roads are cut there. Points
    that aren't among the nodes are left out, and so is a point that repeats the one before it. Of nodes that repeat
    an id, one counts. Points meet their places by an equi-join and go back to their way, whose list was a row before,
    so no group is larger than that. Empty tables: no rows.
    """
    kept = staged(roads(ways), "roads")
    points = kept.select("way_id", F.posexplode("refs").alias("pos", "id"))
    at = nodes.where("id is not null and lat is not null and lon is not null").groupBy("id").agg(F.min(F.struct("lat", "lon")).alias("p"))
    points = staged(points.join(at, "id").select("way_id", "pos", "id", "p.lat", "p.lon"), "points")
    line = F.sort_array(F.collect_list(F.struct("pos", "id", "lat", "lon")))
    lines = points.groupBy("way_id").agg(line.alias("l")).select("way_id", F.filter("l", lambda x, i: (i == 0) | (F.get(F.col("l"), i - 1)["id"] != x["id"])).alias("l")).where(F.size("l") > 1)
    lines = staged(lines, "lines")
    ends = F.transform("l", lambda x, i: F.struct(x["id"].alias("id"), F.when((i == 0) | (i == F.size("l") - 1), 2).otherwise(1).alias("uses")))
    junctions = lines.select(F.inline(ends)).groupBy("id").agg(F.sum("uses").alias("uses")).where("uses > 1").select("id")
    # The places at which a way is cut, by the way.
    cut = lines.select("way_id", F.posexplode(F.transform("l", lambda x: x["id"])).alias("i", "id")).join(junctions, "id")
    cuts = cut.groupBy("way_id").agg(F.sort_array(F.collect_list(F.col("i") + 1)).alias("c"))
    pieces = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda k: F.struct((k - 1).alias("k"), F.slice("l", F.get("c", k - 1), F.get("c", k) - F.get("c", k - 1) + 1).alias("g")))
    rows = lines.join(cuts, "way_id").select("way_id", F.inline(pieces)).join(kept.drop("refs"), "way_id")
    edge = F.when(F.col("k") < PER_WAY, F.col("way_id") * PER_WAY + F.col("k")).otherwise(F.raise_error(F.lit("a way has too many segments")).cast("long"))
    geometry = F.transform("g", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))
    return rows.select(edge.alias("edge_id"), F.element_at("g", 1)["id"].alias("base"), F.element_at("g", -1)["id"].alias("adj"), "car_fwd", "car_bwd", "road_env", geometry.alias("geometry"), "speed_kmh")
