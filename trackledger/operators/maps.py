"""Map documents: validate, compile, compare.

A document is rows of four tables, each with ``map_id``: ``elements`` (pos, id, type,
layer_id, z, x, y, points, adjacent_map, direction), ``layers`` (id, order), ``bindings``
(pos, id, element_id, type, td_area, berth, address, bit, allow_duplicate), and ``nodes``
(id) with ``edges`` (pos, id, from_node, to_node).  So any number of documents is checked
and compiled in one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackledger.operators.tables import diff

LAYER_BAND = 1_000_000
MARGIN, LEAST_SIZE = 40, 100

POINT = "struct<x:double,y:double>"
DOCUMENT = (
    "schemaVersion int, map struct<id:string,name:string,timezone:string>, layers array<struct<id:string,order:int>>,"
    f"elements array<struct<id:string,type:string,layerId:string,zIndex:int,x:double,y:double,points:array<{POINT}>,adjacentMapSlug:string,direction:string>>,"
    "bindings array<struct<id:string,elementId:string,type:string,tdArea:string,berth:string,address:string,bit:int,allowDuplicate:boolean>>,"
    "topology struct<nodes:array<struct<id:string>>,edges:array<struct<id:string,fromNodeId:string,toNodeId:string>>>"
)
# The kinds of elements and bindings that a document may have.
ELEMENT_TYPES = ("trackPath", "platform", "berth", "signal", "label", "boundary")
BINDING_TYPES = ("tdBerth", "tdSBit")


@dataclass
class Document:
    elements: DataFrame
    layers: DataFrame
    bindings: DataFrame
    nodes: DataFrame
    edges: DataFrame


def read(documents: DataFrame) -> Document:
    """The tables of (map_id, json) rows; missing lists are empty, missing z orders 0."""
    whole = documents.select("map_id", F.from_json("json", DOCUMENT).alias("d"))

    def rows(path: str, **columns: Column) -> DataFrame:
        found = whole.select("map_id", F.posexplode(f"d.{path}").alias("pos", "r"))
        return found.select("map_id", "pos", *[c.alias(n) for n, c in columns.items()])

    r = lambda name: F.col(f"r.{name}")
    return Document(
        elements=rows("elements", id=r("id"), type=r("type"), layer_id=r("layerId"), z=F.coalesce(r("zIndex"), F.lit(0)), x=r("x"), y=r("y"), points=r("points"), adjacent_map=r("adjacentMapSlug"), direction=r("direction")),
        layers=rows("layers", id=r("id"), order=r("order")),
        bindings=rows("bindings", id=r("id"), element_id=r("elementId"), type=r("type"), td_area=r("tdArea"), berth=r("berth"), address=r("address"), bit=r("bit"), allow_duplicate=F.coalesce(r("allowDuplicate"), F.lit(False))),
        nodes=rows("topology.nodes", id=r("id")),
        edges=rows("topology.edges", id=r("id"), from_node=r("fromNodeId"), to_node=r("toNodeId")),
    )


def issues(doc: Document) -> DataFrame:
    """(map_id, code, element_id, binding_id, detail): everything that keeps a document from being published."""
    none = F.lit(None).cast("string")

    def found(rows: DataFrame, code: str, element: Column = none, binding: Column = none, detail: Column = none) -> DataFrame:
        return rows.select("map_id", F.lit(code).alias("code"), element.alias("element_id"), binding.alias("binding_id"), detail.alias("detail"))

    e, b = doc.elements, doc.bindings
    schema = found(e.where(e["id"].isNull() | ~F.coalesce(e["type"].isin(*ELEMENT_TYPES), F.lit(False))), "invalid_schema", F.col("id"), detail=F.col("type"))
    schema = schema.unionByName(found(b.where(~F.coalesce(b["type"].isin(*BINDING_TYPES), F.lit(False))), "invalid_schema", F.col("element_id"), F.col("id"), F.col("type")))
    repeated = e.groupBy("map_id", "id").agg(F.count("*").alias("n")).where("n > 1")
    repeated = found(repeated.withColumn("_again", F.explode(F.sequence(F.lit(2), F.col("n").cast("int")))), "duplicate_element_id", F.col("id"))
    layers = doc.layers.select("map_id", F.col("id").alias("layer_id")).distinct()
    no_layer = found(e.join(layers, ["map_id", "layer_id"], "left_anti"), "missing_layer", F.col("id"), detail=F.col("layer_id"))
    ends = doc.edges.select("map_id", F.col("id").alias("edge"), F.explode(F.array("from_node", "to_node")).alias("id"))
    loose = ends.join(doc.nodes.select("map_id", "id").distinct(), ["map_id", "id"], "left_anti").select("map_id", "edge").distinct()
    loose = found(loose, "topology_edge_missing_node", detail=F.col("edge"))
    last = b.groupBy("map_id", "element_id").agg(F.max_by(F.struct("id", "type"), "pos").alias("b"))
    bound = e.where("type = 'berth'").select("map_id", F.col("id").alias("element_id")).join(last, ["map_id", "element_id"], "left")
    unbound = found(bound.where("b is null"), "missing_berth_binding", F.col("element_id"))
    wrong = found(bound.where("b.type <> 'tdBerth'"), "invalid_berth_binding", F.col("element_id"), F.col("b.id"))
    shared = b.where("type = 'tdBerth'").groupBy("map_id", "td_area", "berth").agg(F.count("*").alias("n"), F.bool_or("allow_duplicate").alias("free"))
    shared = found(shared.where("n > 1 and not free"), "duplicate_berth_binding", detail=F.concat_ws("|", "td_area", "berth"))
    out = schema
    for part in (repeated, no_layer, loose, unbound, wrong, shared):
        out = out.unionByName(part)
    return out


def warnings(doc: Document, known_maps: DataFrame, observed: DataFrame) -> DataFrame:
    """(map_id, code, severity, element_id): continuations to unknown maps, and bindings never seen in the feed."""
    away = doc.elements.where("type = 'boundary' and adjacent_map is not null").join(known_maps.select(F.col("slug").alias("adjacent_map")).distinct(), "adjacent_map", "left_anti")
    unseen = doc.bindings.where("type = 'tdBerth'").join(observed.select("td_area", "berth").distinct(), ["td_area", "berth"], "left_anti")
    out = away.select("map_id", F.lit("unknown_adjacent_map").alias("code"), F.lit("error").alias("severity"), F.col("id").alias("element_id"))
    return out.unionByName(unseen.select("map_id", F.lit("binding_never_observed").alias("code"), F.lit("warning").alias("severity"), "element_id"))


def painted(doc: Document) -> DataFrame:
    """The elements with ``paint_key``: layer, then z; unknown layers last.  Ties keep document order (pos)."""
    layers = doc.layers.groupBy("map_id", F.col("id").alias("layer_id")).agg(F.max_by("order", "pos").alias("layer_order"))
    key = F.coalesce(F.col("layer_order").cast("double") * LAYER_BAND + F.col("z"), F.lit(float("inf")))
    return doc.elements.join(layers, ["map_id", "layer_id"], "left").withColumn("paint_key", key)


def binding_index(doc: Document) -> DataFrame:
    """(map_id, kind, key, element_id): where each berth or signal bit is shown; the last binding of a key wins."""
    berth = F.col("type") == "tdBerth"
    key = F.when(berth, F.concat_ws("|", "td_area", "berth")).otherwise(F.concat_ws("|", "td_area", "address", F.col("bit").cast("string")))
    rows = doc.bindings.withColumn("kind", F.when(berth, "berth").otherwise("s_bit")).withColumn("key", key)
    return rows.groupBy("map_id", "kind", "key").agg(F.max_by("element_id", "pos").alias("element_id"))


def live_state(index: DataFrame, state: DataFrame) -> DataFrame:
    """(map_id, element_id, descr, event_at, source_seq): every bound berth of a binding index, of drafts as of versions, with its current state."""
    keyed = state.select(F.concat_ws("|", "td_area", "berth").alias("key"), "descr", "event_at", "source_seq")
    return index.where("kind = 'berth'").join(keyed, "key", "left").select("map_id", "element_id", "descr", "event_at", "source_seq")


def bounding_boxes(doc: Document) -> DataFrame:
    """(map_id, min_x, min_y, max_x, max_y, width, height): the extent of all points, and the canvas that fits it."""
    line = F.col("type").isin("trackPath", "platform")
    points = F.when(line, F.col("points")).otherwise(F.array(F.struct("x", "y")))
    xy = doc.elements.select("map_id", F.explode_outer(points).alias("p"))
    box = xy.groupBy("map_id").agg(*[F.coalesce(f(f"p.{c}"), F.lit(0.0)).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xy"])
    size = lambda c: F.greatest(F.col(f"max_{c}") - F.col(f"min_{c}") + 2 * MARGIN, F.lit(float(LEAST_SIZE)))
    return box.select("map_id", "min_x", "min_y", "max_x", "max_y", size("x").alias("width"), size("y").alias("height"))


def adjacency(doc: Document) -> DataFrame:
    """(map_id, node, neighbours): both directions of every edge in document order; unknown nodes have no row."""
    both = F.array(F.struct(F.col("from_node").alias("node"), F.col("to_node").alias("other"), F.lit(0).alias("half")), F.struct(F.col("to_node").alias("node"), F.col("from_node").alias("other"), F.lit(1).alias("half")))
    ends = doc.edges.select("map_id", "pos", F.explode(both).alias("e")).select("map_id", "pos", "e.*")
    lists = ends.groupBy("map_id", "node").agg(F.array_sort(F.collect_list(F.struct("pos", "half", "other"))).alias("l"))
    nodes = doc.nodes.select("map_id", F.col("id").alias("node")).distinct()
    return nodes.join(lists, ["map_id", "node"], "left").select("map_id", "node", F.coalesce(F.transform("l", lambda x: x["other"]), F.array().cast("array<string>")).alias("neighbours"))


def continuations(doc: Document) -> DataFrame:
    return doc.elements.where("type = 'boundary'").select("map_id", F.col("id").alias("element_id"), "adjacent_map", "direction")


def element_counts(doc: Document, observed: DataFrame) -> DataFrame:
    """(map_id, n_elements, n_berths, n_bound, observed_percent)."""
    kinds = doc.elements.groupBy("map_id").agg(F.count("*").alias("n_elements"), F.count_if(F.col("type") == "berth").alias("n_berths"))
    seen = observed.select("td_area", "berth").distinct().withColumn("_seen", F.lit(1))
    bound = doc.bindings.where("type = 'tdBerth'").join(seen, ["td_area", "berth"], "left").groupBy("map_id").agg(F.count("*").alias("n_bound"), F.count("_seen").alias("_n"))
    share = F.when(F.col("n_bound") > 0, F.round(100 * F.col("_n") / F.col("n_bound"))).otherwise(0.0)
    out = kinds.join(bound, "map_id", "left")
    return out.select("map_id", "n_elements", "n_berths", F.coalesce("n_bound", F.lit(0)).alias("n_bound"), share.alias("observed_percent"))


def info(doc: Document, observed: DataFrame) -> DataFrame:
    """(map_id, element_counts, n_bound_berths, n_unbound_berths, observed_percent): what an editor is told of a document.

    ``element_counts`` maps types to numbers.  A berth is bound if any binding names it, and
    the share is of berth bindings seen in the feed, rounded, 0 without any.
    """
    kinds = doc.elements.groupBy("map_id", "type").agg(F.count("*").alias("n")).groupBy("map_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("element_counts"))
    named = doc.bindings.select("map_id", F.col("element_id").alias("id")).distinct().withColumn("_bound", F.lit(1))
    own = doc.elements.where("type = 'berth'").join(named, ["map_id", "id"], "left").groupBy("map_id").agg(F.count("_bound").alias("n_bound_berths"), F.count_if(F.col("_bound").isNull()).alias("n_unbound_berths"))
    share = element_counts(doc, observed).select("map_id", "observed_percent")
    none = {c: F.coalesce(c, F.lit(0)) for c in ("n_bound_berths", "n_unbound_berths")}
    return kinds.join(own, "map_id", "left").withColumns(none).join(share, "map_id", "left").withColumn("observed_percent", F.coalesce("observed_percent", F.lit(0.0)))


def effective_at(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """(slug, at, version, found): the version of each wanted map that is in effect at a time; a map without one is not found.

    ``versions``: (slug, version, effective_from, effective_to), the last one open.
    """
    now = versions.select("slug", "version", "effective_from", "effective_to").withColumnRenamed("slug", "_slug")
    inside = (F.col("effective_from") <= F.col("at")) & (F.col("effective_to").isNull() | (F.col("effective_to") > F.col("at")))
    found = wanted.join(now, (F.col("slug") == F.col("_slug")) & inside, "left")
    return found.groupBy("slug", "at").agg(F.max("version").alias("version")).withColumn("found", F.col("version").isNotNull())


def listed(versions: DataFrame, bindings: DataFrame, last_seen: DataFrame, now: Column, status) -> DataFrame:
    """(slug, version, last_at, live_status) of each map with a version in effect, by the newest message of the areas that it shows.

    ``last_seen``: (td_area, last_at); ``status``: a function of the last and the present time.
    """
    current = effective_at(versions, versions.select("slug").distinct().withColumn("at", now)).where("found")
    areas = bindings.select("slug", "td_area").distinct().join(last_seen, "td_area").groupBy("slug").agg(F.max("last_at").alias("last_at"))
    return current.join(areas, "slug", "left").select("slug", "version", "last_at", status(F.col("last_at"), now).alias("live_status"))


def changes(before: Document, after: Document) -> DataFrame:
    """(map_id, part, id, change) between two versions of documents, by map and id."""
    out = None
    for part in ("elements", "bindings", "layers"):
        found = diff(getattr(before, part).drop("pos"), getattr(after, part).drop("pos"), ["map_id", "id"]).withColumn("part", F.lit(part))
        out = found if out is None else out.unionByName(found)
    return out.select("map_id", "part", "id", "change")


# A document without content, as the editor begins one.
BLANK_CANVAS, BLANK_LAYER, ZONE = {"width": 2000, "height": 800, "gridSize": 10}, {"id": "layer-default", "name": "Default", "visible": True, "locked": False, "order": 0}, "Europe/London"


def blank_document(slug: Column) -> Column:
    """The JSON of an empty document of this slug."""
    plain = lambda values: F.struct(*[F.lit(v).alias(n) for n, v in values.items()])
    none = F.array().cast("array<string>")
    head = F.struct(slug.alias("id"), slug.alias("name"), plain(BLANK_CANVAS).alias("canvas"), F.lit(ZONE).alias("timezone"))
    topology = F.struct(none.alias("nodes"), none.alias("edges"))
    return F.to_json(F.struct(F.lit(1).alias("schemaVersion"), head.alias("map"), F.array(plain(BLANK_LAYER)).alias("layers"), none.alias("elements"), topology.alias("topology"), none.alias("bindings"), F.create_map().cast("map<string,string>").alias("editorMetadata")))


def seeded_drafts(wanted: DataFrame, drafts: DataFrame, current: DataFrame) -> DataFrame:
    """(slug, revision, document, base_version) of each wanted slug: its draft, else revision 1 of the current version or of a blank document.

    ``drafts``: (slug, revision, document, base_version), one per slug; ``current``: (slug,
    version, document) of the versions in effect.
    """
    own = drafts.select("slug", F.struct("revision", "document", "base_version").alias("_d"))
    base = current.select("slug", F.col("version").alias("_v"), F.col("document").alias("_b"))
    rows = wanted.select("slug").distinct().join(own, "slug", "left").join(base, "slug", "left")
    seed = F.coalesce("_b", blank_document(F.col("slug")))
    has = F.col("_d").isNotNull()
    return rows.select("slug", F.coalesce("_d.revision", F.lit(1)).alias("revision"), F.when(has, F.col("_d.document")).otherwise(seed).alias("document"), F.when(has, F.col("_d.base_version")).otherwise(F.col("_v")).alias("base_version"))


def diff_sides(requests: DataFrame, versions: DataFrame, drafts: DataFrame) -> DataFrame:
    """(slug, from_version, to_version, before, after): the documents of both sides; without ``to_version`` the draft is compared.

    Requests whose side does not exist are left out.
    """
    old = versions.select("slug", F.col("version").alias("from_version"), F.col("document").alias("before"))
    new = versions.select("slug", F.col("version").alias("to_version"), F.col("document").alias("_v"))
    draft = drafts.select("slug", F.col("document").alias("_d"))
    rows = requests.join(old, ["slug", "from_version"]).join(new, ["slug", "to_version"], "left").join(draft, "slug", "left")
    after = F.when(F.col("to_version").isNull(), F.col("_d")).otherwise(F.col("_v"))
    return rows.withColumn("after", after).where("after is not null").select("slug", "from_version", "to_version", "before", "after")


def publish(versions: DataFrame, slug: str, document: str, effective_from: str, spark: SparkSession) -> DataFrame:
    """The version table (slug, version, document, effective_from, effective_to) with one more; the open one ends where it begins."""
    start = F.lit(effective_from).cast("timestamp")
    own = versions.where(F.col("slug") == slug)
    if not own.where(F.col("effective_to").isNull() & (F.col("effective_from") >= start)).isEmpty():
        raise ValueError("a version must begin after the one that is open")
    number = (own.agg(F.max("version")).first()[0] or 0) + 1
    closed = versions.withColumn("effective_to", F.when((F.col("slug") == slug) & F.col("effective_to").isNull(), start).otherwise(F.col("effective_to")))
    new = spark.range(1).select(F.lit(slug).alias("slug"), F.lit(number).alias("version"), F.lit(document).alias("document"), start.alias("effective_from"), F.lit(None).cast("timestamp").alias("effective_to"))
    return closed.unionByName(new)


def published(requests: DataFrame) -> DataFrame:
    """(slug, seq, version, effective_from, effective_to) after all publish requests (slug, seq, effective_from), in order of ``seq``.

    A version begins after all versions before it and closes the open one; a request that
    begins no later than an earlier one is refused and has no row.  The last accepted
    beginning is the latest of all before, so one running maximum tells.
    """
    order = Window.partitionBy("slug").orderBy("seq")
    latest = F.max("effective_from").over(order.rowsBetween(Window.unboundedPreceding, -1))
    taken = requests.withColumn("_latest", latest).where(F.col("_latest").isNull() | (F.col("effective_from") > F.col("_latest")))
    return taken.select("slug", "seq", F.row_number().over(order).alias("version"), "effective_from", F.lead("effective_from").over(order).alias("effective_to"))


def overlapping_versions(versions: DataFrame) -> DataFrame:
    """(slug, version): versions that begin before the one before them ends."""
    ends = F.expr("lag(effective_to) over (partition by slug order by effective_from, version)")
    opened = F.expr("lag(version) over (partition by slug order by effective_from, version)")
    rows = versions.withColumn("_end", ends).withColumn("_last", opened)
    return rows.where(F.col("_last").isNotNull() & (F.col("_end").isNull() | (F.col("_end") > F.col("effective_from")))).select("slug", "version")
