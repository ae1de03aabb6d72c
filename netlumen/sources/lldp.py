"""Link-layer neighbour reports, JSON or text, to host and link observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlumen.functions.devices import capability_type
from netlumen.functions.net import bind, normalize_mac
from netlumen.operators.topology import observations
from netlumen.schemas import LINK_OBSERVATION
from netlumen.sources.neighbours import dealt, line_order

SOURCE = "lldp"


def _object(text: Column) -> Column:
    """JSON object as name -> raw JSON text; NULL for anything else."""
    return bind(text, lambda t: F.when(F.startswith(F.ltrim(t), F.lit("{")), F.from_json(t, "map<string,string>")))


def _items(text: Column) -> Column:
    """A JSON list as raw items; a single value as a list of one; NULL as empty."""
    return bind(text, lambda t: F.when(t.isNull(), F.array().cast("array<string>")).when(
        F.startswith(F.ltrim(t), F.lit("[")), F.from_json(t, "array<string>")).otherwise(F.array(t)))


def _leaf(text: Column) -> Column:
    """Leaves come bare, as {"value": x}, or as a list of either."""
    return bind(F.try_element_at(_items(text), F.lit(1)), lambda one: F.coalesce(
        F.try_element_at(_object(one), F.lit("value")), one))


def _field(obj: Column, name: str) -> Column:
    return F.try_element_at(obj, F.lit(name))


def _observed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with iface, name, descr, mac, mgmt_ip, caps, port_id, port_descr."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    hosts = observations(rows.select(
        "ord", F.nullif("mgmt_ip", F.lit("")).alias("ip"), "mac", empty("name").alias("hostname"),
        F.col("iface").alias("interface"), F.lit(SOURCE).alias("source"),
        capability_type(F.col("caps")).alias("device_type_hint"), empty("descr").alias("os_hint"),
        F.create_map(F.lit("capabilities"), F.array_join("caps", ","),
                     F.lit("port_descr"), empty("port_descr")).alias("extra")))
    name = F.coalesce(F.nullif("name", F.lit("")), "mac")
    links = rows.filter(name.isNotNull()).select(
        "ord", F.col("local_name").alias("local"), name.alias("remote"),
        F.col("iface").alias("local_port"),
        F.coalesce(F.nullif("port_id", F.lit("")), "port_descr", F.lit("")).alias("remote_port"),
        F.lit(SOURCE).alias("source"), F.lit("ethernet").alias("kind"),
        F.lit(None).cast("int").alias("bandwidth_mbps"), F.lit(None).cast("string").alias("local_mac"),
        F.col("mac").alias("remote_mac")).select(*LINK_OBSERVATION.names)
    return hosts, links


def parse_json(dumps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports as JSON: interfaces may be a list of named objects, a list of one-key
    objects, or an object keyed by interface. ``dumps`` has dump, text, local_name."""
    top = dealt(dumps).select("dump", "local_name", _object(F.col("text")).alias("t"))
    root = top.select("dump", "local_name", F.coalesce(
        _object(_field(F.col("t"), "lldp")), F.col("t")).alias("r"))
    faces = root.select("dump", "local_name", F.coalesce(
        _field(F.col("r"), "interface"), _field(F.col("r"), "interfaces")).alias("f"))
    # An object keyed by interface is a list of that one object without a name.
    listed = faces.select("dump", "local_name", F.posexplode(_items(F.col("f"))).alias("p0", "item"))
    obj = listed.withColumn("o", _object(F.col("item"))).filter(F.col("o").isNotNull())
    is_named = F.map_contains_key("o", F.lit("name"))
    single = F.array(F.struct(_leaf(_field(F.col("o"), "name")).alias("key"),
                              F.col("item").alias("value")))
    several = F.flatten(F.transform(F.map_entries("o"), lambda e: F.transform(
        _items(e["value"]), lambda b: F.struct(e["key"].alias("key"), b.alias("value")))))
    entries = obj.select("dump", "local_name", "p0",
                         F.posexplode(F.when(is_named, single).otherwise(several)).alias("p1", "e"))
    body = entries.select(
        "dump", "local_name", (F.col("p0") * 65536 + F.col("p1")).alias("pos"),
        F.coalesce("e.key", F.lit("")).alias("iface"), _object(F.col("e.value")).alias("b")
    ).filter(F.col("b").isNotNull())
    raw = body.withColumn("c", _object(_field(F.col("b"), "chassis")))
    by_name = F.col("c").isNotNull() & ~F.map_contains_key("c", F.lit("name")) & ~F.map_contains_key(
        "c", F.lit("id"))
    first = F.map_entries("c")[0]
    chassis = raw.withColumns({
        "sysname": F.when(by_name, first["key"]),
        "ch": F.when(by_name, _object(_leaf(first["value"]))).otherwise(
            _object(_leaf(_field(F.col("b"), "chassis"))))}).filter(
        F.col("ch").isNotNull() | ~F.map_contains_key("b", F.lit("chassis")))
    ch = F.col("ch")
    caps = F.filter(F.transform(_items(_field(ch, "capability")), lambda x: bind(
        F.struct(_object(x).alias("o"), x.alias("x")), lambda s: F.lower(F.when(
            s["o"].isNull(), s["x"]).when(
            F.coalesce(_field(s["o"], "enabled"), F.lit("true")) != "false",
            F.coalesce(_field(s["o"], "type"), _field(s["o"], "value")))))),
        lambda x: x.isNotNull() & (x != ""))
    port = chassis.withColumn("pt", _object(_leaf(_field(F.col("b"), "port"))))
    mgmt = F.coalesce(*[F.nullif(_leaf(_field(ch, k)), F.lit(""))
                        for k in ("mgmt-ip", "mgmt_ip", "mgmt-ip-v4")])
    return _observed(port.select(
        line_order().alias("ord"), "local_name", "iface",
        F.coalesce(_leaf(_field(ch, "name")), "sysname", F.lit("")).alias("name"),
        _leaf(_field(ch, "descr")).alias("descr"),
        normalize_mac(_leaf(_field(ch, "id"))).alias("mac"), mgmt.alias("mgmt_ip"),
        F.coalesce(caps, F.array().cast("array<string>")).alias("caps"),
        _leaf(_field(F.col("pt"), "id")).alias("port_id"),
        _leaf(_field(F.col("pt"), "descr")).alias("port_descr")))


def parse_text(dumps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports as text: one block per 'Interface:' line, 'key: value' lines inside."""
    blocks = F.slice(F.split("text", r"(?m)^[ \t]*Interface:"), 2, 2 ** 30)
    rows = dumps.select("dump", "local_name", F.posexplode(blocks).alias("pos", "block"))
    block = F.col("block")

    def values(*names: str) -> Column:
        keys = "|".join(names)
        return F.regexp_extract_all(block, F.lit(rf"(?im)^[ \t]*(?:{keys})[ \t]*:[ \t]*(.*?)[ \t\r]*$"))

    last = lambda *n: F.try_element_at(values(*n), F.lit(-1))
    tail = lambda v: F.when(v.rlike(r"^\S+\s+\S"), F.regexp_replace(v, r"^\S+\s+", "")).otherwise(v)
    chassis = last("ChassisID")
    mac = normalize_mac(F.when(chassis.rlike(r"(?i)^mac\s+\S"), tail(chassis)).otherwise(chassis))
    caps = F.filter(F.transform(
        F.filter(values("Capability"), lambda v: ~F.contains(F.lower(v), F.lit("off"))),
        lambda v: F.lower(F.trim(F.substring_index(v, ",", 1)))), lambda v: v != "")
    parsed = rows.select(
        line_order().alias("ord"), "local_name",
        F.trim(F.substring_index(F.substring_index(block, "\n", 1), ",", 1)).alias("iface"),
        F.coalesce(last("SysName"), F.lit("")).alias("name"), last("SysDescr").alias("descr"),
        mac.alias("mac"), F.try_element_at(values("MgmtIP", "mgmt-ip"), F.lit(1)).alias("mgmt_ip"),
        caps.alias("caps"), tail(last("PortID")).alias("port_id"), last("PortDescr").alias("port_descr"))
    return _observed(parsed.filter((F.col("name") != "") | F.col("mac").isNotNull()))
