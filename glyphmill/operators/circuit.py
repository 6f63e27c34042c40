"""Electrical rules over netlists (ref, pin, net) and parts (ref, part)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import constants as K
from ..session import materialize


def device_pins(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(devices: part, pins, vcc, gnd, desc; gate pins: part, gate, pin, role) of the built-in pinouts; both of fixed size."""
    dev = [d[:5] for d in K.DEVICES]
    gates = [(d[0], g, pin, role) for d in K.DEVICES for g, gate in enumerate(d[5], 1) for role, pins in zip(("in", "ctrl", "out"), gate) for pin in pins]
    return spark.createDataFrame(dev, "part string, pins int, vcc int, gnd int, description string"), spark.createDataFrame(gates, "part string, gate int, pin int, role string")


def pin_roles(devices: DataFrame, gates: DataFrame) -> DataFrame:
    """(part, pin, role): vcc and gnd first, then the first gate that names the pin, as output, control, input."""
    g = gates.select("part", "pin", (F.col("gate") * 4 + F.when(F.col("role") == "out", 1).when(F.col("role") == "ctrl", 2).otherwise(3)).alias("o"), "role")
    p = devices.select("part", F.col("vcc").alias("pin"), F.lit(-2).alias("o"), F.lit("vcc").alias("role")).unionByName(devices.select("part", F.col("gnd").alias("pin"), F.lit(-1).alias("o"), F.lit("gnd").alias("role")))
    return g.unionByName(p).groupBy("part", "pin").agg(F.min_by("role", "o").alias("role"))


def validate(nets: DataFrame, parts: DataFrame, devices: DataFrame, gates: DataFrame) -> DataFrame:
    """(rule, severity, ref, pin, net) of every finding; columns that a rule doesn't concern are null. ``nets`` has one row per (ref, pin)."""
    none = F.lit(None).cast("string")
    power = F.col("net").isin(K.POWER_NETS)
    roles = pin_roles(devices, gates)
    known = nets.join(parts, "ref", "left").join(F.broadcast(devices), "part", "left").withColumn("p", F.col("pin").try_cast("int"))
    known = materialize(known.join(F.broadcast(roles.withColumnRenamed("pin", "p")), ["part", "p"], "left"), "pins")  # every rule starts from it
    refs = known.filter("pins is null").select(F.when(F.col("part").isNull(), "unknown part").otherwise("no pinout").alias("rule"), F.lit("warning").alias("severity"), "ref", none.alias("pin"), none.alias("net")).distinct()
    pins = known.filter("pins is not null")
    inside = F.col("p").between(1, F.col("pins"))
    rule = (
        F.when(F.col("p").isNull(), "pin is no number").when(~inside, "pin outside").when(F.col("role").isNull(), "no-connect")
        .when(F.col("role").isin("vcc", "gnd") & ~power, "supply pin without supply").when(F.col("role").isin("in", "out", "ctrl") & power, "signal pin on supply")
    )
    per_pin = pins.withColumn("rule", rule).filter("rule is not null").select("rule", F.when(F.col("rule").isin("no-connect", "signal pin on supply"), "warning").otherwise("error").alias("severity"), "ref", "pin", "net")
    g = pins.select("ref", "part", "p").distinct().join(F.broadcast(gates.withColumnRenamed("pin", "p")), ["part", "p"]).groupBy("ref", "gate").agg(F.count_distinct(F.when(F.col("role") == "in", F.col("p"))).alias("i"), F.count_distinct(F.when(F.col("role") == "out", F.col("p"))).alias("o"))
    g = g.groupBy("ref").agg(F.min(F.when((F.col("o") > 0) & (F.col("i") == 0), F.col("gate"))).alias("dangling"), F.min(F.when((F.col("i") >= 2) & (F.col("o") == 0), F.col("gate"))).alias("starved"))
    gate = g.filter("dangling is not null").select(F.when(F.col("starved").isNotNull(), "output of the wrong gate").otherwise("output without inputs").alias("rule"), F.when(F.col("starved").isNotNull(), "error").otherwise("warning").alias("severity"), "ref", F.col("dangling").cast("string").alias("pin"), none.alias("net"))
    drivers = pins.filter((F.col("role") == "out") & inside & ~power).groupBy("net").agg(F.count(F.lit(1)).alias("k"), F.bool_and(F.col("description").endswith("(OC)")).alias("oc")).filter("k > 1")
    short = drivers.select(F.lit("several outputs").alias("rule"), F.when(F.col("oc"), "warning").otherwise("error").alias("severity"), none.alias("ref"), none.alias("pin"), "net")
    lone = known.filter(~power).groupBy("net").agg(F.count(F.lit(1)).alias("k")).filter("k = 1").select(F.lit("one pin only").alias("rule"), F.lit("warning").alias("severity"), none.alias("ref"), none.alias("pin"), "net")
    return refs.unionByName(per_pin).unionByName(gate).unionByName(short).unionByName(lone)


def verdict(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def pin_sets(devices: DataFrame, gates: DataFrame) -> DataFrame:
    """(part, signal_pins, unused): pins that carry no supply, and those of them that no gate names."""
    every = devices.select("part", F.array_except(F.sequence(F.lit(1), "pins"), F.array("vcc", "gnd")).alias("signal_pins"))
    used = gates.groupBy("part").agg(F.collect_set("pin").alias("used"))
    return every.join(used, "part").select("part", "signal_pins", F.array_sort(F.array_except("signal_pins", "used")).alias("unused"))


def power_pins(devices: DataFrame) -> DataFrame:
    """(part, pin, net): the supply pins of each part, from its pinout."""
    return devices.select("part", F.explode(F.array(F.struct(F.col("vcc").alias("pin"), F.lit("+5V").alias("net")), F.struct(F.col("gnd").alias("pin"), F.lit("GND").alias("net")))).alias("s")).select("part", F.col("s.pin").cast("string").alias("pin"), F.col("s.net").alias("net"))


def connect_power(pads: DataFrame, devices: DataFrame, decoupling: str = "0.1uF") -> DataFrame:
    """(ref, pin, net) of the pads (ref, value, pin) that the supply rails reach: the supply pins of known parts, and both pads of decoupling capacitors (pad 1 to the supply)."""
    chips = pads.join(F.broadcast(power_pins(devices).withColumnRenamed("part", "value")), ["value", "pin"]).select("ref", "pin", "net")
    caps = pads.filter((F.col("value") == decoupling) & F.col("ref").startswith("C")).join(F.broadcast(devices.select(F.col("part").alias("value"))), "value", "left_anti")
    return chips.unionByName(caps.select("ref", "pin", F.when(F.col("pin") == "1", "+5V").otherwise("GND").alias("net")))


def connect_signals(nets: DataFrame, pads: DataFrame) -> DataFrame:
    """(net, ref, pin, state) of the wanted connections (net, ref, pin): 'connected', 'no footprint' or 'no pad' by what the board's ``pads`` (ref, pin) hold.

    One row per footprint with its pins, which meets the connections by shuffle: pads unfolded from their parts are many times what the planner takes them for, so it mustn't
    choose to broadcast them by that.
    """
    held = pads.filter("ref is not null").groupBy("ref").agg(F.collect_set("pin").alias("_p")).hint("merge")
    state = F.when(F.array_contains("_p", F.col("pin")), "connected").when(F.col("_p").isNotNull(), "no pad").otherwise("no footprint")
    return nets.join(held, "ref", "left").select("net", "ref", "pin", state.alias("state"))


def pad_tally(connections: DataFrame) -> DataFrame:
    """(net, pads, parts): connected pads and different parts of each net."""
    return connections.filter("net is not null").groupBy("net").agg(F.count(F.lit(1)).alias("pads"), F.count_distinct("ref").alias("parts"))


def library_check(devices: DataFrame, gates: DataFrame, names: DataFrame, symbols: DataFrame) -> DataFrame:
    """(part, symbol, problem, detail): what a symbol library says against the pinouts; one row with a null problem for a part that agrees.

    ``names`` is (part, symbol); ``symbols`` is (symbol, pin, name, kind), pins as text. A part without name or symbol is 'not checked'. A symbol may lack pins (unconnected ones),
    not have more than the package.
    """
    none = F.lit(None).cast("string")
    d = devices.join(names, "part", "left")
    n = symbols.groupBy("symbol").agg(F.count_distinct("pin").alias("n"))
    d = d.join(n, "symbol", "left")
    known = d.filter("n is not null")
    unchecked = d.filter("n is null").select("part", "symbol", F.lit("not checked").alias("problem"), none.alias("detail"))
    excess = known.filter("n > pins").select("part", "symbol", F.lit("more pins than the package").alias("problem"), F.col("n").cast("string").alias("detail"))
    rails = known.select("part", "symbol", F.explode(F.array(F.struct(F.lit("VCC").alias("name"), F.col("vcc").alias("want")), F.struct(F.lit("GND").alias("name"), F.col("gnd").alias("want")))).alias("r")).select("part", "symbol", F.col("r.name").alias("name"), F.col("r.want").cast("string").alias("want"))
    told = symbols.select("symbol", F.upper("name").alias("name"), "pin").groupBy("symbol", "name").agg(F.collect_set("pin").alias("got"))
    supply = rails.join(told, ["symbol", "name"]).filter(~F.array_contains("got", F.col("want"))).select("part", "symbol", F.lit("supply pin differs").alias("problem"), F.concat("name", F.lit(" "), F.array_join(F.array_sort("got"), "/")).alias("detail"))
    used = gates.select("part", F.col("pin").cast("string").alias("pin"), "role").distinct().join(known.select("part", "symbol"), "part").join(symbols.select("symbol", "pin", "kind"), ["symbol", "pin"], "left")
    missing = used.filter("kind is null").select("part", "symbol", F.lit("pin not on symbol").alias("problem"), F.col("pin").alias("detail")).distinct()
    typed = used.filter((F.col("role") == "out") & F.col("kind").isNotNull() & ~F.col("kind").isin(K.OUTPUT_TYPES)).select("part", "symbol", F.lit("output typed otherwise").alias("problem"), F.concat("pin", F.lit(" "), "kind").alias("detail"))
    found = excess.unionByName(supply).unionByName(missing).unionByName(typed)
    fine = known.join(found.select("part").distinct(), "part", "left_anti").select("part", "symbol", none.alias("problem"), none.alias("detail"))
    return found.unionByName(unchecked).unionByName(fine)
