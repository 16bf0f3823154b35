"""Addresses and longest prefixes against the ipaddress module."""

import ipaddress
import random

from pyspark.sql import functions as F

from tidegauge.functions.addresses import address_key
from tidegauge.operators import enrich


def _number(text):
    try:
        found = ipaddress.ip_address(text)
    except ValueError:
        return None
    return int(found) if found.version == 6 else 0xFFFF << 32 | int(found)


ODD = [
    "1.2.3.4", "0.0.0.0", "255.255.255.255", "256.1.1.1", "1.2.3", "1.2.3.4.5", "01.2.3.4", "", None, "text", "::", "::1", "1::",
    "2001:db8::1", "2001:DB8:0:0:0:0:0:1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", ":1", "1:",
    "::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "::1.2.3.256", "1.2.3.4::", "12345::", "g::1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8",
    "1:2:3:4::5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "fe80::1%eth0", "0:0::0:0", "1::2:3.4.5.6", " ::1",
]


def test_address_keys(spark):
    rnd = random.Random(1)
    texts = list(ODD)
    for _ in range(300):
        found = ipaddress.IPv6Address(rnd.getrandbits(128) & rnd.choice([-1, (1 << 64) - 1, ~((1 << 80) - 1 << 20)]))
        texts += [str(found), found.exploded, str(found).upper()]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k INT, ip STRING")
    got = {r["k"]: r["key"] for r in rows.select("k", address_key(F.col("ip")).alias("key")).collect()}
    want = {k: None if t is None or (n := _number(t.split("%")[0] if "%" not in t else "x")) is None else f"{n:032x}" for k, t in enumerate(texts)}
    assert {k: (texts[k], got[k], want[k]) for k in got if got[k] != want[k]} == {}


def test_longest_prefix_against_all_networks(spark):
    rnd = random.Random(3)
    networks = [("0.0.0.0/0", "any4"), ("::/0", "any"), ("10.0.0.0/8", "ten"), ("10.0.0.0/8", "again"), ("1.2.3.4", "host"), ("2001:db8::/33", "odd"),
                ("300.0.0.0/8", "bad"), ("1.0.0.0/33", "bad"), ("1.0.0.0/x", "bad"), (None, "bad"), ("::/129", "bad")]
    for _ in range(60):
        bits = rnd.randrange(8, 33)
        networks.append((f"{ipaddress.IPv4Address(10 << 24 | rnd.getrandbits(12) << 12)}/{bits}", f"n{len(networks)}"))
        networks.append((f"{ipaddress.IPv6Address(0x20010DB8 << 96 | rnd.getrandbits(20) << 76)}/{rnd.randrange(20, 65)}", f"n{len(networks)}"))
    addresses = [str(ipaddress.IPv4Address(10 << 24 | rnd.getrandbits(24))) for _ in range(200)] + ["1.2.3.4", "::1", "x", None, "8.8.8.8"]
    addresses += [str(ipaddress.IPv6Address(0x20010DB8 << 96 | rnd.getrandbits(96))) for _ in range(200)]

    def parsed(text):
        try:
            found = ipaddress.ip_network(text, strict=False)
        except ValueError:
            return None
        size = found.prefixlen + (96 if found.version == 4 else 0)
        return _number(str(found.network_address)), size

    def best(ip):
        n = None if ip is None else _number(ip)
        if n is None:
            return None
        held = [(-p[1], net, place) for net, place in networks if net and (p := parsed(net)) and (n ^ p[0]) >> (128 - p[1]) == 0]
        return min(held)[1:] if held else None

    events = spark.createDataFrame([(k, ip) for k, ip in enumerate(addresses + addresses[:3])], "k INT, ip STRING")
    table = spark.createDataFrame([(n, p, None, None, None, None) for n, p in networks], "network STRING, country STRING, region STRING, city STRING, lat DOUBLE, lng DOUBLE")
    found = {r["k"]: (r["geo_network"], r["geo_country"]) for r in enrich.enrich_geo_networks(events, table).collect()}
    want = {k: best(ip) or (None, None) for k, ip in enumerate(addresses + addresses[:3])}
    assert {k: (found[k], want[k]) for k in want if found[k] != want[k]} == {}
    assert enrich.enrich_geo_networks(events, table.limit(0)).where("geo_network IS NOT NULL").isEmpty()


def _joined_rows(frame):
    """Rows that the joins of a collected frame made, by Spark's own metrics."""
    frame.collect()
    found, nodes = 0, [frame._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.finalPhysicalPlan())
            continue
        if name.endswith("QueryStageExec"):
            nodes.append(node.plan())
            continue
        if "Join" in name:
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
    return found


def test_repeated_networks_do_not_multiply_the_join(spark):
    """500 networks of one prefix, by several spellings of it: an address meets one of them, the smallest."""
    spelled = [("10.1.2.3/8", "z"), ("10.0.0.0/8", "b"), ("10.0.0.0/8", "a"), ("10.9.0.0/16", "c")]
    networks = spark.createDataFrame(spelled * 125, "network STRING, country STRING")
    addresses = spark.range(400).select(F.concat_ws(".", F.lit(10), F.col("id") % 20, F.floor(F.col("id") / 20), F.lit(7)).alias("ip"))
    best = enrich.longest_prefix(addresses, networks)
    assert 400 < _joined_rows(best) <= 2 * 400
    got = {r["ip"]: (r["network"], r["country"]) for r in best.collect()}
    assert len(got) == 400
    assert {ip: v for ip, v in got.items() if v != (("10.9.0.0/16", "c") if ip.startswith("10.9.") else ("10.0.0.0/8", "a"))} == {}
