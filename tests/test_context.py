"""Address scopes and seals against the standard library."""

import hashlib
import hmac
import ipaddress
import random

from pyspark.sql import functions as F

from lumenwatch.operators import context, quality, reports, search

DOCUMENTATION = [ipaddress.ip_network(n) for n in ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "2001:db8::/32")]


def scope(text):
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return None
    a = getattr(a, "ipv4_mapped", None) or a
    named = "loopback" if a.is_loopback else "link-local" if a.is_link_local else "multicast" if a.is_multicast else "documentation" if any(a in n for n in DOCUMENTATION) else None
    return named or ("public" if a.is_global else "private" if a.is_private else "reserved")


def test_scopes_of_both_kinds_of_address(spark):
    rng = random.Random(3)
    tops = [0, 0x64FF9B0001 << 88, 0x100 << 112, 0x2001 << 112, 0x20010001 << 96, 0x20010020 << 96, 0x20010DB8 << 96, 0x2002 << 112, 0x3FFF << 112, 0xFC << 120, 0xFE80 << 112, 0xFEC0 << 112, 0xFF << 120, 0xFFFF << 32, 0x26 << 120]
    texts = []
    for top in tops:
        for bits in (2, 20, 64, 90, 104):
            a = ipaddress.IPv6Address(top | rng.getrandbits(bits) & ((1 << 112) - 1))
            texts += [str(a), a.exploded.upper()]
    texts += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(200)]
    texts += ["::", "::1", "1::", "::ffff:203.0.113.9", "::ffff:8.8.8.8", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:7::", "", ":", ":::", "1::2::3", "1:2:3:4:5:6:7:8:9", "1:2:3", "12345::", "g::", "::1.2.3", "1.2.3.4.5", "::1.2.3.400", "1:2:3:4:5:6:7:8::", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", context.scope_of(F.col("t")).alias("s")).collect()
    wrong = [(r.t, r.s, scope(r.t)) for r in got if r.s != (None if r.t is None else scope(r.t))]
    assert not wrong


def test_seals_equal_hmac_and_show_changes(spark):
    for key in (b"k", b"x" * 64, b"y" * 100):
        assert spark.range(1).select(search.seal(key, F.lit("abc"))).first()[0] == hmac.new(key, b"abc", hashlib.sha256).hexdigest()
    mac = lambda h, key=b"k": hmac.new(key, h.encode(), hashlib.sha256).hexdigest()
    log = [(1, "a", None), (2, "b", mac("b")), (3, "c", mac("c", b"z")), (4, "d", ""), (5, None, mac("")), (6, "f", mac("f"))]
    rows = spark.createDataFrame(log, "seq long, hash string, mac string")
    assert {tuple(r) for r in search.verify_seals(rows, b"k").collect()} == {(3, "mac"), (4, "unsigned")}
    assert search.verify_seals(rows.where("seq = 1"), b"k").count() == 0


def test_usage_and_confidence(spark):
    rows = spark.createDataFrame([("a", True, False, 2_000_000, 10), ("a", None, True, None, None), ("b", False, False, None, None)], "k string, error boolean, fallback boolean, input_tokens long, output_tokens long")
    got = {r.k: r for r in quality.usage(rows, "k", prices=(0.5, 100.0)).collect()}
    assert (got["a"].error_rate, got["a"].fallback_rate, round(got["a"].cost_usd, 9)) == (0.5, 0.5, 1.001)
    assert (got["b"].input_tokens, got["b"].cost_usd) == (0, None)
    for severity in (0, 25, 50, 75, 100):
        for n in (1, 2, 3, 9):
            want = round(min(0.5 + 0.25 * (severity / 100) + 0.15 * (min(n, 3) / 3), 0.9), 2)
            assert spark.range(1).select(reports.step_confidence(F.lit(severity), F.lit(n))).first()[0] == want
