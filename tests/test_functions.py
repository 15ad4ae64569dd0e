import pytest
from pyspark.sql import functions as F

from fleetweave.functions import net, similarity, text
from fleetweave.functions.timetext import Zone, read


def test_sentinels(one):
    assert one(text.strip_sentinels, None, "", " ", "null", "NULL", "--", " x ", "N/A", " y") == ["", "", "", "", "NULL", "", "x", "", "y"]


def test_names(one):
    assert one(text.normalize_name, "WS28.corp.example", "dev (241314000004736121)", None, "192.168.1.5", "A") == ["ws28", "dev", "", "192", "a"]


def test_macs(one):
    assert one(text.normalize_mac, "AA-BB,00:00:00:00:00:00,aa:bb:cc:dd:ee:ff", "AABB.CCDD.EEFF", "x", None, "00:00:00:00:00:00") == ["aabbccddeeff", "aabbccddeeff", "", "", ""]


def test_serials(one):
    given = ["SN-12345", "SN:12345", "S/N:12345", "sn-12345", "PC-ABC123", "CND-XYZ789", "0000-1111-2222-3333-4444-5555-66", "--", None]
    assert one(text.normalize_serial, *given) == ["12345"] * 4 + ["ABC123", "XYZ789", "", "", ""]


def test_os_family(one):
    given = ["Windows 11 Pro", "macOS 14", "Mac OS X", "iOS 17", "FortiOS", "Android 14", "Ubuntu 22.04", "Solaris", "", None]
    assert one(text.os_family, *given) == ["windows", "macos", "macos", "ios", "ios", "android", "linux", "solaris", "", ""]


def test_classes(one):
    given = ["AA:BB:CC:DD:EE:FF", "192.168.1.100", "354666655016848", "user@domain.com", "SN001234", "", "N/A", None, "ws-28"]
    assert one(text.classify, *given) == ["mac_address", "ip_address", "imei", "email", "serial_number", "none", "none", "none", "hostname"]


def test_families_and_classes_of_the_fixed_lists(one):
    assert one(text.os_family, "RHEL 9", "iPadOS 17", "win32", "iPhone") == ["linux", "ios", "win32", "iphone"]
    given = ["a1-b.example.org", "999.1.1.1", "7host-a", "AA.BB.CC.DD.EE.FF", "a-very-long-host-name", "ab", "null"]
    assert one(text.classify, *given) == ["none", "ip_address", "hostname", "mac_address", "none", "none", "none"]


def test_human_texts(spark):
    df = spark.createDataFrame([(12,), (1536,), (5 * 1024**2,), (4 * 1024**3,), (0,)], "n long")
    assert [r.x for r in df.select(text.human_bytes(F.col("n")).alias("x")).collect()] == ["12 B", "1.5 KB", "5.0 MB", "4.00 GB", "0 B"]
    assert [r.x for r in df.select(text.human_duration(F.col("n")).alias("x")).collect()][:2] == ["12ms", "1.5s"]


def test_human_sizes_at_halves(spark):
    given = [1280, 1331, 1792, 2304, 5 * 1024**2 + 2**18, 5 * 1024**2 + 3 * 2**18, 4 * 1024**3 + 2**27, 4 * 1024**3 + 3 * 2**27, 1023, -5000, 2**63 - 1, None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(given)], "i int, n long")
    got = [r.x for r in df.select("i", text.human_bytes(F.col("n")).alias("x")).orderBy("i").collect()]
    assert got == ["1.2 KB", "1.3 KB", "1.8 KB", "2.2 KB", "5.2 MB", "5.8 MB", "4.12 GB", "4.38 GB", "1023 B", "-5000 B", "8589934592.00 GB", None]


def test_tokens(one):
    assert one(text.tokens, "Bob's ws-28.corp x laptop1 ab12", None) == [["ws-28", "laptop1", "ab12"], []]


def test_url_html_numbers(one, spark):
    assert one(text.employee_from_url, "/Agreements/Rick%20Ahmed__10/x.pdf", "/a+b/", "/Agreements/a+b__1/", None) == ["Rick Ahmed", "", "a+b", ""]
    assert one(text.strip_html, "<p>a&amp;b</p>\n<b> c</b>") == ["a&b c"]
    assert one(lambda c: text.number_or_text(c)[0], "1.5", "1d", "x", " 2 ", None) == [1.5, None, None, 2.0, None]
    assert spark.range(1).select(text.coverage_text(F.lit(3).cast("long"), F.lit(4).cast("long")).alias("x")).first().x == "3/4 (75%)"


def test_addresses(one, spark):
    assert one(net.ipv4_number, "10.0.0.1", "256.1.1.1", "x", None) == [167772161, None, None, None]
    b = spark.createDataFrame([("10.1.2.3/14",)], "v string").select(*(c.alias(n) for c, n in zip(net.cidr_bounds(F.col("v")), "lhn"))).first()
    assert (b.l, b.h, b.n) == (167772160, 167772160 + 4 * 65536 - 1, 14)
    got = one(net.address_bytes, "10.0.0.1", "::1", "x", None)
    assert got[0][-4:] == b"\x0a\x00\x00\x01" and got[1][-1:] == b"\x01" and got[2:] == [None, None]


def test_jaro_winkler():
    assert similarity.winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert similarity.winkler("dwayne", "duane") == pytest.approx(0.84, abs=1e-4)
    assert similarity.winkler("", "a") == 0.0 and similarity.winkler("a", "a") == 1.0


def test_levels(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("abcd", "abce"), ("abcd", "abxx"), ("abcd", "wxyz"), (None, "a")], "a string, b string")
    assert [r.x for r in df.select(similarity.level_edits(F.col("a"), F.col("b"), (1, 2)).alias("x")).collect()] == [3, 2, 1, 0, -1]
    assert [r.x for r in df.select(similarity.level_similarity(F.col("a"), F.col("b"), (0.9, 0.7)).alias("x")).collect()] == [3, 1, 0, 0, -1]


UTC0 = 1_735_689_600  # 2025-01-01


@pytest.mark.parametrize(
    "given, seconds, micro, offset",
    [
        ("2025-01-01T00:00:00Z", UTC0, 0, 0), ("2025-01-01 02:00:00.123456789+0200", UTC0 + 7200, 123456, 120), ("01.02.2025 00:00", UTC0 + 31 * 86400, 0, None), ("Wed, 01 Jan 2025 00:00:00 -0800", UTC0, 0, -480),
        ("Jan 1, 2025 12:05 AM", UTC0 + 300, 0, None), ("Jan 1, 2025 12:05 PM", UTC0 + 43500, 0, None), ("01-Jan-2025 00:00:01", UTC0 + 1, 0, None), ("2025/01/01 00:00:00", UTC0, 0, None), ("20250101000000.0Z", UTC0, 0, 0),
        ("20250101000000", UTC0, 0, None), ("2025-01-01 00:00:00 CEST", UTC0, 0, 120), ("2025-01-01", UTC0, 0, None), ("13/01/2025 00:00:00", UTC0 + 12 * 86400, 0, None),
    ],
)
def test_times(given, seconds, micro, offset):
    assert read(given, False) == (None, seconds, micro, offset)


def test_counted_times_and_none():
    us = UTC0 * 10**6
    for t in (str(UTC0), f"{UTC0}.000", f"{UTC0}000", f"{UTC0}000000", str((us + 11_644_473_600_000_000) * 10), f"/Date({UTC0}000)/"):
        assert read(t, False)[0] == us, t
    for t in ("", "never", "0", "9223372036854775807", "null", "--", "n/a", "2025-13-01", "2025-02-30 10:00", "2025-01-01 25:00", "2025-01-01 00:00 XYZ", "0001-01-01T00:00:00Z", "01/01/0001", "1601-01-01 00:00:00", "1970-01-01T00:00:00+00:00", "9999-12-31 23:59:59"):
        assert read(t, False) is None, t
    assert read("02/03/2025 00:00:00", True)[1] == UTC0 + 33 * 86400  # month first
    assert read("1970-01-01 00:00:01", False)[1] == 1 and read("0002-01-01", False) is not None


def test_zone_changes():
    z = Zone("Europe/Berlin")
    back = 1_761_445_800  # 2025-10-26 02:30 local as if UTC: happens twice
    assert z.utc(back) == back - 7200  # the earlier
    gap = 1_743_301_800  # 2025-03-30 02:30 local doesn't happen
    assert z.utc(gap) == gap - 3600


def test_hardware(one):
    from fleetweave.functions.hardware import hardware_fields

    got = one(hardware_fields, "CPU: i7 Processor: x; RAM = 16 GB &; Disk: 512, Disk: 9 serial number: AB1", None, "", "focus: none")
    assert got == [{"cpu": "i7 Processor: x", "ram": "16 GB", "storage": "512, Disk: 9", "serial_number": "AB1"}, {}, {}, {}]
