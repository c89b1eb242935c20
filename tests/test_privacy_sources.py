import base64
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from conductrisk.functions.pseudonym import mask, secret, token
from conductrisk.operators import privacy, timeline
from conductrisk.operators import telemetry as L
from conductrisk.session import fresh_path
from conductrisk.sources import readers, sinks


@pytest.fixture
def users(spark):
    return spark.createDataFrame([("User123", "pc1"), ("b", "pc2"), (None, "pc3")], "user string, pc string")


def test_mask(users):
    rows = users.select(mask(F.col("user"), "s1").alias("a"), mask(F.col("user"), "s2").alias("b")).collect()
    assert rows[0].a == hashlib.sha256(b"s1User123").hexdigest()[:32] and rows[0].a != rows[0].b
    assert rows[2].a is None


@pytest.mark.parametrize("key", [b"short", b"k" * 64, b"long" * 40])
def test_token_is_hmac(spark, users, key):
    got = users.filter("user = 'User123'").select(token(F.col("user"), secret(spark, key), "day")).first()[0]
    want = base64.urlsafe_b64encode(hmac.new(key, b"User123:day", hashlib.sha256).digest()).decode()
    assert got == want


def test_role_views(users):
    assert privacy.role_view(users, "Admin", "s").first().user == "User123"
    assert len(privacy.role_view(users, "Analyst", "s").first().user) == 32
    with pytest.raises(PermissionError):
        privacy.role_view(users, "Viewer", "s")


def test_encryption_and_erasure(spark):
    df = spark.createDataFrame([("a", "secret"), ("b", "other")], "user string, note string")
    keys = privacy.user_keys(df, b"master")
    box = privacy.encrypted(df, keys, ["note"])
    assert box.first().note != b"secret"
    assert {tuple(r) for r in privacy.decrypted(box, keys, ["note"]).collect()} == {("a", "secret"), ("b", "other")}
    requests = spark.createDataFrame([("a", "op"), ("zz", "op")], "user string, operator string")
    left, audit = privacy.erase(keys, requests)
    assert {r.user: r.note for r in privacy.decrypted(box, left, ["note"]).collect()} == {"a": None, "b": "other"}
    assert {r.user: r.success for r in audit.collect()} == {"a": True, "zz": False}


def test_access_decisions(spark):
    asked = [("Admin", "deanonymize", "x"), ("Admin", "erase", "x"), ("Compliance", "erase", None), ("Guest", "read", None), ("Viewer", "read", None)]
    df = spark.createDataFrame(asked, "role string, action string, justification string")
    got = {(r.role, r.action): (r.allowed, r.reason) for r in privacy.access_decisions(df, privacy.policy_table(spark)).collect()}
    assert got[("Admin", "deanonymize")] == (True, None) and got[("Viewer", "read")] == (True, None)
    assert got[("Admin", "erase")] == (False, "Role Admin cannot erase")
    assert got[("Compliance", "erase")] == (False, "Justification required")
    assert got[("Guest", "read")] == (False, "Unknown role: Guest")


def test_csv_log_tolerates_bad_values(spark, tmp_path):
    path = tmp_path / "file.csv"
    path.write_text("id,user,date,pc,filename,activity,to_removable_media\n1,U1,2024-01-01 08:00:00,P,f,File Copy,True\n2,U1,whenever,P,f,Shred,1\n")
    log = readers.read_log(spark, str(path), "file")
    rows = {r.id: r for r in log.collect()}
    assert rows["1"].date is not None and rows["2"].date is None
    good, bad = timeline.split_valid(log, "file")
    assert [r.id for r in good.collect()] == ["1"] and [r.id for r in bad.collect()] == ["2"]


def test_source_fallback(spark, tmp_path):
    raw = spark.sql("select '1' id, 'U' user, timestamp'2024-01-01 21:00:00' date, 'P' pc, 'File' source, 'File Copy' activity")
    sinks.write_table(raw, f"{tmp_path}/raw")
    rows = readers.read_featured_or_raw(spark, f"{tmp_path}/featured", f"{tmp_path}/raw").first()
    assert (rows.hour, rows.day_of_week, rows.is_after_hours, rows.usb_count) == (21, 0, 1, 0)
    sinks.write_table(spark.sql("select 'U' user, 3 usb_count"), f"{tmp_path}/featured")
    assert readers.read_featured_or_raw(spark, f"{tmp_path}/featured", f"{tmp_path}/raw").columns == ["user", "usb_count"]


def test_artifact_status(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.bin").write_bytes(b"12345")
    got = {r.name: (r.exists, r.size_bytes) for r in readers.artifact_status(spark, str(tmp_path / "m"), [("A", "a.bin"), ("B", "b.bin")]).collect()}
    assert got == {"A": (True, 5), "B": (False, None)}
    assert readers.artifact_status(spark, str(tmp_path / "none"), [("A", "a.bin")]).first().exists is False


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 20), ("c", 30)], "k string, v int")
    assert dict(L.upsert(old, new, "k").collect()) == {"a": 1, "b": 20, "c": 30}
    assert dict(L.insert_missing(old, new, "k").collect()) == {"a": 1, "b": 2, "c": 30}
    changes = spark.createDataFrame([("a", None), ("b", 5)], "k string, v int")
    assert dict(L.apply_changes(old, changes, "k").collect()) == {"a": 1, "b": 5}


def test_payload_defaults(spark):
    df = spark.createDataFrame([('{"user_id": "U1", "timestamp": "2024-01-01T08:00:00"}',), ("not json",)], "payload string")
    first, second = L.flatten_payload(df).collect()
    assert (first.user_id, first.mouse_velocity_avg, first.active_app, first.keystroke_count) == ("U1", 0.0, "unknown", 0)
    assert second.user_id is None


def test_timeline_sink_keeps_all_rows(spark):
    rows = spark.range(100).selectExpr("cast(id as string) id", "'U' user", "timestamp_seconds(1704067200 + id * 3600) date", "'P' pc", "'File' source", "'x' activity")
    path = fresh_path(spark, "t")
    sinks.write_timeline(rows, path)
    assert readers.read_timeline(spark, path).count() == 100


def test_release_deletes_intermediate_tables(spark):
    from conductrisk.session import release, stage
    from conductrisk.sources.readers import exists
    table = stage(spark.range(3), "range")
    path = table.inputFiles()[0].rsplit("/", 1)[0]
    assert table.count() == 3 and exists(spark, path)
    assert release(spark) >= 1 and not exists(spark, path)


def test_plans_do_not_show_the_key(spark):
    key = b"a-very-secret-key-0123456789"
    users = spark.createDataFrame([("a", "x"), ("b", "y")], "user string, activity string")
    keys = privacy.user_keys(users, key)
    for df in (privacy.pseudonymised(users, key, "day"), privacy.encrypted(users, keys, ["activity"])):
        df.collect()
        plan = df._jdf.queryExecution().toString()
        pads = [bytes(b ^ x for b in key.ljust(64, b"\0")).hex().upper() for x in (0x36, 0x5C)]
        assert not any(x in plan for x in (key.decode(), key.hex().upper(), *pads))
