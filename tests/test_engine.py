"""The engine over a store, from the catalogue file to restoring."""

from __future__ import annotations

import json
import shutil
import zipfile
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

import images
from sievecraft import cli
from sievecraft.config import EngineConfig
from sievecraft.engine import Engine
from sievecraft.functions.scalars import blob_path
from sievecraft.operators import embed
from sievecraft.operators.reports import thumb_sample
from sievecraft.sources import files
from sievecraft.streaming.ingest import burst_sessions, stream_census, windowed_arrivals

NOW = "2024-05-01T00:00:00+00:00"


def line(key, **more):
    return json.dumps({"media_key": key, "dedup_key": "d-" + key, "timestamp": 1000, "thumb": f"https://img/{key}=w1", "res_width": 100, "res_height": 100} | more)


CENSUS = [
    json.dumps({"_type": "quota", "totalUsed": 5}),
    json.dumps({"_type": "meta", "version": 2, "note": None}),
    "   ",
    line("mk1", is_favorite=True),
    line("mk2", timestamp=1001, duration=12.5),
    line("mk3", timestamp=1002, is_live_photo=True),
    line("mk4", timestamp=1003, in_album=True),
]


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/lib", EngineConfig(), lambda: NOW)
    (tmp_path / "census.jsonl").write_text("\n".join(CENSUS))
    return e


def test_import_safety_and_reports(engine, tmp_path):
    counts = engine.import_census(f"file://{tmp_path}/census.jsonl")
    assert counts == {"total": 4, "videos": 1, "live_photos": 1, "favorites": 1, "inserted": 4, "updated": 0}
    assert engine.safety() == {"favorites": 1, "album_members": 0, "videos": 1, "live_photos": 1, "total_excluded": 3}
    reasons = {r["media_key"]: r["exclude_reason"] for r in engine.table("photos").collect()}
    assert reasons == {"mk1": "favorite", "mk2": "video", "mk3": "live_photo", "mk4": None}
    meta = {r["key"]: r["value"] for r in engine.table("meta").collect()}
    assert meta["version"] == "2" and meta["note"] == "None" and "totalUsed" in meta["quota_baseline"] and meta["census_imported_at"] == NOW
    (tmp_path / "again.jsonl").write_text("\n".join([line("mk4", is_favorite=True), line("mk4", file_name="late.jpg"), line("mk5")]))
    assert engine.import_census(f"file://{tmp_path}/again.jsonl")["updated"] == 2
    rows = {r["media_key"]: r for r in engine.table("photos").collect()}
    assert rows["mk4"]["file_name"] == "late.jpg" and not rows["mk4"]["is_favorite"] and rows["mk1"]["excluded"] and len(rows) == 5
    report = {r["metric"]: r["value"] for r in cli.run(engine, "census-report").collect()}
    assert report["total"] == "5" and report["photos"] == "4"
    assert {r["metric"]: r["value"] for r in cli.run(engine, "status").collect()}["next_step"] == "fetch"


@pytest.mark.parametrize("bad", ["{broken", json.dumps({"media_key": "x"}), json.dumps({"media_key": "x", "dedup_key": "d", "res_width": "wide"}), json.dumps({"media_key": "x", "dedup_key": "d", "timestamp": 1.5})])
def test_one_bad_line_fails_the_import(engine, tmp_path, bad):
    (tmp_path / "bad.jsonl").write_text("\n".join([line("ok"), bad]))
    with pytest.raises(Exception):  # noqa: B017, PT011  Spark's kind of error depends on the line
        engine.import_census(f"file://{tmp_path}/bad.jsonl")
    assert engine.table("photos").count() == 0


def put(spark, tmp_path, pictures):
    """Zips of the pictures, and one entry that is no image."""
    (tmp_path / "zips").mkdir()
    with zipfile.ZipFile(tmp_path / "zips" / "thumbs_batch_1.zip", "w") as z:
        for key, data in pictures.items():
            z.writestr(f"{key}.png", data)
        z.writestr("mk0.jpg", b"<html> no image at all")
        z.writestr("notes.txt", b"x")
    with zipfile.ZipFile(tmp_path / "zips" / "other.zip", "w") as z:
        z.writestr("mk9.png", images.png(images.sky()))


def test_embedding_stops_where_thumbs_are_no_images(spark, engine, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(line(f"mk{k:02}", timestamp=9000 - k) for k in range(40)))
    engine.import_census(f"file://{tmp_path}/c.jsonl")
    engine.write_blobs(spark.createDataFrame([(f"mk{k:02}", bytearray(b"<html>please sign in")) for k in range(10)] + [(f"mk{k:02}", bytearray(images.png(images.sky()))) for k in range(20, 40)], "media_key string, content binary")).collect()
    engine.store.commit(photos=engine.table("photos").withColumn("thumb_cached", F.col("media_key") < "mk28"))

    def make_encoder():
        return lambda batch: np.ones((len(batch), 4))

    pending = embed.first_pending(embed.pending(engine.table("photos"), engine.table("embeddings")), 3)
    assert [r["media_key"] for r in pending.collect()] == ["mk27", "mk26", "mk25"]
    assert engine.embed(make_encoder, limit=3) == 3
    engine.store.commit(photos=engine.table("photos").withColumn("thumb_cached", F.col("media_key") < "mk26"))
    assert engine.embed(make_encoder) == 8  # 20 of the 25 that are left are bad
    engine.store.commit(photos=engine.table("photos").withColumn("thumb_cached", F.lit(True)), embeddings=engine.table("embeddings").limit(0))
    engine.write_blobs(spark.createDataFrame([(f"mk{k:02}", bytearray(b"{}")) for k in range(32, 40)], "media_key string, content binary")).collect()
    with pytest.raises(embed.InvalidThumbs, match="28 of 50 .*mk00: html"):
        engine.embed(make_encoder)
    assert engine.table("embeddings").count() == 0


def test_from_blobs_to_restore(spark, engine, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(line(f"mk{k}", timestamp=5000 + k, space_taken=1 << 20) for k in range(10)))
    engine.import_census(f"file://{tmp_path}/c.jsonl")
    shapes = [images.content(), images.content(), images.sky(), images.page()]
    put(spark, tmp_path, {f"mk{k}": images.png(x) for k, x in enumerate(shapes, start=1)})
    assert engine.import_zips(f"file://{tmp_path}/zips") == {"zips": 1, "ok": 4, "skipped": 0, "unknown_or_bad": 1}
    assert engine.import_zips(f"file://{tmp_path}/zips") == {"zips": 1, "ok": 0, "skipped": 4, "unknown_or_bad": 1}
    photos = engine.table("photos")
    assert tuple(thumb_sample(photos, files.cached_blobs(spark, photos, engine.blobs("thumbs"))).first()) == (4, 4)

    def make_encoder():
        def encode(batch):
            if len(batch) > 1:
                raise MemoryError
            return np.stack([x[::16, ::16][:6, :8].astype(float).ravel() for x in batch])

        return encode

    engine.cfg = replace(engine.cfg, time_cosine=0.999, global_cosine=0.999)
    counters = engine.pipeline(make_encoder)
    assert counters["groups"] == 1 and counters["members"] == 2
    shown = engine.next_group().collect()
    keys = [m["media_key"] for m in shown[0]["members"]]
    assert set(keys) == {"mk1", "mk2"} and shown[0]["members"][0]["is_proposed_keeper"] and shown[0]["proposed_keeper"] == "mk1"
    assert engine.embed(make_encoder) == 4  # nothing pending: the same vectors

    group = shown[0]["group_id"]
    act = lambda action, keep=(): engine.decide(spark.createDataFrame([(group, action, list(keep))], "group_id string, action string, keep_keys array<string>")).collect()[0]
    assert act("override", ["nobody"])["error"] == "keep_media_key is not in this group"
    assert act("dance")["error"] == "unknown action dance"
    assert act("skip")["status"] == "skipped" and engine.table("decisions").count() == 0
    assert act("accept")["status"] == "accepted"
    done = engine.table("decisions").collect()[0]
    assert (done["keep_media_key"], done["trash_dedup_keys"], done["applied"]) == ("mk1", ["d-mk2"], False)
    dry = engine.dry_run().collect()[0]
    assert dry["items_to_trash"] == 1 and dry["estimated_bytes"] == 1 << 20 and dry["safe_to_apply"]
    path = engine.export_trash("run-1").removeprefix("file://")
    payload = json.loads("".join(p.read_text() for p in sorted(__import__("pathlib").Path(path).glob("part-*"))))
    assert payload["item_count"] == 1 and payload["items"] == [{"media_key": "mk2", "dedup_key": "d-mk2", "group_id": group}]

    (tmp_path / "undo.json").write_text(json.dumps({"run_id": "run-1", "items": [{"dedup_key": "d-mk2", "media_key": "mk2"}]}))
    assert engine.import_undo(f"file://{tmp_path}/undo.json", strict=True) == 1
    assert engine.table("decisions").collect()[0]["applied"]
    assert engine.export_restore().endswith("restore_run-1")
    assert engine.mark_restored("run-1") == 1
    with pytest.raises(ValueError, match="no unrestored"):
        engine.export_restore()
    assert engine.store.vacuum("photos") >= 1 and engine.table("photos").count() == 10

    engine.scan_text(("thumbs",))
    assert [r["media_key"] for r in engine.table("text_flags").where("is_text").collect()] == ["mk4"]
    engine.decide_text(spark.createDataFrame([("mk4", "accept")], "media_key string, action string"))
    engine.scan_text(("thumbs",))  # a new scan keeps the decision
    assert engine.table("text_flags").where("is_text").first()["review_status"] == "accepted" and engine.next_text().count() == 0
    engine.export_accepted_text(f"file://{tmp_path}/accepted")
    engine.scan_corrupt()
    assert engine.table("corrupt_flags").count() == 4


def test_corrupt_verdicts_on_a_tree(spark, engine, tmp_path):
    root = tmp_path / "tree"
    (root / "sub").mkdir(parents=True)
    whole = images.jpeg(spark, images.content(), tmp_path)
    noisy = images.jpeg(spark, np.random.default_rng(4).integers(0, 255, (192, 256, 3)).astype(np.uint8), tmp_path)
    (root / "ok.jpg").write_bytes(whole)
    (root / "sky.PNG").write_bytes(images.png(images.sky()))
    (root / "sub" / "cut.jpg").write_bytes(images.truncated(noisy, 0.25))
    (root / "sub" / "noend.jpg").write_bytes(whole[:-2])
    (root / "page.jpg").write_bytes(b"<!DOCTYPE html><html><body>no</body></html>")
    (root / "short.jpg").write_bytes(b"x")
    (root / "readme.txt").write_bytes(b"x")
    to = tmp_path / "flagged"
    (to / "sub").mkdir(parents=True)
    (to / "sub" / "cut.jpg").write_bytes(b"taken, and long enough")
    rows = engine.scan_tree(f"file://{root}", report=f"file://{tmp_path}/report", to=f"file://{to}", copy=True).collect()
    got = {r["path"].rsplit("/", 1)[1]: r for r in rows}
    assert {k: list(r["reasons"]) for k, r in got.items()} == {"ok.jpg": [], "sky.PNG": [], "cut.jpg": ["decoder_fill"], "noend.jpg": ["truncated_jpeg"], "page.jpg": ["not_an_image"], "short.jpg": ["empty"]}
    assert got["cut.jpg"]["fill_color"] == [128, 128, 128] and got["cut.jpg"]["fill_fraction"] >= 0.08 and got["ok.jpg"]["width"] == 256
    assert sorted(str(p.relative_to(to)) for p in to.rglob("*.jpg")) == ["page.jpg", "short.jpg", "sub/cut.jpg", "sub/cut_1.jpg", "sub/noend.jpg"]


def test_review_of_corrupt_items(spark, engine):
    flags = spark.createDataFrame([("a", True, None), ("b", True, "pending"), ("c", False, None)], "media_key string, corrupted boolean, review_status string")
    engine.store.commit(corrupt_flags=flags)
    act = lambda rows: engine.decide_corrupt(spark.createDataFrame(rows, "media_key string, action string"))
    act([("a", "trash")])
    assert {r["media_key"]: r["review_status"] for r in engine.table("corrupt_flags").collect()} == {"a": "trash", "b": "pending", "c": None}
    for bad in ([("a", "burn")], [("c", "keep")], [("z", "keep")]):
        with pytest.raises(Exception, match="unknown action|not flagged"):
            act(bad)


def test_cookies(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# Netscape\n#HttpOnly_.x.org\tTRUE\t/\tTRUE\t0\tSID\tv1\n.x.org\tFALSE\t/\tFALSE\t99\tother\tv 2\nbroken line\n")
    got = files.read_cookies(spark, f"file://{tmp_path}/c.txt")
    assert [tuple(r) for r in got.collect()] == [(".x.org", True, True, "/", True, None, "SID", "v1"), (".x.org", False, False, "/", False, 99, "other", "v 2")]
    assert files.cookies_look_usable(got).first()["usable"] and not files.cookies_look_usable(got.where("name = 'other'")).first()["usable"]


def test_fetching(spark):
    image = images.png(images.sky())

    def make():
        tries = {}

        def fetch(url):
            tries[url] = tries.get(url, 0) + 1
            if "flaky" in url and tries[url] < 3:
                raise OSError("reset")
            return (404, b"") if "gone" in url else (200, b"<html>sign in, please</html>") if "page" in url else (200, image)

        return fetch

    urls = spark.createDataFrame([(k, f"http://x/{k}") for k in ("good", "flaky", "gone", "page")], "media_key string, url string")
    got = {r["media_key"]: r for r in files.fetch_images(urls, make, tasks=2, pause=lambda s: None).collect()}
    assert {k: r["ok"] for k, r in got.items()} == {"good": True, "flaky": True, "gone": False, "page": False}
    assert got["gone"]["error"] == "status 404" and got["page"]["error"] == "not an image"
    refused = files.fetch_images(spark.createDataFrame([(str(k), "u") for k in range(12)], "media_key string, url string"), lambda: lambda u: (403, b""), tasks=1, pause=lambda s: None)
    assert refused.where("error like 'stopped%'").count() == 4


def test_vector_blobs_round_trip(spark):
    v = np.array([0.5, -1.25, 3], dtype=np.float32)
    got = embed.unpack(spark.createDataFrame([("a", embed.pack(v))], "media_key string, vector binary")).collect()[0]
    assert got["dim"] == 3 and got["vector"] == v.tolist()


def test_blob_path(spark):
    got = spark.createDataFrame([("mediaKey-123",), ("a/b é",)], "k string").select(blob_path(__import__("pyspark").sql.functions.col("k"), "root").alias("p")).collect()
    assert got[0]["p"] == "root/39/dc/mediaKey-123.jpg" and got[1]["p"].endswith("/a_b_é.jpg")


def test_streamed_imports(spark, engine, tmp_path):
    folder = tmp_path / "arriving"
    folder.mkdir()
    (folder / "1.jsonl").write_text("\n".join([line("a"), line("b", is_favorite=True)]))
    run = lambda: stream_census(spark, f"file://{folder}", engine.store, f"file://{tmp_path}/ck").awaitTermination(120)
    run()
    assert {r["media_key"]: r["excluded"] for r in engine.table("photos").collect()} == {"a": False, "b": True}
    (folder / "2.jsonl").write_text(line("c"))
    run()
    run()
    assert engine.table("photos").count() == 3


def test_streamed_windows_and_bursts(spark, tmp_path):
    at = f"{tmp_path}/events"
    shutil.copytree("/root/testdata/sf0.001/events.parquet", at) if __import__("os").path.isdir("/root/testdata/sf0.001/events.parquet") else (__import__("os").mkdir(at), shutil.copy("/root/testdata/sf0.001/events.parquet", f"{at}/p.parquet"))
    batch = spark.read.parquet(f"file://{at}")
    stream = lambda: spark.readStream.schema(batch.schema).parquet(f"file://{at}")
    own = stream()
    q = windowed_arrivals(own.withColumn("ts", own.ts.cast("timestamp"))).writeStream.outputMode("complete").format("memory").queryName("arrivals").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("arrivals").agg({"n": "sum"}).first()[0] == batch.count()
    q = burst_sessions(stream(), 3600).writeStream.outputMode("update").format("memory").queryName("bursts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    times: dict[int, list] = {}
    for r in batch.collect():
        times.setdefault(r["user_id"], []).append(r["ts"])
    want = {}
    for user, own in times.items():
        own = sorted(int((t - __import__("datetime").datetime(1970, 1, 1)).total_seconds()) for t in own)
        want[user] = (1 + sum(b - a > 3600 for a, b in zip(own, own[1:], strict=False)), len(own))
    assert {r["user_id"]: (r["bursts"], r["shots"]) for r in spark.table("bursts").collect()} == want


def test_config_from_environment(monkeypatch):
    monkeypatch.setenv("SIEVECRAFT_TOPK", "7")
    monkeypatch.setenv("SIEVECRAFT_EXCLUDE_ALBUM_MEMBERS", "true")
    cfg = EngineConfig.from_env()
    assert cfg.topk == 7 and cfg.exclude_album_members and abs(sum(cfg.weights.values()) - 1) < 1e-9


def test_values_written_as_strings(engine, tmp_path):
    (tmp_path / "s.jsonl").write_text(json.dumps({"media_key": "a", "dedup_key": "d", "timestamp": "12", "res_width": 3.0, "is_favorite": "yes", "duration": "2.5"}))
    engine.import_census(f"file://{tmp_path}/s.jsonl")
    r = engine.table("photos").first()
    assert (r["timestamp"], r["res_width"], r["is_favorite"], r["duration"], r["is_video"]) == (12, 3, True, 2.5, True)


def test_a_commit_that_stops_changes_nothing(engine, spark, monkeypatch):
    """Stopped between any two steps: before the manifest, and between its writing and its renaming."""
    one = spark.createDataFrame([("a", "1")], "key string, value string")
    engine.store.commit(meta=one)
    real = engine.store._publish

    def stop(written):
        raise KeyboardInterrupt

    monkeypatch.setattr(engine.store, "_publish", stop)
    with pytest.raises(KeyboardInterrupt):
        engine.store.commit(meta=one.limit(0), undo_log=engine.table("undo_log"))
    monkeypatch.setattr(engine.store, "_publish", real)
    at = engine.store.root.removeprefix("file://") + "/_manifests"
    (__import__("pathlib").Path(at) / ".half.partial").write_text("{")
    assert [tuple(r) for r in engine.table("meta").collect()] == [("a", "1")] and engine.store.current("undo_log") is None
    engine.store.commit(meta=one.limit(0))
    assert engine.table("meta").count() == 0 and engine.store.vacuum("meta") == 2


def test_blobs_need_a_mounted_folder(spark, tmp_path):
    e = Engine(spark, "hdfs://host/library", EngineConfig(), lambda: NOW)
    with pytest.raises(ValueError, match="mount"):
        e.write_blobs(spark.createDataFrame([("a", b"x")], "media_key string, content binary"))
    assert Engine(spark, "hdfs://host/library", blob_root=f"file://{tmp_path}").blobs("thumbs") == f"file://{tmp_path}/blobs/thumbs"


WEBP = b"RIFF\x1a\0\0\0WEBPVP8L\x0d\0\0\0\x2f\0\0\0\x10\x07\x10\x11\x11\x88\x88\xfe\x07\0"


def test_webp_is_not_corrupt(spark, engine, tmp_path):
    """Without a decoder it isn't judged; with one it is an image like others."""
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.webp").write_bytes(WEBP)
    engine.make_decoder = lambda: None
    r = engine.scan_tree(f"file://{tmp_path}/tree").collect()
    assert [(x["corrupted"], list(x["reasons"]), x["error"]) for x in r] == [(None, [], "format not supported")]
    pixels = images.content()
    engine.make_decoder = lambda: lambda data: pixels
    r = engine.scan_tree(f"file://{tmp_path}/tree").collect()
    assert [(x["corrupted"], x["width"]) for x in r] == [(False, 256)]
    assert not engine.scan_tree(f"file://{tmp_path}/tree", "text").first()["is_text"]


def test_zip_entries_match_bare_names(spark, engine, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join([line("a_b"), line("vid", duration=3)]))
    engine.import_census(f"file://{tmp_path}/c.jsonl")
    (tmp_path / "zips").mkdir()
    with zipfile.ZipFile(tmp_path / "zips" / "z.zip", "w") as z:
        for name in ("in/a_b.png", "vid.png", "a_b.gif", "other.png"):
            z.writestr(name, images.png(images.sky()))
    assert engine.import_zips(f"file://{tmp_path}/zips") == {"zips": 1, "ok": 1, "skipped": 0, "unknown_or_bad": 2}


def test_status_asks_for_repair(engine, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join([line("a"), line("b")]))
    engine.import_census(f"file://{tmp_path}/c.jsonl")
    engine.store.commit(photos=engine.table("photos").withColumn("thumb_cached", __import__("pyspark").sql.functions.lit(True)))
    assert engine.status().first()["next_step"] == "repair"


def test_command_line_factories(engine):
    assert cli.factory("json:dumps") is json.dumps and {"embed", "fetch", "review"} <= set(cli.COMMANDS)
    assert set(a for _, a in cli.OPTIONAL) <= {x for names, _ in cli.COMMANDS.values() for x in names}
