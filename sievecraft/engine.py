"""The engine over a snapshot store: each method reads tables, runs one plan, and commits tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig
from .functions.kernels import FaceModel
from .functions.scalars import blob_path, sized_url
from .operators.vectors import neighbour_percentiles
from .operators import apply, classify, embed, grouping, reports, review, safety, scoring, upsert
from .plans.lineage import materialise
from .plans.store import SnapshotStore
from .sources import census, files, sinks


def utc_now() -> str:
    return datetime.now(UTC).isoformat()


class Engine:
    """``root`` holds tables/ and exports/, in any file system that Spark knows; ``blob_root`` (``root`` if not given) holds
    blobs/{thumbs,previews,full}/, a folder that all executors mount, as image files are written there by their workers.
    ``now`` gives the clock, so that runs can be repeated; ``make_decoder`` decodes what Spark's image source can't."""

    def __init__(self, spark: SparkSession, root: str, cfg: EngineConfig = EngineConfig(), now: Callable[[], str] = utc_now, blob_root: str | None = None, make_decoder: Callable[[], files.Decoder | None] = files.pillow_decoder):
        self.spark, self.root, self.cfg, self.now, self.make_decoder = spark, root.rstrip("/"), cfg, now, make_decoder
        self.blob_root = (blob_root or root).rstrip("/")
        self.store = SnapshotStore(spark, f"{self.root}/tables")

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def blobs(self, kind: str) -> str:
        return f"{self.blob_root}/blobs/{kind}"

    # ---- catalogue

    def import_census(self, path: str) -> dict:
        """Upsert a catalogue file; one bad line fails the whole import. Counts are per line."""
        found = census.read_census(self.spark, path)
        old = self.table("photos")
        found.items = materialise(found.items, "census-items")  # parsed once
        counts = upsert.import_counters(old, found.items).first().asDict()
        stamp = self.spark.createDataFrame([("census_imported_at", self.now())], "key string, value string")
        meta = upsert.upsert_meta(self.table("meta"), found.meta).where("key != 'census_imported_at'").unionByName(stamp)
        self.store.commit(photos=upsert.upsert_photos(old, found.items), meta=meta)
        return counts

    def census_report(self) -> DataFrame:
        return reports.census_report(self.table("photos"), self.table("groups"))

    def status(self) -> DataFrame:
        """The funnel, with the advice to repair if most of some cached thumbs aren't there."""
        photos = self.table("photos")
        seen = reports.thumb_sample(photos, files.cached_blobs(self.spark, photos, self.blobs("thumbs"))).first()
        missing = bool(seen["sampled"]) and 2 * seen["valid"] < seen["sampled"]
        return reports.status_funnel(*(self.table(t) for t in ("photos", "embeddings", "groups", "corrupt_flags", "text_flags")), missing=missing)

    # ---- blobs

    def valid_blobs(self, kind: str = "thumbs") -> DataFrame:
        from .functions.image_bytes import looks_like_image

        return files.cached_blobs(self.spark, self.table("photos"), self.blobs(kind)).where(looks_like_image(F.col("content")))

    def scan_thumbs(self, repair: bool = False) -> int:
        """Set the flag of keys with a valid thumb; with ``repair``, clear the others'."""
        photos = upsert.mark_cached(self.table("photos"), self.valid_blobs().select("media_key"), "thumb_cached", repair)
        self.store.commit(photos=photos)
        return self.table("photos").where("thumb_cached").count()

    def write_blobs(self, images: DataFrame, kind: str = "thumbs") -> DataFrame:
        """Write (media_key, content) rows to their hashed paths, each by a rename; (media_key, ok)."""
        import os

        root = sinks.mounted(self.blobs(kind))

        def run(batches):
            for b in batches:
                for path, content in zip(b["path"], b["content"], strict=True):
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(path + ".partial", "wb") as f:
                        f.write(content)
                    os.replace(path + ".partial", path)
                yield b[["media_key"]].assign(ok=[os.path.getsize(p) == len(c) for p, c in zip(b["path"], b["content"], strict=True)])

        named = images.select("media_key", "content", blob_path(F.col("media_key"), root).alias("path"))
        return named.mapInPandas(run, "media_key string, ok boolean")

    def import_zips(self, folder: str) -> dict:
        """Counts of zips and entries: ok, skipped, unknown_or_bad."""
        judged = materialise(files.judge_entries(files.zip_entries(self.spark, folder), self.table("photos"), self.valid_blobs()), "zip-entries")
        counts = files.zip_counters(judged).first().asDict()
        self.write_blobs(files.read_zips(judged)).where("ok").count()
        self.scan_thumbs()
        return counts

    def fetch(self, make_fetcher: Callable[[], files.Fetcher], kind: str = "thumbs", only_group_members: bool = False, limit: int | None = None) -> DataFrame:
        """Fetch missing images of photos that aren't videos; (ok, failed) counts. The fetcher is the caller's."""
        px = {"thumbs": self.cfg.thumb_px, "previews": self.cfg.preview_px, "full": self.cfg.full_px}[kind]
        wanted = self.table("photos").where(F.col("thumb").isNotNull() & (F.col("thumb") != "") & ~F.col("is_video"))
        if only_group_members:
            wanted = wanted.join(self.table("group_members").select("media_key").distinct(), "media_key", "left_semi")
        wanted = wanted.join(self.valid_blobs(kind).select("media_key"), "media_key", "left_anti").orderBy("timestamp", "media_key")
        wanted = wanted.limit(limit) if limit else wanted
        urls = wanted.select("media_key", sized_url(F.col("thumb"), px).alias("url"))
        got = files.fetch_images(urls, make_fetcher, self.cfg.fetch_concurrency, self.cfg.fetch_retries, self.cfg.auth_failure_limit)
        got = materialise(got, "fetched")  # fetched once
        self.write_blobs(got.where("ok"), kind).where("ok").count()
        return got.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))

    def images(self, *kinds: str) -> DataFrame:
        """(media_key, width, height, channels, bgr): the first of ``kinds`` that decodes."""
        sources = []
        for kind in kinds or ("previews", "thumbs"):
            root = self.blobs(kind).removeprefix("file://")
            named = self.table("photos").select("media_key", blob_path(F.col("media_key"), root).alias("path"))
            others = files.decode_others(files.cached_blobs(self.spark, self.table("photos"), self.blobs(kind)), self.make_decoder)
            sources.append(named.join(files.decode_images(self.spark, self.blobs(kind)).unionByName(others), "path").drop("path"))
        return scoring.best_image(*sources)

    # ---- safety, vectors, groups, scores

    def safety(self) -> dict:
        photos = safety.apply_exclusions(self.table("photos"), self.cfg)
        groups, members, decisions = safety.cascade(photos, self.table("groups"), self.table("group_members"), self.table("decisions"))
        counts = safety.exclusion_counts(photos, self.cfg).first().asDict()
        self.store.commit(photos=photos, groups=groups, group_members=members, decisions=decisions)
        return counts

    def embed(self, make_encoder: Callable[[], embed.Encoder], limit: int | None = None) -> int:
        """Embed pending photos, or the ``limit`` oldest of them. A model is plugged in; a rerun resumes.

        Raises InvalidThumbs, before a model is made, if half of the 50 oldest have no image behind them.
        """
        todo = embed.pending(self.table("photos"), self.table("embeddings"))
        if limit is not None:
            todo = embed.first_pending(todo, limit)
        some = embed.first_pending(todo)
        bad = embed.bad_thumbs(some, files.cached_blobs(self.spark, some, self.blobs("thumbs"))).orderBy("media_key").collect()
        if len(bad) > embed.MOST_BAD:
            named = ", ".join(f"{r['media_key']}: {r['found']}" for r in bad[:5])
            raise embed.InvalidThumbs(f"{len(bad)} of {embed.SAMPLE} sampled thumbs are not images ({named}); clear and fetch them anew, then embed")
        new = embed.embed(self.images("thumbs").join(todo.select("media_key"), "media_key", "left_semi"), make_encoder, self.cfg)
        self.store.commit(embeddings=upsert.upsert_vectors(self.table("embeddings"), new))
        done = self.table("embeddings").select(F.col("media_key").alias("_k"))
        photos = self.table("photos").join(done, F.col("media_key") == F.col("_k"), "left").withColumn("embedded", F.col("_k").isNotNull()).drop("_k")
        self.store.commit(photos=photos)
        return done.count()

    def group(self) -> dict:
        """Replace all groups; decisions on the old ones go with them."""
        found = grouping.build_groups(self.table("photos"), self.table("embeddings"), self.cfg)
        nothing = lambda c, kind: F.lit(None).cast(kind).alias(c)
        groups = found.members.groupBy("group_id").agg(F.count("*").cast("int").alias("size")).select("group_id", "size", nothing("proposed_keeper", "string"), F.lit("pending").alias("status"), nothing("override_keeper", "string"), nothing("reviewed_at", "string"))
        members = found.members.select("group_id", "media_key", *[nothing(c, "double") for c in ("score", *scoring.COMPONENTS)], F.lit(False).alias("is_proposed_keeper"))
        self.store.commit(groups=groups, group_members=members, decisions=self.table("decisions").limit(0))
        if not found.counters["groups"]:
            p99 = neighbour_percentiles(found.neighbours).first()["p99"]
            return found.counters | {"try_global_cosine": grouping.no_group_hint(p99)}
        return found.counters

    def score(self, make_face: Callable[[], FaceModel] | None = None) -> int:
        features = scoring.image_features(self.images(), make_face)
        picked = scoring.pick_keepers(scoring.score_members(self.table("group_members"), self.table("photos"), features, self.cfg))
        members = picked.select("group_id", "media_key", "score", *scoring.COMPONENTS, "is_proposed_keeper")
        self.store.commit(group_members=members, groups=scoring.propose(self.table("groups"), picked))
        return self.table("groups").count()

    def pipeline(self, make_encoder: Callable[[], embed.Encoder] | None = None, make_face: Callable[[], FaceModel] | None = None) -> dict:
        """Safety, embedding of what is pending, grouping, scoring; stops when there are no groups."""
        self.safety()
        if make_encoder:
            self.embed(make_encoder)
        counters = self.group()
        if counters["groups"]:
            self.score(make_face)
        return counters

    # ---- classifiers

    def _scan(self, features: Callable, verdicts: Callable, kinds: tuple[str, ...]) -> DataFrame:
        images = self.images(*kinds).withColumnRenamed("media_key", "path")
        blobs = None
        for kind in kinds:
            found = files.cached_blobs(self.spark, self.table("photos"), self.blobs(kind)).select(F.col("media_key").alias("path"), "content")
            blobs = found if blobs is None else blobs.unionByName(found.join(blobs.select("path"), "path", "left_anti"))
        return verdicts(blobs, features(images), self.cfg).withColumnRenamed("path", "media_key").drop("width", "height", "error").withColumn("scanned_at", F.lit(self.now())).transform(lambda x: materialise(x, "verdicts"))

    def scan_corrupt(self, kinds: tuple[str, ...] = ("thumbs",)) -> DataFrame:
        found = self._scan(classify.fill_features, classify.corrupt_verdicts, kinds)
        self.store.commit(corrupt_flags=upsert.upsert_flags(self.table("corrupt_flags"), found, "corrupted", upsert.CORRUPT_FINAL))
        return classify.scan_stats(found, "corrupted", self.table("photos").where("thumb_cached").select("media_key"))

    def scan_text(self, kinds: tuple[str, ...] = ("previews", "thumbs")) -> DataFrame:
        found = self._scan(classify.text_features, classify.text_verdicts, kinds)
        self.store.commit(text_flags=upsert.upsert_flags(self.table("text_flags"), found, "is_text", upsert.TEXT_FINAL))
        return classify.scan_stats(found, "is_text", self.table("photos").where("thumb_cached").select("media_key"))

    def scan_tree(self, root: str, what: str = "corrupt", report: str | None = None, to: str | None = None, copy: bool = False) -> DataFrame:
        """Verdicts on all images under a folder; flagged ones are moved or copied to ``to`` if given. Files under ``to`` are left out."""
        found = files.scan_images(self.spark, root)
        if to:
            found = found.where(~F.col("path").startswith(to.removeprefix("file://").rstrip("/") + "/"))
        images = files.decode_images(self.spark, root).unionByName(files.decode_others(found, self.make_decoder))
        verdicts = classify.corrupt_verdicts(found, classify.fill_features(images), self.cfg) if what == "corrupt" else classify.text_verdicts(found, classify.text_features(images), self.cfg)
        verdicts = materialise(verdicts, "tree-verdicts")
        if report:
            sinks.write_report(verdicts.orderBy("path"), report)
        if to:
            flagged = verdicts.where("corrupted" if what == "corrupt" else "is_text").select("path")
            taken = files.scan_images(self.spark, to).select("path") if files.exists(self.spark, to) else None
            sinks.relocate(sinks.plan_moves(flagged, sinks.mounted(root), sinks.mounted(to), taken), copy).count()
        return verdicts

    def export_accepted_text(self, path: str) -> None:
        sinks.accepted_text(self.table("text_flags"), self.table("photos")).coalesce(1).write.mode("overwrite").json(path)

    # ---- review

    def next_group(self, after: str | None = None) -> DataFrame:
        """The next pending group with its members; empty when the queue is."""
        found = review.next_pending(self.table("groups"), after)
        members = self.table("group_members").join(found.select("group_id"), "group_id", "left_semi")
        return found.join(review.member_views(members, self.table("photos")), "group_id", "left")

    def group_view(self, group_id: str) -> DataFrame:
        own = F.col("group_id") == group_id
        return self.table("groups").where(own).join(review.member_views(self.table("group_members").where(own), self.table("photos")), "group_id", "left")

    def queue(self) -> DataFrame:
        return review.queue_counts(self.table("groups"))

    def decide(self, actions: DataFrame) -> DataFrame:
        """Apply (group_id, action, keep_keys) rows; returns what became of each, with errors."""
        groups = self.table("groups")
        done = review.decide(actions, groups, self.table("group_members"), self.table("photos")).cache()
        new = review.new_decisions(done, self.now())
        self.store.commit(groups=review.decided_groups(groups, done, self.now()), decisions=upsert.upsert_decisions(self.table("decisions"), new))
        return done

    def next_corrupt(self, after: str | None = None) -> DataFrame:
        return review.next_flagged(self.table("corrupt_flags"), self.table("photos"), "corrupted", after)

    def next_text(self, after: str | None = None) -> DataFrame:
        return review.next_flagged(self.table("text_flags"), self.table("photos"), "is_text", after)

    def decide_corrupt(self, actions: DataFrame) -> None:
        self.store.commit(corrupt_flags=review.decide_items(self.table("corrupt_flags"), actions, "corrupted", review.CORRUPT_ACTIONS))

    def decide_text(self, actions: DataFrame) -> None:
        self.store.commit(text_flags=review.decide_items(self.table("text_flags"), actions, "is_text", review.TEXT_ACTIONS))

    # ---- export, undo, restore

    def dry_run(self) -> DataFrame:
        return apply.dry_run(self.table("groups"), self.table("decisions"), self.table("photos"), self.table("corrupt_flags"))

    def export_trash(self, run_id: str, path: str | None = None) -> str:
        path = path or f"{self.root}/exports/trash"
        sinks.write_document(apply.export_trash(self.table("groups"), self.table("decisions"), self.table("photos"), self.table("corrupt_flags"), run_id, self.now()), path)
        return path

    def import_undo(self, path: str, strict: bool = False) -> int:
        """Append an undo file to the log and mark decisions applied: all, or with ``strict`` those the log covers."""
        new = files.read_undo_log(self.spark, path)
        log = apply.import_undo(self.table("undo_log"), new, self.now())
        self.store.commit(undo_log=log, decisions=apply.mark_applied(self.table("decisions"), self.now(), new if strict else None))
        for r in new.select("run_id").distinct().collect():  # one archive per run
            sinks.write_document(apply.payload(new.where(F.col("run_id") == r["run_id"]).select("dedup_key", "media_key", "trashed_at"), r["run_id"]), f"{self.root}/undo/{r['run_id']}")
        return new.count()

    def export_restore(self, run_id: str | None = None) -> str:
        log = self.table("undo_log")
        run = run_id or (apply.latest_run(log).first() or {"run_id": None})["run_id"]
        if run is None:
            raise ValueError("no unrestored undo entries")
        path = f"{self.root}/exports/restore_{run}"
        sinks.write_document(apply.payload(apply.restore_items(log, run), run), path)
        return path

    def mark_restored(self, run_id: str) -> int:
        log = self.table("undo_log")
        self.store.commit(undo_log=apply.mark_restored(log, run_id))
        return self.table("undo_log").where(F.col("run_id") == run_id).count()
