"""An index folder: versioned tables, a run log, incremental updates, tags and searches."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import FIELDS, ascii_key, strip
from scriptorium.operators import snapshot as snap
from scriptorium.operators import tags as tag_ops
from scriptorium.operators.filters import MAX_LIMIT, subtree_prefix, tag_key, with_mark
from scriptorium.operators.postings import corpus_stats, path_shard, path_shard_of, posting_blocks, postings
from scriptorium.operators.query import Tagged
from scriptorium.plans import segments
from scriptorium.plans.batch import search_many
from scriptorium.plans.corpus import (
    Corpus,
    empty_tags,
    file_size,
    listed_bytes,
    shard_count,
    write_documents,
    write_postings,
)
from scriptorium.plans.ordered import Interval, Ranges, beneath, within, write_ordered
from scriptorium.plans.search import search
from scriptorium.sources.documents import listing_of, rows_from_table
from scriptorium.sources.files import failures, normal_root, oversized, read_files, rows_of, scan_files

RUN_COLUMNS = (
    "walked", "txt", "md", "unchanged", "upserted", "pruned", "unreadable", "kept", "never_indexed", "errors",
)
RUN_SCHEMA = (
    "run_at timestamp, corpus_root string, " + ", ".join(f"{c} bigint" for c in RUN_COLUMNS) + ", last_run_stats string"
)
#: The root of an index over a table, unless it is given one.
TABLE_ROOT = "table:"
#: Folders of an index that only the run that wrote them reads.
SCRATCH = ("listing", "changes", "read", "removed", "outcome")


def run_row(stats: DataFrame, root: str, run_at: Column | None = None) -> DataFrame:
    """One log row: the counters of :func:`snapshot.run_stats` with their JSON form."""
    summary = F.to_json(
        F.struct("walked", "upserted", "unchanged", "pruned", F.col("unreadable").alias("dataless"), "errors")
    )
    return stats.select(
        (F.current_timestamp() if run_at is None else run_at).alias("run_at"),
        F.lit(root).alias("corpus_root"),
        *RUN_COLUMNS,
        summary.alias("last_run_stats"),
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of a run log."""
    runs = spark.read.parquet(path)
    latest = runs.agg(F.max_by(F.struct(*runs.columns), "run_at").alias("r"))
    return latest.select("r.*")


class Index:
    """A corpus index below ``location``.

    Every change writes new parts to fresh folders and then one version file that names all parts, so readers
    always see a complete version and a failed run leaves the last one in place. What a change writes is in proportion
    to it; :mod:`scriptorium.plans.segments` says how. :meth:`compact` merges parts and logs, :meth:`vacuum` drops folders
    that no version needs; both run only when called.
    """

    def __init__(self, spark: SparkSession, location: str):
        self.spark = spark
        self.location = location.rstrip("/")

    # -- state -----------------------------------------------------------------------------------

    def _states(self):
        """Names of the version files, and the Hadoop calls to use them with."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.location}/state")
        store = folder.getFileSystem(conf)
        names = [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []
        return sorted(n for n in names if n.endswith(".json") and not n.startswith(("_", "."))), folder, store, jvm

    def _state(self) -> dict | None:
        names, folder, store, jvm = self._states()
        if not names:
            return None
        return self._read_state(store, jvm, folder, names[-1])

    @staticmethod
    def _read_state(store, jvm, folder, name: str) -> dict:
        stream = store.open(jvm.org.apache.hadoop.fs.Path(folder, name))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, state: dict, run: dict | None = None) -> None:
        """Write the next version: one file with all table places and, after an update, the run's counters.

        The file gets its name in one step that fails if another writer has made that version.
        """
        _, folder, store, jvm = self._states()
        state = {**state, "version": state.get("version", 0) + 1, "run": run}
        path = jvm.org.apache.hadoop.fs.Path
        draft, final = path(folder, f".{uuid.uuid4().hex}"), path(folder, f"v{state['version']:012d}.json")
        stream = store.create(draft, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            folder.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()
        )
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(draft, final, options)
        except Py4JJavaError as error:
            store.delete(draft, False)
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            raise RuntimeError(f"version {state['version']} was written by another writer; run again") from error

    def _require(self) -> dict:
        state = self._state()
        if state is None:
            raise ValueError("the index is empty; update it first")
        return state

    def _fresh(self, name: str) -> str:
        return f"{self.location}/{name}/{'part=' if name in segments.SCHEMAS else ''}{uuid.uuid4().hex}"

    def _saved(self, name: str, frame: DataFrame) -> DataFrame:
        path = self._fresh(name)
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def _part(self, state: dict, name: str) -> DataFrame:
        return segments.read(self.spark, name, state["tables"][name])

    def _log(self, state: dict, name: str) -> DataFrame | None:
        """A log that is mostly empty; None leaves its join out of a plan."""
        return self._part(state, name) if state["tables"][name] else None

    def _assignments(self, state: dict) -> DataFrame:
        return segments.live_assignments(
            self._part(state, "assigned"), self._log(state, "unassigned"), self._log(state, "dropped")
        )

    def _documents(self, state: dict) -> DataFrame:
        return segments.live(self._part(state, "documents"), self._log(state, "tombstones"))

    def _catalog(self, state: dict) -> DataFrame:
        return self.spark.read.parquet(state["tables"]["tags"])

    def corpus(self) -> Corpus:
        state = self._require()
        return Corpus(
            self._documents(state),
            segments.live(self._part(state, "postings"), self._log(state, "tombstones")),
            segments.summed_stats(self._part(state, "stats")),
            self._catalog(state),
            self._assignments(state),
            self._part(state, "terms"),
            state["shards"],
            segments.not_dropped(self._part(state, "bits"), self._log(state, "dropped")),
            self._part(state, "documents"),
            self._ranges(state, "terms"),
            lambda under: self._located(state, beneath(subtree_prefix(under))),
        )

    def _ranges(self, state: dict, name: str) -> dict[str, Ranges]:
        return {p.rsplit("=", 1)[-1]: state["order"][p] for p in state["tables"][name]}

    def _located(self, state: dict, intervals: list[Interval]) -> DataFrame:
        """Live rows ``path, ext, segment, ord`` whose folded path may lie in an interval."""
        rows = within(self._part(state, "paths"), self._ranges(state, "paths"), intervals)
        return segments.live(rows, self._log(state, "tombstones"))

    def _near(self, state: dict, paths: list[str], under: str | None) -> DataFrame:
        """Live rows among which the named documents and those of the subtree are."""
        intervals = beneath(subtree_prefix(under)) if under is not None else []
        raw = self.spark.createDataFrame([(p,) for p in paths], "given string").select(strip(F.col("given")).alias("given"))
        base = state["root"].rstrip("/") + "/"
        below = F.substring("given", F.lit(len(base) + 1), F.length("given"))
        for r in raw.select(F.lower("given"), F.when(F.startswith("given", F.lit(base)), F.lower(below))).collect():
            intervals += [(key, key) for key in r if key is not None]
        return self._located(state, intervals)

    def runs(self) -> DataFrame:
        """One row for each update, oldest first."""
        rows = self.spark.read.schema(f"version bigint, run struct<{RUN_SCHEMA}>").json(f"{self.location}/state")
        return rows.filter("run is not null").orderBy("version").select("run.*")

    def errors(self) -> DataFrame:
        """``path, message`` of every file that the last update could not take."""
        return self.spark.read.parquet(self._require()["tables"]["errors"])

    # -- documents -------------------------------------------------------------------------------

    def _source(self, source: str | DataFrame, root: str | None) -> tuple[str, DataFrame | None]:
        """The root of a source, and its rows if it is a table."""
        if isinstance(source, str):
            return normal_root(source), None
        mtime = F.col("mtime") if "mtime" in source.columns else F.lit(None)
        return root or TABLE_ROOT, rows_from_table(source, F.col("path"), F.col("text"), mtime)

    def _stored(self, state: dict | None) -> DataFrame:
        if state is None:
            return self.spark.createDataFrame([], "path string, size bigint, mtime timestamp, digest string")
        return self._documents(state).select("path", "size", "mtime", "digest")

    def update(
        self,
        source: str | DataFrame,
        *,
        full: bool = False,
        snapshot: DataFrame | None = None,
        root: str | None = None,
    ) -> DataFrame:
        """Bring the index in line with ``source``; returns the run's counters.

        ``source`` is a folder, or a table ``path, text[, mtime]`` whose rows are taken as files: a row counts as changed
        when its text does (by a digest), rows above the size guard or with a repeated path are errors. ``snapshot``
        replaces the listing, for instance to mark files as unreadable. ``root`` names a table's origin.
        """
        root, rows = self._source(source, root)
        state = self._state()
        snap.check_root(state and state["root"], root, full)
        if snapshot is None:
            snapshot = scan_files(self.spark, root) if rows is None else listing_of(rows)
        listing = self._saved("listing", snapshot)
        whole = full or state is None
        changes = self._saved("changes", snap.diff(listing, self._stored(None if full else state), full))
        failed = None
        if whole or not changes.filter(F.col("status").isin("upsert", "pruned")).isEmpty():
            wanted = listing.join(snap.with_status(changes, "upsert"), "path", "left_semi")
            if rows is None:
                read = self._saved("read", read_files(self.spark, root, wanted))
                failed = failures(read)
                changes = self._saved("changes", snap.with_failures(changes, failed))
                changed = rows_of(read)
            else:
                changed = rows.join(wanted.select("path"), "path", "left_semi")
            written = self._rebuilt if whole else self._appended
            state = written(state, changes, changed, listed_bytes(wanted))
        errors = oversized(listing.join(snap.with_status(changes, "error"), "path", "left_semi"))
        errors = errors if failed is None else errors.unionByName(failed)
        place = self._fresh("errors")
        errors.dropDuplicates(["path"]).write.parquet(place)
        state = {**state, "root": root, "tables": {**state["tables"], "errors": place}}
        run = run_row(snap.run_stats(changes), root).first().asDict()
        self._commit(state, {**run, "run_at": run["run_at"].isoformat()})
        return self.spark.createDataFrame([tuple(run.values())], RUN_SCHEMA)

    def _write_part(self, changed: DataFrame, total: int, shards: int, segment: int) -> tuple[DataFrame, DataFrame, dict]:
        """Documents and postings of one change; also as rows of the tables' lists."""
        places = {n: self._fresh(n) for n in ("documents", "postings")}
        with file_size(self.spark, total):
            write_documents(changed, places["documents"], shards, segment)
            stored = segments.read(self.spark, "documents", [places["documents"]])
            write_postings(posting_blocks(stored), places["postings"], shards)
        return stored, segments.read(self.spark, "postings", [places["postings"]]), places

    def _write_ordered(self, order: dict, name: str, rows: DataFrame, key: str) -> str:
        place = self._fresh(name)
        order[place] = write_ordered(rows, key, place)
        return place

    def _write_small(self, name: str, rows: DataFrame) -> str:
        place = self._fresh(name)
        rows.hint("rebalance").write.parquet(place)
        return place

    def _size(self, stats: str) -> int:
        return segments.read(self.spark, "stats", [stats]).first()["n_docs"]

    def _write_marks(self, state: dict, assigned: DataFrame, documents: DataFrame, seq: int) -> str:
        """Bitmaps of the assignments of ``documents``, which are new."""
        places = assigned.join(documents.select("path", "segment", "ord"), "path")
        place = self._fresh("bits")
        segments.write_bits(segments.bitmap_rows(places, seq), place)
        return place

    def _rebuilt(self, state: dict | None, changes: DataFrame, changed: DataFrame, total: int) -> dict:
        """All documents in one part, all logs empty; tags stay."""
        version = state["version"] if state else 0
        shards, seq = shard_count(total), version + 1
        stored, post, places = self._write_part(changed, total, shards, seq)
        tables = {name: [] for name in segments.SCHEMAS} | {n: [p] for n, p in places.items()}
        order: dict[str, Ranges] = {}
        tables["terms"] = [self._write_ordered(order, "terms", segments.signed_terms(post, None), "term")]
        tables["paths"] = [self._write_ordered(order, "paths", segments.path_keys(stored), "key")]
        tables["stats"] = [self._write_small("stats", corpus_stats(stored))]
        if state:
            tables["tags"] = state["tables"]["tags"]
            place = self._fresh("assigned")
            kept = tag_ops.drop_orphans(self._assignments(state), stored).withColumn("seq", F.lit(seq))
            segments.write_assignments(kept, place, shards)
            tables["assigned"] = [place]
            tables["bits"] = [self._write_marks(state, segments.read(self.spark, "assigned", [place]), stored, seq)]
        else:
            tables["tags"] = self._fresh("tags")
            empty_tags(self.spark)[0].write.parquet(tables["tags"])
        state = {"version": version} if state else {}
        return {**state, "tables": tables, "order": order, "shards": shards, "sizes": [self._size(tables["stats"][0])]}

    def _appended(self, state: dict, changes: DataFrame, changed: DataFrame, total: int) -> dict:
        """One part for the changed documents, and what it does to the others as rows of the logs."""
        seq, shards = state["version"] + 1, state["shards"]
        tables = {n: list(p) if isinstance(p, list) else p for n, p in state["tables"].items()}
        sizes, order = list(state["sizes"]), dict(state["order"])
        touched = changes.filter(F.col("status").isin("upsert", "pruned"))
        gone = touched.select("path", "status", path_shard(F.col("path"), shards).alias("shard"))
        fields = ("path", "ext", "dl", *FIELDS, "status")
        removed = self._saved("removed", self._documents(state).join(gone, ["path", "shard"]).select(*fields))
        dead, new = not removed.isEmpty(), changes.filter("status = 'upsert'").count()
        stored = post = None
        if new:
            stored, post, places = self._write_part(changed, total, shards, seq)
            for name, place in places.items():
                tables[name].append(place)
            sizes.append(new)
            tables["paths"].append(self._write_ordered(order, "paths", segments.path_keys(stored), "key"))
        if dead:
            rows = removed.select("path", F.lit(seq).alias("before"))
            tables["tombstones"].append(self._write_small("tombstones", rows))
        if new or dead:
            terms = segments.signed_terms(post, postings(removed) if dead else None)
            tables["terms"].append(self._write_ordered(order, "terms", terms, "term"))
            less = corpus_stats(removed).select(*[(-F.col(c)).alias(c) for c in ("n_docs", "n_tokens")])
            stats = corpus_stats(stored).unionByName(less) if new else less
            tables["stats"].append(self._write_small("stats", segments.summed_stats(stats)))
        if tables["assigned"]:
            pruned = gone.filter("status = 'pruned'").select("path", "shard")
            orphans = self._assignments(state).join(pruned, ["path", "shard"], "left_semi")
            lost = self._saved("outcome", orphans.select("path", "name_key"))
            if not lost.isEmpty():
                place = self._fresh("unassigned")
                segments.write_assignments(lost.withColumn("seq", F.lit(seq)), place, shards)
                tables["unassigned"].append(place)
            if new:
                upserts = gone.filter("status = 'upsert'").select("path", "shard")
                again = self._assignments(state).join(upserts, ["path", "shard"], "left_semi")
                tables["bits"].append(self._write_marks(state, again, stored, seq))
        return {**state, "tables": tables, "sizes": sizes, "order": order}

    def plan(self, source: str | DataFrame, *, full: bool = False, root: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Dry run: the counters and the first changes; nothing is written."""
        root, rows = self._source(source, root)
        state = self._state()
        snap.check_root(state and state["root"], root, full)
        listing = scan_files(self.spark, root) if rows is None else listing_of(rows)
        changes = snap.diff(listing, self._stored(state), full)
        return snap.run_stats(changes), snap.change_list(changes)

    # -- upkeep ----------------------------------------------------------------------------------

    def compact(self, below: int | None = None) -> None:
        """Merge parts without their dead rows: all of them, or those that came in with fewer than ``below`` documents.

        A full run also folds the logs. Rows keep their places, so bitmaps stay as they are.
        """
        state = self._require()
        tables = {n: list(p) if isinstance(p, list) else p for n, p in state["tables"].items()}
        chosen = [i for i, n in enumerate(state["sizes"]) if below is None or n < below]
        dead = self._log(state, "tombstones")
        if len(chosen) > 1 or (below is None and dead is not None):
            taken = {n: [tables[n][i] for i in chosen] for n in ("documents", "postings")}
            rows = segments.live(segments.read(self.spark, "documents", taken["documents"]), dead)
            total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
            post = segments.live(segments.read(self.spark, "postings", taken["postings"]), dead)
            places = {n: self._fresh(n) for n in taken}
            with file_size(self.spark, total):
                write_documents(rows.drop("part"), places["documents"], state["shards"])
                write_postings(post.drop("part"), places["postings"], state["shards"])
            for name, place in places.items():
                tables[name] = [p for p in tables[name] if p not in taken[name]] + [place]
            state["sizes"] = [n for i, n in enumerate(state["sizes"]) if i not in chosen] + [count]
        if below is None:
            seq = state["version"] + 1
            order: dict[str, Ranges] = {}
            tables["terms"] = [self._write_ordered(order, "terms", segments.summed_terms(self._part(state, "terms")), "term")]
            paths = segments.live(self._part(state, "paths"), dead).drop("part", "range")
            tables["paths"] = [self._write_ordered(order, "paths", paths, "key")]
            state["order"] = order
            tables["stats"] = [self._write_small("stats", segments.summed_stats(self._part(state, "stats")))]
            place = self._fresh("assigned")
            segments.write_assignments(self._assignments(state).withColumn("seq", F.lit(seq)), place, state["shards"])
            tables["assigned"] = [place]
            bits = segments.not_dropped(self._part(state, "bits"), self._log(state, "dropped"))
            place = self._fresh("bits")
            segments.write_bits(segments.folded_bits(bits, seq), place)
            tables["bits"] = [place]
            tables |= {"tombstones": [], "unassigned": [], "dropped": []}
        self._commit({**state, "tables": tables})

    def vacuum(self, keep: int = 1) -> int:
        """Delete folders that the last ``keep`` versions do not name; returns how many. Run it while nobody writes."""
        names, folder, store, jvm = self._states()
        used = set()
        for name in names[-max(1, keep) :]:
            for place in self._read_state(store, jvm, folder, name)["tables"].values():
                used.update(place if isinstance(place, list) else [place])
        used = {p.rsplit("/", 2)[-2] + "/" + p.rsplit("/", 1)[-1] for p in used}
        path, gone = jvm.org.apache.hadoop.fs.Path, 0
        for table in (*segments.SCHEMAS, "tags", "errors", *SCRATCH):
            top = path(f"{self.location}/{table}")
            for found in store.listStatus(top) if store.exists(top) else []:
                if f"{table}/{found.getPath().getName()}" not in used:
                    gone += bool(store.delete(found.getPath(), True))
        return gone

    # -- tags ------------------------------------------------------------------------------------

    def _names(self, names: list[str]) -> DataFrame:
        frame = self.spark.createDataFrame(list(enumerate(names)), "seq bigint, name string")
        tag_ops.check_names(frame)
        return frame

    def _with_catalog(self, state: dict, tags: DataFrame) -> dict:
        place = self._fresh("tags")
        tags.write.parquet(place)
        return {**state, "tables": {**state["tables"], "tags": place}}

    def create_tags(self, names: list[str]) -> DataFrame:
        state = self._require()
        change = tag_ops.create_tags(self._catalog(state), self._names(names))
        outcome = self._saved("outcome", change.outcome)
        self._commit(self._with_catalog(state, change.table))
        return outcome

    def delete_tags(self, names: list[str]) -> DataFrame:
        """The cascade is one row per tag: whatever was assigned before it no longer counts."""
        state = self._require()
        change = tag_ops.delete_tags(self._catalog(state), self._assignments(state), self._names(names))[0]
        outcome = self._saved("outcome", change.outcome)
        after = self._with_catalog(state, change.table)
        rows = outcome.filter("outcome = 'deleted'").select(
            ascii_key(F.col("name")).alias("name_key"), F.lit(state["version"] + 1).alias("seq")
        )
        if not rows.isEmpty():
            dropped = [*state["tables"]["dropped"], self._write_small("dropped", rows)]
            after["tables"] = {**after["tables"], "dropped": dropped}
        self._commit(after)
        return outcome

    def list_tags(self) -> DataFrame:
        state = self._require()
        return tag_ops.list_tags(self._catalog(state), self._assignments(state))

    def _marked(self, state: dict, name: str, paths: list[str], under: str | None) -> tuple[str, DataFrame]:
        """The key of a tag, and the chosen documents with their places and whether they have it."""
        key = tag_key(name)
        self._names([name])
        if self._catalog(state).filter(F.col("name_key") == key).isEmpty():
            raise ValueError(f"tag not found: {name}")
        given = self.spark.createDataFrame([(p,) for p in paths], "given string") if paths else None
        documents = self._near(state, paths, under)
        chosen = tag_ops.select_paths(documents, given, under, state["root"], few=len(paths) <= MAX_LIMIT)
        bits = segments.not_dropped(self._part(state, "bits"), self._log(state, "dropped"))
        placed = documents.select("path", "segment", "ord").join(chosen, "path", "left_semi")
        return key, self._saved("outcome", with_mark(placed, bits, Tagged(name), "had"))

    def _change_marks(self, state: dict, key: str, rows: DataFrame, log: str, added: bool) -> None:
        """Append one change of a tag to the log of assignments and to its bitmap."""
        if rows.isEmpty():
            return
        seq = state["version"] + 1
        rows = rows.withColumns({"name_key": F.lit(key), "seq": F.lit(seq)})
        places = {log: self._fresh(log), "bits": self._fresh("bits")}
        segments.write_assignments(rows, places[log], state["shards"])
        segments.write_bits(segments.bitmap_rows(rows, seq, added), places["bits"])
        tables = state["tables"] | {n: [*state["tables"][n], p] for n, p in places.items()}
        self._commit({**state, "tables": tables})

    def apply_tag(self, name: str, paths: list[str] = (), *, under: str | None = None) -> DataFrame:
        state = self._require()
        key, rows = self._marked(state, name, list(paths), under)
        self._change_marks(state, key, rows.filter("NOT had"), "assigned", True)
        return rows.select("path", F.when(F.col("had"), "already").otherwise("tagged").alias("outcome"))

    def remove_tag(self, name: str, paths: list[str] = (), *, under: str | None = None) -> DataFrame:
        state = self._require()
        key, rows = self._marked(state, name, list(paths), under)
        self._change_marks(state, key, rows.filter("had"), "unassigned", False)
        return rows.select("path", F.when(F.col("had"), "untagged").otherwise("absent").alias("outcome"))

    def show_tags(self, path: str) -> DataFrame:
        state = self._require()
        given = self.spark.createDataFrame([(path,)], "given string")
        found = tag_ops.select_paths(self._near(state, [path], None), given, None, state["root"], few=True).first()["path"]
        rows = self._assignments(state).filter(F.col("shard") == path_shard_of(found, state["shards"]))
        return tag_ops.show_tags(self._catalog(state), rows, found)

    # -- searches --------------------------------------------------------------------------------

    def search(self, query=None, **options) -> DataFrame:
        """See :func:`scriptorium.plans.search.search`; absolute paths are below the indexed root."""
        options.setdefault("root", self._require()["root"])
        return search(self.corpus(), query, **options)

    def search_many(self, clauses: DataFrame, limit: int, **options) -> DataFrame:
        return search_many(self.corpus(), clauses, limit, **options)
