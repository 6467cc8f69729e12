"""The store's API: open, mine, store, search, digest, statistics, graph. Tables lie under one path as parts, deletions and a
log of commits (see operators/versions.py): a write counts for all tables at once or for none, and several writers may
work at a time. A reader sees the state that it took last."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import embed, text
from tessera.operators import digest, graph, search, store
from tessera.operators.numbering import checkpointed
from tessera.operators.versions import Change, State, Store
from tessera.sources import mining

#: Parts of a table from which small ones are joined.
MAX_PARTS = 64


@dataclass
class MineStats:
    files_processed: int
    files_skipped: int
    bytes: int
    errors: int
    chunks_seen: int
    drawers_inserted: int


class Palace:
    def __init__(self, spark: SparkSession, path: str, embedder=None, metric: str = "l2"):
        self.spark, self.path, self.metric = spark, path.rstrip("/"), metric
        self.embedder = embedder or embed.HashEmbedder()
        self.db = Store(spark, self.path, schema.TABLES)

    @classmethod
    def open(cls, spark: SparkSession, path: str, dim: int = 384, metric: str = "l2", embedder=None) -> Palace:
        """Open or create a store."""
        return cls(spark, path, embedder or embed.HashEmbedder(dim), metric)

    def refresh(self) -> None:
        """Take the last published state, as another session may have written."""
        self.db.refresh()

    def table(self, name: str) -> DataFrame:
        return self.db.table(name)

    def _add(self, name: str, fresh) -> None:
        """Commit the rows that fresh(table, first free id) finds missing, if any."""
        def work(state: State) -> Change | None:
            part = self.db.stage(name, fresh(self.db.table(name, state), state.next_id.get(name, 1)))
            return Change(add={name: [part]}, reserve={name: part[1]}, built_on=[name]) if part[1] else None

        self.db.transact(work)

    def wing_id(self, name: str, wing_type: str, now: int) -> int:
        wanted = self.spark.createDataFrame([(name, "", wing_type)], "name string, description string, wing_type string")
        self.refresh()
        if not (hit := self.table("wings").where(F.col("name") == name).head()):
            self._add("wings", lambda wings, first: store.fresh_wings(wings, wanted, now, first))
            hit = self.table("wings").where(F.col("name") == name).head()
        return hit["id"]

    def insert(self, rows: DataFrame, wing: str, wing_type: str, now: int) -> tuple[int, int]:
        """Insert (room, source_path, source_type, chunk_index, content) into a wing: (rows seen, drawers inserted). A text
        that is stored already, in any wing or room, isn't stored again. Texts that the embedder can't embed have no vector."""
        wing_id, done = self.wing_id(wing, wing_type, now), 0
        rows = checkpointed(rows.withColumn("content_hash", text.content_hash(F.col("content"))))
        named = rows.select(F.lit(wing_id).cast("long").alias("wing_id"), F.col("room").alias("name"), F.lit("").alias("description"))
        order = ["source_path", "chunk_index", "room_id"]

        def work(state: State) -> Change | None:
            nonlocal done
            have = lambda name: self.db.table(name, state)
            rooms = self.db.stage("rooms", store.fresh_rooms(have("rooms"), named, now, state.next_id.get("rooms", 1)))
            known = have("rooms").unionByName(self.db.staged("rooms", rooms))
            ids = known.where(F.col("wing_id") == wing_id).select(F.col("id").alias("room_id"), F.col("name").alias("_room"))
            placed = rows.join(ids, F.col("room").eqNullSafe(F.col("_room"))).drop("room", "_room")
            fresh = store.dedup(placed, have("drawers"), order).dropDuplicates(["content_hash"])
            new = store.numbered(fresh, [F.col(c) for c in order], "id", state.next_id.get("drawers", 1))
            drawers = self.db.stage("drawers", new.withColumn("created_at", F.lit(now).cast("long")))
            vectors = self.db.staged("drawers", drawers).select("id", self.embedder.column(F.col("content")).alias("embedding")).where("embedding IS NOT NULL")
            add = {"rooms": rooms, "drawers": drawers, "vec_drawers": self.db.stage("vec_drawers", vectors)}
            done = drawers[1]
            add = {name: [part] for name, part in add.items() if part[1]}
            return Change(add=add, reserve={"rooms": rooms[1], "drawers": done}, built_on=["rooms", "drawers"]) if add else None

        state = self.db.transact(work)
        for name in ("drawers", "vec_drawers", "rooms"):
            if len(state.parts.get(name, [])) > MAX_PARTS:
                self.db.compact(name, small=state.rows(name) // 4 + 1)
        return rows.count(), done

    def mine(self, path: str, wing: str, mode: str = "auto", max_chunk: int = text.MAX_CHUNK, overlap: int = text.OVERLAP, *, now: int,
             ignore: list[str] | None = None, changed_only: bool = False) -> MineStats:
        """Ingest a folder, a file or a chat export (mode: auto, directory, file, conversation). ignore: globs of files of a folder
        to leave out; changed_only: files that were mined with the same length and time of change are not read again, and
        count as skipped."""
        if mode == "auto":
            mode = "conversation" if path.lower().endswith((".json", ".jsonl")) else "directory" if self._is_dir(path) else "file"
        files = mining.read_files(self.spark, path)
        if mode == "conversation":
            rows, counts, kind = mining.conversation_chunks(self.spark, path), files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("b")).head(), "conversation"
            return MineStats(counts.n, 0, counts.b or 0, 0, *self.insert(rows, wing, kind, now))
        root, known, fresh = path if mode == "directory" else None, 0, None
        if changed_only:
            self.refresh()
            every = mining.listed(self.spark, path).where(mining.mined(F.col("path"), F.col("length"), root, ignore))
            have = self.table("mined_files").select("path", "length", "modified")
            fresh = checkpointed(every.join(have, ["path", "length", "modified"], "left_anti"))
            known, files = every.count() - fresh.count(), checkpointed(mining.with_content(fresh))
        rows = mining.file_chunks(files.where("content IS NOT NULL") if changed_only else files, root, max_chunk, overlap, every=mode == "file", ignore=ignore).drop("start", "end")
        done, skipped, size, errors = mining.stats(files, root, ignore).head()
        out = MineStats(done, skipped + known, size, errors, *self.insert(rows, wing, "auto-mined", now))
        if changed_only:
            self._mined(fresh.join(files.where("content IS NOT NULL").select("path"), "path", "left_semi"))
        return out

    def _mined(self, files: DataFrame) -> None:
        """Note files (path, length, modified) as mined, in place of what was noted of them before."""
        def work(state: State) -> Change:
            new = store.numbered(files, [F.col("path")], "id", state.next_id.get("mined_files", 1))
            part = self.db.stage("mined_files", new)
            old = self.db.deletion(self.db.placed("mined_files", state).join(files.select("path"), "path", "left_semi"))
            return Change(add={"mined_files": [part]}, delete={"mined_files": old}, reserve={"mined_files": part[1]}, built_on=["mined_files"])

        self.db.transact(work)

    def _is_dir(self, path: str) -> bool:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(where).isDirectory()

    def store(self, content: str, wing: str, room: str = "notes", source: str = "agent", *, now: int) -> int:
        """Store one text; its id, an older one's where the same text is stored already."""
        self.insert(mining.snippet(self.spark, content, room, source), wing, "memory", now)
        return self.table("drawers").where(F.col("content_hash") == text.content_hash(F.lit(content))).agg(F.min("id")).head()[0]

    def search(self, query: str, limit: int = search.LIMIT, *, now: int, recency_boost: float = search.RECENCY_BOOST, keyword_boost: float = search.KEYWORD_BOOST, reranker=None) -> DataFrame:
        return search.hybrid(self.table("vec_drawers"), self.table("drawers"), self.table("rooms"), self.table("wings"), query, self.embedder.embed(query), limit=limit, now=now,
                             recency_boost=recency_boost, keyword_boost=keyword_boost, metric=self.metric, reranker=reranker)

    def wake_up_rows(self, wing: str | None = None, max_drawers: int = digest.MAX_DRAWERS, max_bytes: int = digest.MAX_BYTES) -> DataFrame:
        return digest.budgeted(digest.newest(self.table("drawers"), self.table("rooms"), self.table("wings"), wing, max_drawers), max_bytes)

    def wake_up(self, wing: str | None = None, max_drawers: int = digest.MAX_DRAWERS, max_bytes: int = digest.MAX_BYTES, preview: int = digest.PREVIEW_BYTES, identity_path: str | None = None) -> str:
        return digest.wake_up(self.table("drawers"), self.table("rooms"), self.table("wings"), wing, max_drawers=max_drawers, max_bytes=max_bytes, preview=preview, identity_path=identity_path)

    def stats(self) -> DataFrame:
        """The number of wings, rooms, drawers and entities, of the log alone."""
        names = ("wings", "rooms", "drawers", "entities")
        return self.spark.createDataFrame([tuple(self.db.rows(t) for t in names)], ", ".join(f"{t} long" for t in names))

    def wings(self) -> DataFrame:
        return self.table("wings").orderBy("name")

    def rooms(self, wing: str) -> DataFrame:
        own = self.table("wings").where(F.col("name") == wing).select(F.col("id").alias("wing_id"))
        return self.table("rooms").join(own, "wing_id", "left_semi").orderBy("name")

    def forget(self, wing: str) -> None:
        """Delete a wing with its rooms, drawers and vectors (an extension)."""
        def work(state: State) -> Change | None:
            at = lambda name: self.db.placed(name, state)
            wings = at("wings").where(F.col("name") == wing)
            rooms = at("rooms").join(wings.select(F.col("id").alias("wing_id")), "wing_id", "left_semi")
            drawers = at("drawers").join(rooms.select(F.col("id").alias("room_id")), "room_id", "left_semi")
            vectors = at("vec_drawers").join(drawers.select("id"), "id", "left_semi")
            found = {name: self.db.deletion(hits) for name, hits in (("wings", wings), ("rooms", rooms), ("drawers", drawers), ("vec_drawers", vectors))}
            return Change(delete={t: d for t, d in found.items() if d}, built_on=["rooms", "drawers"]) if found["wings"] else None

        self.db.transact(work)

    def export(self, path: str, wing: str | None = None) -> None:
        """Write the store, or what is in a wing and the whole graph, as plain Parquet tables under path."""
        at = lambda name: self.db.table(name)
        wings = at("wings") if wing is None else at("wings").where(F.col("name") == wing)
        rooms = at("rooms").join(wings.select(F.col("id").alias("wing_id")), "wing_id", "left_semi")
        drawers = at("drawers").join(rooms.select(F.col("id").alias("room_id")), "room_id", "left_semi")
        out = {"wings": wings, "rooms": rooms, "drawers": drawers, "vec_drawers": at("vec_drawers").join(drawers.select("id"), "id", "left_semi")}
        for name, df in (out | {n: at(n) for n in ("entities", "relationships")}).items():
            df.write.parquet(f"{path}/{name}")

    def merge(self, path: str) -> dict[str, int]:
        """Take in what was exported to path: rows added by table. Wings and entities are the same by name, rooms by wing and
        name, texts by hash, edges by both ends, predicate and times; what is new gets ids of this store, and references follow.
        Descriptions and times of what is here already stay."""
        kind = lambda name: self.spark.createDataFrame([], schema.TABLES[name]).columns
        theirs = {n: self.spark.read.schema(schema.TABLES[n]).parquet(f"{path}/{n}") for n in ("wings", "rooms", "drawers", "vec_drawers", "entities", "relationships")}
        done: dict[str, int] = {}

        def work(state: State) -> Change | None:
            parts: dict[str, tuple[str, int]] = {}

            def taken(name: str, rows: DataFrame, key: list[str]) -> DataFrame:
                """rows (old and columns of the table): those whose key is new are staged; (old, new) of all."""
                have, old = self.db.table(name, state), checkpointed(rows)
                first = old.groupBy(*key).agg(F.min("old").alias("_first"))
                one = old.join(first, [*[old[k].eqNullSafe(first[k]) for k in key], old["old"] == first["_first"]], "left_semi").drop("id")
                fresh = checkpointed(store.new_rows(have, one.dropDuplicates(key), key, first=state.next_id.get(name, 1)))
                parts[name] = self.db.stage(name, fresh.select(*kind(name)))
                known = have.select("id", *key).unionByName(fresh.select("id", *key)).groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.min("id").alias("new"))
                same = F.lit(True)
                for k in key:
                    same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
                return checkpointed(old.join(known, same).select("old", "new"))

            named = lambda name: theirs[name].withColumn("old", F.col("id"))
            moved = lambda df, ids, column: df.join(ids.select(F.col("old").alias(column), F.col("new").alias("_to")), column).drop(column).withColumnRenamed("_to", column)
            wings = taken("wings", named("wings"), ["name"])
            rooms = taken("rooms", moved(named("rooms"), wings, "wing_id"), ["wing_id", "name"])
            drawers = taken("drawers", moved(named("drawers"), rooms, "room_id"), ["content_hash"])
            fresh = self.db.staged("drawers", parts["drawers"]).select("id")
            vectors = moved(theirs["vec_drawers"].dropDuplicates(["id"]), drawers, "id").join(fresh, "id", "left_semi").dropDuplicates(["id"])
            parts["vec_drawers"] = self.db.stage("vec_drawers", vectors.select(*kind("vec_drawers")))
            entities = taken("entities", named("entities"), ["name"])
            edges = moved(moved(named("relationships"), entities, "subject_id"), entities, "object_id")
            source = drawers.select(F.col("old").alias("source_drawer_id"), F.col("new").alias("_to"))
            edges = edges.join(source, "source_drawer_id", "left").drop("source_drawer_id").withColumnRenamed("_to", "source_drawer_id")
            taken("relationships", edges, ["subject_id", "predicate", "object_id", "valid_from", "valid_until"])
            done.update({n: p[1] for n, p in parts.items()})
            add = {n: [p] for n, p in parts.items() if p[1]}
            return Change(add=add, reserve={n: p[0][1] for n, p in add.items() if n != "vec_drawers"}, built_on=list(theirs)) if add else None

        self.db.transact(work)
        return done

    def see_entities(self, seen: DataFrame, now: int) -> None:
        """Add the entities (name, entity_type) that are new; known ones are seen last now."""
        names = seen.select("name").distinct()

        def work(state: State) -> Change:
            known = self.db.placed("entities", state).join(names, "name", "left_semi")
            all_ = graph.upsert_entities(self.db.table("entities", state), seen, now, state.next_id.get("entities", 1))
            part = self.db.stage("entities", all_.join(names, "name", "left_semi"))
            old = self.db.deletion(known)
            return Change(add={"entities": [part]}, delete={"entities": old}, reserve={"entities": part[1] - sum(n for _, _, n in old)}, built_on=["entities"])

        self.db.transact(work)

    def add_edges(self, edges: DataFrame, now: int) -> None:
        self._add("relationships", lambda held, first: graph.fresh_edges(held, edges, now, first))

    def edges(self, subject: str | None = None, predicate: str | None = None, limit: int = graph.QUERY_ROWS) -> DataFrame:
        return graph.query(self.table("relationships"), self.table("entities"), subject, predicate, limit)

    def edges_as_of(self, at: int) -> DataFrame:
        return graph.as_of(self.table("relationships"), self.table("entities"), at)
