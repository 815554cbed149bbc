"""Indexes as versioned parquet tables under one root, with a manifest per index, aliases, snapshots and dead letters.

An index is a list of parts, oldest first. A write appends a part, of documents or of the ids that are gone, and then swaps
the manifest by rename, so a reader sees a whole version and a lost writer leaves the old one; what is written is of the
size of the change. Reading takes from each part the documents that no later part has. When there are MAX_PARTS parts, or
the later ones hold more rows than the first, the next write merges all into one. Snapshots are lists of parts, and
vacuum() removes parts that neither the index nor a snapshot names.

The manifest has a digest of the names and lengths of each part's files. A part that doesn't match it is missing files or
damaged; it is restored from the fallback root where there is one, and an error otherwise.
"""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.runtime import BROADCAST_ROWS
from skein.operators.index import latest
from skein.plans.model import INDEX_NAME, EngineError, FieldMapping, IndexSettings

KEEP_SNAPSHOTS = 20
MAX_PARTS = 8


class Store:
    """Paths go through Hadoop's file systems, so any of them (local, s3a, hdfs) can be the root."""

    def __init__(self, spark: SparkSession, root: str, fallback: str | None = None):
        self.spark, self.root, self.fallback = spark, root.rstrip("/"), fallback
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- small files -----------------------------------------------------------------------------------------------
    def _read(self, name: str) -> Any | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        rows = self.spark.read.option("wholetext", True).text(f"{self.root}/{name}").collect()
        return json.loads(rows[0][0]) if rows else None

    def _write(self, name: str, value: Any) -> None:
        temp = self._path(f"{self.root}/{name}.tmp")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        sc = self.spark.sparkContext
        jvm, rename = sc._jvm, getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        flags = sc._gateway.new_array(rename, 1)
        flags[0] = rename.OVERWRITE
        final = self._path(f"{self.root}/{name}")
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration()).rename(temp, final, flags)

    # --- indexes ---------------------------------------------------------------------------------------------------
    def names(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory() and self._fs.exists(self._path(f"{self.root}/{s.getPath().getName()}/manifest.json")))

    def resolve(self, name: str) -> str:
        name = (self._read("aliases.json") or {}).get(name, name)
        if name not in self.names():
            raise EngineError("ERR_INDEX_NOT_FOUND", name)
        return name

    def manifest(self, name: str) -> dict:
        return self._read(f"{self.resolve(name)}/manifest.json")

    def mappings(self, name: str) -> dict[str, FieldMapping]:
        return {k: FieldMapping(**v) for k, v in self.manifest(name)["mappings"].items()}

    def settings(self, name: str) -> IndexSettings:
        return IndexSettings(**self.manifest(name)["settings"])

    def create(self, name: str, mappings: dict[str, FieldMapping] | None = None, settings: IndexSettings | None = None) -> None:
        if not INDEX_NAME.match(name):
            raise EngineError("ERR_VALIDATION", f"bad index name {name}")
        if name in self.names():
            raise EngineError("ERR_INDEX_EXISTS", name)
        self._write(f"{name}/manifest.json", {"mappings": {k: asdict(v) for k, v in (mappings or {}).items()}, "settings": asdict(settings or IndexSettings()), "version": 0, "next_seq": 0, "parts": [], "snapshots": []})

    def update(self, name: str, mappings: dict[str, FieldMapping] | None = None, settings: dict | None = None) -> None:
        """Shallow merge; documents are not indexed anew until reindex."""
        m = self.manifest(name)
        m["mappings"] |= {k: asdict(v) for k, v in (mappings or {}).items()}
        m["settings"] |= settings or {}
        self._write(f"{self.resolve(name)}/manifest.json", m)

    def drop(self, name: str) -> None:
        name = self.resolve(name)
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def alias(self, alias: str, name: str | None) -> None:
        all_ = self._read("aliases.json") or {}
        if name is None:
            all_.pop(alias, None)
        else:
            all_[alias] = self.resolve(name)
        self._write("aliases.json", all_)

    def aliases(self) -> dict[str, str]:
        return self._read("aliases.json") or {}

    # --- documents -------------------------------------------------------------------------------------------------
    def _digest(self, path: str) -> str:
        """Of the names and lengths of a folder's data files; "" where it is missing."""
        p = self._path(path)
        if not self._fs.exists(p):
            return ""
        files = sorted(f"{x.getPath().getName()}:{x.getLen()}" for x in self._fs.listStatus(p) if x.getPath().getName().startswith("part-"))
        return hashlib.sha256("\n".join(files).encode()).hexdigest()

    def _part(self, name: str, part: dict) -> DataFrame:
        path = f"{self.root}/{name}/v={part['v']}"
        if self._digest(path) != part["digest"]:
            if not self.fallback:
                raise EngineError("ERR_VALIDATION", f"part {part['v']} of {name} is damaged")
            self.spark.read.parquet(f"{self.fallback}/{name}/v={part['v']}").write.mode("overwrite").parquet(path)
            m = self._read(f"{name}/manifest.json")
            for x in [p for y in (m, *m["snapshots"]) for p in y["parts"] if p["v"] == part["v"]]:
                x["digest"] = self._digest(path)
            self._write(f"{name}/manifest.json", m)
        return self.spark.read.parquet(path)

    def _merged(self, name: str, parts: list[dict]) -> DataFrame:
        """From each part the documents that no later part has. Ids of later parts are broadcast while they are few."""
        out, later, n = None, None, 0
        for part in reversed(parts):
            rows = self._part(name, part)
            ids = rows.select("id")
            if not part["gone"]:
                kept = rows if later is None else rows.join(F.broadcast(later) if n <= BROADCAST_ROWS else later, "id", "left_anti")
                out = kept if out is None else kept.unionByName(out, allowMissingColumns=True)
            later = ids if later is None else later.unionByName(ids)
            n += part["rows"]
        return out

    def docs(self, name: str) -> DataFrame | None:
        """Documents of the current version; None if there never were any. seq has the order of insertion."""
        name = self.resolve(name)
        parts = self._read(f"{name}/manifest.json")["parts"]
        return self._merged(name, parts) if parts else None

    def _save(self, name: str, rows: DataFrame, v: int, gone: bool) -> dict:
        path = f"{self.root}/{name}/v={v}"
        rows.write.option("maxRecordsPerFile", 1_000_000).parquet(path)
        if self.fallback:
            self.spark.read.parquet(path).write.mode("overwrite").parquet(f"{self.fallback}/{name}/v={v}")
        return {"v": v, "gone": gone, "rows": self.spark.read.parquet(path).count(), "digest": self._digest(path)}

    def _commit(self, name: str, rows: DataFrame, next_seq: int, gone: bool = False, alone: bool = False) -> int:
        """Append rows as a part (alone: instead of all others), and merge when there are too many."""
        m = self._read(f"{name}/manifest.json")
        v = m["version"] + 1
        parts = [*([] if alone else m["parts"]), self._save(name, rows, v, gone)]
        if len(parts) > 1 and (len(parts) >= MAX_PARTS or sum(p["rows"] for p in parts[1:]) > parts[0]["rows"]):
            v += 1
            parts = [self._save(name, self._merged(name, parts), v, False)]
        self._write(f"{name}/manifest.json", m | {"version": v, "next_seq": next_seq, "parts": parts})
        return v

    def derived(self, name: str, kind: str, version: int) -> str:
        """The folder for tables worked out of a version of an index."""
        return f"{self.root}/{self.resolve(name)}/{kind}/{version}"

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def vacuum(self, name: str) -> list[int]:
        """Remove parts that neither the index nor a snapshot names, and return their numbers. Readers of older versions must be done."""
        name = self.resolve(name)
        m = self._read(f"{name}/manifest.json")
        used = {p["v"] for x in (m, *m["snapshots"]) for p in x["parts"]}
        removed = []
        for s in self._fs.listStatus(self._path(f"{self.root}/{name}")):
            label = s.getPath().getName()
            if label.startswith("v=") and int(label[2:]) not in used:
                self._fs.delete(s.getPath(), True)
                removed.append(int(label[2:]))
        return sorted(removed)

    def upsert(self, name: str, rows: DataFrame) -> int:
        """Write documents (id, fields...; of equal ids the last by seq counts); each gets a new place at the end of the order.

        seq is the next number of the index plus the row's own seq, so it needs no global sort.
        """
        if name not in self.names() and name not in self.aliases():
            self.create(name)
        name = self.resolve(name)
        m = self._read(f"{name}/manifest.json")
        if "seq" not in rows.columns:
            rows = rows.withColumn("seq", F.monotonically_increasing_id())
        top = rows.agg(F.max("seq")).first()[0]
        if top is None:
            return m["version"]
        new = latest(rows).withColumn("seq", F.col("seq") + F.lit(m["next_seq"]))
        return self._commit(name, new, m["next_seq"] + top + 1)

    def delete_ids(self, name: str, ids: DataFrame) -> int:
        name = self.resolve(name)
        m = self._read(f"{name}/manifest.json")
        return self._commit(name, ids.select("id").where("id IS NOT NULL").distinct(), m["next_seq"], gone=True) if m["parts"] else m["version"]

    def clear(self, name: str) -> int:
        name, old = self.resolve(name), self.docs(name)
        m = self._read(f"{name}/manifest.json")
        return m["version"] if old is None else self._commit(name, old.limit(0), m["next_seq"], alone=True)

    def update_by_query(self, name: str, condition, changes: dict[str, Any], max_docs: int = 100, also=None) -> int:
        """Set fields of the first max_docs (at most 1000) matching documents in order; they move to the end. Returns how many.

        also: a function of the changed rows, for columns that depend on others.
        """
        docs = self.docs(name)
        if docs is None:
            return 0
        hit = docs.where(condition(docs) if callable(condition) else condition).orderBy("seq").limit(min(max_docs, 1000))
        n = hit.count()
        if n:
            base = hit.agg(F.min("seq")).first()[0]
            new = hit.withColumns({k: F.lit(v).cast(docs.schema[k].dataType) if k in docs.columns else F.lit(v) for k, v in changes.items()})
            self.upsert(name, (also(new) if also else new).withColumn("seq", F.col("seq") - F.lit(base)))
        return n

    def get(self, name: str, doc_id: Any) -> DataFrame:
        docs = self.docs(name)
        found = docs.where(F.col("id") == F.lit(doc_id)) if docs is not None else None
        if found is None or found.isEmpty():
            raise EngineError("ERR_DOC_NOT_FOUND", str(doc_id))
        return found

    def listing(self, name: str, offset: int = 0, size: int = 20) -> tuple[DataFrame | None, int]:
        """A page of at most 200 documents in order of insertion, and their number."""
        docs = self.docs(name)
        return (None, 0) if docs is None else (docs.orderBy("seq").offset(offset).limit(min(size, 200)), docs.count())

    # --- snapshots -------------------------------------------------------------------------------------------------
    def snapshot(self, name: str) -> str:
        name = self.resolve(name)
        m = self._read(f"{name}/manifest.json")
        now = int(time.time() * 1000)
        sid = f"v_{now}_{hashlib.sha256(f'{name}{now}'.encode()).hexdigest()[:8]}"
        m["snapshots"] = [*m["snapshots"], {"id": sid, "version": m["version"], "parts": m["parts"], "at": now}][-KEEP_SNAPSHOTS:]
        self._write(f"{name}/manifest.json", m)
        return sid

    def snapshots(self, name: str) -> list[dict]:
        return self.manifest(name)["snapshots"]

    def revert(self, name: str, sid: str) -> int:
        """The parts of a snapshot as a new version; nothing is written anew."""
        name = self.resolve(name)
        m = self._read(f"{name}/manifest.json")
        hit = next((s for s in m["snapshots"] if s["id"] == sid), None)
        if hit is None:
            raise EngineError("ERR_VALIDATION", f"no snapshot {sid}")
        if not hit["parts"]:
            return self.clear(name)
        m |= {"version": m["version"] + 1, "parts": hit["parts"]}
        self._write(f"{name}/manifest.json", m)
        return m["version"]

    # --- dead letters ----------------------------------------------------------------------------------------------
    def bury(self, rows: DataFrame, source: str, index: str) -> None:
        """Append dead letters (id, payload, error, at), by day."""
        out = rows.select("id", "payload", "error", "at").withColumns({"source": F.lit(source), "index": F.lit(index), "dt": F.to_date("at")})
        out.write.mode("append").partitionBy("dt").parquet(f"{self.root}/_dead_letter")

    def mark_replayed(self, letters: DataFrame) -> None:
        """Record that dead letters were sent again."""
        letters.select("id", "at", F.current_timestamp().alias("replayed_at")).write.mode("append").parquet(f"{self.root}/_replayed")

    def dead_letters(self, source: str | None = None, index: str | None = None, limit: int = 50) -> DataFrame:
        """Newest first, at most 200, with the last time each was replayed."""
        rows = self.spark.read.parquet(f"{self.root}/_dead_letter")
        if self._fs.exists(self._path(f"{self.root}/_replayed")):
            done = self.spark.read.parquet(f"{self.root}/_replayed").groupBy("id", "at").agg(F.max("replayed_at").alias("replayed_at"))
            rows = rows.join(done, ["id", "at"], "left")
        else:
            rows = rows.withColumn("replayed_at", F.lit(None).cast("timestamp"))
        rows = rows.where(F.col("source") == source) if source else rows
        rows = rows.where(F.col("index") == index) if index else rows
        return rows.orderBy(F.desc("at"), "id").limit(min(limit, 200))

    # --- configuration ---------------------------------------------------------------------------------------------
    def export(self) -> dict:
        return {"indexes": [{"name": n, "mappings": self.manifest(n)["mappings"], "settings": self.manifest(n)["settings"], "aliases": sorted(a for a, t in self.aliases().items() if t == n)} for n in self.names()]}

    def plan(self, spec: dict, prune: bool = False) -> list[dict]:
        """Actions that bring the indexes to the specification: create_index, update_index, delete_index (prune)."""
        have, out = {n: self.manifest(n) for n in self.names()}, []
        for want in spec.get("indexes", []):
            name, live = want["name"], have.get(want["name"])
            if live is None:
                out.append({"type": "create_index", "target": name, "mappings": want.get("mappings", {}), "settings": want.get("settings", {}), "aliases": want.get("aliases", [])})
                continue
            new = {f: m for f, m in want.get("mappings", {}).items() if live["mappings"].get(f, {}).get("type") != m["type"]}
            changed = {k: v for k, v in want.get("settings", {}).items() if live["settings"].get(k) != v}
            if new or changed:
                out.append({"type": "update_index", "target": name, "mappings": new, "settings": changed})
        if prune:
            wanted = {w["name"] for w in spec.get("indexes", [])}
            out += [{"type": "delete_index", "target": n} for n in have if n not in wanted]
        return out

    def apply(self, actions: list[dict]) -> list[dict]:
        """Carry out actions; errors are collected, not raised."""
        done = []
        for a in actions:
            try:
                maps = {k: FieldMapping(**v) for k, v in a.get("mappings", {}).items()}
                if a["type"] == "create_index":
                    self.create(a["target"], maps, IndexSettings(**a.get("settings", {})))
                    for alias in a.get("aliases", []):
                        self.alias(alias, a["target"])
                elif a["type"] == "update_index":
                    self.update(a["target"], maps, a.get("settings"))
                else:
                    self.drop(a["target"])
                done.append({**a, "ok": True})
            except (EngineError, TypeError) as e:
                done.append({**a, "ok": False, "error": str(e)})
        return done
