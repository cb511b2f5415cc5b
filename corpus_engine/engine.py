"""The engine: the entry points of a note service as methods over tables."""

from __future__ import annotations

import datetime
import hashlib
import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from corpus_engine.config import DEFAULT, EngineConfig
from corpus_engine.functions import kernels
from corpus_engine.functions import markdown as md
from corpus_engine.functions import paths as pt
from corpus_engine.functions import text as tx
from corpus_engine.functions.kernels import NotFound, Refused
from corpus_engine.operators import cache, catalogue, checks, chunks, lexical, links, mutate, vectors
from corpus_engine.operators.layers import Layers
from corpus_engine.plans import hybrid
from corpus_engine.sources import notes as src

log = logging.getLogger(__name__)
SEARCHED = ("title", "breadcrumb", "text")


def utc_now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class Engine:
    """Search and edits over a table of notes (path, text) and of extracted documents (path, markdown, status).

    An edit gives a new engine on a new version of the notes; readers of the old one are not disturbed. Where the index
    was built, the edit replaces the rows of the paths it touches in its tables (chunks, postings, vectors).
    """

    def __init__(self, spark: SparkSession, notes: DataFrame, extracted: DataFrame | None = None, embedder: vectors.Embedder | None = None, cfg: EngineConfig = DEFAULT, scope: str | None = None, clock: Callable[[], str] = utc_now):
        self.spark, self.embedder, self.cfg, self.scope, self.clock = spark, embedder, cfg, scope, clock
        none = "path string, markdown string, status string"
        self._notes = Layers(notes.select("path", "text"))
        self._files = Layers(extracted.select("path", "markdown", "status") if extracted is not None else spark.createDataFrame([], none))
        self._index: dict[str, Layers] | None = None
        self._streams: list = []

    @property
    def notes(self) -> DataFrame:
        return self._notes.table()

    @property
    def extracted(self) -> DataFrame:
        return self._files.table()

    # ---- index -------------------------------------------------------------------------------------------------
    def _rows(self, notes: DataFrame, files: DataFrame) -> DataFrame:
        """The chunk table of some notes and documents."""
        shown = notes.where(~tx.is_search_excluded(F.col("path"), self.cfg))
        docs = files.where(~tx.is_search_excluded(F.col("path"), self.cfg))
        return chunks.note_chunks(shown, self.cfg).unionByName(chunks.document_chunks(docs, self.cfg))

    def _posted(self, rows: DataFrame) -> DataFrame:
        """(chunk, term, tf, path): stemmed postings of a chunk table."""
        own = rows.select("chunk", F.concat_ws(" ", *SEARCHED).alias("text"))
        return lexical.postings(own, stemmed=True).withColumn("path", F.regexp_extract("chunk", "^(.*)#[0-9]+$", 1))

    def _embedded(self, rows: DataFrame, store: DataFrame | None) -> DataFrame:
        """(chunk, path, text_sha, embedding): what the store (text_sha, embedding) has is not embedded again."""
        keyed = rows.select("chunk", "path", "embed_text")
        if store is None:
            store = self.spark.createDataFrame([], "text_sha string, embedding array<float>")
        found, _ = vectors.embed_misses(keyed, store, self.embedder, self.cfg.dims)
        return found.select("chunk", "path", "text_sha", "embedding")

    def build(self, store: cache.TableStore | None = None) -> Engine:
        """Builds the index. A store (of the mark cache.fingerprint gives) is read first and written last: notes with
        known content keep their chunks, known texts their vectors."""
        if store is None:
            rows = self._rows(self.notes, self.extracted).persist()
            vector = self._embedded(rows, None).persist() if self.embedder is not None else None
        else:
            texts = self._keyed()
            held = store.read("chunks", self._rows(self.notes, self.extracted).withColumn("key", F.lit("")).schema)
            fresh = texts.join(held.select("key").distinct(), "key", "left_anti").select("path")
            made = self._rows(self.notes.join(fresh, "path", "left_semi"), self.extracted.join(fresh, "path", "left_semi"))
            kept = held.join(texts.select("key"), "key", "left_semi").select(made.columns)
            rows = kept.unionByName(made).persist()
            old = store.read("vectors", "text_sha string, embedding array<float>")
            vector = self._embedded(rows, old).persist() if self.embedder is not None else None
        self._index = {"chunks": Layers(rows), "postings": Layers(self._posted(rows).persist())}
        if vector is not None:
            self._index["vectors"] = Layers(vector)
        if store is not None:
            store.save(self.stored_tables(), time.time_ns())
        return self

    def _keyed(self) -> DataFrame:
        """(path, text, key): the key names a path with its content."""
        return src.read_any(self.notes, self.extracted).select("path", "text").withColumn("key", cache.content_key())

    def stored_tables(self) -> dict[str, DataFrame]:
        """What a store keeps of the index: chunks by content, vectors by text."""
        tables = self._tables()
        out = {"chunks": tables["chunks"].join(self._keyed().select("path", "key"), "path").select(*tables["chunks"].columns, "key")}
        if "vectors" in tables:
            out["vectors"] = tables["vectors"].select("text_sha", "embedding").dropDuplicates(["text_sha"])
        return out

    def _tables(self) -> dict[str, DataFrame]:
        if self._index is None:
            self.build()
        return {name: x.table() for name, x in self._index.items()}

    def _with(self, notes: dict[str, str | None], files: dict[str, tuple[str, str] | None] | None = None) -> Engine:
        """A new engine with these notes and documents in place of those of their paths; None removes one."""
        new = Engine.__new__(Engine)
        new.__dict__ = dict(self.__dict__)
        files = files or {}
        new._notes = self._notes.replaced([(p, t) for p, t in notes.items() if t is not None], notes)
        new._files = self._files.replaced([(p, *f) for p, f in files.items() if f is not None], files)
        if self._index is not None:
            new._index = self._reindexed(notes, files)
        if new._notes.crowded or new._files.crowded:  # a new base: rare, and the plan stays short
            new._notes, new._files, new._index = Layers(new.notes.persist()), Layers(new.extracted.persist()), None
        return new

    def _reindexed(self, notes: dict, files: dict) -> dict[str, Layers]:
        paths = [*notes, *files]
        own = self.spark.createDataFrame([(p, t) for p, t in notes.items() if t is not None], "path string, text string")
        docs = self.spark.createDataFrame([(p, *f) for p, f in files.items() if f is not None], "path string, markdown string, status string")
        rows = self.spark.createDataFrame(self._rows(own, docs).collect(), self._index["chunks"].base.schema)  # of the edited paths
        out = {"chunks": self._index["chunks"].replaced(rows.collect(), paths)}
        posted = self._posted(rows).select(self._index["postings"].base.columns)
        out["postings"] = self._index["postings"].replaced(posted.collect(), paths)
        if "vectors" in self._index:
            shas = [hashlib.sha256(r["embed_text"].encode()).hexdigest() for r in rows.collect()]
            known = self._index["vectors"].table().where(F.col("text_sha").isin(shas)).select("text_sha", "embedding").dropDuplicates(["text_sha"])
            vector = self._embedded(rows, known).select(self._index["vectors"].base.columns)
            out["vectors"] = self._index["vectors"].replaced(vector.collect(), paths)
        return out

    def summary(self) -> dict:
        c = self._tables()["chunks"]
        n, paths = c.agg(F.count("*"), F.countDistinct("path")).first()
        return {"chunks": n, "paths_with_chunks": paths, "notes": self.notes.count(), "matrix_mb": round(n * self.cfg.dims * 4 / 1e6, 1)}

    # ---- reading -----------------------------------------------------------------------------------------------
    def search_batch(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """(query, chunk, path, title, breadcrumb, line, score, text, place) for queries (query, q)."""
        tables = self._tables()
        kind = dict(queries.dtypes)["query"]
        dense = self.spark.createDataFrame([], f"query {kind}, chunk string, rank int")
        if self.embedder is not None:
            asked = [(r["query"], r["q"]) for r in queries.toLocalIterator()]  # a stated set, searched in blocks
            v = self.embedder.embed([f"search_query: {q}" for _, q in asked])
            dense = vectors.dense_topk(tables["vectors"], [(i, list(map(float, x))) for (i, _), x in zip(asked, v, strict=True)], self.cfg.candidates, query_type=kind)
        plain = tables["chunks"].select("chunk", "path", F.concat_ws(" ", *SEARCHED).alias("text"))
        best = hybrid.search(plain, queries, dense, k, tables["postings"].drop("path"), self.cfg, stemmed=True).drop("path")
        own = tables["chunks"].select("chunk", "path", "title", "breadcrumb", "line", "text")
        return best.join(own, "chunk").select("query", "chunk", "path", "title", "breadcrumb", "line", "score", "text", "place")

    def search(self, q: str, k: int | None = None) -> list[Row]:
        return self.search_batch(self.spark.createDataFrame([("q", q)], "query string, q string"), k).orderBy("place").collect()

    def search_text(self, q: str, k: int | None = None) -> str:
        """The results of one search as markdown, or that there are none."""
        found = self.search_batch(self.spark.createDataFrame([("q", q)], "query string, q string"), k)
        row = hybrid.rendered(found).first()
        return row["rendered"] if row else hybrid.NOTHING

    def _one(self, table: DataFrame, path: str) -> Row | None:
        return table.where(F.col("path") == path).first()

    def _text(self, path: str) -> str:
        if path in self._notes.fresh and self._notes.fresh[path]:
            return self._notes.fresh[path][0][1]
        row = self._one(src.read_any(self.notes, self.extracted), path)
        if row is None:
            raise NotFound(f"no note or readable document at {path!r}")
        return row["text"]

    def read(self, path: str, section: str | None = None) -> str:
        text = self._text(path)
        if section is None:
            return text
        if not path.endswith(".md"):
            raise Refused("a document has no sections to read")
        wanted = section.strip().lstrip("#").strip().casefold()
        found = kernels.headings(text)
        first = next((h for h in found if h.text.casefold() == wanted), None)
        if first is None:
            raise NotFound(f"no heading {section!r}; there are: " + ", ".join(h.text for h in found))
        lo, hi = kernels.bounds(text, first, "markerAndContent")
        return "\n".join(text.split("\n")[lo:hi]).rstrip() + "\n"

    def note(self, path: str, section: str | None = None) -> dict:
        text = self._text(path)
        content = self.read(path, section) if section is not None else text
        return {"path": path, "content": content, "body": kernels.FRONT.sub("", text, count=1).lstrip("\r\n"), "frontmatter": kernels.metadata(text)}

    def list(self, folder: str = "") -> DataFrame:
        sized = self.notes.select("path", F.octet_length("text").cast("long").alias("size"))
        sized = sized.unionByName(self.extracted.select("path", F.lit(None).cast("long").alias("size")))
        return src.list_dir(sized).where(F.col("folder") == folder.strip("/")).orderBy(F.col("type") != "dir", F.lower("name"), "name")

    def outline(self, path: str) -> list[str]:
        return ["::".join(h.path) for h in kernels.headings(self._text(path))]

    def map(self, path: str) -> dict:
        """A note's front matter and outline, or what became of a document and its pages' headings."""
        row = self._one(self.extracted, path)
        if row is not None:
            return {"path": path, "status": row["status"], "chars": len((row["markdown"] or "").strip()), "outline": ["::".join(h.path) for h in kernels.headings(row["markdown"] or "")]}
        text = self._text(path)
        return {"path": path, "frontmatter": kernels.metadata(text), "outline": self.outline(path)}

    def find(self, key: str, value: str, folder: str | None = None) -> DataFrame:
        """Paths of notes with a front-matter value, below a folder; one that is a note or isn't there is an error."""
        hit = self.notes.where(F.array_contains(md.front_values(F.col("text"), key), value))
        if folder:
            under = F.startswith("path", F.lit(folder.strip("/") + "/"))
            if self._one(self.notes, folder.strip("/")) is not None:
                raise Refused(f"{folder!r} is a note, not a folder")
            if self.notes.where(under).limit(1).count() == 0:
                raise NotFound(f"no folder {folder!r}")
            hit = hit.where(under)
        return hit.select("path").orderBy("path")

    # ---- checks ------------------------------------------------------------------------------------------------
    def catalogue(self) -> DataFrame:
        return catalogue.rendered(catalogue.entries(self.notes, self.cfg), tuple(sorted(self.cfg.catalogue_exclude, key=str.casefold)))

    def callouts(self) -> DataFrame:
        return checks.callouts(self.notes)

    def check_all(self, today: str) -> DataFrame:
        """Findings of the nine checks, in their order; one that fails is itself a finding. The stored catalogue is index.md."""
        return checks.all_checks(self.notes, self.extracted, catalogue.parsed(self.notes.where("path = 'index.md'")), today, self.cfg)

    # ---- edits -------------------------------------------------------------------------------------------------
    def _allowed(self, path: str, documents: bool = False) -> str:
        clean = pt.normal(path)
        kind = pt.suffix(clean or "")
        if not clean or not (kind == ".md" or documents and kind in self.cfg.document_suffixes):
            raise Refused(f"{path!r} is not a path of a note" + " or document" * documents)
        if pt.protected(clean) or not pt.in_scope(clean, self.scope):
            raise Refused(f"{path!r} may not be written")
        return clean

    def scoped(self, scope: str | None) -> Engine:
        new = Engine.__new__(Engine)
        new.__dict__ = self.__dict__ | {"scope": scope}
        return new

    def _replace(self, path: str, text: str, stamp: bool = True) -> Engine:
        return self._with({path: kernels.stamped(text, self.clock()) if stamp else text})

    def _exists(self, path: str) -> bool:
        return self._one(self.notes, path) is not None or self._one(self.extracted, path) is not None

    def patch(self, path: str, target: str, operation: str, content: str, scope: str = "content") -> Engine:
        path = self._allowed(path)
        return self._replace(path, kernels.patch(self._text(path), target, operation, content, scope))

    def append(self, path: str, content: str, create: bool = False) -> Engine:
        path = self._allowed(path)
        if not self._exists(path):
            if not create:
                raise NotFound(f"no note at {path!r}")
            return self._replace(path, kernels.append("", content))
        return self._replace(path, kernels.append(self._text(path), content))

    def write(self, path: str, content: str, overwrite: bool = False) -> Engine:
        path = self._allowed(path)
        if not overwrite and self._exists(path):
            raise Refused(f"{path!r} exists")
        return self._replace(path, content)

    def set_body(self, path: str, content: str) -> Engine:
        path = self._allowed(path)
        front = kernels.FRONT.match(text := self._text(path))
        return self._replace(path, (text[: front.end()] if front else "") + kernels.normal(content))

    def set_field(self, path: str, key: str, value=None, delete: bool = False) -> Engine:
        path = self._allowed(path)
        return self._replace(path, kernels.set_field(self._text(path), key, value, delete), stamp=key != "timestamp")

    def delete(self, path: str) -> Engine:
        path = self._allowed(path, documents=True)
        if not self._exists(path):
            raise NotFound(f"nothing at {path!r}")
        return self._with({}, {path: None}) if pt.suffix(path) != ".md" else self._with({path: None})

    def move(self, source: str, target: str) -> Engine:
        """Moves a note or a document; links to it are rewritten, without a new timestamp for the notes that hold them."""
        if self.scope is not None:
            raise Refused("a scoped caller cannot move notes")
        source, target = self._allowed(source, documents=True), self._allowed(target, documents=True)
        if pt.suffix(source) != pt.suffix(target):
            raise Refused("a move does not change the kind of file")
        if not self._exists(source):
            raise NotFound(f"nothing at {source!r}")
        if self._exists(target):
            raise Refused(f"{target!r} exists")
        moves = self.spark.createDataFrame([(source, target)], "source string, target string")
        touched = {r["path"]: r["text"] for r in links.moved(self.notes, moves).where("rewritten > 0").select("path", "text").collect()}  # notes that link to it
        if pt.suffix(source) == ".md":
            text = touched.pop(target, None) or self._text(source)
            return self._with(touched | {source: None, target: kernels.stamped(text, self.clock())})
        row = self._one(self.extracted, source)
        return self._with(touched, {source: None, target: (row["markdown"], row["status"])})

    def upload(self, path: str, content: bytes) -> tuple[Engine, str]:
        """Files a document; (engine, status): filed, unchanged, replaced or refused. It is extracted by what is registered for its kind."""
        path = self._allowed(path, documents=True)
        new = self.spark.createDataFrame([(path, bytearray(content))], "path string, content binary")
        got = src.extract(new, self.cfg).first()
        held = self._one(self.extracted, path)
        sha = hashlib.sha256(content).hexdigest()
        files = [(path, sha if (got["markdown"], got["status"]) == (held["markdown"], held["status"]) else "")] if held is not None else []
        status = mutate.uploaded(self.spark.createDataFrame(files, "path string, sha string"), new, self.cfg).first()["status"]
        if status in ("refused", "unchanged"):
            return self, status
        return self._with({}, {path: (got["markdown"], got["status"])}), status

    # ---- one request -------------------------------------------------------------------------------------------
    def put(self, path: str, content: str | bytes) -> Engine:
        """Writes a note or files a document, by the suffix of the path."""
        if pt.suffix(path) == ".md":
            return self.write(path, content.decode("utf-8", "replace") if isinstance(content, bytes) else content, overwrite=True)
        return self.upload(path, content if isinstance(content, bytes) else content.encode())[0]

    def change(self, path: str, kind: str, target: str | None = None, operation: str = "replace", content=None, scope: str = "content", create: bool = False) -> Engine:
        """One edit by the kind of its target: heading, frontmatter or body."""
        steps = {
            ("heading", "replace"): lambda: self.patch(path, target, operation, content, scope),
            ("heading", "append"): lambda: self.patch(path, target, operation, content, scope),
            ("heading", "prepend"): lambda: self.patch(path, target, operation, content, scope),
            ("frontmatter", "replace"): lambda: self.set_field(path, target, content),
            ("frontmatter", "delete"): lambda: self.set_field(path, target, delete=True),
            ("body", "replace"): lambda: self.set_body(path, content),
            ("body", "append"): lambda: self.append(path, content, create),
        }
        if (kind, operation) not in steps:
            raise Refused(f"no operation {operation!r} on a {kind!r}")
        return steps[kind, operation]()

    def broken_links(self) -> DataFrame:
        return links.broken(links.links(self.notes), self.notes.select("path").unionByName(self.extracted.select("path")))

    # ---- upkeep ------------------------------------------------------------------------------------------------
    def start(self, *queries) -> None:
        """Takes charge of running streaming queries."""
        self._streams += queries

    def stop(self) -> None:
        """Stops them, the last one started first, and lets each finish what it has begun."""
        while self._streams:
            q = self._streams.pop()
            if q.isActive:
                q.processAllAvailable()
            q.stop()

    def status(self) -> dict:
        """building before the index is there, degraded with their errors if a stream has stopped, else ready."""
        bad = {q.name or str(q.id): str(q.exception() or "stopped") for q in self._streams if not q.isActive}
        return {"state": "degraded" if bad else "building" if self._index is None else "ready", "errors": bad}
