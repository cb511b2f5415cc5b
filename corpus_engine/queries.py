"""Registered queries: every operator over the driver's tables. Names carry the inventory ids they cover."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpus_engine.config import DEFAULT
from corpus_engine.functions import markdown as md
from corpus_engine.functions import text as tx
from corpus_engine.operators import batch, cache, catalogue, checks, chunks, evaluate, lexical, links, mutate, vectors
from corpus_engine.plans import hybrid
from corpus_engine.sources import notes as src
from corpus_engine.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DIMS = 256


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk, path, text): each document as one chunk; documents of a source and language share a path."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("chunk"), F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("xx"))).alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("q"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.derived_notes(spark, sf_dir)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, size) of derived notes and filed pages."""
    pages = src.pages(spark, sf_dir).select("path", F.octet_length("html").cast("long").alias("size"))
    return notes(spark, sf_dir).select("path", "size").unionByName(pages)


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    markdown = src.html_markdown(F.col("html"))
    return src.pages(spark, sf_dir).select("path", markdown.alias("markdown")).withColumn("status", src.extraction_status(F.col("markdown"), F.lit(1)))


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("path", "text", md.headings(F.col("text")).alias("h"))


# ---- scans -------------------------------------------------------------------------------------------------------
@query
def S1_index_walk(spark, sf_dir):
    return src.index_walk(files(spark, sf_dir))


@query
def S2_link_walk(spark, sf_dir):
    return src.link_walk(files(spark, sf_dir)).select("path")


@query
def S4_polymorphic_read(spark, sf_dir):
    return src.read_any(notes(spark, sf_dir), extracted(spark, sf_dir)).select("path", "kind", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def S5_directory_listing(spark, sf_dir):
    return src.list_dir(files(spark, sf_dir))


@query
def S6_extracted_documents(spark, sf_dir):
    return extracted(spark, sf_dir).select("path", "status", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


@query
def S8_page_assembly(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.md5(md.assembled(F.transform("t", lambda x: x["text"])).cast("binary")).alias("doc_md5"))


# ---- predicates and projections ----------------------------------------------------------------------------------
@query
def F1_F7_path_predicates(spark, sf_dir):
    p = F.col("path")
    return files(spark, sf_dir).select("path", tx.is_hidden(p).alias("hidden"), tx.is_protected(p).alias("protected"), tx.is_search_excluded(p).alias("excluded"), tx.under_any(p, DEFAULT.catalogue_exclude).alias("generated"), tx.is_document(p).alias("document"), tx.in_write_scope(p, "src4").alias("in_scope"))


@query
def F6_safe_paths(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/"), "source", F.lit("/./"), "lang", F.when(F.col("lang") == "en", F.lit("/../..")).when(F.col("lang") == "fr", F.lit("/../../..")).otherwise(""), F.lit("/doc.md")).alias("raw"))
    return raw.select("doc_id", tx.normal_path(F.col("raw")).alias("path"))


@query
def F8_frontmatter_query(spark, sf_dir):
    n = notes(spark, sf_dir)
    return n.where(F.array_contains(md.front_values(F.col("text"), "tags"), "fr") & F.startswith("path", F.lit("src4/"))).select("path")


@query
def F9_note_json(spark, sf_dir):
    t = F.col("text")
    n = notes(spark, sf_dir).select("path", md.without_front_matter(t).alias("body"), md.front_values(t, "title").alias("title"), md.front_values(t, "tags").alias("tags"))
    return n.select("path", F.char_length("body").cast("long").alias("body_chars"), F.array_join("title", "|").alias("title"), F.array_join("tags", "|").alias("tags"))


@query
def F13_searchable(spark, sf_dir):
    return extracted(spark, sf_dir).select("path", src.searchable(F.col("markdown")).alias("searchable"))


# ---- markdown ----------------------------------------------------------------------------------------------------
@query
def M2_normal_bodies(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    crlf = F.concat(F.lit("\ufeff"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\r\n")), F.lit("\n\n\n"))
    return d.select("doc_id", F.md5(md.normal_body(crlf).cast("binary")).alias("body_md5"))


@query
def M3_front_matter_lines(spark, sf_dir):
    return notes(spark, sf_dir).select("path", md.front_lines(F.col("text")).cast("long").alias("front_lines"), F.md5(md.without_front_matter(F.col("text")).cast("binary")).alias("rest_md5"))


@query
def M4_front_matter_bounds(spark, sf_dir):
    b = md.front_bounds(F.col("text"))
    return notes(spark, sf_dir).select("path", b["start"].cast("long").alias("first"), b["end"].cast("long").alias("last"))


@query
def M6_headings(spark, sf_dir):
    return headed(spark, sf_dir).select("path", F.explode_outer("h").alias("h")).where("h is not null").select("path", F.col("h.depth").cast("long").alias("depth"), "h.text", F.col("h.line").cast("long").alias("line"))


@query
def M7_sections_read(spark, sf_dir):
    n = headed(spark, sf_dir)
    wanted = F.get("h", F.lit(1))["text"]
    return n.select("path", F.md5(md.section_text(F.col("text"), F.col("h"), F.concat(F.lit("## "), wanted)).cast("binary")).alias("section_md5"))


@query
def M8_M9_outline(spark, sf_dir):
    n = headed(spark, sf_dir)
    return n.select("path", F.md5(F.array_join(md.outline(F.col("h")), "\n").cast("binary")).alias("outline_md5"), F.size("h").cast("long").alias("headings"))


@query
def M10_heading_keys(spark, sf_dir):
    """NFKC and case folding have no SQL form here; tested against the kernel."""
    from corpus_engine.functions.kernels import heading_key

    @F.pandas_udf("string")
    def key(s):
        return s.map(heading_key)

    return M6_headings(spark, sf_dir).select("path", "line", key("text").alias("key"))


@query
def M12_section_bounds(spark, sf_dir):
    n = headed(spark, sf_dir)
    each = n.select("path", "h", F.size(tx.lines(F.col("text"))).alias("total"), F.explode_outer("h").alias("x")).where("x is not null")
    return each.select("path", F.col("x.line").cast("long").alias("line"), md.section_end(F.col("h"), F.col("x.line"), F.col("x.depth"), F.col("total") - 1).cast("long").alias("last"))


@query
def M13_links(spark, sf_dir):
    return links.links(page_notes(spark, sf_dir)).select("path", F.col("ord").cast("long").alias("ord"), "raw", "target")


def page_notes(spark, sf_dir):
    """Pages as notes: their hyperlinks as markdown links."""
    return src.pages(spark, sf_dir).select(F.format_string("web/page-%d.md", "page_id").alias("path"), F.regexp_replace("html", r'<a href="([^"\s)]*)"[^>]*>([^<]*)</a>', "[$2]($1)").alias("text"))


@query
def M14_titles(spark, sf_dir):
    n = extracted(spark, sf_dir)
    return n.select("path", md.title_of(F.col("markdown"), tx.stem(F.col("path"))).alias("title"))


@query
def M15_folded_values(spark, sf_dir):
    return notes(spark, sf_dir).select("path", md.folded_value(F.col("text"), "description").alias("description"))


@query
def M16_first_sentences(spark, sf_dir):
    return notes(spark, sf_dir).select("path", md.first_sentence(F.col("text")).alias("sentence"))


@query
def M17_callouts(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("path"), F.concat(F.lit("intro\n> [!"), F.when(F.col("role") == "user", "NOTE").otherwise("tip"), F.lit("] Turn\n> body of "), F.col("role"), F.lit("\n\n> bare\n")).alias("text"))
    return checks.callouts(d).select("path", F.col("line").cast("long").alias("line"), "type", "title", "body")


@query
def FM1_frontmatter_values(spark, sf_dir):
    return notes(spark, sf_dir).select("path", F.array_join(md.front_values(F.col("text"), "tags"), "|").alias("tags"), F.array_join(md.front_values(F.col("text"), "title"), "|").alias("title"))


@query
def FM2_typed_metadata(spark, sf_dir):
    """YAML has no SQL form; tested against the kernel."""
    import json

    from corpus_engine.functions.kernels import metadata

    @F.pandas_udf("string")
    def typed(s):
        return s.map(lambda t: json.dumps(metadata(t), ensure_ascii=False, sort_keys=True))

    return notes(spark, sf_dir).select("path", typed("text").alias("metadata"))


# ---- chunks ------------------------------------------------------------------------------------------------------
@query
def C1_token_estimates(spark, sf_dir):
    return notes(spark, sf_dir).select("path", md.token_estimate(F.col("text")).alias("tokens"))


@query
def C2_sections(spark, sf_dir):
    n = headed(spark, sf_dir).select("path", F.posexplode_outer(md.sections(F.col("text"), F.col("h"))).alias("n", "s")).where("s is not null")
    return n.select("path", "s.breadcrumb", F.col("s.line").cast("long").alias("line"), F.md5(F.col("s.body").cast("binary")).alias("body_md5"))


@query
def C4_bare_links(spark, sf_dir):
    """List items of notes; those of French ones are made bare links, those of German ones links with a word beside."""
    n = notes(spark, sf_dir).select("path", F.posexplode_outer(F.regexp_extract_all("text", F.lit(r"(?m)^- .*$"), F.lit(0))).alias("ord", "item")).where("item is not null")
    first = F.regexp_extract("item", r"^- (\S+)", 1)
    linked = F.when(F.contains("path", F.lit("/fr/")), F.concat(F.lit("- ["), first, F.lit("](/a); [[b]]."))).when(F.contains("path", F.lit("/de/")), F.concat(F.lit("- ["), first, F.lit("](/a) see"))).otherwise(F.col("item"))
    return n.select("path", F.col("ord").cast("long").alias("ord"), md.is_bare_link(linked).alias("bare"))


@query
def C7_paragraphs(spark, sf_dir):
    return extracted(spark, sf_dir).select("path", F.posexplode_outer(md.paragraphs(F.col("markdown"))).alias("ord", "p")).where("p is not null").select("path", F.col("ord").cast("long").alias("ord"), F.md5(F.col("p").cast("binary")).alias("paragraph_md5"))


@query
def C10_embed_texts(spark, sf_dir):
    n = headed(spark, sf_dir).select("path", F.coalesce(md.folded_value(F.col("text"), "title"), F.lit("")).alias("title"), F.coalesce(md.folded_value(F.col("text"), "description"), F.lit("")).alias("about"), F.posexplode_outer(md.sections(F.col("text"), F.col("h"))).alias("n", "s")).where("s is not null")
    return n.select("path", F.col("s.line").cast("long").alias("line"), F.md5(md.embed_text(F.col("title"), F.col("about"), F.col("s.breadcrumb"), F.col("s.body")).cast("binary")).alias("embed_md5"))


@query
def C11_note_chunks(spark, sf_dir):
    """The chunker is a sequential fold; tested against properties and small cases."""
    return chunks.note_chunks(notes(spark, sf_dir)).select("path", "ordinal", "breadcrumb", "line", "text", "embed_text")


@query
def C12_document_chunks(spark, sf_dir):
    return chunks.document_chunks(extracted(spark, sf_dir)).select("path", "ordinal", "description", "breadcrumb", "line", "text")


# ---- lexical -----------------------------------------------------------------------------------------------------
@query
def L1_postings(spark, sf_dir):
    return lexical.postings(lifted(spark, sf_dir))


@query
def L1_stemmed_vocabulary(spark, sf_dir):
    """Stems have no SQL form; tested against published pairs."""
    return lexical.postings(lifted(spark, sf_dir), stemmed=True).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query
def L3_term_set_sizes(spark, sf_dir):
    return lifted(spark, sf_dir).select("chunk", F.size(F.array_distinct(lexical.tokens(F.col("text")))).cast("long").alias("terms"))


@query
def L4_document_frequency(spark, sf_dir):
    return lexical.document_frequency(lexical.postings(lifted(spark, sf_dir)))


@query
def A7_corpus_stats(spark, sf_dir):
    c = lifted(spark, sf_dir)
    return lexical.corpus_stats(c, lexical.postings(c)).select("n", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf"))


@query
def L5_bm25_scores(spark, sf_dir):
    return batch.bm25(lifted(spark, sf_dir), asked(spark, sf_dir)).select("query", "chunk", F.round("score", 6).alias("score"))


@query
def L6_rarest_term(spark, sf_dir):
    return lexical.rarest_term(lexical.postings(lifted(spark, sf_dir)), asked(spark, sf_dir))


@query
def L7_containment(spark, sf_dir):
    return lexical.containing(lexical.postings(lifted(spark, sf_dir)), asked(spark, sf_dir))


@query
def L5_stemmed_bm25(spark, sf_dir):
    """Stems have no SQL form; tested against the formula."""
    return batch.bm25(lifted(spark, sf_dir), asked(spark, sf_dir), stemmed=True).select("query", "chunk", F.round("score", 6).alias("score"))


# ---- vectors -----------------------------------------------------------------------------------------------------
@query
def V1_normalised_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.round(vectors.norm(F.col("embedding")), 4).alias("norm"), F.round(vectors.norm(vectors.l2_normalised(F.col("embedding"))), 4).alias("unit"))


@query
def V4_hashed_vectors(spark, sf_dir):
    return vectors.hashed_entries(lifted(spark, sf_dir), DIMS).select("chunk", "dim", (F.round("value", 6) + F.lit(0.0)).alias("value"))  # no negative zero


@query
def V5_dense_topk(spark, sf_dir):
    """The 50 nearest vectors of every vector whose id is divisible by 20, against all rows."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    wanted = [(r["vec_id"], r["embedding"]) for r in v.where("vec_id % 20 = 0").toLocalIterator()]  # a stated query set; searched in blocks
    found = vectors.dense_topk(v, wanted, 50, id_col="vec_id", id_type="long", digits=4)
    return found.select("query", F.col("chunk").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


@query
def V6_embed_misses(spark, sf_dir):
    """Texts that a store of the English ones lacks: distinct texts to embed, and chunks they serve."""
    d = table(spark, sf_dir, "documents").select("lang", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha"))
    miss = cache.misses(d, d.where("lang = 'en'"), "text_sha")
    return miss.groupBy("lang").agg(F.count("*").alias("chunks"), F.countDistinct("text_sha").alias("texts"))


# ---- ranking -----------------------------------------------------------------------------------------------------
def arms(spark, sf_dir, stemmed=False):
    c, q = lifted(spark, sf_dir), asked(spark, sf_dir)
    vocab = batch.vocabulary(c, stemmed).persist()  # read by the statistics, the weights and the pins
    dense = batch.hashed_topk(c, q, DEFAULT.candidates, DIMS)
    sparse = hybrid.candidates(c, q, vocab, stemmed=stemmed).persist()  # 50 rows a query, read by the fusion and the pins
    return c, q, vocab, dense, sparse


@query
def R1_F12_lexical_candidates(spark, sf_dir):
    return arms(spark, sf_dir)[4].select("query", "chunk", "score", F.col("rank").cast("long").alias("rank"))


@query
def R2_rrf(spark, sf_dir):
    *_, dense, sparse = arms(spark, sf_dir)
    return hybrid.fuse(dense, sparse).select("query", "chunk", F.round("score", 6).alias("score"), F.col("pos").cast("long").alias("pos"))


@query
def R4_lookup_hits(spark, sf_dir):
    _, q, vocab, _, sparse = arms(spark, sf_dir)
    return hybrid.lookup_hits(None, q, sparse, F.col("chunk"), frequency=vocab).select("query", "chunk", F.col("pin").cast("long").alias("pin"))


def results_of(parts, k=None, stemmed=False):
    c, q, vocab, dense, sparse = parts
    found = hybrid.search(c, q, dense, k, stemmed=stemmed, vocab=vocab, sparse=sparse)
    return found.select("query", "chunk", "path", "score", F.col("place").cast("long").alias("place"))


def hybrid_results(spark, sf_dir, k=None):
    return results_of(arms(spark, sf_dir), k)


@query
def R3_lookup_gate(spark, sf_dir):
    """Whether a query names something nearly unique that some candidate holds in full."""
    c, q, vocab, _, sparse = arms(spark, sf_dir)
    pinned = hybrid.lookup_hits(None, q, hybrid.with_paths(sparse, c), F.col("path"), frequency=vocab).select("query").distinct().withColumn("hit", F.lit(True))
    return lexical.rarest_term(None, q, frequency=vocab).join(pinned, "query", "left").select("query", "rarest", F.coalesce("hit", F.lit(False)).alias("is_lookup"))


@query
def R7_hybrid_search(spark, sf_dir):
    return hybrid_results(spark, sf_dir)


@query
def R7_stemmed_search(spark, sf_dir):
    """The same over stems, as the engine searches; stems have no SQL form."""
    return results_of(arms(spark, sf_dir, stemmed=True), stemmed=True)


@query
def R6_diversified_20(spark, sf_dir):
    return hybrid_results(spark, sf_dir, 20)


@query
def K5_rendered_results(spark, sf_dir):
    hit = hybrid_results(spark, sf_dir)
    return hybrid.rendered(hit.withColumns({"breadcrumb": F.col("chunk"), "line": F.lit(1), "text": F.concat(F.lit("text of "), "chunk")}))


# ---- evaluation --------------------------------------------------------------------------------------------------
def verbatim(c, q):
    """(query, path): the chunks that hold all terms of a query and its text verbatim; read several times."""
    held = batch.containing(c, q).join(F.broadcast(q), "query").where(F.contains("text", F.col("q")))  # a stated query set
    return held.select("query", F.col("chunk").alias("path")).persist()


def judged(spark, sf_dir):
    """Documents that hold a benchmark passage verbatim are what its query should find; German ones must not come."""
    parts = arms(spark, sf_dir)
    expected = verbatim(parts[0], parts[1])
    results = results_of(parts).select("query", F.col("chunk").alias("path"), "place", F.col("path").alias("folder")).persist()  # k rows a query
    never = results.where(F.endswith("folder", F.lit("/de"))).select("query", "path").join(expected, ["query", "path"], "left_anti")
    return evaluate.rows(results, expected, never)


@query
def E1_E4_eval_rows(spark, sf_dir):
    return judged(spark, sf_dir)


@query
def E2_recall_mrr(spark, sf_dir):
    return evaluate.summarised(judged(spark, sf_dir)).select("scored_queries", "hits", "recall", "mrr", "worst_max_per_path")


@query
def E3_compare_baseline(spark, sf_dir):
    """The lexical arm alone against the hybrid ranking."""
    parts = arms(spark, sf_dir)
    held, sparse = verbatim(parts[0], parts[1]), parts[4]
    lexical_rows = evaluate.rows(sparse.where("rank <= 6").select("query", F.col("chunk").alias("path"), F.col("rank").cast("long").alias("place")), held)
    both = evaluate.rows(results_of(parts).select("query", F.col("chunk").alias("path"), "place").persist(), held)
    return evaluate.compared(both, lexical_rows)


# ---- joins, sets, cache ------------------------------------------------------------------------------------------
@query
def J5_cache_retention(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("key"))
    return cache.retained(d.where("source <> 'src5'"), d.where("source = 'src5'"), "key").groupBy("source").agg(F.count("*").alias("kept"))


@query
def J6_upserted_sizes(spark, sf_dir):
    """Files with those of one source emptied and those of another gone."""
    f = files(spark, sf_dir)
    changed = f.where(F.startswith("path", F.lit("src4/"))).select("path", F.lit(0).cast("long").alias("size"))
    return catalogue.upsert(f, changed, f.where(F.startswith("path", F.lit("src6/"))).select("path"))


@query
def T4_folder_order(spark, sf_dir):
    """Folders by their parts, not as strings."""
    f = files(spark, sf_dir).select(F.explode(tx.ancestors(F.col("path"))).alias("folder")).distinct()
    key = F.transform(tx.parts(F.col("folder")), F.lower)
    return f.orderBy(key).select("folder", F.array_join(key, "\x01").alias("order_key"))


@query
def A4_median_tokens(spark, sf_dir):
    n = notes(spark, sf_dir).select(tx.folder(F.col("path")).alias("folder"), md.token_estimate(F.col("text")).alias("tokens"))
    return n.groupBy("folder").agg(F.median("tokens").alias("median_tokens"), F.count_if(F.col("tokens") >= DEFAULT.chunk_target_tokens).alias("long_notes"))


@query
def J10_ancestor_folders(spark, sf_dir):
    return files(spark, sf_dir).select(F.explode_outer(tx.ancestors(F.col("path"))).alias("folder")).where("folder is not null").groupBy("folder").agg(F.count("*").alias("files"))


@query
def J8_prefix_join(spark, sf_dir):
    """Files under each folder of a language, by an equi-join on all folders above a file."""
    f = files(spark, sf_dir)
    wanted = f.select(tx.folder(F.col("path")).alias("folder")).distinct()
    return changes.arrived(wanted.where(F.endswith("folder", F.lit("/es"))), f)


@query
def J11_reconcile(spark, sf_dir):
    """A state that missed the errors' users against a rebuild."""
    e = table(spark, sf_dir, "events")
    state = e.where("event_type <> 'error'").groupBy(F.col("user_id").cast("string").alias("path")).agg(F.count("*").alias("n"))
    rebuilt = e.where("event_type <> 'signup'").groupBy(F.col("user_id").cast("string").alias("path")).agg(F.count("*").alias("n"))
    return changes.reconcile(state, rebuilt)


@query
def A8_duplicate_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
    return d.groupBy("text_md5").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query
def A9_index_summary(spark, sf_dir):
    c = lifted(spark, sf_dir)
    return c.agg(F.count("*").alias("chunks"), F.countDistinct("path").alias("paths"), F.round(F.count("*") * DEFAULT.dims * 4 / 1e6, 3).alias("matrix_mb"))


@query
def A11_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))


@query
def U2_U3_set_operations(spark, sf_dir):
    """Users of both clicks and purchases, and of clicks without an error."""
    e = table(spark, sf_dir, "events")
    of = lambda kind: e.where(F.col("event_type") == kind).select("user_id")
    both = of("click").intersect(of("purchase")).select("user_id", F.lit("both").alias("what"))
    return both.unionByName(of("click").exceptAll(of("error")).distinct().select("user_id", F.lit("more clicks than errors").alias("what")))


@query
def W9_series_gaps(spark, sf_dir):
    days = table(spark, sf_dir, "events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("series"), F.to_date("ts").alias("day")).distinct()
    return checks.series_gaps(days.withColumn("path", F.concat("series", F.lit("/"), F.col("day").cast("string"))))


@query
def K6_json_rows(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("json"))


# ---- streaming, as batch replay ----------------------------------------------------------------------------------
def log(spark, sf_dir):
    """Events as a change log: users are notes."""
    op = F.when(F.col("event_type") == "error", "delete").otherwise("modify")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), op.alias("op"), F.lit(None).cast("string").alias("target"), "ts")


@query
def ST1_watched_changes(spark, sf_dir):
    return changes.watched(log(spark, sf_dir)).groupBy("path", "op").agg(F.count("*").alias("n"))


@query
def ST2_debounced(spark, sf_dir):
    from dataclasses import replace

    return changes.debounced(changes.watched(log(spark, sf_dir)), replace(DEFAULT, debounce_seconds=3600.0)).select("path", F.date_format("first", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first"), F.date_format("last", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last"), "n")


@query
def ST4_incremental_state(spark, sf_dir):
    """The index after all changes: notes whose last change is no delete, with their current rows."""
    e = log(spark, sf_dir)
    current = e.groupBy("path").agg(F.count("*").alias("size"))
    state = current.withColumn("size", F.lit(0).cast("long"))
    return changes.applied(state, changes.watched(e), current)


@query
def ST10_cache_reuse(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("key"))
    return cache.reuse(d.where("source <> 'src0'"), d.where("source <> 'src1'"), "key")


# ---- mutations ---------------------------------------------------------------------------------------------------
@query
def X1_patched_notes(spark, sf_dir):
    """Section edits are a sequential kernel; tested on small cases."""
    n = headed(spark, sf_dir)
    edits = n.where(F.size("h") > 0).select("path", F.lit("append").alias("action"), F.array_join(F.get(md.heading_paths(F.col("h")), F.lit(0))["path"], "::").alias("target"), F.lit("added line").alias("content"), F.lit("content").alias("scope"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"))
    return mutate.edited(n, edits).select("path", F.md5(F.col("text").cast("binary")).alias("text_md5"), "error")


@query
def X2_appended(spark, sf_dir):
    return notes(spark, sf_dir).select("path", F.md5(mutate.appended(F.col("text"), F.lit("\n\nadded\n\n")).cast("binary")).alias("text_md5"))


@query
def X4_set_fields(spark, sf_dir):
    """Front-matter edits are a sequential kernel; tested on small cases."""
    n = notes(spark, sf_dir)
    edits = n.select("path", F.lit("set").alias("action"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("scope"), F.lit("status").alias("field"), F.lit('"on"').alias("value"))
    return mutate.edited(n, edits).select("path", F.md5(F.col("text").cast("binary")).alias("text_md5"), "error")


@query
def X5_set_body(spark, sf_dir):
    return notes(spark, sf_dir).select("path", F.md5(mutate.set_body(F.col("text"), F.lit("new body\n\n\n")).cast("binary")).alias("text_md5"))


@query
def X6_deleted(spark, sf_dir):
    n = notes(spark, sf_dir).select("path")
    return mutate.deleted(n, n.where(F.startswith("path", F.lit("Reports/"))))


@query
def X8_moved_notes(spark, sf_dir):
    """Page targets that are named most move under a folder: links to them are rewritten."""
    n = page_notes(spark, sf_dir)
    moves = links.links(n).groupBy("target").agg(F.countDistinct("path").alias("n")).where("n > 20 and target rlike '^[a-z]+$'").select(F.col("target").alias("source"), F.concat(F.lit("moved to/"), "target").alias("target"))
    return links.moved(n, moves).select("path", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("rewritten").cast("long").alias("rewritten"))


@query
def X9_uploads(spark, sf_dir):
    p = src.pages(spark, sf_dir)
    held = p.select("path", F.sha2(F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise("old").cast("binary"), 256).alias("sha")).where("path not like '%7.pdf'")
    return mutate.uploaded(held, p.select("path", F.col("html").cast("binary").alias("content"))).select("path", "status")


# ---- catalogue and checks ----------------------------------------------------------------------------------------
@query
def G1_catalogue_entries(spark, sf_dir):
    return catalogue.entries(notes(spark, sf_dir))


@query
def G2_catalogue_lines(spark, sf_dir):
    """The catalogue's lines with their numbers."""
    listed = catalogue.placed(catalogue.entries(notes(spark, sf_dir)), ("Reports", "Workflows"))
    return listed.select("line_no", "folder", "kind", "line")


@query
def CK1_broken_links(spark, sf_dir):
    n = page_notes(spark, sf_dir)
    known = links.links(n).where(F.char_length("target") % 2 == 0).select(F.col("target").alias("path")).distinct()
    return checks.broken_links(n, known).groupBy("path").agg(F.count("*").alias("broken"))


@query
def CK3_front_matter(spark, sf_dir):
    return checks.front_matter(notes(spark, sf_dir))


@query
def CK4_hygiene(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = F.concat(F.when(F.col("lang") == "fr", F.lit("\ufeff")).otherwise(""), F.when(F.col("lang") == "de", F.lit("a\r\nb\n")).otherwise(""), F.coalesce("text", F.lit("")))
    return checks.hygiene(d.select(F.concat(F.when(F.col("lang") == "es", "DOC").otherwise("doc"), F.floor(F.col("doc_id") / 2).cast("string")).alias("path"), raw.alias("text"))).groupBy("detail", "severity").agg(F.count("*").alias("n"))


@query
def CK7_duplicate_headings(spark, sf_dir):
    return checks.duplicate_headings(notes(spark, sf_dir)).select("path", "detail")


@query
def CK8_documents(spark, sf_dir):
    n = notes(spark, sf_dir).select("path", F.concat(F.lit("see [p](/Files/page-"), F.col("doc_id").cast("string"), F.lit(".pdf)\n")).alias("text")).where("path like '%en/%'")
    return checks.documents(extracted(spark, sf_dir).select("path", "status"), n).select("path", "detail", "severity")


@query
def G3_check_summary(spark, sf_dir):
    """All nine checks over the notes, the filed pages and a stored catalogue; each check has a query of its own beside this."""
    n = notes(spark, sf_dir).select("path", "text")
    return checks.summary(checks.all_checks(n, extracted(spark, sf_dir), stored_catalogue(spark, sf_dir), "1998-01-01"))


def stored_catalogue(spark, sf_dir):
    """A catalogue that lacks one source's notes, has another description for another's, and lists the reports."""
    n = notes(spark, sf_dir)
    held = catalogue.entries(n).where(~F.startswith("path", F.lit("src4/")))
    old = F.when(F.startswith("path", F.lit("src5/")), F.concat(F.lit("old "), F.coalesce("description", F.lit("")))).otherwise(F.col("description"))
    reports = n.where(F.startswith("path", F.lit("Reports/"))).select("path", F.lit("Report").alias("title"), F.lit("listed").alias("description"))
    return held.select("path", "title", old.alias("description")).unionByName(reports)


@query
def CK2_catalogue_drift(spark, sf_dir):
    return checks.catalogue_drift(notes(spark, sf_dir), stored_catalogue(spark, sf_dir)).select("path", "detail")


@query
def CK5_series(spark, sf_dir):
    """Orders as a generated series of a note a day for each priority, empty where all orders are finished."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status"))
    path = F.concat(F.lit("Reports/"), "o_orderpriority", F.lit("/"), F.col("day").cast("string"), F.lit(".md"))
    n = o.groupBy(path.alias("path")).agg(F.when(F.bool_and(F.col("status") == "F"), " \n").otherwise("orders\n").alias("text"))
    return checks.series(n).select("path", "detail")


@query
def CK6_expiries(spark, sf_dir):
    """Orders as notes that expire on their day; those of one priority have no valid date."""
    o = table(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("soon")).when(F.col("o_orderpriority") == "2-HIGH", F.lit("none")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    n = o.select(F.concat(F.lit("o/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("---\nexpires:\n  - "), value, F.lit("\n---\n")).alias("text"))
    return checks.expiries(n, "1998-01-01").select("path", "detail", "severity")


@query
def CK9_callouts(spark, sf_dir):
    kind = F.when(F.col("role") == "user", "NOTE] Turn").when(F.col("turn") % 2 == 0, "odd] Turn").otherwise("WARNING]")
    d = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("path"), F.concat(F.lit("intro\n> [!"), kind, F.lit("\n> body\n\n> bare\n\n> [!tip] T\n")).alias("text"))
    return checks.callout_findings(d).select("path", "detail", "severity")


@query
def T2_listing_order(spark, sf_dir):
    """Places in the listing of each folder: folders first, then by name in any case."""
    order = Window.partitionBy("folder").orderBy(F.col("type") != "dir", F.lower("name"), "name")
    return src.list_dir(files(spark, sf_dir)).select("folder", "name", F.row_number().over(order).alias("place"))


@query
def S3_note_texts(spark, sf_dir):
    """Bytes with a byte-order mark, CR LF line ends and a broken byte at the end, as text."""
    raw = F.concat(F.unhex(F.lit("EFBBBF")), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\r\n")).cast("binary"), F.unhex(F.lit("FF")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(src.note_text(raw).cast("binary")).alias("text_md5"))


@query
def M11_resolved_targets(spark, sf_dir):
    """Where an edit of the last heading's name would go: its line, or that the name is ambiguous."""
    from corpus_engine.functions import kernels

    @F.pandas_udf("string")
    def found(text, target):
        def one(t, x):
            try:
                return f"line {kernels.resolve(t, x).line}"
            except kernels.Refused:
                return "ambiguous"
            except kernels.NotFound:
                return "not found"

        return text.__class__([one(t, x) for t, x in zip(text, target, strict=True)])

    n = headed(spark, sf_dir).select("path", "text", F.explode_outer(F.slice("h", -1, 1)).alias("x")).select("path", "text", F.col("x.text").alias("target")).where(F.col("target").rlike("^[a-zA-Z .,]*[a-zA-Z][a-zA-Z .,]*$"))
    return n.select("path", found("text", "target").alias("found"))


@query
def FM4_scalars(spark, sf_dir):
    """Names stay bare, numbers and words that YAML takes for something else are quoted."""
    from corpus_engine.functions import kernels

    @F.pandas_udf("string")
    def written(v):
        return v.map(kernels.scalar)

    n = table(spark, sf_dir, "nation")
    values = F.array("n_name", F.col("n_nationkey").cast("string"), F.lit("true"), F.concat(F.lit("a: "), "n_name"), F.lit("2024-01-02T03:04:05Z"))
    return n.select("n_nationkey", F.posexplode(values).alias("at", "value")).select("n_nationkey", F.col("at").cast("long").alias("at"), written("value").alias("written"))


@query
def FM7_deleted_fields(spark, sf_dir):
    n = notes(spark, sf_dir)
    edits = n.select("path", F.lit("delete").alias("action"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("scope"), F.lit("tags").alias("field"), F.lit(None).cast("string").alias("value"))
    return mutate.edited(n, edits).select("path", F.md5(F.col("text").cast("binary")).alias("text_md5"), "error")


@query
def FM6_inserted_fields(spark, sf_dir):
    """A description where there was none: before the tags, after the title."""
    n = notes(spark, sf_dir).select("path", F.regexp_replace("text", r"\ndescription:[^\n]*(\n  [a-z][^\n]*)*", "").alias("text"))
    edits = n.select("path", F.lit("set").alias("action"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("scope"), F.lit("description").alias("field"), F.lit('"a: b"').alias("value"))
    return mutate.edited(n, edits).select("path", F.md5(F.col("text").cast("binary")).alias("text_md5"), "error")
