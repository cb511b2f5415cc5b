"""Benchmark decontamination by template canonicalisation.

Texts become tokens, and tokens become a template: numbers, units after a number and names turn into typed
placeholders, other words into lower case. Hashes of template windows of the benchmark are hash-joined with those of
the documents. Windows that agree only up to placeholders count if the slots are filled consistently along their
alignment: one benchmark value always stands for one document value, and one document value for one benchmark value.
A document holds an item if at least `containment` of the item's windows are found in it. DataFrame operations only.

Documents have one template, in which every capitalised word is a name: names also start sentences and lines. Items
have three, since a copy may have another case or stand elsewhere in a sentence: with every capitalised word as a
name, with those inside a sentence only, and with none. A window of the first counts only if it has a word that is no
placeholder. The place of an item is found if its window of any of the three is.

An item of fewer than `width` tokens is one window, all its tokens with the values they have in it: only copies of it
(in any case and with any marks between) hold it, at one token just that word. Null or empty texts have no windows. Rows equal in id
and text count as one document; different texts of one id, or without an id, are different documents. Repeated items are
each reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.common import blob_of, written

#: Units that follow a number (fixed values).
UNITS = ("mm", "cm", "m", "km", "g", "kg", "mg", "t", "s", "ms", "min", "h", "l", "ml", "kb", "mb", "gb", "hz", "v", "w", "kw", "c", "f", "ft", "lb", "lbs", "oz", "mph", "eur", "usd", "percent", "meters", "metres", "miles", "inches", "hours", "minutes", "seconds", "days", "years", "dollars", "euros")
#: Placeholders and the sign that joins the parts of a decimal number, from the private use area.
NUMBER, UNIT, NAME, POINT = "\ue000", "\ue001", "\ue002", "\ue004"
INNER_NAME = r"(?<=[\p{Ll},;:] )\p{Lu}\p{Ll}+"
ANY_NAME = r"(?<![\p{L}\p{N}\p{M}_\uE000-\uE004])\p{Lu}\p{Ll}+"
#: The names that each of an item's templates replaces.
TEMPLATES = (ANY_NAME, INNER_NAME, None)
BETWEEN = r"[^\p{L}\p{N}\p{M}_\uE000-\uE004]+"
#: Benchmark windows up to which their side of the join is broadcast (16 bytes each); beyond it is shuffled.
BROADCAST_WINDOWS = 500_000


def tokens(text: Column, names: str | None = ANY_NAME) -> Column:
    """The tokens of a text: placeholders, each followed by what it stands for, and words in lower case.

    names is the pattern of names, INNER_NAME or ANY_NAME or none; the tokens are cut in the same places with each.
    """
    text = F.coalesce(text, F.lit(""))
    numbers = F.regexp_replace(F.regexp_replace(text, r"(?<=\p{Nd})[.,](?=\p{Nd})", POINT), rf"\p{{Nd}}[\p{{Nd}}{POINT}]*", NUMBER + "$0")
    units = F.regexp_replace(numbers, rf"(?<={NUMBER}[\p{{Nd}}{POINT}]{{0,40}}[ -]?)(?i:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])", UNIT + "$0")
    out = F.when(text.rlike(r"\p{Nd}"), units).otherwise(text)
    if names:
        out = F.regexp_replace(out, names, NAME + "$0")
    return F.split(F.lower(out), BETWEEN, -1)


def kind(token: Column) -> Column:
    """A token of the template: the placeholder alone, or the word."""
    first = F.left(token, F.lit(1))
    return F.when(first.isin(NUMBER, UNIT, NAME), first).otherwise(token)


def windows(df: DataFrame, width: int, id_col: str, names: str | None = ANY_NAME, values: bool = False) -> DataFrame:
    """(id, t, at, h): every window of a table (id, text), h the hash of its template and t the tokens of the whole text.

    With values the hash is that of the tokens themselves. Each step is a column of its own: an expression inlined into
    a lambda would be evaluated for every element. t is for those who cut the window's tokens from it in the same stage.
    """
    hashed = df.withColumn("t", tokens(F.col("text"), names)).withColumn("hashed", F.transform("t", lambda t: F.xxhash64(t if values else kind(t))))
    several = F.transform(F.sequence(F.lit(0), F.size("hashed") - width), lambda i: window_hash(i, width))
    rows = hashed.withColumn("w", F.when(F.size("hashed") >= width, several))
    # outer: else a filter on the windows is inferred and evaluates all steps above once more, nested
    return rows.select(id_col, "t", F.posexplode_outer("w").alias("at", "h")).where("h is not null")


def window_hash(i: Column, width: int) -> Column:
    return F.xxhash64(*[F.get("hashed", i + j) for j in range(width)])


def is_slot(token: Column) -> Column:
    return F.left(token, F.lit(1)).isin(NUMBER, UNIT, NAME)


def item_windows(benchmark: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, pos, h, theirs, slots, n_windows) of all templates; slots is whether the window has placeholders."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    each = None
    for names in TEMPLATES:
        whole = ~F.exists("filled", lambda t: t == "")  # marks at the ends of a text leave an empty token
        some_word = F.exists("filled", lambda t: ~is_slot(t)) if names == ANY_NAME else F.lit(True)
        own = windows(items, width, "item_id", names).withColumn("filled", F.slice("t", F.col("at") + 1, width)).where(whole & some_word)
        own = own.select("item_id", F.col("at").alias("pos"), "h", F.col("filled").alias("theirs"), F.exists("filled", is_slot).alias("slots"))
        each = own if each is None else each.unionByName(own)
    each = each.distinct()
    size = each.groupBy(F.col("item_id").alias("q")).agg(F.countDistinct("pos").alias("n_windows"))
    return each.join(size, F.col("item_id").eqNullSafe(F.col("q"))).drop("q")


def short_items(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, n_tokens, h) of the items of fewer than width tokens: the hash of all tokens with their values."""
    rows = benchmark.select("item_id", F.array_remove(tokens(F.col("text"), None), "").alias("t"))
    rows = rows.where(F.size("t").between(1, width - 1)).withColumn("hashed", F.transform("t", lambda t: F.xxhash64(t)))
    whole = F.coalesce(*[F.when(F.size("hashed") == n, window_hash(F.lit(0), n)) for n in range(1, width)])
    return rows.select("item_id", F.size("t").alias("n_tokens"), whole.alias("h"))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, containment) of the pairs that reach the containment."""
    return found(docs, benchmark, width, containment, id_col, text_col).withColumn("doc_id", F.col("doc_id.id"))


def found(docs: DataFrame, benchmark: DataFrame, width: int = 5, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As contaminated, but doc_id is the row's identity: a struct of its id and its text's SHA-256."""
    items = written(item_windows(benchmark, width), "benchmark_windows", narrow=True)
    small = items.count() <= BROADCAST_WINDOWS
    # every hash once: a document's window meets one row, whatever number of items hold it
    keys = items.groupBy("h").agg(F.collect_set(F.struct("item_id", "pos", "slots", "theirs", "n_windows")).alias("held"))
    texts = docs.select(F.struct(F.col(id_col).alias("id"), blob_of(F.col(text_col)).alias("blob")).alias("doc_id"), F.col(text_col).alias("text"))
    part = F.slice("t", F.col("at") + 1, width).alias("filled")
    if small:  # windows are cut from their text after the join, where few are left
        met = windows(texts, width, "doc_id").join(F.broadcast(keys), "h").select("doc_id", "at", part, "held")
    else:  # before the exchange, so that no text goes through it
        met = windows(texts, width, "doc_id").select("doc_id", "at", "h", part).join(keys, "h")
    met = met.select("doc_id", "at", "filled", F.explode("held").alias("i"))
    each = met.select("doc_id", "i.item_id", "i.pos", (F.col("at") - F.col("i.pos")).alias("shift"), "i.slots", "i.n_windows", F.when(F.col("i.slots"), F.col("filled")).alias("ours"), F.when(F.col("i.slots"), F.col("i.theirs")).alias("theirs"))
    each = written(each.distinct(), "benchmark_hits", narrow=True)
    odd = inconsistent(each.where("slots"), width)
    same = each.doc_id.eqNullSafe(F.col("o_doc")) & each.item_id.eqNullSafe(F.col("o_item")) & (each["shift"] == F.col("o_shift"))
    hits = each.join(odd, same & each.slots, "left_anti").select("doc_id", "item_id", "pos", "n_windows")
    short = written(short_items(benchmark, width), "short_items", narrow=True)
    for n in sorted(r["n_tokens"] for r in short.select("n_tokens").distinct().collect()):
        own = short.where(F.col("n_tokens") == n).groupBy("h").agg(F.collect_list("item_id").alias("held"))
        rows = windows(texts, n, "doc_id", None, values=True).select("doc_id", "h").join(F.broadcast(own) if small else own, "h")
        rows = rows.select("doc_id", F.explode("held").alias("item_id")).distinct()
        hits = hits.unionByName(rows.select("doc_id", "item_id", F.lit(0).alias("pos"), F.lit(1).cast("long").alias("n_windows")))
    share = F.col("n_found") / F.col("n_windows")
    return hits.groupBy("doc_id", "item_id", "n_windows").agg(F.countDistinct("pos").alias("n_found")).withColumn("containment", share).where(F.col("containment") >= containment)


def inconsistent(hits: DataFrame, width: int) -> DataFrame:
    """Alignments (o_doc, o_item, o_shift) whose slots are filled by no one-to-one relation of values."""
    slot = F.filter(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.struct(F.get("theirs", j).alias("theirs"), F.get("ours", j).alias("ours"))), lambda f: is_slot(f["theirs"]))
    filled = hits.select("doc_id", "item_id", "shift", F.explode_outer(slot).alias("f")).where("f is not null").select("doc_id", "item_id", "shift", "f.*").distinct()
    alignment = ["doc_id", "item_id", "shift"]
    each = [filled.groupBy(*alignment, side).agg(F.count("*").alias("n")).where("n > 1").select(*alignment) for side in ("theirs", "ours")]
    return each[0].unionByName(each[1]).distinct().toDF("o_doc", "o_item", "o_shift")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 5, containment: float = 0.8) -> DataFrame:
    """docs without those that hold a benchmark item."""
    bad = written(found(docs, benchmark, width, containment).select(F.col("doc_id.id").alias("_ce_bad"), F.col("doc_id.blob").alias("_ce_blob")).distinct(), "contaminated", narrow=True)
    return docs.join(bad, docs.doc_id.eqNullSafe(bad._ce_bad) & (blob_of(docs.text) == bad._ce_blob), "left_anti")
