"""DuckDB SQL for the training-data queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from corpus_engine.llm.licenses import ABOVE, GAP, RULES, sequences
from corpus_engine.llm.secrets import BASE
from corpus_engine.llm.secrets import RULES as SECRETS


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _secrets() -> str:
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS kind, {r.least} AS least, unnest(regexp_extract_all(t, {quoted(r.pattern)}, 0)) AS m, unnest(regexp_extract_all(t, {quoted(r.pattern)}, {r.group})) AS g, "
        f"unnest(regexp_split_to_array(t, {quoted(r.pattern)})[:len(regexp_extract_all(t, {quoted(r.pattern)}, 0))]) AS gap, generate_subscripts(regexp_extract_all(t, {quoted(r.pattern)}, 0), 1) AS n FROM d WHERE regexp_matches(t, {quoted(r.pattern)})"
        for i, r in enumerate(SECRETS)
    )
    names = "[" + ", ".join(quoted(r.kind) for r in SECRETS) + "]"
    text = f"{names}[kind + 1] || ':' || start || ':' || stop"
    counts = ", ".join(f"count(CASE WHEN kind = {i} THEN 1 END) AS n_{r.kind}" for i, r in enumerate(BASE))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({kinds}),
ends AS (SELECT doc_id, kind, least, g, length(m) AS size, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY n) AS stop FROM found),
spans AS (SELECT doc_id, kind, (stop - size)::BIGINT AS start, stop::BIGINT AS stop FROM ends WHERE length(g) >= least)
SELECT doc_id, {counts}, sha256(coalesce(string_agg({text}, ',' ORDER BY start, kind) FILTER (WHERE kind < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg({text}, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id"""


def _licenses() -> str:
    """Separators are doubled, so that neighbours need not share one, and sentences are looked for longest first."""
    by_name: dict[str, list[str]] = {}
    for words, name in sequences():
        by_name.setdefault(name, []).append(words.replace(".", r"\.\.").replace(" ", "(?: |\n\n|;;)"))
    text = r"chr(10) || lower(coalesce(text, '')) || chr(10)"
    for pattern, to in (
        (r"[^\p{L}\p{N}.!?:;\n]+", " "),
        (r"([\p{L}\p{N}])[.!?:;]([\p{L}\p{N}])", r"\1 \2"),
        (r"([\p{L}\p{N}])[.!?:;]([\p{L}\p{N}])", r"\1 \2"),
        (r"[ :;\n]*[.!?][ .!?:;\n]*", "."),
        (r"[ :;]*\n[ :;]*\n[ .!?:;\n]*", "."),
        (r"[ \n]*[:;][ :;\n]*", ";"),
        (r" ?\n ?", "\n"),
        (r"([.;\n])", r"\1\1"),
    ):
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(to)}, 'g')"
    text = f"'..' || {text} || '..'"
    for name, patterns in by_name.items():
        text = f"regexp_replace({text}, {quoted(f'([.;\n])(?:{'|'.join(patterns)})([.;\n])')}, {quoted(rf'\1<{name}>\2')}, 'g')"
    rules = " UNION ALL ".join(
        f"SELECT doc_id, {quoted(r.license)} AS license, {quoted(r.family)} AS rule, len(regexp_extract_all(line, {quoted(rf'(?: \w+ ){{0,{GAP}}}?'.join(f' {s} ' for s in r.sentences))})) AS n, "
        f"list_min(list_transform(list_filter(hits, lambda h: h.name IN ({', '.join(map(quoted, r.sentences))})), lambda h: h.pos)) AS first, list_max(list_transform(list_filter(hits, lambda h: h.name IN ({', '.join(map(quoted, r.sentences))})), lambda h: h.pos)) AS last, {n} AS no, {ABOVE[n]}::INT[] AS above FROM seqs"
        for n, r in enumerate(RULES)
    )
    return rf"""WITH named AS (SELECT doc_id, {text} AS t FROM documents WHERE regexp_matches(coalesce(text, ''), '(?i)licen[cs]e|permi|warrant|redistrib|copyright|public|this|mpl|advert')),
cut AS (SELECT doc_id, string_split(t, '..') AS s FROM named WHERE contains(t, '<')),
each AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) - 2 AS pos FROM cut),
found AS (SELECT doc_id, pos, unnest(regexp_extract_all(s, '<(\w+)>', 1)) AS name, generate_subscripts(regexp_extract_all(s, '<(\w+)>', 1), 1) AS n FROM each),
seqs AS (SELECT doc_id, list({{'pos': pos, 'name': name}} ORDER BY pos, n) AS hits, ' ' || string_agg(name, '  ' ORDER BY pos, n) || ' ' AS line FROM found GROUP BY doc_id),
matched AS (SELECT * FROM ({rules}) WHERE n > 0)
SELECT doc_id, license, rule, n, first, last FROM matched m WHERE NOT EXISTS (SELECT 1 FROM matched o WHERE o.doc_id = m.doc_id AND list_contains(m.above, o.no) AND o.first <= m.first AND o.last >= m.last)"""


SUBSTRINGS = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
wins AS (SELECT doc_id, i, CASE WHEN i <= len(w) - 12 THEN array_to_string(w[i:i + 12], ' ') END AS win, words.word FROM words JOIN w USING (doc_id)),
firsts AS (SELECT win, min(doc_id) AS first FROM wins WHERE win IS NOT NULL GROUP BY win),
marked AS (SELECT doc_id, i, word, max(CASE WHEN first < doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS 12 PRECEDING) AS gone FROM wins LEFT JOIN firsts USING (win))
SELECT doc_id, count(i) AS n_words, count(CASE WHEN gone = 1 THEN 1 END) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM documents LEFT JOIN marked USING (doc_id) GROUP BY doc_id"""

LONG_STRINGS = r"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
each_byte AS (SELECT doc_id, b, unnest(range(1, octet_length(b) + 1)) AS i FROM d),
strings AS (SELECT doc_id, i, CASE WHEN i <= octet_length(b) - 199 THEN md5(b[i:i + 199]) END AS s, hex(b[i:i]) AS byte FROM each_byte),
counts AS (SELECT s, count(*) AS n FROM strings WHERE s IS NOT NULL GROUP BY s),
marked AS (SELECT doc_id, i, byte, max(CASE WHEN n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS 199 PRECEDING) AS gone FROM strings LEFT JOIN counts USING (s)),
edges AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS opens FROM marked)
SELECT doc_id, count(i) AS n_bytes, count(CASE WHEN gone = 1 THEN 1 END) AS n_removed, count(CASE WHEN opens THEN 1 END) AS n_spans, sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE gone = 0), ''))) AS kept_sha256
FROM documents LEFT JOIN edges USING (doc_id) GROUP BY doc_id"""

ORACLES = {"op1_secrets": _secrets(), "op4_licenses": _licenses(), "op7_substrings": SUBSTRINGS, "op8_runindex": LONG_STRINGS}
