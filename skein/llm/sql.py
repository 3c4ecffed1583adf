"""DuckDB SQL of the corpus queries whose whole results SQL can express."""

from __future__ import annotations

from skein.llm import decontaminate, license_scan, mixing
from skein.llm._text import ALNUM_WORD, LOWER, SOLID_WORD, UPPER


def _words(table: str, id_col: str) -> str:
    return f"SELECT row_number() OVER () AS rid, {id_col}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM_WORD}') AS w FROM {table}"


def _templates() -> str:
    rows = []
    for base, group in (("true", license_scan.PHRASES), ("false", license_scan.TEXTS)):
        for label, text in group.items():
            words = license_scan.words_of(text)
            rows += [f"('{label}', {base}, {len(words)}, {i}, '{a} {b}')" for i, (a, b) in enumerate(zip(words, words[1:]))]
    return ", ".join(rows)


OP1 = f"""WITH d AS ({_words("documents", "doc_id")}),
t(template, base, size, place, gram) AS (VALUES {_templates()}),
g AS (SELECT rid, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT rid, w, unnest(range(1, len(w))) AS i FROM d)),
h AS (SELECT rid, template, base, size, pos, place, pos - place AS diagonal FROM g JOIN t USING (gram)),
votes AS (SELECT rid, template, base, size, diagonal, min(pos) AS first, max(pos) + 1 AS last, list(DISTINCT place) AS places
    FROM h GROUP BY rid, template, base, size, diagonal HAVING NOT base OR count(DISTINCT place) = size - 1),
far AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) <= {license_scan.NEIGHBOUR} THEN 0 ELSE 1 END AS fresh FROM votes),
near AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal) AS near FROM far),
reach AS (SELECT *, max(last) OVER (PARTITION BY rid, template, near ORDER BY first, diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM near),
part AS (SELECT *, sum(CASE WHEN base OR reached IS NULL OR first > reached + size THEN 1 ELSE 0 END) OVER (PARTITION BY rid, template, near ORDER BY first, diagonal) AS span FROM reach),
spans AS (SELECT rid, template, base, size, min(first) AS first, flatten(list(places)) AS places FROM part GROUP BY rid, template, base, size, near, span),
seen AS (SELECT *, len(list_distinct(list_concat(places, list_transform(places, lambda p: p + 1)))) / size AS part FROM spans),
good AS (SELECT * FROM seen WHERE part >= {license_scan.COVER})
SELECT d.doc_id, cast(len(any_value(d.w)) AS bigint) AS n_words, count(*) FILTER (WHERE base) AS n_base, cast(min(first) FILTER (WHERE base) AS bigint) AS first_word,
    cast(max(first) FILTER (WHERE base) AS bigint) AS last_word, coalesce(string_agg(DISTINCT template, ',' ORDER BY template) FILTER (WHERE base), '') AS base_labels,
    coalesce(string_agg(DISTINCT template, ',' ORDER BY template), '') AS labels, coalesce(max(part), 0.0) AS score, count(*) FILTER (WHERE NOT base) AS n_texts
FROM d LEFT JOIN good USING (rid) GROUP BY rid, d.doc_id"""

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(
    f"substr('{_ALPHABET}', (cast('0x' || substr(sha1(coalesce(html, '')), {1 + 5 * k}, 5) AS bigint) >> {shift}) % 32 + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0)
)

OP2 = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, {_BASE32} AS digest, row_number() OVER own AS r, first_value(page_id) OVER own AS first
    FROM pages WINDOW own AS (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST, coalesce(url, '')))
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN first END AS refers_to FROM p"""

OP4 = f"""WITH w AS (SELECT doc_id, source, md5(coalesce(cast(doc_id AS varchar), '') || '|' || coalesce(text, '')) AS ord, coalesce(len(regexp_extract_all(text, '{SOLID_WORD}')), 0) AS size FROM documents),
e AS (SELECT doc_id, source, ord, size, count(*) AS copies FROM w GROUP BY ALL),
p AS (SELECT source, cast(sum(size * copies) AS bigint) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM e GROUP BY source),
q AS (SELECT *, list_extract({list(mixing.WEIGHTS)}::double[], (rank - 1) % {len(mixing.WEIGHTS)} + 1) AS weight, cast({mixing.LIMIT} AS double) * source_size AS cap FROM p),
l AS (SELECT *, (cast({mixing.SHARE} AS double) * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM q WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap ELSE max(CASE WHEN cap > level * weight THEN level END) OVER () * weight END AS target FROM l),
s AS (SELECT e.*, source_size, target, cast(floor(target) AS bigint) AS stop, cast(coalesce(sum(size * copies) OVER (PARTITION BY e.source ORDER BY ord, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS start
    FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, greatest(0, least(start + size * copies, stop) - start) + greatest(0, least(start + source_size + size * copies, stop) - start - source_size) AS got FROM s)
SELECT doc_id, cast(size AS bigint) AS size, source_size, target, cast(got // copies + CASE WHEN copy < got % copies THEN 1 ELSE 0 END AS bigint) AS taken FROM (SELECT *, unnest(range(copies)) AS copy FROM k)"""

OP10 = f"""WITH d AS ({_words("documents", "doc_id")}), b AS ({_words("benchmark", "item_id")}),
i AS (SELECT cast(item_id AS varchar) AS item, w, least({decontaminate.WINDOW}, len(w)) AS size FROM b WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item, size, array_to_string(w[k:k + size - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM i)),
sizes AS (SELECT DISTINCT size FROM i),
places AS (SELECT rid, k, size, array_to_string(w[k:k + size - 1], ' ') AS phrase FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes)),
found AS (SELECT rid, k, size, item FROM places JOIN phrases USING (size, phrase)),
hits AS (SELECT rid, count(DISTINCT word) AS n_hit FROM (SELECT rid, unnest(range(k, k + size)) AS word FROM (SELECT DISTINCT rid, k, size FROM found)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)"""

SQL: dict[str, str] = {"op1_license_scan": OP1, "op2_warc": OP2, "op4_mixing": OP4, "op10_decontamination": OP10}
