"""DuckDB SQL for the operators that SQL can express, over the whole tables."""

from __future__ import annotations

from . import quality_rules as q

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def urls(rules: dict[str, str], blocked: list[str]) -> str:
    def case(value) -> str:
        parts = []
        for rule in sorted(rules, key=lambda x: (-len(x), x)):
            host, _, path = rule.partition("/")
            parts.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{value(rule)}'")
        return " ".join(parts)

    listed = " OR ".join(f"host = '{x}' OR ends_with(host, '.{x}')" for x in blocked)
    return f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 p AS (SELECT page_id, {LOWERED.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
 SELECT page_id, host, path, CASE {case(lambda x: x)} END AS rule, CASE {case(lambda x: rules[x])} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM p"""


PASSAGES = rf"""WITH dw AS (SELECT doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 il AS (SELECT item_id, w, least(10, len(w)) AS n FROM iw WHERE len(w) > 0), win AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS g FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM il)),
 ns AS (SELECT DISTINCT n FROM win), dg AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns WHERE len(w) >= n)),
 h AS (SELECT doc_id, i, dg.n, item_id FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g), hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
 it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
 SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)"""

ARCHIVES = """WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS n FROM pages), g AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS top FROM p)
 SELECT page_id, n AS payload_bytes, payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM g"""

MIDDLES = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
 h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
 c AS (SELECT doc_id, t, n, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi FROM h),
 p AS (SELECT *, substr(t, 1, lo) AS a, substr(t, lo + 1, hi - lo) AS b, substr(t, hi + 1) AS z FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

#: Every order is applied to every document; no subset is counted.
AUDIT = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS low FROM documents),
 lb AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
 f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, list_concat(
   CASE WHEN len(w) < 200 THEN ['A'] ELSE [] END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN ['B'] ELSE [] END,
   CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN ['C'] ELSE [] END,
   CASE WHEN regexp_matches(t, '[#$%&*|]') THEN ['D'] ELSE [] END, CASE WHEN d.doc_id > low THEN ['E'] ELSE [] END) AS fails FROM d LEFT JOIN lb USING (doc_id)),
 l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
 o AS (SELECT a.c || b.c || x.c || y.c || z.c AS filter_order FROM l a, l b, l x, l y, l z WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
 s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS c, string_split(filter_order[1:step - 1], '') AS before FROM o, range(1, 6) r(step)),
 k AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY 1, 2),
 e AS (SELECT part, filter_order, step, c, sum(CASE WHEN NOT list_contains(fails, c) AND NOT list_has_any(fails, before) THEN n ELSE 0 END) AS kept,
   sum(CASE WHEN list_contains(fails, c) AND NOT list_has_any(fails, before) THEN n ELSE 0 END) AS removed, sum(CASE WHEN list_contains(fails, c) AND list_has_any(fails, before) THEN n ELSE 0 END) AS redundant,
   sum(CASE WHEN fails = [c] THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN list_contains(fails, c) AND NOT list_has_any(fails, before) THEN good ELSE 0 END) AS good_lost,
   sum(CASE WHEN list_contains(fails, c) AND NOT list_has_any(fails, before) THEN bad ELSE 0 END) AS toxic_lost FROM k, s GROUP BY 1, 2, 3, 4)
 SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM e"""


def rules() -> str:
    """The base counts, the histograms, each language's reference and the distances to them."""
    t, marks = "coalesce(text, '')", "[#*%&]"
    gone = lambda p: f"(length({t}) - length(regexp_replace({t}, '{p}', '', 'g')))"
    chars = [gone(r"\p{Ll}"), gone(r"\p{Lu}"), gone(r"[\p{Lt}\p{Lm}\p{Lo}\p{M}]"), gone(r"\p{N}"), f"({gone(r'\p{P}')} - {gone(marks)})", f"({gone(r'\p{S}')} + {gone(marks)})"]
    word = "[^\\x20\\x09-\\x0D]+"
    common = ", ".join(f"len(list_filter(lw, lambda x: x = '{w}'))" for w in q.COMMON_WORDS)

    def far(column: str, enough: str, most: float, width: int) -> str:
        p, r = f"({column}[i] / pn)", "(ref[i] / rn)"
        m = f"(({p} + {r}) / 2)"
        term = f"CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + CASE WHEN {r} > 0 THEN {r} * log2({r} / {m}) ELSE 0 END"
        return f"""SELECT row, sqrt(greatest(sum({term}) / 2, 0)) > {most} AS far FROM (SELECT row, lang, {column}, list_sum({column})::DOUBLE AS pn FROM k WHERE {enough} AND list_sum({column}) > 0) JOIN
 (SELECT lang, [{", ".join(f"sum({column}[{i}])" for i in range(1, width + 1))}] AS ref, sum(list_sum({column}))::DOUBLE AS rn FROM k WHERE NOT base_failed GROUP BY lang HAVING sum(list_sum({column})) > 0) USING (lang), range(1, {width + 1}) s(i) GROUP BY row"""

    return rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(lang, '') AS lang, text, regexp_extract_all({t}, '{word}') AS w FROM documents), f AS (SELECT row, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {gone("[#*$%&|<>]")} AS n_symbols,
 len(list_filter(string_split({t}, chr(10)), lambda x: regexp_matches(x, '{word}'))) - len(list_distinct(list_filter(string_split({t}, chr(10)), lambda x: regexp_matches(x, '{word}')))) AS n_dup_lines, [{", ".join(chars)}] AS chars, list_append([{common}], len(w) - list_sum([{common}])) AS common
 FROM (SELECT *, list_filter(list_transform(w, lambda x: lower(x)), lambda x: strlen(x) <= {q.LONGEST}) AS lw FROM d)),
 wn AS (SELECT row, i, w[i:i + 4] AS g FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)), rp AS (SELECT row, i FROM wn QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
 rw AS (SELECT row, count(DISTINCT p) AS n_repeat_words FROM (SELECT row, unnest(range(i, i + 5)) AS p FROM rp) GROUP BY 1),
 k AS (SELECT f.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed FROM f LEFT JOIN rw USING (row)),
 c AS ({far("chars", f"list_sum(chars) >= {q.MIN_CHARS}", q.MAX_CLASS_DISTANCE, len(chars))}), o AS ({far("common", f"n_words >= {q.MIN_WORDS}", q.MAX_WORD_DISTANCE, len(q.COMMON_WORDS) + 1)})
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(c.far, false) AND NOT coalesce(o.far, false) AS kept FROM k LEFT JOIN c USING (row) LEFT JOIN o USING (row)"""
