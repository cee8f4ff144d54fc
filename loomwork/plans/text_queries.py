"""Queries over documents, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import textjobs as tj
from .registry import Registry

TOK = "list_filter(regexp_split_to_array(lower(strip_accents({})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def register(r: Registry) -> None:
    add = r.add
    add("txt_clean", "documents", lambda d: d.select("doc_id", tx.clean_text(F.concat(F.lit("​  a\tb \r\n"), "text", F.lit("\n\n\n\nfoo-\nbar  "))).alias("v")),
        r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate('a' || chr(9) || 'b ' || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10) || 'foo-' || chr(10) || 'bar', chr(9), ' '), '([a-z])-\n([a-z])', '\1\2', 'g'), ' +', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS v FROM documents""")
    add("txt_repeated_lines", "documents", lambda d: tj.repeated_lines(d, "doc_id", "source", "text", 0.01).select("source", "line", "n"),
        r"""WITH l AS (SELECT DISTINCT source, doc_id, regexp_replace(lower(trim(raw)), '[0-9]+', '#', 'g') AS line, FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents) WHERE trim(raw) <> '' AND length(trim(raw)) <= 160), p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1)
            SELECT source, line, count(*) AS n FROM l JOIN p USING (source) WHERE pages >= 3 GROUP BY source, line, pages HAVING count(*) > 0.01 * pages""")
    add("txt_strip_lines", "documents", lambda d: tj.strip_repeated_lines(d, "doc_id", "source", "text", threshold=0.01),
        r"""WITH s AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, source, i, l[i] AS raw, regexp_replace(lower(trim(l[i])), '[0-9]+', '#', 'g') AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM s)),
            p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1), f AS (SELECT source, line FROM (SELECT DISTINCT source, doc_id, line FROM e WHERE trim(raw) <> '' AND length(trim(raw)) <= 160) JOIN p USING (source) WHERE pages >= 3 GROUP BY source, line, pages HAVING count(*) > 0.01 * pages)
            SELECT d.doc_id, coalesce(t, '') AS text FROM documents d LEFT JOIN (SELECT doc_id, string_agg(raw, chr(10) ORDER BY i) AS t FROM e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.source = e.source AND f.line = e.line) GROUP BY 1) x USING (doc_id)""")
    add("txt_chunk", "documents", lambda d: tj.chunks(d, "doc_id", "text"))
    def idf(i):
        return f"greatest(0.1, ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)))"
    def part(i):
        return f"{idf(i)} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / av))"
    add("txt_bm25", "documents", lambda d: tj.bm25(d, "doc_id", "text", ["there", "onen"]),
        f"""WITH t AS (SELECT doc_id AS id, {TOK.format('text')} AS t FROM documents), f AS (SELECT id, len(t) AS len, len(list_filter(t, lambda x: starts_with(x, 'there')))::DOUBLE AS tf0, len(list_filter(t, lambda x: starts_with(x, 'onen')))::DOUBLE AS tf1 FROM t),
            s AS (SELECT count(*) AS n, avg(len) AS av, count(*) FILTER (tf0 > 0) AS df0, count(*) FILTER (tf1 > 0) AS df1 FROM f), g AS (SELECT id, round({part(0)} + {part(1)}, 6) AS score FROM f, s) SELECT * FROM g WHERE score > 0""")
    def both(i, q):
        return f"2.0 * len(list_filter(a, lambda x: starts_with(x, '{q}'))) + len(list_filter(t, lambda x: starts_with(x, '{q}'))) AS tf{i}"
    add("txt_bm25__weights", "documents", lambda d: tj.bm25(d, "doc_id", {"source": 2.0, "text": 1.0, "lang": 0.0}, ["web", "there"]),
        f"""WITH t AS (SELECT doc_id AS id, coalesce({TOK.format('source')}, []) AS a, coalesce({TOK.format('text')}, []) AS t FROM documents), f AS (SELECT id, len(a) + len(t) AS len, {both(0, 'web')}, {both(1, 'there')} FROM t),
            s AS (SELECT count(*) AS n, avg(len) AS av, count(*) FILTER (tf0 > 0) AS df0, count(*) FILTER (tf1 > 0) AS df1 FROM f), g AS (SELECT id, round(({part(0)} + {part(1)})::DOUBLE, 6) AS score FROM f, s) SELECT * FROM g WHERE score > 0""")
    add("txt_pii", "documents", lambda d: tj.scan_pii(d, "doc_id", "text"))
    add("txt_pii_mask", "documents", lambda d: tj.mask(d, "doc_id", "text"))
    add("txt_name_match", "part", lambda d: tj.name_matches(d, d, "p_name", "p_name", 0.3),
        f"""WITH a AS (SELECT DISTINCT p_name AS a, list_distinct({TOK.format('p_name')}) AS wa FROM part), b AS (SELECT DISTINCT p_name AS b, list_distinct({TOK.format('p_name')}) AS wb FROM part)
            SELECT a, b, round(len(list_intersect(wa, wb)) / (len(wa) + len(wb) - len(list_intersect(wa, wb)))::DOUBLE, 6) AS score FROM a, b WHERE score >= 0.3""")
    typo = "translate(p_name, 'ae', 'ea')"
    add("txt_link", "part", lambda d: tj.link_names(d.select(F.expr(typo).alias("q")), d, "q", "p_name"),
        f"""WITH q AS (SELECT DISTINCT {typo} AS q FROM part), n AS (SELECT DISTINCT p_name AS name FROM part), s AS (SELECT q, name, CASE WHEN q = name THEN 1.0 WHEN starts_with(name, q) THEN 0.95 WHEN len(list_filter(string_split(q, ' '), lambda t: NOT list_contains(string_split(name, ' '), t))) = 0 THEN 0.9 ELSE 1 - levenshtein(q, name) / greatest(length(q), length(name))::DOUBLE END::DOUBLE AS score FROM q, n)
            SELECT q, name, round(score, 6) AS score FROM s WHERE score >= 0.78 QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, name) <= 3""")
    add("txt_amounts", "part", lambda d: d.select("p_partkey", tj.parse_amount(F.expr("case p_partkey % 4 when 0 then concat('EUR 1.', lpad(p_size, 3, '0'), ',50') when 1 then concat('$1,', lpad(p_size, 3, '0'), '.50') when 2 then concat(p_size, ',5') else concat('1.', lpad(p_size, 3, '0')) end")).alias("v")),
        "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1000.5 + p_size WHEN 1 THEN 1000.5 + p_size WHEN 2 THEN p_size + 0.5 ELSE 1000 + p_size END::DOUBLE AS v FROM part")
    # "1.050" is 1050 by itself, but 1.05 in a column whose other values show a decimal point
    made = "case p_partkey % 3 when 0 then concat('1.', lpad(p_size, 3, '0')) when 1 then concat('USD ', p_size, '.5') else concat('$1,', lpad(p_size, 3, '0'), '.50') end"
    add("txt_amounts__column", "part", lambda d: tj.parse_amounts(d.select("p_partkey", F.expr(made).alias("amount")), "amount", "v").select("p_partkey", F.round("v", 6).alias("v")),
        "SELECT p_partkey, round(CASE p_partkey % 3 WHEN 0 THEN 1 + p_size / 1000.0 WHEN 1 THEN p_size + 0.5 ELSE 1000.5 + p_size END, 6)::DOUBLE AS v FROM part")
    add("url_normalise", "pages", lambda d: d.select("page_id", tx.normalize_url(F.col("url")).alias("v")),
        """WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, lower(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), ':(80|443)$', '')) AS h, regexp_extract(regexp_replace(url, '#.*$', ''), '://[^/?]*([^?]*)', 1) AS p, regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1) AS q FROM pages),
           w AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid|ref)(=|$)'))) AS l FROM u)
           SELECT page_id, s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(l) > 0 THEN '?' || array_to_string(l, '&') ELSE '' END AS v FROM w""")
    add("url_dedupe", "pages", lambda d: tj.dedupe_pages(d, "url", "page_id"))
    add("page_text", "pages", lambda d: tj.page_texts(d, "page_id", "html"))
    add("page_quality", "documents", lambda d: d.select("doc_id", tj.page_quality(F.col("text")).alias("quality")),
        f"""WITH t AS (SELECT doc_id, text, len({TOK.format('text')}) AS w, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents), s AS (SELECT *, len(list_filter(l, lambda x: len(regexp_split_to_array(trim(x), '\\s+')) <= 3)) AS sh FROM t)
            SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{tj.REFUSED}') AND w < 200 THEN 'blocked' WHEN w < 50 THEN 'too_short' WHEN sh > 0.7 * len(l) THEN 'navigation' ELSE 'ok' END AS quality FROM s""")
    units = ", ".join(f"'{u}'" for u in tj.UNITS)
    words = "regexp_split_to_array(trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')), ' ')"
    marks = tj.MARKS.replace("'", "''")
    heads = ", ".join(f"'{h}'" for h in tj.HEADS)
    def there(k):
        return f"i + {k} > 0 AND " if k < 0 else ""
    def head(k):
        return f"({there(-k)}coalesce(c[i + {-k}] IN ({heads}), false) AND coalesce(regexp_matches(c[i + {1 - k}], '^[0-9]+$'), false) AND coalesce(regexp_matches(c[i + {2 - k}], '^[a-z]+$'), false))"
    norm = f"""array_to_string(list_filter(w, lambda x, i: NOT (regexp_matches(c[i], '{tj.CLOCK}') OR regexp_matches(c[i], '{tj.NAME}') OR c[i] = 'ago'
        OR (regexp_matches(c[i], '{tj.DAY}') AND coalesce(regexp_matches(c[i + 1], '{tj.CLOCK}'), false)) OR {head(0)} OR {head(1)} OR {head(2)}
        OR (c[i] IN ({units}) AND coalesce(c[i + 1] = 'ago', false)) OR (regexp_matches(c[i], '^[0-9]+$') AND coalesce(c[i + 1] IN ({units}), false) AND coalesce(c[i + 2] = 'ago', false)))), ' ')"""
    def worded(raw):
        return rf"(SELECT doc_id, w, list_transform(w, lambda x: regexp_replace(x, '{marks}', '', 'g')) AS c FROM (SELECT doc_id, {words} AS w FROM (SELECT doc_id, unnest(string_split({raw}, chr(10))) AS raw FROM documents)))"
    fetched = r"'new line' || chr(10) || regexp_replace(text, '^[^\n]*\n', '')"
    def after(d):
        return d.select("doc_id", F.concat(F.lit("new line\n"), F.regexp_replace("text", "^[^\n]*\n", "")).alias("text"))
    add("page_change", "documents", lambda d: tj.page_changes(d, after(d), "doc_id", "text"),
        rf"""WITH a AS (SELECT DISTINCT doc_id, {norm} AS line FROM {worded("text")}), b AS (SELECT DISTINCT doc_id, {norm} AS line FROM {worded(fetched)})
            SELECT doc_id, 'added' AS change, line FROM b WHERE line <> '' AND NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id AND a.line = b.line) UNION ALL SELECT doc_id, 'removed', line FROM a WHERE line <> '' AND NOT EXISTS (SELECT 1 FROM b WHERE a.doc_id = b.doc_id AND a.line = b.line)""")
    cos = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query, e.vec_id AS id, list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))) AS s FROM e, e q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id),
        k AS (SELECT query, id, round(s, 5) AS score, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank FROM s)"""
    def near(d):
        return tj.topk(d, d.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    add("vec_topk", "embeddings", near, f"{cos} SELECT * FROM k WHERE rank <= 10")
    add("rank_fusion__rrf", "part", lambda d: tj.rrf(fused(d)), "SELECT id, round(sum(weight / (60 + rank)), 8) AS score FROM (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS rank, 1.0::DOUBLE AS weight FROM part UNION ALL SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey), 0.5 FROM part) GROUP BY id")
    add("rank_fusion__minmax", "part", lambda d: tj.minmax_fuse(fused(d)), "SELECT id, round(sum(weight * (score - lo) / (hi - lo)), 6) AS score FROM (SELECT p_partkey AS id, p_retailprice AS score, 1.0::DOUBLE AS weight, min(p_retailprice) OVER () AS lo, max(p_retailprice) OVER () AS hi FROM part UNION ALL SELECT p_partkey, p_size, 0.5, min(p_size) OVER (), max(p_size) OVER () FROM part) GROUP BY id")


def fused(part):
    from ..operators.ranks import global_rank

    price = global_rank(part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").cast("double").alias("score")), ["score", "id"])
    size = global_rank(part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score")), ["score", "id"])
    both = [(price, "price", 1.0), (size, "size", 0.5)]
    a, b = [x.select(F.lit(n).alias("ranking"), "id", "score", "rank", F.lit(w).alias("weight")) for x, n, w in both]
    return a.unionByName(b)
