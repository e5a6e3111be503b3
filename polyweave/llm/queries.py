"""Registered queries of this package and their SQL, where SQL can say it."""

from __future__ import annotations

import public_tokenizers

from . import (bpe, centroids, chat, decontaminate, divergence, html_text, metric_join, pitman_yor, quality, secrets, simhash, topk,
               toxicity)
from .common import read_table

SQL = {}


def op1_toxicity(spark, folder):
    return toxicity.scores(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op2_simhash(spark, folder):
    return simhash.near_duplicates(read_table(spark, folder, "documents"))


def op3_topk(spark, folder):
    vectors = topk.usable(read_table(spark, folder, "embeddings"))
    return topk.top_k(vectors, topk.query_rows(vectors).dropDuplicates(["vec_id"]))


SQL["op3_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
          FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5"""


def op4_pitman_yor(spark, folder):
    return pitman_yor.score(read_table(spark, folder, "documents"))


def op5_quotations(spark, folder):
    return chat.conversations(read_table(spark, folder, "conversations"))


SQL["op5_quotations"] = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn::BIGINT AS turn, role, string_split_regex(coalesce(text, ''), '\r?\n') AS ls FROM conversations),
x AS (SELECT r, conv_id, turn, role, list_transform(ls, lambda s: struct_pack(
        level := len(regexp_extract(s, '^\s*((>\s?)+)', 1)) - len(replace(regexp_extract(s, '^\s*((>\s?)+)', 1), '>', '')),
        said := regexp_replace(s, '^\s*((>\s?)+)', ''))) AS lines FROM m),
each_line AS (SELECT r, conv_id, turn, l.level AS level, trim(regexp_replace(lower(l.said), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm
              FROM (SELECT r, conv_id, turn, unnest(lines) AS l FROM x WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
quoted AS (SELECT r, conv_id, turn, level, norm, count(*) AS n FROM each_line WHERE level > 0 AND norm <> '' GROUP BY ALL),
linked AS (SELECT q.r, q.level, q.norm, any_value(q.n) AS n, max(o.turn) AS origin FROM quoted q
           JOIN each_line o ON o.conv_id = q.conv_id AND o.norm = q.norm AND o.level = 0 AND o.turn < q.turn GROUP BY q.r, q.level, q.norm),
votes AS (SELECT r, origin, row_number() OVER (PARTITION BY r ORDER BY level, n DESC, origin DESC) AS k
          FROM (SELECT r, level, origin, sum(n) AS n FROM linked GROUP BY r, level, origin)),
counts AS (SELECT r, sum(n) AS n_linked FROM linked GROUP BY r),
step AS (SELECT conv_id, turn, max(origin) AS parent FROM x JOIN votes USING (r) WHERE k = 1 GROUP BY conv_id, turn),
walk AS (SELECT conv_id, turn, parent AS at_turn, 1 AS depth FROM step
         UNION ALL SELECT w.conv_id, w.turn, s.parent, depth + 1 FROM walk w JOIN step s ON s.conv_id = w.conv_id AND s.turn = w.at_turn),
ends AS (SELECT conv_id, turn, max(depth) AS depth, arg_max(at_turn, depth) AS thread FROM walk GROUP BY conv_id, turn)
SELECT x.conv_id, x.turn, role, trim(array_to_string([l.said for l in lines if l.level = 0], chr(10))) AS text,
       len([1 for l in lines if l.level > 0])::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked, v.origin AS parent_turn,
       coalesce(depth, 0)::BIGINT AS depth, coalesce(thread, x.turn) AS thread_turn
FROM x LEFT JOIN (SELECT * FROM votes WHERE k = 1) v USING (r) LEFT JOIN counts c USING (r)
LEFT JOIN ends e ON e.conv_id = x.conv_id AND e.turn = x.turn"""


def op6_secrets(spark, folder):
    return secrets.scan(read_table(spark, folder, "documents"))


def op7_decontamination(spark, folder):
    return decontaminate.report(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


SQL["op7_decontamination"] = r"""
WITH upper_lower AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents, upper_lower),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark, upper_lower),
win AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, n, array_to_string(w[p : p + n - 1], ' ') AS s
        FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS s
           FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT r, p, n, item FROM places JOIN win USING (n, s)),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM found) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items
          FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN names USING (r)"""


def op8_quality(spark, folder):
    return quality.scores(read_table(spark, folder, "documents"))


def op9_bpe(spark, folder):
    return bpe.digests(read_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_html(spark, folder):
    return html_text.extract(read_table(spark, folder, "pages"))


def op11_divergence(spark, folder):
    return divergence.audit(read_table(spark, folder, "documents"))


SQL["op11_divergence"] = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
gn AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (coalesce(total, 0) + v) AS p
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (t + v) AS q
      FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN (SELECT lang, sum(n) AS t FROM c GROUP BY lang) USING (lang) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
none AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         WHERE a.lang NOT IN (SELECT lang FROM v)),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
           FROM (SELECT * FROM pair UNION ALL SELECT * FROM none UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""


def op12_metric_join(spark, folder):
    return metric_join.near_duplicates(read_table(spark, folder, "embeddings"))


SQL["op12_metric_join"] = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
usable AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
n AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a),
least AS (SELECT a AS r, min(vec_id) AS least FROM reach JOIN v ON v.r = reach.b GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, least) AS component_id, coalesce(vec_id = least(vec_id, least), false) AS kept
FROM v LEFT JOIN n USING (r) LEFT JOIN least USING (r)"""


def op13_centroids(spark, folder):
    return centroids.cluster(read_table(spark, folder, "embeddings"))


def _centroids_sql(clusters: int = 8, rounds: int = 10) -> str:
    """Every round as a common table: the nearest centroid by whole-number distances, then floored means."""
    nearest = """a{k} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, (min((d, c)))[2] AS c, min(d) AS d
        FROM (SELECT r, vec_id, v.v, c.c, (list_dot_product(v.v, v.v) - 2 * list_dot_product(v.v, c.m) + list_dot_product(c.m, c.m))::BIGINT AS d FROM v, m{k} c) GROUP BY r)"""
    mean = """m{n} AS MATERIALIZED (SELECT c, coalesce(x.m, o.m) AS m FROM m{k} o LEFT JOIN
        (SELECT c, list(f ORDER BY i) AS m FROM (SELECT c, i, ((s - ((s % n) + n) % n) // n)::DOUBLE AS f
            FROM (SELECT c, i, sum(v[i]::BIGINT)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{k}, range(1, 65) t(i) GROUP BY c, i)) GROUP BY c) x USING (c))"""
    steps = [step.format(k=k, n=k + 1) for k in range(rounds) for step in (nearest, mean)] + [nearest.format(k=rounds)]
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
       WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('3:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT {clusters})),
{(", " + chr(10)).join(steps)}
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(m, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} JOIN m{rounds} USING (c)"""


SQL["op13_centroids"] = _centroids_sql()


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_topk, op4_pitman_yor, op5_quotations, op6_secrets, op7_decontamination, op8_quality, op9_bpe,
                                   op10_html, op11_divergence, op12_metric_join, op13_centroids)}


def registered() -> dict:
    """name -> (callable(spark, folder), SQL text or None)"""
    return {name: (fn, SQL.get(name)) for name, fn in QUERIES.items()}
