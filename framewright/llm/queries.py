"""The training-data queries, one for each operator, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from framewright.llm import language, media, middle, minhash, negatives, packing, segments, token_counts, token_files, toxicity, urls, vectors, warc
from framewright.llm.base import release  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.op1_warc,
        "op2_token_files": token_files.op2_token_files,
        "op3_near_duplicates": minhash.op3_near_duplicates,
        "op4_sampled_pieces": segments.op4_sampled_pieces,
        "op5_media": media.op5_media,
        "op6_near_vectors": vectors.op6_near_vectors,
        "op7_language": language.op7_language,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_url_filter": urls.op9_url_filter,
        "op10_packing": packing.op10_packing,
        "op11_hard_negatives": negatives.op11_hard_negatives,
        "op12_token_counts": token_counts.op12_token_counts,
        "op13_fill_in_middle": middle.op13_fill_in_middle,
        "pipeline": corpus_pipeline.run,
    }


#: Response is the largest page_id of equal payloads of 1000 bytes or more (one record of it), the others revisit it.
WARC_SQL = """WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, url, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, first_value(page_id) OVER w AS top, row_number() OVER w AS n FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND n > 1 THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 1000 AND n > 1 THEN top END AS refers_to, url FROM q"""

#: Weighted Jaccard similarity of five-word shingles by an inverted index, and reachability.
NEAR_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '(?:[a-z0-9]|[^\x00-\x7F])+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ') || ' #'] ELSE ['text ' || t] END) AS s FROM w),
m AS (SELECT doc_id, s, count(*) AS n FROM s GROUP BY ALL), z AS (SELECT doc_id, sum(n) AS n FROM m GROUP BY 1),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS n FROM m a JOIN m b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM k JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE k.n >= 0.8 * (x.n + y.n - k.n)),
r AS (SELECT doc_id AS v, doc_id AS c FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v)
SELECT v AS doc_id, min(c) AS component_id, min(c) = v AS kept FROM r GROUP BY v"""

#: Cosines of all pairs, and reachability.
VECTORS_SQL = """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1),
r AS (SELECT vec_id AS v, vec_id AS c FROM e UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v)
SELECT v AS vec_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_links, min(c) AS component_id, min(c) = v AS kept FROM r LEFT JOIN n ON n.a = r.v GROUP BY v"""


#: Inner products of all anchors with all rows, their best five of the same label, and the windows below those.
NEGATIVES_SQL = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
f AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(x, lambda c: floor(256 * c)) AS v FROM e WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM f a JOIN f b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT a, b AS p, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p ORDER BY score DESC, b) AS INTEGER) AS rank, b AS negative_id, ps AS positive_score, score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT same AND 80 * ps <= 100 * score AND score <= ps QUALIFY row_number() OVER (PARTITION BY p.a, p ORDER BY score DESC, b) <= 5"""

#: Units by one pattern; cuts and form from the digest of the id.
MIDDLE_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, len(u) AS n, list_transform(range(0, 4), lambda k: CAST('0x' || substr(x, CAST(8 * k + 1 AS BIGINT), 8) AS BIGINT)) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS i, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS j, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:i], '') AS pre, array_to_string(u[i + 1:j], '') AS mid, array_to_string(u[j + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def url_sql(rounds: int = 200) -> str:
    """Rules, host edges and ``rounds`` of both ranks, one table expression a round; more rounds than the ranks take to settle."""
    rule = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}:{v}'" for v, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = ", ".join(f"r{k} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (SELECT r.kind, f.dst AS host, r.rank * f.share * 0.85 AS rank FROM r{k - 1} r JOIN flow f ON f.kind = r.kind AND f.src = r.host UNION ALL SELECT kind, host, 0.15 * rank FROM r0) GROUP BY 1, 2)" for k in range(1, rounds + 1))
    return f'''WITH u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
a AS (SELECT page_id, html, {fold.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT *, {rule} AS fit FROM a), h AS (SELECT page_id, html, host, path, split_part(fit, ':', 1) AS rule, split_part(fit, ':', 2) AS verdict FROM j),
k AS (SELECT host AS src, {fold.format("""unnest(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\\s>]+)', 1))""")} AS dst FROM h),
links AS (SELECT src, dst, count(*) AS w FROM k WHERE src <> '' AND src <> dst GROUP BY 1, 2),
hosts AS (SELECT host FROM h WHERE host LIKE '%.%' UNION SELECT dst FROM links WHERE dst LIKE '%.%'),
chain AS (SELECT DISTINCT array_to_string(l[i:], '.') AS child FROM (SELECT l, unnest(range(1, len(l))) AS i FROM (SELECT string_split(host, '.') AS l FROM hosts))),
up AS (SELECT child AS src, substr(child, instr(child, '.') + 1) AS dst FROM chain WHERE substr(child, instr(child, '.') + 1) LIKE '%.%'),
edges AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM links UNION ALL SELECT src, dst, 1 FROM up UNION ALL SELECT dst, src, 1 FROM up) GROUP BY 1, 2),
kinds AS (SELECT 'trust' AS kind, src, dst, w FROM edges UNION ALL SELECT 'distrust', dst, src, w FROM edges),
flow AS MATERIALIZED (SELECT kind, src, dst, w / sum(w) OVER (PARTITION BY kind, src) AS share FROM kinds),
c AS (SELECT host, CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, count(*) AS n FROM h WHERE verdict IS NOT NULL AND verdict <> '' GROUP BY 1, 2),
r0 AS MATERIALIZED (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS rank FROM c), {steps},
s AS (SELECT host, sum(CASE kind WHEN 'trust' THEN rank ELSE 0 END) AS t, sum(CASE kind WHEN 'distrust' THEN rank ELSE 0 END) AS d FROM r{rounds} GROUP BY 1),
g AS (SELECT page_id, h.host, path, nullif(rule, '') AS rule, nullif(verdict, '') AS verdict, coalesce(round(d / nullif(t + d, 0), 9), 0) AS share FROM h LEFT JOIN s ON s.host = h.host)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN share > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, CAST(share AS DOUBLE) AS distrust_share FROM g'''


def oracle_sql() -> dict[str, str]:
    """Oracles of the operators that SQL expresses; the others are tested against plain versions."""
    own = {"op1_warc": WARC_SQL, "op3_near_duplicates": NEAR_SQL, "op6_near_vectors": VECTORS_SQL, "op9_url_filter": url_sql(), "op11_hard_negatives": NEGATIVES_SQL, "op13_fill_in_middle": MIDDLE_SQL}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
