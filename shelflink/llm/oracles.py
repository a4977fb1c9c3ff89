"""Independent DuckDB SQL for the queries of the subpackage."""

SOURCE_MIX = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT *, (ARRAY[5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS rank, source_size * 2.0::DOUBLE AS lim FROM totals),
sums AS (
  SELECT *, (SELECT sum(source_size) FROM totals)::DOUBLE * 1500
      - coalesce(sum(lim) OVER before, 0)::DOUBLE * 1000 AS remaining,
    (SELECT sum(weight) FROM ranked) - coalesce(sum(weight) OVER before, 0) AS rest FROM ranked
  WINDOW before AS (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, remaining * weight >= lim * 1000 * rest AS above FROM sums),
level AS (SELECT remaining, rest FROM marked WHERE NOT above ORDER BY lim / weight, rank LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN above THEN lim
    ELSE weight * (SELECT remaining FROM level) / ((SELECT rest FROM level) * 1000) END AS target FROM marked),
known AS (SELECT s.*, t.source_size, t.target FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
queued AS (
  SELECT doc_id, source, size, target, turn, md5(doc_id || ':' || turn) AS place
  FROM known, (VALUES (0), (1)) v(turn) WHERE size > 0),
timed AS (
  SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY turn, place, doc_id
    ROWS UNBOUNDED PRECEDING))::DOUBLE / target AS finish FROM queued),
ordered AS (SELECT *, sum(size) OVER (ORDER BY finish, doc_id, turn ROWS UNBOUNDED PRECEDING) AS words FROM timed),
copies AS (
  SELECT doc_id, count(*) AS copies FROM ordered
  WHERE words <= (SELECT sum(size) FROM sizes) * 1500 // 1000 GROUP BY doc_id)
SELECT k.doc_id, k.size::BIGINT AS size, k.source_size, k.target, (coalesce(c.copies, 0) * k.size)::BIGINT AS taken
FROM known k LEFT JOIN copies c USING (doc_id)
"""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

NEAR_DEDUP = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM tokens),
classes AS (SELECT s, min(doc_id) AS leader, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
members AS (SELECT leader, n, hash(unnest(s)) AS shingle FROM classes),
common AS (
  SELECT x.leader AS a, y.leader AS b, x.n AS na, y.n AS nb, count(*) AS n_both
  FROM members x JOIN members y ON x.shingle = y.shingle AND x.leader < y.leader
    AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * n_both >= 80 * (na + nb - n_both)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT leader AS node, leader AS low FROM classes
  UNION SELECT e.b, r.low FROM reach r JOIN edges e ON e.a = r.node AND r.low < e.b),
ids AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id,
  coalesce(component_id, doc_id) = doc_id AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN ids ON ids.node = classes.leader
"""

VECTOR_DEDUP = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM vectors),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM normed x JOIN normed y
    ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id <> y.vec_id
  WHERE list_inner_product(x.v, y.v) / (x.norm * y.norm) >= 0.93::DOUBLE),
reach AS (SELECT vec_id AS node, vec_id AS low FROM embeddings
  UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node AND r.low < l.b),
ids AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN ids ON node = vec_id LEFT JOIN counts ON a = vec_id
"""


def _resample() -> str:
    # The checksum runs over the bytes of each distinct feature with the usual table of its polynomial.
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = "i::BIGINT AS c"
    rows = f"SELECT i, 0 AS round, {table} FROM range(256) t(i)"
    byte = "('0x' || substr(code, 2 * k::INT + 1, 2))::BIGINT"

    def features(source: str, key: str) -> str:
        return f"""
  SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {source}"""

    def runs(source: str, key: str) -> str:
        return f"""
  SELECT {key}, unnest(list_concat(w, list_concat(
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS f FROM {source}"""

    return f"""
WITH RECURSIVE steps AS ({rows} UNION ALL SELECT i, round + 1, {step} FROM steps WHERE round < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE round = 8),
words AS ({features('documents', 'doc_id')}),
aims AS ({features('benchmark', 'item_id')}),
own AS MATERIALIZED ({runs('words', 'doc_id')}),
aim AS MATERIALIZED ({runs('aims', 'item_id')}),
codes AS (SELECT f, hex(encode(f)) AS code FROM (SELECT f FROM own UNION SELECT f FROM aim)),
hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda k: {byte}),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM codes, crc),
s AS (SELECT bucket, count(*)::DOUBLE AS s FROM own JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM aim JOIN hashed USING (f) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM own)::DOUBLE AS all_s, (SELECT count(*) FROM aim)::DOUBLE AS all_t),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + 10000) / ((coalesce(s, 0) + 1) * (all_t + 10000))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket), sums),
weights AS (
  SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM own JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 5 * count(*) OVER () // 100 AS wanted
  FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, r::BIGINT AS rank
FROM scored LEFT JOIN (SELECT * FROM ranked WHERE r <= wanted) USING (doc_id)
"""


def _centroids(clusters: int = 16, rounds: int = 3) -> str:
    """Plain assignment of all vectors to all centroids in every round."""
    square = "list_sum(list_transform(range(1, 65), lambda i: (p[i] - c[i]) * (p[i] - c[i])))::BIGINT"
    steps = ""
    for r in range(rounds + 1):
        steps += f""",
near{r} AS MATERIALIZED (
  SELECT vec_id, p, k, c, {square} AS d FROM points, centres{r}
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"""
        if r < rounds:
            steps += f""",
sums{r} AS (
  SELECT k, i, (s - ((s % n) + n) % n) // n AS m FROM (
    SELECT k, i, sum(p[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM near{r}, range(1, 65) AS t(i) GROUP BY k, i)),
centres{r + 1} AS MATERIALIZED (
  SELECT k, coalesce(m, c) AS c FROM centres{r}
  LEFT JOIN (SELECT k, list(m::BIGINT ORDER BY i) AS m FROM sums{r} GROUP BY k) USING (k))"""
    return f"""
WITH points AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS p FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
centres0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, p AS c FROM points
  QUALIFY k < {clusters}){steps}
SELECT vec_id, k::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near{rounds}
"""


RESAMPLE = _resample()
CENTROIDS = _centroids()
