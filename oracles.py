"""Independent SQL for the registered queries (DuckDB dialect, one statement each).

Fragments are put together as common table expressions. Similarities use integer bit masks per
pair, titles and identifiers plain string functions; nothing is shared with the Spark code.
"""

from __future__ import annotations

NAMES = "['Ada Berg','Ilya Moreau','Quentin Zhou','Tove Lindqvist','Umar Kapoor']"
WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def name(number: str) -> str:
    return f"{NAMES}[({number}) % 5 + 1]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def number(x: str, modulus: int) -> str:
    return f"(('0x' || substr(md5({x}), 1, 7))::BIGINT % {modulus})"


def check13(nine: str) -> str:
    """13-digit identifier from nine digits."""
    total = "+".join(f"substr('978'||{nine},{i + 1},1)::INT*{1 if i % 2 == 0 else 3}" for i in range(12))
    return f"('978'||{nine}||((10-({total})%10)%10)::VARCHAR)"


def check10(nine: str) -> str:
    """10-character identifier from nine digits."""
    total = "+".join(f"substr({nine},{i + 1},1)::INT*{10 - i}" for i in range(9))
    digit = f"((11-({total})%11)%11)"
    return f"({nine}||CASE WHEN {digit}=10 THEN 'X' ELSE {digit}::VARCHAR END)"


def isbn_norm(x: str) -> str:
    bare = f"upper(replace(replace({strip(x)},'-',''),' ',''))"
    return f"nullif(regexp_extract({bare}, '^([0-9]{{9}}[0-9X]|[0-9]{{13}})$', 1), '')"


def unwrap(x: str) -> str:
    plain = f"replace(replace({strip(x)},'-',''),' ','')"
    return (
        f"CASE WHEN regexp_matches({x}, '=\"([^\"]*)\"') "
        f"THEN nullif({strip(f'''regexp_extract({x}, '="([^"]*)"', 1)''')}, '') "
        f"ELSE nullif(regexp_extract({plain}, '^([0-9]{{9}}[0-9X]|[0-9]{{13}})$', 1), '') END"
    )


def sentences(table: str, key: str, text: str, keep: str) -> str:
    return f"""
  SELECT *, ({key} << 32) + n AS position FROM (
    SELECT {keep}, n, regexp_replace(pieces[n + 1], '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') AS sentence
    FROM (SELECT {keep}, string_split_regex({text}, '[.!?\\n]+') AS pieces FROM {table}) AS split,
         unnest(range(len(pieces))) AS place(n))
  WHERE sentence <> ''"""


NINE = (
    f"lpad({number('''string_split(sentence, ' ')[1]''', 1000000)}::VARCHAR, 6, '0') || "
    f"lpad({number('sentence', 1000)}::VARCHAR, 3, '0')"
)

READING_LIST = f"""
sentences_q AS ({sentences('documents', 'doc_id', 'text', 'doc_id, lang, source')}),
numbered_q AS (SELECT *, {NINE} AS nine FROM sentences_q),
coded_q AS (SELECT *, {check10('nine')} AS i10, {check13('nine')} AS i13 FROM numbered_q),
export AS (
  SELECT position,
    CASE source WHEN 'src1' THEN 'The ' || sentence
      WHEN 'src2' THEN sentence || ' (Harbour Series)'
      WHEN 'src3' THEN sentence || ' (Harbour, Book 2)'
      WHEN 'src4' THEN sentence || ' (Harbour #3)'
      WHEN 'src5' THEN sentence || ' (Volume 4)'
      WHEN 'src6' THEN sentence || ' 2nd Edition'
      WHEN 'src7' THEN sentence || ': A Novel'
      WHEN 'src8' THEN sentence || ': Notes From the Long Coast'
      WHEN 'src9' THEN sentence || ' (Revised Edition)'
      ELSE sentence END AS title,
    CASE WHEN length(sentence) % 7 <> 0 THEN {name('length(sentence)')} END AS author,
    CASE WHEN {number('sentence', 8)} < 5 AND source = 'src10' THEN i10 END AS cell10,
    CASE WHEN {number('sentence', 8)} < 5 AND source <> 'src10' THEN
      CASE WHEN source IN ('src0','src1','src2','src3','src4') THEN '="' || i13 || '"'
           ELSE i13 END END AS cell13,
    lang AS shelf
  FROM coded_q)"""

WANTED = f"""{READING_LIST},
wanted AS (
  SELECT position, nullif({strip('title')}, '') AS title, author,
         coalesce({unwrap('cell13')}, {unwrap('cell10')}) AS isbn, shelf
  FROM export)"""

VISIBLE = (
    "regexp_replace(regexp_replace(html, "
    "'(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', '', 'g'), "
    "'<[^>]*>', chr(10), 'g')"
)
CATALOGUE = f"""
sentences_l AS ({sentences('pages', 'page_id', VISIBLE, 'page_id, url')}),
numbered_l AS (SELECT *, {NINE} AS nine FROM sentences_l),
catalogue AS (
  SELECT position AS listing_pos, sentence AS title,
    CASE WHEN length(sentence) % 11 <> 0
      THEN {name('length(sentence) + (page_id % 4 = 0)::INT')} END AS author,
    CASE WHEN {number('sentence', 8)} < 3 THEN {check10('nine')}
         WHEN {number('sentence', 8)} = 6 THEN {check13('nine')} END AS isbn,
    '$' || ({number('sentence', 7000)} // 100)::VARCHAR || '.' ||
      lpad(({number('sentence', 7000)} % 100)::VARCHAR, 2, '0') AS price,
    url
  FROM numbered_l)"""


def title_parts(source: str, out: str, title: str = "title") -> str:
    """CTEs ``{out}`` = source plus main, subtitle, variations."""
    steps = [
        f"^(the|a|an){WS}+",
        f"{WS}*\\(.*series.*\\)",
        f"{WS}*\\(.*book{WS}+\\p{{Nd}}+.*\\)",
        f"{WS}*\\(.*#\\p{{Nd}}+.*\\)",
        f"{WS}*\\(volume{WS}+\\p{{Nd}}+\\)",
        f"{WS}*\\(vol\\.{WS}*\\p{{Nd}}+\\)",
        f"{WS}*\\(\\p{{Nd}}+\\)",
        f"{WS}*\\(.*edition.*\\)",
        f"{WS}*\\p{{Nd}}+(st|nd|rd|th){WS}+edition",
    ]
    base = f"lower({title})"
    for step in steps:
        base = f"regexp_replace({base}, '{step}', '', 'gi')"

    def tidy(x: str) -> str:
        marks = "['\":;,.\\[\\]()]+".replace("'", "''")
        return f"trim(regexp_replace(regexp_replace({x}, '{marks}', '', 'g'), '{WS}+', ' ', 'g'))"

    return f"""
{out}_base AS (SELECT *, {base} AS b FROM {source}),
{out}_cut AS (
  SELECT * EXCLUDE (b), CASE WHEN position(':' IN b) > 0 THEN {strip("substr(b, 1, position(':' IN b) - 1)")} ELSE b END AS m,
    CASE WHEN position(':' IN b) > 0 THEN {strip("substr(b, position(':' IN b) + 1)")} ELSE '' END AS subtitle
  FROM {out}_base),
{out}_tidy AS (SELECT * EXCLUDE (m), {tidy('m')} AS main, {tidy('subtitle')} AS sub FROM {out}_cut),
{out} AS (
  SELECT * EXCLUDE (sub), list_filter([main,
      CASE WHEN subtitle <> '' THEN main || ' ' || sub END,
      CASE WHEN subtitle <> '' AND len(string_split(sub, ' ')) > 3
        THEN main || ' ' || array_to_string(string_split(sub, ' ')[1:3], ' ') END],
    lambda v: v IS NOT NULL) AS variations
  FROM {out}_tidy)"""


def tokens(x: str) -> str:
    """Sorted cleaned tokens, repeats kept."""
    clean = (
        f"lower(regexp_replace(regexp_replace({x}, '[\\x{{80}}-\\x{{FF}}]', '', 'g'), "
        "'[^\\p{L}\\p{N}_]+', ' ', 'g'))"
    )
    return f"list_sort(list_filter(string_split({clean}, ' '), lambda w: w <> ''))"


# --- similarity: masks of the first text per character of the second ---------------------------


def masks(a: str, b: str) -> str:
    return (
        f"list_transform(range(1, len({b}) + 1), lambda j: coalesce(list_sum(list_transform("
        f"range(1, len({a}) + 1), lambda i: CASE WHEN {a}[i] = {b}[j] "
        f"THEN 1::BIGINT << (i - 1)::INT ELSE 0::BIGINT END)), 0)::BIGINT)"
    )


def lcs(a: str, mask_list: str) -> str:
    full = f"((1::BIGINT << len({a})::INT) - 1)"
    return (
        f"(len({a}) - bit_count(list_reduce({mask_list}, "
        f"lambda v, k: ((v + (v & k)) | (v - (v & k))) & {full}, {full})))"
    )


def percent(common: str, total: str) -> str:
    return f"round_even(100.0::DOUBLE * ((2 * ({common}))::DOUBLE / greatest({total}, 1)), 0)::INT"


def ratio(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a} = {b} THEN 100 WHEN {a} = '' OR {b} = '' THEN 0 "
        f"ELSE {percent(lcs(a, masks(a, b)), f'len({a}) + len({b})')} END"
    )


def partial(a: str, b: str) -> str:
    short = f"CASE WHEN len({a}) <= len({b}) THEN {a} ELSE {b} END"
    long = f"CASE WHEN len({a}) <= len({b}) THEN {b} ELSE {a} END"
    window = lcs("x.s", "x.m[w:w + len(x.s) - 1]")
    best = (
        f"list_max(list_transform(range(1, len(x.l) + 1), lambda w: (2 * {window})::DOUBLE / "
        "(len(x.s) + least(len(x.s), len(x.l) - w + 1))))"
    )
    score = f"(SELECT {best} FROM (SELECT y.s, y.l, {masks('y.s', 'y.l')} AS m FROM (SELECT {short} AS s, {long} AS l) AS y) AS x)"
    return (
        f"CASE WHEN {a} = {b} THEN 100 WHEN {a} = '' OR {b} = '' THEN 0 "
        f"WHEN {score} > 0.995 THEN 100 ELSE round_even(100.0::DOUBLE * {score}, 0)::INT END"
    )


def similarity(source: str, out: str, a: str = "a", b: str = "b") -> str:
    """CTEs: source plus the four measures of text columns a and b."""
    return f"""
{out}_tok AS (SELECT *, {tokens(a)} AS ta, {tokens(b)} AS tb FROM {source}),
{out}_set AS (
  SELECT *, array_to_string(ta, ' ') AS sa, array_to_string(tb, ' ') AS sb,
    array_to_string(list_sort(list_intersect(list_distinct(ta), list_distinct(tb))), ' ') AS inter,
    array_to_string(list_sort(list_filter(list_distinct(ta), lambda w: NOT list_contains(tb, w))), ' ') AS da,
    array_to_string(list_sort(list_filter(list_distinct(tb), lambda w: NOT list_contains(ta, w))), ' ') AS db
  FROM {out}_tok),
{out}_sides AS (SELECT *, trim(inter || ' ' || da) AS ca, trim(inter || ' ' || db) AS cb FROM {out}_set),
{out}_win AS (
  SELECT *, CASE WHEN len({a}) <= len({b}) THEN {a} ELSE {b} END AS s_,
            CASE WHEN len({a}) <= len({b}) THEN {b} ELSE {a} END AS l_ FROM {out}_sides),
{out}_mask AS (SELECT *, {masks('s_', 'l_')} AS m_ FROM {out}_win),
{out}_best AS (
  SELECT *, list_max(list_transform(range(1, len(l_) + 1), lambda w:
      (2 * {lcs('s_', 'm_[w:w + len(s_) - 1]')})::DOUBLE / (len(s_) + least(len(s_), len(l_) - w + 1)))) AS best_
  FROM {out}_mask),
{out} AS (
  SELECT * EXCLUDE (ta, tb, sa, sb, inter, da, db, ca, cb, s_, l_, m_, best_),
    {ratio(a, b)} AS ratio,
    CASE WHEN {a} = {b} THEN 100 WHEN {a} = '' OR {b} = '' THEN 0 WHEN best_ > 0.995 THEN 100
         ELSE round_even(100.0::DOUBLE * best_, 0)::INT END AS partial_ratio,
    {ratio('sa', 'sb')} AS token_sort_ratio,
    CASE WHEN sa = '' OR sb = '' THEN 0 ELSE greatest(
      {ratio('inter', 'ca')}, {ratio('inter', 'cb')}, {ratio('ca', 'cb')}) END AS token_set_ratio
  FROM {out}_best)"""


def token_set_only(source: str, out: str, a: str, b: str, result: str) -> str:
    """CTEs: source plus the token-set measure of two (possibly NULL) author columns."""
    return f"""
{out}_tok AS (SELECT *, {tokens(f'lower({a})')} AS ta, {tokens(f'lower({b})')} AS tb FROM {source}),
{out}_set AS (
  SELECT *, array_to_string(list_sort(list_intersect(list_distinct(ta), list_distinct(tb))), ' ') AS inter,
    array_to_string(list_sort(list_filter(list_distinct(ta), lambda w: NOT list_contains(tb, w))), ' ') AS da,
    array_to_string(list_sort(list_filter(list_distinct(tb), lambda w: NOT list_contains(ta, w))), ' ') AS db
  FROM {out}_tok),
{out}_sides AS (SELECT *, trim(inter || ' ' || da) AS ca, trim(inter || ' ' || db) AS cb FROM {out}_set),
{out} AS (
  SELECT * EXCLUDE (ta, tb, inter, da, db, ca, cb),
    CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN len(ta) = 0 OR len(tb) = 0 THEN 0 ELSE greatest(
      {ratio('inter', 'ca')}, {ratio('inter', 'cb')}, {ratio('ca', 'cb')}) END AS {result}
  FROM {out}_sides)"""


def variants(x: str) -> str:
    """Array of identifier forms of a normalised identifier."""
    return (
        f"CASE WHEN length({x}) = 10 THEN [{x}, {check13(f'substr({x}, 1, 9)')}] "
        f"WHEN length({x}) = 13 AND {x} LIKE '978%' THEN [{x}, {check10(f'substr({x}, 4, 9)')}] "
        f"WHEN length({x}) = 13 THEN [{x}] ELSE []::VARCHAR[] END"
    )


# --- parts as entries and listings --------------------------------------------------------------

PARTS = f"""
parts AS (
  SELECT *, p_name || ' ' || lower(p_type) || ' ' || replace(lower(p_brand), '#', ' ') AS t,
         lpad((p_partkey * 7)::VARCHAR, 9, '0') AS nine FROM part),
wanted AS (
  SELECT p_partkey AS position,
    CASE p_type WHEN 'ECONOMY' THEN 'The ' || t WHEN 'SMALL' THEN t || ' (Workshop Series)'
      WHEN 'LARGE' THEN t || ': A Handbook for the Curious' WHEN 'MEDIUM' THEN t || ' 3rd edition'
      WHEN 'STANDARD' THEN array_to_string(list_transform(string_split(p_name, ' '),
           lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' (Volume 2)' ELSE t END AS title,
    CASE WHEN p_size % 6 <> 0 THEN {name('p_size')} END AS author,
    CASE WHEN p_size < 10 THEN {check13('nine')} WHEN p_size < 25 THEN {check10('nine')} END AS isbn
  FROM parts),
offers AS (
  SELECT p.*, k AS place, p_partkey + k AS query_id FROM parts p, (VALUES (0), (1), (2)) AS o(k)),
listings AS (
  SELECT (o.query_id << 8) + place AS listing_pos, o.query_id, place AS page_pos, o.t AS title,
    CASE WHEN p_size % 8 <> 0 THEN {name('p_size')} END AS author,
    CASE WHEN p_size % 10 <> 0 THEN {check10('nine')} END AS isbn,
    CASE WHEN p_size >= 20 AND p_size < 35 THEN 'Now' ELSE '' END || printf('$%.2f', p_retailprice - 880) AS price,
    'https://shop.example/book/' || replace(o.t, ' ', '-') || '/' || CASE WHEN p_size % 8 = 0 THEN 'various'
      ELSE lower(string_split({name('p_size')}, ' ')[2] || '-' || string_split({name('p_size')}, ' ')[1]) END
      || '/' || {check10('nine')} || 'B' AS url,
    'https://shop.example/covers/' || p_partkey || '.jpg' AS cover_url
  FROM offers o JOIN (SELECT p_partkey AS page, p_type AS kind FROM part) g ON g.page = o.query_id
  WHERE g.kind <> 'PROMO'
  UNION ALL
  SELECT (p_partkey << 8) + k, p_partkey, k, CASE k WHEN 0 THEN t ELSE 'Second hand copy' END,
    NULL, NULL, NULL, NULL, NULL
  FROM parts, (VALUES (0), (1)) AS o(k) WHERE p_type = 'PROMO')"""


def candidate_words(queries: str, listings: str, overlap: int = 60) -> str:
    """CTEs: ``candidates(query_id, listing_id)`` of two title tables, without any prefix filter."""
    return f"""
rows_ AS (
  SELECT 'q' AS side, id, i AS v, list_distinct({tokens('variations[i]')}) AS toks
  FROM {queries}, unnest(range(1, len(variations) + 1)) AS u(i)
  UNION ALL
  SELECT 'l', id, i, list_distinct({tokens('variations[i]')})
  FROM {listings}, unnest(range(1, len(variations) + 1)) AS u(i)),
words AS (SELECT side, id, v, unnest(toks) AS word FROM rows_),
weights AS (SELECT word, length(bin((SELECT count(*) FROM rows_ WHERE side = 'l')
  // greatest(count(*) FILTER (side = 'l'), 1))) AS weight FROM words GROUP BY word),
weighted AS (SELECT w.*, weight, sum(weight) OVER (PARTITION BY side, id, v) AS whole
  FROM words w JOIN weights USING (word)),
shared AS (
  SELECT q.id AS query_id, q.v AS qv, l.id AS listing_id, l.v AS lv
  FROM weighted q JOIN weighted l ON l.word = q.word AND l.side = 'l'
  WHERE q.side = 'q'
  GROUP BY ALL
  HAVING sum(q.weight) * 100 >= greatest(max(q.whole), max(l.whole)) * {overlap}),
candidates AS (SELECT DISTINCT query_id, listing_id FROM shared)"""


def title_rows(queries: str, listings: str) -> str:
    """CTEs ``qr`` and ``lr``: one row per variation with lengths and weight, ``qw`` and ``lw``: its words."""

    def side(tag: str, table: str) -> str:
        return f"""
{tag}texts AS (
  SELECT id, variations[i] AS text, {tokens('variations[i]')} AS toks
  FROM {table}, unnest(range(1, len(variations) + 1)) AS u(i)),
{tag}numbered AS (SELECT *, row_number() OVER () AS rid, list_distinct(toks) AS words FROM {tag}texts WHERE len(toks) > 0),
{tag}r AS MATERIALIZED (
  SELECT rid, id, len(text) AS tl, len(array_to_string(toks, ' ')) AS sl, words,
    list_sum(list_transform(words, lambda w: len(w) + 1))::BIGINT AS whole FROM {tag}numbered),
{tag}w AS MATERIALIZED (SELECT rid, whole, unnest(words) AS word FROM {tag}r)"""

    return side("q", queries) + "," + side("l", listings)


def titles_sharing(need: int = 72, share: int = 47) -> str:
    """CTE ``sharing(query_id, listing_id)`` over ``title_rows``."""

    def most(a: str, b: str) -> str:
        return f"least(100.0::DOUBLE, least({a}, {b}) * 200.0::DOUBLE / greatest({a} + {b}, 1) + 0.5::DOUBLE)"

    def weight(short: float, long: float) -> str:
        return f"CASE WHEN q.tl > 50 OR l.tl > 50 THEN {long}::DOUBLE ELSE {short}::DOUBLE END"

    token_set = f"greatest({most('(s - 1)', 'least(q.whole - 1, l.whole - 1)')}, {most('(q.whole - 1)', '(l.whole - 1)')})"
    return f"""
common AS (
  SELECT q.rid AS q, l.rid AS l, sum(len(word) + 1)::BIGINT AS s FROM qw q JOIN lw l USING (word)
  GROUP BY 1, 2 HAVING sum(len(word) + 1) * 100 >= least(any_value(q.whole), any_value(l.whole)) * {share}),
sharing AS (
  SELECT DISTINCT q.id AS query_id, l.id AS listing_id FROM common c JOIN qr q ON q.rid = c.q JOIN lr l ON l.rid = c.l
  WHERE floor(({most('q.tl', 'l.tl')} * {weight(0.15, 0.1)} + 100.0::DOUBLE * {weight(0.2, 0.1)}
      + {most('q.sl', 'l.sl')} * {weight(0.25, 0.2)} + {token_set} * {weight(0.4, 0.6)})
    * CASE WHEN q.tl + l.tl > 100 THEN CASE WHEN abs(q.tl - l.tl) > 30 THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END
        WHEN abs(q.tl - l.tl) > 10 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END + 1e-9::DOUBLE) >= {need})"""


NEAR_WORDS = """
vocabulary AS (SELECT word, 'q' AS side FROM qw WHERE len(word) >= 5 UNION SELECT word, 'l' FROM lw WHERE len(word) >= 5),
drops AS (
  SELECT DISTINCT side, word, unnest(list_append(list_transform(range(1, len(word) + 1),
    lambda i: substr(word, 1, i - 1) || substr(word, i + 1)), word)) AS rest FROM vocabulary),
alike AS MATERIALIZED (
  SELECT DISTINCT q.word, l.word AS near FROM drops q JOIN drops l ON l.rest = q.rest AND l.side = 'l' AND l.word <> q.word
  WHERE q.side = 'q')"""


def titles_near(percent: int = 80) -> str:
    """CTE ``near(query_id, listing_id)`` over ``title_rows``."""
    return f"""{NEAR_WORDS},
called AS (SELECT word, word AS near FROM (SELECT DISTINCT word FROM qw) UNION ALL SELECT word, near FROM alike),
met AS MATERIALIZED (
  SELECT q.rid AS q, l.rid AS l, q.word AS a, l.word AS b, q.whole AS qwhole, l.whole AS lwhole
  FROM qw q JOIN called c ON c.word = q.word JOIN lw l ON l.word = c.near
  WHERE least(q.whole, l.whole) * 100 >= greatest(q.whole, l.whole) * {percent}),
known AS (
  SELECT q, l FROM (SELECT DISTINCT q, l, a, qwhole FROM met) GROUP BY q, l
  HAVING sum(len(a) + 1) * 100 >= any_value(qwhole) * {percent}),
offered AS (
  SELECT q, l FROM (SELECT DISTINCT m.q, m.l, b, lwhole FROM met m JOIN known k ON k.q = m.q AND k.l = m.l) GROUP BY q, l
  HAVING sum(len(b) + 1) * 100 >= any_value(lwhole) * {percent}),
near AS (
  SELECT DISTINCT q.id AS query_id, l.id AS listing_id
  FROM offered o JOIN qr q ON q.rid = o.q JOIN lr l ON l.rid = o.l)"""


def page_pairs(author_scores_pairs: bool = False, by_title: bool = False) -> str:
    """CTEs up to ``scored``: every variation pair of an entry and the listings it meets.

    Those of its page, or (``by_title``) the first listing of every candidate title.
    """
    q = title_parts("wanted", "qt")
    l = title_parts("listings", "lt")
    if by_title:
        l = f"""firsts AS (SELECT title, min(listing_pos) AS listing_pos, 0 AS query_id,
            NULL::VARCHAR AS author FROM listings GROUP BY title),
            {title_parts('firsts', 'lt')},
            qids AS (SELECT position AS id, variations FROM qt),
            lids AS (SELECT listing_pos AS id, variations FROM lt),{candidate_words('qids', 'lids')}"""
    met = (
        "candidates c JOIN qv q ON q.position = c.query_id JOIN lv l ON l.listing_pos = c.listing_id"
        if by_title
        else "qv q JOIN lv l ON l.query_id = q.position"
    )
    author = token_set_only("measured0", "measured", "pair_author", "l_author", "pair_author_score")
    factor = """ * CASE WHEN pair_author_score / 100.0::DOUBLE > 0.8 THEN 1.2::DOUBLE
        WHEN pair_author_score / 100.0::DOUBLE < 0.4 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END"""
    return f"""{PARTS},{q},{l},
qv AS (SELECT position, main, i - 1 AS qv, variations[i] AS a FROM qt, unnest(range(1, len(variations) + 1)) AS u(i)),
lv AS (SELECT listing_pos, query_id, author AS l_author, main, i - 1 AS lv, variations[i] AS b
  FROM lt, unnest(range(1, len(variations) + 1)) AS u(i)),
pairs AS (
  SELECT q.position, q.qv, q.a, q.main AS q_main, l.listing_pos, l.lv, l.b, l.main AS l_main, l.l_author
  FROM {met}),
texts AS (SELECT DISTINCT a, b FROM pairs),
{similarity('texts', 'compared')},
{"lookup AS (SELECT title, list(author ORDER BY position DESC)[1] AS pair_author FROM wanted GROUP BY title)," if author_scores_pairs else ""}
measured0 AS (
  SELECT pairs.*, c.ratio, c.partial_ratio, c.token_sort_ratio, c.token_set_ratio
    {", k.pair_author" if author_scores_pairs else ""}
  FROM pairs JOIN compared c ON c.a = pairs.a AND c.b = pairs.b
  {"JOIN wanted w ON w.position = pairs.position JOIN lookup k ON k.title = w.title" if author_scores_pairs else ""}),
{author + "," if author_scores_pairs else ""}
scored AS (
  SELECT *, (CASE WHEN len(a) > 50 OR len(b) > 50
      THEN ratio * 0.1::DOUBLE + partial_ratio * 0.1::DOUBLE + token_sort_ratio * 0.2::DOUBLE + token_set_ratio * 0.6::DOUBLE
      ELSE ratio * 0.15::DOUBLE + partial_ratio * 0.2::DOUBLE + token_sort_ratio * 0.25::DOUBLE + token_set_ratio * 0.4::DOUBLE END)
    * CASE WHEN len(list_distinct(string_split(trim(a), ' '))) <= 3
        AND len(list_intersect(list_distinct(string_split(trim(a), ' ')), list_distinct(string_split(trim(b), ' ')))) * 2
            < len(list_distinct(string_split(trim(a), ' '))) THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END
    * CASE WHEN len(a) + len(b) > 100 THEN CASE WHEN abs(len(a) - len(b)) > 30 THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END
        WHEN abs(len(a) - len(b)) > 10 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END
    * CASE WHEN q_main = l_main THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END
    {factor if author_scores_pairs else ""} AS base_score
  FROM {"measured" if author_scores_pairs else "measured0"})"""


BEST = """
best AS (
  SELECT position, listing_pos, base_score FROM scored WHERE base_score > 0
  QUALIFY row_number() OVER (PARTITION BY position ORDER BY base_score DESC, qv, listing_pos, lv) = 1)"""


def page_matches(
    author_scores_pairs: bool = False, threshold: int = 90, by_title: bool = False
) -> str:
    """CTEs up to ``matches`` with the default settings."""
    own_page = "true" if by_title else "l.query_id = i.position"
    return f"""{page_pairs(author_scores_pairs, by_title)},{BEST},
ids AS (SELECT position, {isbn_norm('isbn')} AS q_norm FROM wanted),
exact AS (
  SELECT position, min(listing_pos) AS listing_pos FROM (
    SELECT i.position, l.listing_pos
    FROM (SELECT position, unnest({variants('q_norm')}) AS form FROM ids) i
    JOIN listings l ON {isbn_norm('l.isbn')} = i.form WHERE {own_page}) GROUP BY position),
decided AS (
  SELECT position, listing_pos, NULL::DOUBLE AS base_score FROM exact
  UNION ALL SELECT * FROM best WHERE position NOT IN (SELECT position FROM exact)),
joined AS (
  SELECT d.*, w.title AS query, w.author, l.title AS l_title, l.author AS l_author, l.price, l.url,
    l.cover_url, l.isbn, coalesce(substr({isbn_norm('w.isbn')}, 1, 9) = substr({isbn_norm('l.isbn')}, 1, 9), false) AS prefix
  FROM decided d JOIN wanted w USING (position) JOIN listings l ON l.listing_pos = d.listing_pos),
{token_set_only('joined', 'authored', 'author', 'l_author', 'author_score')},
flagged AS (SELECT *, coalesce(author_score / 100.0::DOUBLE >= 0.95, false) AS same_author,
    least(floor(base_score)::INT, 100) AS s0 FROM authored),
first_bonus AS (SELECT *, CASE WHEN prefix THEN least(floor(s0 * 1.10::DOUBLE)::INT, 100) ELSE s0 END AS s1 FROM flagged),
second_bonus AS (SELECT *, CASE WHEN same_author THEN least(floor(s1 * 1.15::DOUBLE)::INT, 100) ELSE s1 END AS s2 FROM first_bonus),
matches AS (
  SELECT position, query,
    l_title || CASE WHEN l_author IS NOT NULL THEN ' by ' || l_author WHEN base_score IS NULL THEN ' by Unknown' ELSE '' END AS match,
    coalesce(s2, 100) AS score, coalesce(s2, 100)::VARCHAR || '%' AS score_pct, price,
    replace(nullif(regexp_extract(price, '\\$?([\\d,]+\\.?\\d*)', 1), ''), ',', '')::DOUBLE AS price_value,
    url, cover_url, isbn,
    CASE WHEN base_score IS NULL THEN 'isbn_exact' WHEN prefix AND same_author THEN 'fuzzy_isbn_author'
      WHEN prefix THEN 'fuzzy_isbn_partial' WHEN same_author THEN 'fuzzy_author_exact' ELSE 'fuzzy' END AS match_type,
    CASE WHEN base_score IS NULL THEN '' ELSE array_to_string(list_filter([
      CASE WHEN prefix THEN 'isbn_partial' END, CASE WHEN same_author THEN 'author_exact' END],
      lambda x: x IS NOT NULL), ',') END AS bonuses,
    listing_pos
  FROM second_bonus
  WHERE coalesce(s2, 100) >= {threshold}
    AND (base_score IS NULL OR author_score IS NULL OR author_score / 100.0::DOUBLE >= 0.5))"""


TITLES = f"""WITH {WANTED},{CATALOGUE},
q0 AS (SELECT title, min(position) AS id FROM wanted WHERE title IS NOT NULL GROUP BY title),
l0 AS (SELECT title, min(listing_pos) AS id FROM catalogue GROUP BY title),
{title_parts('q0', 'qt')},{title_parts('l0', 'lt')},"""
BLOCKS = f"{TITLES}{candidate_words('qt', 'lt')} SELECT query_id, listing_id FROM candidates"
REACH = f"{TITLES}{title_rows('qt', 'lt')},{titles_sharing()} SELECT query_id, listing_id FROM sharing"
NEAR = f"{TITLES}{title_rows('qt', 'lt')},{titles_near()} SELECT query_id, listing_id FROM near"
SPELLINGS = f"{TITLES}{title_rows('qt', 'lt')},{NEAR_WORDS} SELECT word, near FROM alike"
