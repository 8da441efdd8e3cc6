"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

_RULES = """
    SELECT *, [
        {'rule': 'symbols', 'v': n_symbols * 10000 // greatest(word_chars, 1), 'least': 50, 'low': false},
        {'rule': 'capitals', 'v': n_upper * 10000 // greatest(word_chars, 1), 'least': 250, 'low': false},
        {'rule': 'dup_lines', 'v': n_dup_lines * 10000 // greatest(n_lines, 1), 'least': 700, 'low': false},
        {'rule': 'word_length', 'v': word_chars * 1000 // greatest(n_words, 1), 'least': 500, 'low': true}] AS rules
    FROM counts"""


def quality_ctes(docs: str) -> str:
    """CTEs that end in ``judged``: the counts and the verdict of every row of
    ``docs`` (doc_id, text, lang, source)."""
    return rf"""
texts AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
grams AS (SELECT rid, p, array_to_string(w[p:p + 4], ' ') AS g
    FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS p FROM texts)),
twice AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + 5)) AS q FROM twice) GROUP BY rid),
line_counts AS (SELECT rid, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines FROM (
    SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts)),
counts AS (SELECT texts.*, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_upper,
        n_lines, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
    FROM texts JOIN line_counts USING (rid) LEFT JOIN covered USING (rid)),
ruled AS ({_RULES}),
cells AS (SELECT rid, lang, source, r.rule, r.v, r.least, r.low,
        CAST(r.v - r.v % CAST(pow(10, greatest(length(CAST(r.v AS VARCHAR)) - 3, 0)) AS BIGINT) AS BIGINT) AS b
    FROM (SELECT rid, lang, source, unnest(rules) AS r FROM ruled)),
own AS (SELECT lang, source, rule, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.5) AS q2, count(*) AS n FROM cells GROUP BY ALL),
by_lang AS (SELECT lang, rule, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.5) AS q2, count(*) AS n FROM cells GROUP BY ALL),
corpus AS (SELECT rule, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.5) AS q2 FROM cells GROUP BY ALL),
quartiles AS (SELECT own.lang, own.source, own.rule,
        CASE WHEN own.n >= 200 THEN own.q1 WHEN by_lang.n >= 200 THEN by_lang.q1 ELSE corpus.q1 END AS q1,
        CASE WHEN own.n >= 200 THEN own.q2 WHEN by_lang.n >= 200 THEN by_lang.q2 ELSE corpus.q2 END AS q2
    FROM own JOIN by_lang ON own.lang IS NOT DISTINCT FROM by_lang.lang AND own.rule = by_lang.rule JOIN corpus ON own.rule = corpus.rule),
broken AS (SELECT rid, list(cells.rule ORDER BY list_position(['symbols', 'capitals', 'dup_lines', 'word_length'], cells.rule)) AS names
    FROM cells JOIN quartiles q ON cells.lang IS NOT DISTINCT FROM q.lang AND cells.source IS NOT DISTINCT FROM q.source AND cells.rule = q.rule
    WHERE v > q2 + 6 * greatest(q2 - q1, least) OR (low AND v < q2 - 6 * greatest(q2 - q1, least)) GROUP BY rid),
base AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM counts),
judged AS (SELECT base.*, array_to_string(list_concat(CASE WHEN base_failed THEN ['base'] ELSE [] END, coalesce(names, [])), ',') AS failed_rules,
        NOT base_failed AND names IS NULL AS kept
    FROM base LEFT JOIN broken USING (rid))"""


def mixing_ctes(docs: str, rounds: int = 4) -> str:
    """CTEs that end in ``mixed``: size, source_size, target, copies and taken of every row of ``docs``."""
    out = rf"""
drawn AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM {docs}),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        [5, 2, 1][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS INT)] AS w, 3 * CAST(sum(size) AS BIGINT) AS cap
    FROM drawn GROUP BY source),
stopped AS (SELECT *, (total - cap_before) * w >= cap * w_left AS stops FROM (
    SELECT *, sum(source_size) OVER () AS total, coalesce(sum(cap) OVER f, 0) AS cap_before, sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS w_left
    FROM sources WINDOW f AS (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
goals AS (SELECT source, source_size, CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE
        CAST((total - coalesce(sum(CASE WHEN stops THEN cap END) OVER (), 0)) * w AS DOUBLE) / CAST(sum(CASE WHEN NOT stops THEN w END) OVER () AS DOUBLE) END AS target
    FROM stopped),
state0 AS (SELECT *, CAST(floor(target - whole * source_size) AS BIGINT) AS rest, CAST(-1 AS BIGINT) AS cut, CAST([] AS BIGINT[]) AS cuts, CAST([] AS BIGINT[]) AS fits FROM (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goals))"""
    for r in range(1, rounds + 1):
        p = f"state{r - 1}"
        out += f""",
sums{r} AS (SELECT d.source, h >> 32 AS b, any_value(rest) AS rest, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY h >> 32) AS c
    FROM drawn d JOIN {p} s ON d.source IS NOT DISTINCT FROM s.source WHERE h > cut AND size <= rest AND size > 0 GROUP BY d.source, h >> 32),
cuts{r} AS (SELECT source, coalesce(max(CASE WHEN c <= rest THEN c END), 0) AS got, min(CASE WHEN c > rest THEN b END) AS over,
        max(CASE WHEN c <= rest THEN b END) AS last FROM sums{r} GROUP BY source),
state{r} AS (SELECT s.source, source_size, target, whole, CAST(rest - coalesce(got, 0) AS BIGINT) AS rest, n.cut, list_append(cuts, n.cut) AS cuts, list_append(fits, rest) AS fits
    FROM {p} s LEFT JOIN cuts{r} k ON s.source IS NOT DISTINCT FROM k.source, LATERAL (SELECT CAST(greatest(CASE WHEN over IS NULL THEN (1 << 60::BIGINT) - 1
        WHEN last IS NULL OR last < (over >> 16 << 16) THEN (over >> 16 << 48) - 1 ELSE ((last + 1) << 32) - 1 END, s.cut) AS BIGINT) AS cut) n)"""
    near = " OR ".join(
        f"(h > {'-1' if r == 1 else f'cuts[{r - 1}]'} AND h <= cuts[{r}] AND size <= fits[{r}])" for r in range(1, rounds + 1)
    )
    out += f""",
least AS (SELECT d.source, min({{'size': size, 'h': h}}) AS m, any_value(rest) AS rest FROM drawn d JOIN state{rounds} s ON d.source IS NOT DISTINCT FROM s.source
    WHERE NOT ({near}) AND size > 0 AND rest > 0 GROUP BY d.source),
state AS (SELECT s.*, CASE WHEN m.size < 2 * s.rest THEN m END AS added FROM state{rounds} s LEFT JOIN least l ON s.source IS NOT DISTINCT FROM l.source)"""
    inside = near + " OR coalesce(size = added.size AND h = added.h, false)"
    return (
        out
        + f""",
mixed AS (SELECT d.*, s.source_size, s.target, CAST(CASE WHEN size > 0 THEN whole + CAST(({inside}) AS INT) ELSE 0 END AS BIGINT) AS copies,
        CAST(CASE WHEN size > 0 THEN whole + CAST(({inside}) AS INT) ELSE 0 END * size AS BIGINT) AS taken
    FROM drawn d JOIN state s ON d.source IS NOT DISTINCT FROM s.source)"""
    )


ORACLE_SQL["op1_quality_rules"] = f"""WITH {quality_ctes("documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules FROM judged"""
ORACLE_SQL["op4_mixing"] = f"""WITH {mixing_ctes("documents")}
SELECT doc_id, size, source_size, target, copies, taken FROM mixed"""


def decontamination_ctes(docs: str, benchmark: str) -> str:
    """CTEs that end in ``found``: hit words and items of every row of ``docs``."""
    def normal(text: str) -> str:
        low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

    return f"""
items AS (SELECT item_id, w, least(len(w), 13) AS m FROM (SELECT item_id, {normal("text")} AS w FROM {benchmark}) WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS g FROM (SELECT item_id, m, w, unnest(range(1, len(w) - m + 2)) AS p FROM items)),
sizes AS (SELECT DISTINCT m FROM wins),
texts AS (SELECT row_number() OVER () AS rid, *, {normal("text")} AS w FROM {docs}),
places AS (SELECT rid, p, m, array_to_string(w[p:p + m - 1], ' ') AS g
    FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM texts, sizes WHERE len(w) >= m)),
matched AS (SELECT rid, p, m, item_id FROM places JOIN wins USING (m, g)),
hit AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + m)) AS q FROM matched) GROUP BY rid),
of_items AS (SELECT rid, list(DISTINCT CAST(item_id AS VARCHAR)) AS ids FROM matched GROUP BY rid),
found AS (SELECT texts.*, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit,
        CAST(len(coalesce(ids, [])) AS BIGINT) AS n_items, sha256(array_to_string(list_sort(coalesce(ids, [])), ',')) AS items_sha256
    FROM texts LEFT JOIN hit USING (rid) LEFT JOIN of_items USING (rid))"""


ORACLE_SQL["op9_decontamination"] = f"""WITH {decontamination_ctes("documents", "benchmark")}
SELECT doc_id, n_words, n_hit, n_items, items_sha256, (n_hit > 0 AND 20 * n_hit >= n_words) AS contaminated FROM found"""


# crc32 of a conversation's decimal id, bit by bit: -1 is a shift, other numbers are bytes
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(s) + 1),
    lambda i: [ord(substr(s, CAST(i AS INT), 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT)"""

ORACLE_SQL["op12_prefix_trie"] = f"""WITH original AS (
    SELECT c, r, x, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, r, md5(concat(length(r), ':', r, x))) AS i
    FROM (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT c, {_CRC32} % 6 AS h FROM (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM original)),
built AS (SELECT v.c, i AS k, r, x FROM convs v JOIN original o ON o.c = v.c - v.c % 100 AND i <= h
    UNION ALL SELECT v.c, 10 + i, r, x FROM convs v JOIN original o ON o.c = v.c AND i > h),
path AS (SELECT c, row_number() OVER w AS d, length(x) AS n, string_agg(sha256(concat(length(r), ':', r, x)), '') OVER w AS id FROM built WINDOW w AS (PARTITION BY c ORDER BY k)),
ends AS (SELECT c, coalesce(max(d), 0) AS d, coalesce(max_by(id, d), '') AS id FROM convs LEFT JOIN path USING (c) GROUP BY c),
nodes AS (SELECT id, d, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM (SELECT c, d, n, id FROM path UNION ALL SELECT c, 0, 0, '' FROM convs) GROUP BY id, d),
kids AS (SELECT left(id, length(id) - 64) AS id, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (id)),
below AS (SELECT a.id, sum(CASE WHEN b.k = 0 THEN 1 ELSE 0 END) AS leaves, sum((b.n_convs - 1) * b.n) AS saved FROM full_nodes a JOIN full_nodes b ON starts_with(b.id, a.id) GROUP BY a.id),
closed AS (SELECT id, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS cs FROM ends GROUP BY id)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.k AS BIGINT) AS n_children,
    CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(cs, '')) AS ends_sha256
FROM full_nodes f JOIN below USING (id) LEFT JOIN closed USING (id) LEFT JOIN nodes up ON f.d > 0 AND up.id = left(f.id, length(f.id) - 64)"""

ORACLE_SQL["op13_hard_negatives"] = """WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
    FROM rows a, rows r WHERE a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 3"""
