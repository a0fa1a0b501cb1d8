"""DuckDB SQL of the queries that SQL can express.

The others have none: trained models (op1, op7, op8), XXH64 (op2, op10), windows of 400 bytes from every byte
(op3, too slow on whole tables), rendering (op9) and merge lists (op13).  Tests compare them with brute force.
"""


def _crc32_table() -> str:
    """The table of the checksum, from its polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return "[" + ",".join(map(str, table)) + "]"


ORACLE: dict[str, str] = {
    "op4_cover_anchors": r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, unnest(generate_series(1, len(w) - 19)) AS s, w FROM d WHERE len(w) >= 20
), later AS (
    SELECT doc_id, s FROM (
        SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s : s + 19], ' ') ORDER BY doc_id, s) AS n FROM windows
    ) WHERE n > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS pos FROM later
), lists AS (
    SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id
), words AS (
    SELECT d.doc_id, w, unnest(generate_series(1, len(w))) AS pos FROM d JOIN lists USING (doc_id)
), kept AS (
    SELECT words.doc_id, string_agg(w[words.pos], ' ' ORDER BY words.pos) AS text
    FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.pos = words.pos WHERE gone.pos IS NULL GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(lists.gone), 0) AS BIGINT) AS n_removed,
    sha256(CASE WHEN lists.doc_id IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept.text, '') END) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op5_source_mix": r"""
WITH d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), levels AS (
    SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS clamps_at,
        CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
    FROM s WINDOW before AS (
        ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
    )
), final AS (
    SELECT arg_min(level, clamps_at) AS level FROM levels WHERE level <= clamps_at
), targets AS (
    SELECT source, source_size, CASE WHEN clamps_at < final.level THEN CAST(3 * source_size AS DOUBLE)
        ELSE least(weight * final.level, CAST(3 * source_size AS DOUBLE)) END AS target FROM levels, final
), parts AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets
), cuts AS (
    SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING) AS DOUBLE)
        - CAST(size AS DOUBLE) / 2 AS middle FROM d
)
SELECT c.doc_id, c.size, p.source_size, p.target,
    CAST(c.size * (p.whole + CASE WHEN c.middle <= p.target - p.whole * p.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM cuts c JOIN parts p ON c.source IS NOT DISTINCT FROM p.source
""",
    "op6_decontaminate": r"""
WITH lowered AS (
    SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
    UNION ALL
    SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), words AS (
    SELECT kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered
), items AS (
    SELECT DISTINCT id AS item_id, n, array_to_string(w[s : s + n - 1], ' ') AS win FROM (
        SELECT id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s
        FROM words WHERE kind = 'b' AND len(w) > 0
    )
), widths AS (
    SELECT DISTINCT n FROM items
), windows AS (
    SELECT id AS doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS s FROM words, widths WHERE kind = 'd' AND len(w) >= n
), hits AS (
    SELECT doc_id, s, items.n, item_id FROM windows JOIN items
        ON items.n = windows.n AND items.win = array_to_string(windows.w[s : s + windows.n - 1], ' ')
), hit_words AS (
    SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS pos FROM hits) GROUP BY doc_id
), hit_items AS (
    SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit_words.n, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(hit_items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    hit_words.n IS NOT NULL AS contaminated
FROM words LEFT JOIN hit_words ON hit_words.doc_id = id LEFT JOIN hit_items ON hit_items.doc_id = id WHERE kind = 'd'
""",
    "op11_spelling_variants": r"""
WITH RECURSIVE runs AS (
    SELECT key, run, count(*) AS c FROM (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS key,
            unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
        FROM documents WHERE text IS NOT NULL
    ) GROUP BY key, run
), points AS (
    SELECT key, run, c, list_transform(string_split(key || ':' || run, ''), lambda x: unicode(x)) AS p FROM runs
), summed AS (
    SELECT run, c, xor(list_reduce(
        flatten(list_transform(p, lambda x: CASE WHEN x < 128 THEN [CAST(x AS BIGINT)] ELSE [195, CAST(x AS BIGINT) - 64] END)),
        lambda h, b: xor(h >> 8, list_extract(CRC_TABLE, CAST((xor(h, b) & 255) + 1 AS INTEGER))), 4294967295), 4294967295) AS h FROM points
), counted AS (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
        ELSE run END AS word, c FROM summed
), v AS (
    SELECT word, CAST(sum(c) AS BIGINT) AS n FROM counted WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), places AS (
    SELECT word, n, unnest(generate_series(1, length(word))) AS pos FROM v
), cut AS (
    SELECT word, n, pos, substr(word, 1, pos - 1) AS a, substr(word, pos + 1) AS b FROM places
), near AS (
    SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.pos = y.pos AND x.a = y.a AND x.b = y.b WHERE x.word <> y.word
    UNION
    SELECT x.word, x.n, v.word, v.n FROM cut x JOIN v ON v.word = x.a || x.b
    UNION
    SELECT v.word, v.n, x.word, x.n FROM cut x JOIN v ON v.word = x.a || x.b
), best AS (
    SELECT word, near, near_n, n_near FROM (
        SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM near
    ) WHERE place = 1
), formed AS (
    SELECT v.word, v.n, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n,
        CAST(coalesce(n_near, 0) AS BIGINT) AS n_near FROM v LEFT JOIN best ON best.word = v.word
), chain AS (
    SELECT word, word AS root, form AS next FROM formed
    UNION ALL
    SELECT chain.word, formed.word, formed.form FROM chain JOIN formed ON formed.word = chain.next
)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN chain ON chain.word = formed.word AND chain.next IS NULL
""".replace("CRC_TABLE", _crc32_table()),
    "op12_filter_audit": r"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), judged AS (
    SELECT part, doc_id, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END AS a, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 1 ELSE 0 END AS b,
        CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 1 ELSE 0 END AS c,
        CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
        CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 1 ELSE 0 END AS e FROM d
), flags AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), masks AS (
    SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM judged LEFT JOIN flags USING (doc_id) GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
    SELECT filter_order, unnest(generate_series(1, 5)) AS step, bits FROM orders
), places AS (
    SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1 : step - 1]), 0) AS INTEGER) AS before FROM steps
), counted AS (
    SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM masks, places GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
""",
}
