"""SQL twins of the operators that SQL can express on whole tables."""

from __future__ import annotations

# Checksum CRC-32 of a list of byte values, {bytes}: the usual table, then a byte at a time.
CRC_TABLE = """
    SELECT list_transform(range(256), lambda n: list_reduce(
        [n, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
    )) AS steps
"""
CRC = """
    xor(list_reduce(list_prepend(4294967295, {bytes}),
                    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)
"""
# The UTF-8 bytes of a text of ASCII and letters up to U+00FF, as a list of code points makes them.
BYTES = """
    flatten(list_transform(string_split({text}, ''),
                           lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)]
                                          ELSE [CAST(195 AS BIGINT), unicode(x) - 64] END))
"""

ORACLES: dict[str, str] = {
    "op5_exact_topk": """
        WITH rows AS MATERIALIZED (
            SELECT vec_id, row_number() OVER () AS row,
                   list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM rows q JOIN rows c ON q.row <> c.row
            WHERE q.vec_id % 100 = 0
        ),
        ranked AS (
            SELECT query_id, vec_id, score,
                   CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op10_jaccard_join": """
        WITH RECURSIVE words AS (
            SELECT doc_id,
                   list_filter(
                       regexp_split_to_array(
                           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[\\x20\\x09-\\x0D]+'
                       ),
                       lambda w: w <> ''
                   ) AS w
            FROM documents
        ),
        sets AS (
            SELECT doc_id,
                   CASE WHEN len(w) = 0 THEN []
                        WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                        ELSE list_distinct(list_transform(
                            range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]
                        ))
                   END AS s
            FROM words
        ),
        elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
        shared AS (
            SELECT x.doc_id AS a, y.doc_id AS b, x.n AS n_a, y.n AS n_b, count(*) AS both_have
            FROM elements x JOIN elements y ON x.e = y.e AND x.doc_id <> y.doc_id
            WHERE 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
            GROUP BY ALL
        ),
        links AS (SELECT a, b FROM shared WHERE 100 * both_have >= 90 * (n_a + n_b - both_have)),
        reached(doc_id, other) AS (
            SELECT doc_id, doc_id FROM sets
            UNION
            SELECT reached.doc_id, links.b FROM reached JOIN links ON reached.other = links.a
        ),
        smallest AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
        SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
        FROM sets JOIN smallest USING (doc_id)
    """,
    "op11_source_mixing": """
        WITH sized AS (
            SELECT doc_id, source,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                   md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))) AS key
            FROM documents
        ),
        sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight
            FROM sized GROUP BY source
        ),
        levels AS (
            SELECT *, 2 * source_size / weight AS stops_at,
                   (1.5 * CAST(sum(source_size) OVER () AS DOUBLE)
                    - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (ORDER BY 2 * source_size / weight, source
                               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM sources
        ),
        targets AS (
            SELECT source, source_size,
                   least(2.0 * source_size, weight * (SELECT max(level) FROM levels WHERE level <= stops_at)) AS target
            FROM levels
        ),
        placed AS (
            SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
                   CAST(floor(target + 0.5) AS BIGINT) AS words,
                   CAST(sum(size) OVER (PARTITION BY s.source ORDER BY key ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               CASE WHEN size = 0 THEN 0
                    ELSE size * (words // source_size)
                         + greatest(0, least(size, words % source_size - start)) END AS taken
        FROM placed
    """,
    "op12_prefix_trie": f"""
        WITH RECURSIVE crc AS ({CRC_TABLE}),
        turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        own AS (
            SELECT conv_id, list({{'role': role, 'text': text}}
                                 ORDER BY turn NULLS FIRST,
                                          left(sha256(concat(length(role), ':', role, text)), 32)) AS own
            FROM turns GROUP BY conv_id
        ),
        cut AS (
            SELECT conv_id, own, CAST({CRC.format(bytes=BYTES.format(text="CAST(conv_id AS VARCHAR)"))} % 6 AS INTEGER) AS h
            FROM own, crc
        ),
        sequences AS (
            SELECT cut.conv_id, list_concat(coalesce(base.own, [])[1:h], cut.own[h + 1:]) AS seq
            FROM cut LEFT JOIN own base ON base.conv_id = cut.conv_id - cut.conv_id % 100
        ),
        prefixes AS (
            SELECT conv_id, len(seq) AS n_turns, d AS depth, seq[1:d] AS prefix
            FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM sequences)
        ),
        nodes AS (
            SELECT prefix, depth, min(conv_id) AS node, count(*) AS n_convs,
                   (count(*) - 1) * coalesce(length(prefix[depth].text), 0) AS saved,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                                   FILTER (n_turns = depth), '')) AS ends
            FROM prefixes GROUP BY prefix, depth
        ),
        steps AS (SELECT p.conv_id, n.* FROM prefixes p JOIN nodes n USING (prefix, depth)),
        parents AS (
            SELECT DISTINCT a.node, a.depth, b.node AS parent
            FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND a.depth = b.depth + 1
        ),
        families AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM parents GROUP BY ALL),
        below AS (
            SELECT DISTINCT a.node, a.depth, b.node AS lower_node, b.depth AS lower_depth, b.saved
            FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND a.depth <= b.depth
        ),
        sums AS (
            SELECT b.node, b.depth, CAST(sum(b.saved) AS BIGINT) AS saved_tokens,
                   count(*) FILTER (f.n_children IS NULL) AS n_leaves
            FROM below b LEFT JOIN families f ON f.node = b.lower_node AND f.depth = b.lower_depth
            GROUP BY b.node, b.depth
        )
        SELECT n.node AS conv_id, n.depth, p.parent AS parent_conv_id, n.n_convs,
               coalesce(f.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends AS ends_sha256
        FROM nodes n
        JOIN sums s USING (node, depth)
        LEFT JOIN parents p USING (node, depth)
        LEFT JOIN families f USING (node, depth)
    """,
    "op13_spelling_variants": f"""
        WITH RECURSIVE crc AS ({CRC_TABLE}),
        runs AS (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
                   unnest(regexp_extract_all(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[A-Za-zÀ-ÿ]+')) AS run
            FROM documents
        ),
        distinct_runs AS (SELECT id, run, concat(id, ':', run) AS named, count(*) AS n FROM runs GROUP BY ALL),
        checked AS (
            SELECT run, n, CAST({CRC.format(bytes=BYTES.format(text="named"))} AS BIGINT) AS h
            FROM distinct_runs, crc
        ),
        cut AS (
            SELECT n, CASE WHEN h % 97 = 0
                           THEN concat(substring(run, 1, h % length(run)), substring(run, h % length(run) + 2))
                           ELSE run END AS word
            FROM checked
        ),
        words AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n
            FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
        ),
        holes AS (
            SELECT word, n, i, concat(substring(word, 1, i), substring(word, i + 2)) AS rest
            FROM (SELECT *, unnest(range(0, length(word))) AS i FROM words)
        ),
        near AS (
            SELECT a.word, b.word AS near, b.n AS near_n
            FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word
        ),
        best AS (
            SELECT word, near AS form, near_n AS form_n, count(*) OVER (PARTITION BY word) AS n_near
            FROM near
            QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1
        ),
        formed AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
                   CASE WHEN form_n >= 2 * w.n THEN form END AS form,
                   CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n
            FROM words w LEFT JOIN best USING (word)
        ),
        followed(word, last, next) AS (
            SELECT word, word, form FROM formed
            UNION ALL
            SELECT followed.word, formed.word, formed.form
            FROM followed JOIN formed ON followed.next = formed.word
        )
        SELECT formed.*, followed.last AS root
        FROM formed JOIN followed ON followed.word = formed.word AND followed.next IS NULL
    """,
}
