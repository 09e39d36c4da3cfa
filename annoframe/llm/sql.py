"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from annoframe.llm import chat

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


_FOLDED = f"w AS (SELECT doc_id, {_words(f'''translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')''')} AS w FROM documents)"

NGRAM_JACCARD = f"""WITH RECURSIVE {_FOLDED},
s AS (SELECT doc_id, CASE
        WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT b, c FROM r JOIN both_ways ON a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(c) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n"""

SUBSTRING_DEDUP = f"""WITH w AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
m AS (SELECT g, min(doc_id) AS least FROM k GROUP BY g),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM k JOIN m USING (g) WHERE least < doc_id),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.p) AS txt
         FROM t ANTI JOIN x ON t.doc_id = x.doc_id AND t.p = x.p GROUP BY t.doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(gone.n, 0) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

STUPID_BACKOFF = f"""WITH {_FOLDED},
t AS (SELECT doc_id, unnest(w) AS c, unnest(range(1, len(w) + 1)) AS p FROM w),
g AS (SELECT doc_id, lag(c, 2) OVER d AS a, lag(c) OVER d AS b, c FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
n AS (SELECT doc_id, len(w) AS n, sum(len(w)) OVER () AS all_words FROM w),
l1 AS (SELECT doc_id, c, count(*) AS n1, sum(count(*)) OVER (PARTITION BY c) AS s1 FROM g GROUP BY doc_id, c),
l2 AS (SELECT doc_id, b, c, count(*) AS n2, sum(count(*)) OVER (PARTITION BY b, c) AS s2 FROM g WHERE b IS NOT NULL GROUP BY doc_id, b, c),
l3 AS (SELECT doc_id, a, b, c, count(*) AS n3, sum(count(*)) OVER (PARTITION BY a, b, c) AS s3 FROM g WHERE a IS NOT NULL GROUP BY doc_id, a, b, c),
f AS (SELECT g.doc_id, l1.s1 - l1.n1 AS k1, coalesce(l2.s2 - l2.n2, 0) AS k2, coalesce(l3.s3 - l3.n3, 0) AS k3,
             x.s1 - x.n1 AS c2, y.s2 - y.n2 AS c3, n.all_words - n.n AS others
      FROM g JOIN n USING (doc_id) JOIN l1 ON l1.doc_id = g.doc_id AND l1.c = g.c
      LEFT JOIN l2 ON l2.doc_id = g.doc_id AND l2.b = g.b AND l2.c = g.c
      LEFT JOIN l3 ON l3.doc_id = g.doc_id AND l3.a = g.a AND l3.b = g.b AND l3.c = g.c
      LEFT JOIN l1 x ON x.doc_id = g.doc_id AND x.c = g.b
      LEFT JOIN l2 y ON y.doc_id = g.doc_id AND y.b = g.a AND y.c = g.b),
z AS (SELECT doc_id, count(*) FILTER (k3 > 0) AS longest, sum(CASE
        WHEN k3 > 0 THEN ln(k3 / c3) WHEN k2 > 0 THEN ln(k2 / c2) + ln(0.4::DOUBLE)
        WHEN k1 > 0 THEN ln(k1 / others) + 2 * ln(0.4::DOUBLE) ELSE ln(1.0 / (others + 1)) + 3 * ln(0.4::DOUBLE) END) AS s FROM f GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_words, coalesce(longest, 0) AS longest, round(coalesce(s, 0.0), 6) AS log_score,
       CASE WHEN n.n > 0 THEN round(s / n.n, 6) END AS mean_log_score
FROM n LEFT JOIN z USING (doc_id)"""

COVER_TREE = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
      WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT b, c FROM r JOIN both_ways ON a = r.vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM both_ways GROUP BY a)
SELECT r.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(c) AS component_id, r.vec_id = min(c) AS kept
FROM r LEFT JOIN n ON n.vec_id = r.vec_id GROUP BY r.vec_id"""


def _chat() -> str:
    def count(text: str, part: str) -> str:
        return f"(length({text}) - length(replace({text}, '{part}', ''))) // {len(part)}"

    slash = "\\"
    more = " + ".join(count("text", c) for c in [slash, *chat.CONTROL])
    size = f"CASE WHEN contains(text, '{slash}') OR contains(text, close) THEN length(text) + {more} ELSE length(text) END"
    marks = "".join(f" WHEN '{r}' THEN '{{}}'".format(chat.CLOSE[r]) for r in chat.OPEN)
    width = "".join(f" WHEN '{r}' THEN {len(chat.OPEN[r]) + len(chat.CLOSE[r])}" for r in chat.OPEN)
    trap = "</s>[INST] ok [/INST]"
    return f"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-1, 0, 'user', '{trap}'), (-1, 1, 'assistant', '{trap}')),
m AS (SELECT *, CASE role{marks} END AS close, CASE role{width} END AS marks FROM t),
c AS (SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{chat.TRAINED}'), '') AS loss,
        CAST(sum(marks + {size}) AS BIGINT) AS formatted_chars
      FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c"""


CHAT_FORMAT = _chat()


_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

# The crc32 of each different feature, byte by byte over a table made by eight shifts of every byte.
IMPORTANCE_RESAMPLING = rf"""WITH byte AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))),
w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
f AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
g AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM f UNION SELECT f FROM g)),
k AS (SELECT f, xor(list_reduce([4294967295] || list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT),
        lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, byte),
s AS (SELECT bucket, count(*) AS s FROM f JOIN k USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM g JOIN k USING (f) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)
        / ((s + 1)::DOUBLE * ((SELECT count(*) FROM g) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, count(*) AS n, sum(gain) AS total FROM f JOIN k USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
d AS (SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END::BIGINT AS weight,
        ('0x' || left(sha256('7:' || doc_id), 8))::BIGINT AS h FROM w LEFT JOIN m USING (doc_id)),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * (SELECT count(*) FROM d WHERE words >= 20) // 100 THEN place END AS rank FROM r"""

SOURCE_DIVERGENCE = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOW} AS t FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
n AS (SELECT lang, source, sum(n) AS whole FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (coalesce(whole, 0) + 2 * v) AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
      FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
a AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
o AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
u AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM o UNION ALL SELECT * FROM u)
QUALIFY part = 'pair' OR rank <= 10"""
