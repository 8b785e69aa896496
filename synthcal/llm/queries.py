"""The registered queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthcal.llm import audit, cascade, chat, compress, langid, maxent, mixing, packing, repair, simhash, topk, warc, winnow
from synthcal.llm.shared import fold

#: Tokenizer file of the packing query; a parameter of the operator.
TOKENIZER = "word_bpe_49k.json"
#: Tokens of a window of the chat query: few enough for most conversations to have several.
CHAT_BUDGET = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.capture_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scores(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict_language(docs, langid.fit_profiles(docs.where(fold("doc_id", 3) != 1)))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.quality_table(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = compress.fit_quality(docs, table(spark, sf_dir, "labels"))
    return compress.quality_scores(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.digests(chat.read_back(chat.chat_windows(conversations, budget=CHAT_BUDGET)))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_fingerprints(table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_warc, op2_mixing, op3_simhash, op4_maxent, op5_language, op6_quality_rules, op7_quality_classifier, op8_packing, op9_chat, op10_topk, op11_audit, op12_winnowing, op13_repair)
    return {f.__name__: f for f in found}


W = r"[^\x20\x09-\x0D]+"

OP1_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, lower(trim(coalesce(url, ''))) AS u FROM pages),
f AS (SELECT sha256(html) AS digest, min(page_id) AS first_id FROM p WHERE strlen(html) >= 100 GROUP BY sha256(html)),
x AS (SELECT page_id, html, sha256(html) AS digest, u, regexp_extract(u, '^[a-z]+://([^/?#]*)', 1) AS net, regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS query FROM p),
y AS (SELECT x.*, regexp_replace(regexp_replace(net, ':[0-9]*$', ''), '^www\.', '') AS host, regexp_extract(net, ':([0-9]+)$', 1) AS port, first_id FROM x LEFT JOIN f ON f.digest = x.digest AND strlen(x.html) >= 100)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to,
  CASE WHEN u = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || CASE WHEN port = '' OR (port = '80' AND u LIKE 'http:%') OR (port = '443' AND u LIKE 'https:%') THEN '' ELSE ':' || port END || ')' ||
    CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END END AS url_key,
  strftime(TIMESTAMP '2023-11-14 22:13:20' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM y
"""

OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{W}')), 0)::BIGINT AS size, coalesce(text, '') AS text,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS solid, length(regexp_replace(text, '[^\p{{L}}\p{{M}}]+', '', 'g')) AS letters,
         string_split(text, chr(10)) AS lines
  FROM documents),
k AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '') || ':' || md5(text)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496::DOUBLE)
    / (0.25::DOUBLE + 0.75::DOUBLE * CASE WHEN solid > 0 THEN letters::DOUBLE / solid * (len(list_distinct(lines))::DOUBLE / len(lines)) ELSE 0 END) AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT source, source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
r AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS ratio FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM r WINDOW o AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, level LIMIT 1) AS final),
t AS (SELECT source, source_size, CASE WHEN final IS NULL OR ratio < final THEN cap::DOUBLE ELSE weight * final END AS target FROM l, f),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
q AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, round(p.target - p.epochs * p.source_size)::BIGINT AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM q
"""

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS win FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g WHERE win IS NOT NULL) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '{W}')) AS lines FROM d),
b AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS up, length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS lo,
    length(text) - length(replace(text, '!', '')) AS bang
  FROM d JOIN ln USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 4 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
       OR 2 * n_dup_lines > n_lines OR (up > 2 * lo AND up > 50) OR 2 * bang > n_words) AS kept
FROM b
"""

OP9_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, row_number() OVER o AS k, len(regexp_extract_all(text, '{W}')) + 4 AS cost,
    length('<turn ' || role || '>' || chr(10)) + length(regexp_replace(replace(text, '\', '\\'), '<(/?turn)', '<\\\1', 'g')) + 8 AS chars
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, sum(cost) OVER o - cost AS start, (cost > {CHAT_BUDGET // 8})::INT AS long, 2 * (sum((cost > {CHAT_BUDGET // 8})::INT) OVER o) - (cost > {CHAT_BUDGET // 8})::INT AS grp
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY k)),
p AS (SELECT *, CASE WHEN long = 1 THEN 0 ELSE start // {CHAT_BUDGET * 3 // 8} END AS cell, start = 0 AND role = 'system' AS sys FROM s),
n AS (SELECT *, min(start) OVER w AS first, max(start + cost) OVER w AS reach FROM p WINDOW w AS (PARTITION BY conv_id, grp, cell)),
sy AS (SELECT conv_id, cost AS s_cost, chars AS s_chars FROM n WHERE sys AND cost <= {CHAT_BUDGET // 4}),
l AS (SELECT n.conv_id, first, least({CHAT_BUDGET // 4}, {CHAT_BUDGET} - (any_value(reach) - first) - coalesce(any_value(s_cost), 0)) AS room, any_value(s_chars) AS s_chars
  FROM n LEFT JOIN sy ON n.conv_id IS NOT DISTINCT FROM sy.conv_id WHERE first > 0 GROUP BY n.conv_id, first),
z AS (
  SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM (
    SELECT conv_id, chars FROM n
    UNION ALL SELECT n.conv_id, n.chars FROM n JOIN l ON n.conv_id IS NOT DISTINCT FROM l.conv_id AND n.reach = l.first WHERE NOT n.sys AND n.reach - n.start <= l.room
    UNION ALL SELECT conv_id, s_chars FROM l WHERE s_chars IS NOT NULL) GROUP BY conv_id)
SELECT t.conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, any_value(formatted_chars) AS formatted_chars
FROM t JOIN z ON t.conv_id IS NOT DISTINCT FROM z.conv_id GROUP BY t.conv_id
"""

OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score FROM v q JOIN v d ON q.vec_id IS DISTINCT FROM d.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents),
m AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 10 * length(d.t), regexp_matches(d.t, '[#$%&*|]'), coalesce(d.doc_id > first_id, false)] AS bad
  FROM d JOIN m ON m.t = d.t LEFT JOIN lab ON lab.doc_id = d.doc_id),
l AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, x.i, y.i] AS ord FROM l a, l b, l c, l x, l y WHERE len(list_distinct([a.i, b.i, c.i, x.i, y.i])) = 5),
g AS (SELECT part, bad, ord, good, toxic, coalesce(nullif(list_position(list_transform(ord, lambda i: bad[i]), true), 0), 6) AS gone FROM f, o),
s AS (
  SELECT part, ord, l.i AS step, ord[l.i] AS filter, count(*) FILTER (gone > l.i) AS kept, count(*) FILTER (gone = l.i) AS removed, count(*) FILTER (bad[ord[l.i]] AND gone < l.i) AS redundant,
    count(*) FILTER (bad[ord[l.i]] AND len(list_filter(bad, lambda x: x)) = 1) AS unique_fails, coalesce(sum(good) FILTER (gone = l.i), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (gone = l.i), 0)::BIGINT AS toxic_lost
  FROM g, l GROUP BY part, ord, l.i)
SELECT part, array_to_string(list_transform(ord, lambda i: 'ABCDE'[i]), '') AS filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM s
"""

OP12_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS k FROM documents),
n AS (SELECT d.*, length(t)::BIGINT AS n_chars, length(t) // 2 AS half, coalesce(lead(t) OVER (ORDER BY k), first_value(t) OVER (ORDER BY k)) AS following FROM d),
e AS (SELECT k, 0 AS side, t AS s FROM n UNION ALL SELECT k, 1, substr(t, 1, (n_chars - half)::INT) || substr(following, 1, half::INT) FROM n),
c AS (SELECT k, side, unnest(regexp_extract_all(s, '(?s).')) AS ch, generate_subscripts(regexp_extract_all(s, '(?s).'), 1) - 1 AS i, length(s) AS n FROM e),
p AS (
  SELECT list_transform(range(1024), lambda j: list_reduce(list_prepend(1::BIGINT, list_transform(range(j), lambda x: {winnow.BASE}::BIGINT)), lambda x, y: x * y % {winnow.PRIME})) AS up,
    list_transform(range(1024), lambda j: list_reduce(list_prepend(1::BIGINT, list_transform(range(j), lambda x: {pow(winnow.BASE, -1, winnow.PRIME)}::BIGINT)), lambda x, y: x * y % {winnow.PRIME})) AS down,
    list_transform(range(1024), lambda j: list_reduce(list_prepend(1::BIGINT, list_transform(range(j), lambda x: {pow(winnow.BASE, 1024, winnow.PRIME)}::BIGINT)), lambda x, y: x * y % {winnow.PRIME})) AS up2,
    list_transform(range(1024), lambda j: list_reduce(list_prepend(1::BIGINT, list_transform(range(j), lambda x: {pow(winnow.BASE, -1024, winnow.PRIME)}::BIGINT)), lambda x, y: x * y % {winnow.PRIME})) AS down2),
b AS (SELECT i, up[i % 1024 + 1] * up2[i // 1024 + 1] % {winnow.PRIME} AS up, down[i % 1024 + 1] * down2[i // 1024 + 1] % {winnow.PRIME} AS down FROM p, (SELECT unnest(range((SELECT max(n) FROM c))) AS i)),
h AS (
  SELECT k, side, c.i, n, least({winnow.GRAM}, n) AS gram, (sum(unicode(ch) * up % {winnow.PRIME}) OVER (PARTITION BY k, side ORDER BY c.i ROWS BETWEEN CURRENT ROW AND {winnow.GRAM - 1} FOLLOWING))::BIGINT % {winnow.PRIME} * down % {winnow.PRIME} AS hash
  FROM c JOIN b ON b.i = c.i),
q AS (SELECT k, side, i, n - gram + 1 AS m, hash::BIGINT * 4294967296 + (4294967295 - i) AS key FROM h WHERE i <= n - gram),
w AS (SELECT k, side, i, m, min(key) OVER (PARTITION BY k, side ORDER BY i ROWS BETWEEN CURRENT ROW AND {winnow.WINDOW - 1} FOLLOWING) AS key FROM q),
u AS (SELECT DISTINCT k, side, key // 4294967296 AS hash, 4294967295 - key % 4294967296 AS place FROM w WHERE i <= greatest(0, m - {winnow.WINDOW})),
r AS (SELECT k, side, string_agg(format('{{:08x}}@{{}}', hash::BIGINT, place::BIGINT), ' ' ORDER BY place) AS shown, list(DISTINCT hash) AS hashes FROM u GROUP BY k, side),
z AS (SELECT n.k, e.s, own.shown AS f, ed.shown AS g, coalesce(own.hashes, []) AS a, coalesce(ed.hashes, []) AS b, n.doc_id, n.n_chars FROM n JOIN e ON e.k = n.k AND e.side = 1 LEFT JOIN r own ON own.k = n.k AND own.side = 0 LEFT JOIN r ed ON ed.k = n.k AND ed.side = 1),
x AS (SELECT z.*, coalesce(lead(a) OVER (ORDER BY k), first_value(a) OVER (ORDER BY k)) AS c FROM z)
SELECT doc_id, n_chars, sha256(s) AS edited_sha256, coalesce(f, '') AS fingerprint, coalesce(g, '') AS edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END::DOUBLE AS near_edited,
  CASE WHEN len(a) + len(c) = 0 THEN 1.0 ELSE len(list_intersect(a, c))::DOUBLE / len(list_distinct(list_concat(a, c))) END::DOUBLE AS near_next
FROM x
"""

def _least(*found: str) -> str:
    out = found[0]
    for x in found[1:]:
        out = f"list_min([{out}, {x}])"
    return out


def _edit(letter: str, cost: str, after: str, line: str | None = None) -> str:
    out = f"{after}.o" if line is None else f"list_prepend({line}, {after}.o)"
    return f"{{'c': {after}.c + {cost}, 'a': '{letter}' || {after}.a, 'o': {out}}}"


def _moves(state: int) -> str:
    """Least of deleting, keeping and giving another role to a row, from a state; ``a0`` to ``a3`` are the costs to go, strings and lines behind it."""
    to = repair.NEXT[state]
    keep = " ".join(f"WHEN initial = '{x}' THEN {_edit('K', 'extra', f'a{t}', 'line')}" for x, code in repair.INITIALS.items() if (t := repair.kept_state(state, code)) is not None)
    given = _edit("R", f"{repair.REROLE} + extra", f"a{to}", f"'{repair.ROLES[to]}:' || text")
    gone = _edit("D", str(repair.DELETE), f"a{state}")
    return f"CASE WHEN gone THEN {gone} ELSE {_least(gone, given, f'CASE {keep} ELSE {gone} END')} END"


def _insert(after: str, role: str) -> str:
    return _edit("I", str(repair.INSERT), after, f"'{role}:'")


# costs to go, least strings and their lines from each state, row by row from the end
OP13_SQL = rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
f AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x // 2, 3988292384::BIGINT * (x % 2)))), 4294967295::BIGINT) % 20 AS fault FROM k),
d AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM f WHERE fault <> 0),
j AS (
  SELECT *, substr(role, 1, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid, role || ':' || text AS line,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, row_number() OVER o AS place, lag(substr(role, 1, 1)) OVER o AS before, count(*) OVER (PARTITION BY conv_id) AS n
  FROM d WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
r AS (
  SELECT *, n - place + 1 AS step, solid = '' OR again AS gone, solid <> '' AND NOT again AND right(solid, 1) NOT IN ('.', '!', '?') AS cut, CASE WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN {repair.TRUNCATED} ELSE 0 END AS extra FROM j),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (solid = '') AS blank, count(*) FILTER (solid <> '' AND again) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (place > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, any_value(n) AS n FROM r GROUP BY conv_id),
dp AS (
  SELECT conv_id, 0::BIGINT AS step, n, {{'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}} AS c0, {{'c': {repair.END[1]}::BIGINT, 'a': 'II', 'o': ['user:', 'assistant:']}} AS c1,
    {{'c': {repair.END[2]}::BIGINT, 'a': 'I', 'o': ['assistant:']}} AS c2, {{'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}} AS c3 FROM g
  UNION ALL
  SELECT conv_id, step, n, {_least("b0", _insert("c2", "user"))}, {_least("b1", _insert("c2", "user"))}, c2, {_least("b3", _insert("b2", "user"))} FROM (
    SELECT *, {_least("b2", _insert("b3", "assistant"))} AS c2 FROM (
      SELECT dp_conv AS conv_id, step, n, {", ".join(f"{_moves(s)} AS b{s}" for s in range(4))} FROM (
        SELECT dp.conv_id AS dp_conv, r.step, dp.n, dp.c0 AS a0, dp.c1 AS a1, dp.c2 AS a2, dp.c3 AS a3, r.initial, r.gone, r.extra, r.line, r.text FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.step = dp.step + 1)))),
e AS (SELECT g.*, dp.c0 AS best FROM g JOIN dp ON dp.conv_id IS NOT DISTINCT FROM g.conv_id AND dp.step = g.n)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op2_mixing": OP2_SQL, "op6_quality_rules": OP6_SQL, "op9_chat": OP9_SQL, "op10_topk": OP10_SQL, "op11_audit": OP11_SQL, "op12_winnowing": OP12_SQL, "op13_repair": OP13_SQL}
