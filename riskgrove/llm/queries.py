"""The operators as queries over the given tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

import corpus_pipeline
from riskgrove.llm import centroids, chat, ctw, decontaminate, exact, html, lines, merkle, mixing
from riskgrove.llm import quality, rollup, secrets, simhash
from riskgrove.llm.common import LOWER, UPPER, WORD, lowered, text_of
from riskgrove.session import shared_path

UPPER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD_SQL = r"'[^\x20\x09-\x0D]+'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.extract(table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return rows.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are counted under two tokenizer versions; documents labelled as poor are
    counted anew (their words without pieces of symbols only) and toxic ones are deleted. The
    second batch is sent twice, as after a restart."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    labels = table(spark, sf_dir, "labels")
    words = rollup.pattern_count("text", WORD)
    plain = rollup.pattern_count("text", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    store = rollup.Store(spark, shared_path(spark, "token-counts")).create()
    store.commit("1 documents", rollup.measured(docs, {"words": words, "plain": plain}))
    poor = labels.where("quality = 0").select(F.col("doc_id").cast("string").alias("doc_id"))
    anew = rollup.measured(docs, {"words": plain}).join(poor, "doc_id", "left_semi")
    for _ in range(2):
        store.commit("2 poor documents", anew)
    store.commit("3 toxic documents", rollup.removed(labels.where("toxic = 1")))
    return store.totals().withColumnRenamed("version", "tokenizer_version")


OP5_SQL = rf"""
WITH d AS (
  SELECT d.*, len(regexp_extract_all(coalesce(text, ''), {WORD_SQL}))::BIGINT AS words,
         len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))::BIGINT AS plain,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0) AS poor
  FROM documents d
  WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)),
v AS (
  SELECT source, lang, 'words' AS tokenizer_version, CASE WHEN poor THEN plain ELSE words END AS n FROM d
  UNION ALL SELECT source, lang, 'plain', plain FROM d)
SELECT source, lang, tokenizer_version, count(*) AS docs, sum(n)::BIGINT AS tokens FROM v GROUP BY ALL
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        F.col("row.doc_id").alias("doc_id"),
        (quality.fold(F.col("row.doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.link(table(spark, sf_dir, "conversations"))
    rows = rows.withColumn("reply_to", F.coalesce("reply_to", F.lit(-1).cast("long")))
    return rows.select("conv_id", "turn", "role", "own_text", "n_quotes", "reply_to", "thread", "position", "formatted")


# The given conversations hold no quoted line; the twin reads quotes all the same.
OP7_SQL = r"""
WITH l AS (
  SELECT conv_id, turn, role, text, unnest(string_split_regex(coalesce(text, ''), '\r?\n')) AS line,
         generate_subscripts(string_split_regex(coalesce(text, ''), '\r?\n'), 1) AS i
  FROM conversations),
m AS (
  SELECT *, len(regexp_replace(regexp_extract(line, '^[ \t]*(>[ \t]*)+'), '[^>]', '', 'g')) AS level,
         regexp_replace(line, '^[ \t]*(>[ \t]*)+', '') AS body
  FROM l),
r AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY i) AS run FROM m),
u AS (
  SELECT conv_id, turn, level, 1 AS part, body AS unit FROM m
  UNION ALL SELECT conv_id, turn, level, 0, string_agg(body, chr(10) ORDER BY i) FROM r WHERE level > 0
            GROUP BY conv_id, turn, level, run
  UNION ALL SELECT conv_id, turn, 0, 0, string_agg(body, chr(10) ORDER BY i) FROM m WHERE level = 0
            GROUP BY conv_id, turn),
n AS (
  SELECT conv_id, turn, level, part,
         trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[\x20\x09-\x0D]+', ' ', 'g')) AS unit FROM u),
f AS (SELECT conv_id, unit, min(turn) AS original FROM n WHERE level = 0 AND unit <> '' GROUP BY ALL),
k AS (
  SELECT n.conv_id, n.turn, arg_min(original, (level, part, -original)) AS reply_to
  FROM n JOIN f ON n.conv_id = f.conv_id AND n.unit = f.unit
  WHERE level > 0 AND n.unit <> '' AND original < n.turn GROUP BY ALL),
t AS (
  WITH RECURSIVE c(conv_id, turn, thread) AS (
    SELECT conv_id, turn, reply_to FROM k
    UNION SELECT c.conv_id, c.turn, k.reply_to FROM c JOIN k ON k.conv_id = c.conv_id AND k.turn = c.thread)
  SELECT conv_id, turn, min(thread) AS thread FROM c GROUP BY ALL),
o AS (
  SELECT conv_id, turn, any_value(role) AS role,
         coalesce(trim(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0), ' '), '') AS own_text
  FROM m GROUP BY ALL),
q AS (SELECT conv_id, turn, count(*) AS n_quotes FROM n WHERE level > 0 AND part = 0 AND unit <> '' GROUP BY ALL)
SELECT conv_id, turn, role, own_text, coalesce(n_quotes, 0) AS n_quotes, coalesce(reply_to, -1) AS reply_to,
       coalesce(thread, turn) AS thread,
       (dense_rank() OVER (PARTITION BY conv_id, coalesce(thread, turn) ORDER BY turn))::BIGINT - 1 AS position,
       '<|' || coalesce(role, '') || '|>' || chr(10) || own_text || chr(10) AS formatted
FROM o LEFT JOIN q USING (conv_id, turn) LEFT JOIN k USING (conv_id, turn) LEFT JOIN t USING (conv_id, turn)
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"), simhash.hex_of(F.col("fingerprint")).alias("fingerprint"), "component_id"
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(table(spark, sf_dir, "documents"), carry=["doc_id"])
    named = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    listed = lambda spans: F.array_join(F.transform(spans, named), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "row.doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(lowered(text_of("text")), 256))
    found = exact.exact_groups(docs, carry=["doc_id", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = f"""
WITH t AS (SELECT doc_id, sha256({UPPER_SQL}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM t JOIN g USING (text_sha256)
"""


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, source, md5(doc_id::VARCHAR) AS key,
         len(regexp_extract_all(coalesce(text, ''), {WORD_SQL})) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s),
b AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights,
         coalesce(sum(3 * source_size) OVER f, 0)::BIGINT AS capped, coalesce(sum(weight) OVER f, 0)::BIGINT AS passed
  FROM w WINDOW f AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(source_size * 3e0,
         max((total - capped)::DOUBLE / (weights - passed)) OVER () * weight) AS target FROM b),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
r AS (
  SELECT d.*, e.source_size, e.target, e.epochs, round(e.target)::BIGINT - e.epochs * e.source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + least(greatest(rest - before, 0), size))::BIGINT AS taken
FROM r
"""

def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("found.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.size("found.spans") > 0).alias("contaminated"),
    )


PLAIN_WORDS_SQL = rf"regexp_extract_all({UPPER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, {PLAIN_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {PLAIN_WORDS_SQL} AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size,
         array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT size FROM p),
g AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, n WHERE len(w) >= size)),
h AS (SELECT g.doc_id, p.item_id, g.i, g.size FROM g JOIN p USING (size, phrase)),
hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM h) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""



def op11_heap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centres, _ = centroids.cluster(table(spark, sf_dir, "embeddings"))
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = sums.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    names = [(i, name) for i, name in enumerate(centroids.named_centroids(centres))]
    named = spark.createDataFrame(names, "cluster int, name string")
    # One row for each of the 40 clusters.
    each = sums.join(named, "cluster").select(
        "cluster", "cluster_inertia", "inertia", F.sha2("name", 256).alias("centroid_sha256")
    )
    return found.withColumnRenamed("id", "vec_id").join(F.broadcast(each), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _op11_sql(k: int = centroids.CLUSTERS, rounds: int = centroids.ROUNDS) -> str:
    floor = "((s - ((s % m) + m) % m) // m)"
    parts = [
        f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor({centroids.STEPS}e0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {centroids.DIMS}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.DIMS}),
cells AS MATERIALIZED (
  SELECT r, unnest(range({centroids.DIMS})) AS i, unnest(v) AS x FROM kept),
seeds AS (
  SELECT row_number() OVER (ORDER BY name, v) - 1 AS c, v
  FROM (SELECT sha256('{centroids.SEED_PREFIX}' || coalesce(vec_id::VARCHAR, '')) AS name, v FROM kept ORDER BY name, v LIMIT {k})),
c0 AS MATERIALIZED (SELECT c, unnest(range({centroids.DIMS})) AS i, unnest(v) AS x FROM seeds)"""
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (
  SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT r, c, sum((p.x - q.x) * (p.x - q.x))::BIGINT AS d FROM cells p JOIN c{n} q USING (i) GROUP BY r, c)
  GROUP BY r)"""
        )
        if n < rounds:
            parts.append(
                f"""c{n + 1} AS MATERIALIZED (
  SELECT q.c, q.i, coalesce(t.x, q.x) AS x
  FROM c{n} q LEFT JOIN (
    SELECT c, i, {floor} AS x
    FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS m FROM cells JOIN a{n} USING (r) GROUP BY c, i)) t USING (c, i))"""
            )
    return f"""WITH {", ".join(parts)},
names AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS name FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
       sum(d) OVER ()::BIGINT AS inertia, name AS centroid_sha256
FROM kept JOIN a{rounds} USING (r) JOIN names USING (c)"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = merkle.audit(docs, merkle.tampered_leaf())
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


def _leaf_sql(text: str) -> str:
    field = lambda f: f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')"
    return "sha256(" + " || ".join(field(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP12_SQL = f"""
WITH RECURSIVE
d AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
         {_leaf_sql("replace(text, chr(10), '')")} AS emptied,
         xor(list_reduce(
           list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda held, byte: list_reduce(
             list_concat([xor(held, byte)], list_transform(range(8), lambda z: 0::BIGINT)),
             lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc
  FROM documents),
r AS (
  SELECT *, CASE WHEN crc % 2 = 0 THEN emptied ELSE leaf END AS claim,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
t AS (
  SELECT source, list(leaf ORDER BY place) AS nodes FROM r GROUP BY source),
up(source, level, nodes) AS (
  SELECT source, 0, nodes FROM t
  UNION ALL
  SELECT source, level + 1,
         list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')))
  FROM up WHERE len(nodes) > 1),
s AS (
  SELECT source, nodes[1] AS subroot, level AS depth,
         row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank
  FROM up WHERE len(nodes) = 1),
above(level, nodes) AS (
  SELECT 0, (SELECT list(subroot ORDER BY rank) FROM s)
  UNION ALL
  SELECT level + 1,
         list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')))
  FROM above WHERE len(nodes) > 1),
levels AS (
  SELECT source, level, nodes, false AS top FROM up WHERE len(nodes) > 1
  UNION ALL
  SELECT source, depth + level, above.nodes, true FROM above, s WHERE len(above.nodes) > 1),
climb(doc_id, source, level, place, claim, path) AS (
  SELECT doc_id, r.source, 0, CASE WHEN depth = 0 THEN rank ELSE place END, claim, ''
  FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT c.doc_id, c.source, c.level + 1,
         CASE WHEN c.level + 1 = s.depth THEN s.rank ELSE c.place // 3 END,
         sha256(array_to_string(l.nodes[c.place // 3 * 3 + 1:c.place], '') || c.claim
                || array_to_string(l.nodes[c.place + 2:c.place // 3 * 3 + 3], '')),
         c.path || array_to_string(l.nodes[c.place // 3 * 3 + 1:c.place], '')
                || array_to_string(l.nodes[c.place + 2:c.place // 3 * 3 + 3], '')
  FROM climb c JOIN levels l ON c.source IS NOT DISTINCT FROM l.source AND c.level = l.level
  JOIN s ON c.source IS NOT DISTINCT FROM s.source),
ends AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) AS n FROM climb),
root AS (SELECT nodes[1] AS root FROM above WHERE len(nodes) = 1)
SELECT r.doc_id, r.leaf, s.subroot, root.root, sha256(e.path) AS proof_sha256, e.claim AS folded_root,
       e.claim = root.root AS verified
FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source JOIN ends e ON r.doc_id = e.doc_id AND e.n = 1, root
"""


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = lines.drop_common_lines(docs)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_KEY_SQL = f"""translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 '{UPPER}', '{LOWER}')"""
OP13_SQL = f"""
WITH l AS (
  SELECT doc_id, i, line, {_KEY_SQL} AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
f AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCS}),
m AS (SELECT l.*, f.key IS NOT NULL AS gone FROM l LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_mix_sources": op2_mix_sources,
    "op3_ctw_score": op3_ctw_score,
    "op4_html_text": op4_html_text,
    "op5_token_rollup": op5_token_rollup,
    "op6_quality_rules": op6_quality_rules,
    "op7_quote_links": op7_quote_links,
    "op8_simhash": op8_simhash,
    "op9_secret_scan": op9_secret_scan,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_heap_clusters": op11_heap_clusters,
    "op12_merkle": op12_merkle,
    "op13_line_dedup": op13_line_dedup,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op1_decontaminate": OP1_SQL,
    "op2_mix_sources": OP2_SQL,
    "op5_token_rollup": OP5_SQL,
    "op7_quote_links": OP7_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_heap_clusters": _op11_sql(),
    "op12_merkle": OP12_SQL,
    "op13_line_dedup": OP13_SQL,
}
