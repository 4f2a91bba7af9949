"""Registered queries of the operators over the given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinelake.llm import (audit, bpe, chat, embeddings, linededup, merkle, mixing, rules, sharding, simhash,
                           suffixes, tokenfile, toxicity)
from brinelake.llm.common import importable, table, tokenizer_file
from brinelake.session import fresh_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@_query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


@_query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@_query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target",
                      (F.col("copies") * F.col("size")).alias("taken"), "rate")


@_query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(control).alias("text"))
    return chat.read_back(chat.formatted(rows.union(own), tokenizer_file("byte_bpe_50k.json")))


ORACLES["op4_chat"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(role || chr(0) || text, '\', '\\'), '<turn>', '\lturn>'),
                        '</turn>', '\l/turn>') AS code FROM c),
g AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             sum(length(code) - 1 + 15 + length(role) - length(replace(role, chr(10), '')))::BIGINT AS formatted_chars
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


@_query
def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op5_embeddings"] = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
      WHERE label IS NOT NULL AND e IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS seen FROM v
      UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.node = v.vec_id LEFT JOIN k ON k.a = v.vec_id
"""


@_query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), folder, tokenizer_file("word_bpe_49k.json"), end_id=1)
    read = tokenfile.read(spark, folder)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.crc32("ids").cast("long").alias("ids_crc32"))


@_query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans",
                      F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return toxicity.scored(docs, labels).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.line_deduplicated(docs, emptied=True, counts=("n_lines", "n_removed"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


ORACLES["op9_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, text FROM documents),
l AS (SELECT r, unnest(range(len(string_split(text, chr(10))))) AS k, string_split(text, chr(10)) AS ls FROM d),
s AS (SELECT r, k, ls[k + 1] AS line, row_number() OVER (PARTITION BY r ORDER BY k) AS i FROM l
      WHERE regexp_matches(ls[k + 1], '[^\x20\x09-\x0D]')),
w AS (SELECT r, i, k, line, lead(line) OVER o AS line2, lead(k) OVER o AS k2 FROM s
      WINDOW o AS (PARTITION BY r ORDER BY i)),
f AS (SELECT *, row_number() OVER (PARTITION BY line, line2 ORDER BY r, i) AS n FROM w WHERE line2 IS NOT NULL
      UNION ALL SELECT r, i, k, line, NULL, k, row_number() OVER (PARTITION BY line ORDER BY r, i) FROM w
      WHERE len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) >= 50),
g AS (SELECT DISTINCT r, unnest([k, k2]) AS k FROM f WHERE n > 1),
t AS (SELECT l.r, string_agg(ls[l.k + 1], chr(10) ORDER BY l.k) FILTER (WHERE g.k IS NULL) AS text,
             count(*) AS n_lines, count(g.k) AS n_removed
      FROM l LEFT JOIN g ON l.r = g.r AND l.k = g.k GROUP BY l.r)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(t.text, '')) END AS text_sha256
FROM d LEFT JOIN t USING (r)
"""


@_query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = F.col("ledger")
    return rules.ledger(docs).select(
        "doc_id", *[m[c].alias(c) for c in
                    ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~rules.passes(m["failures"], "base")).alias("base_failed"),
        rules.passes(m["failures"]).alias("kept"), m["failures"].alias("failures"))


ORACLES["op10_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
      FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words
      FROM (SELECT r, i, unnest([0, 1, 2]) AS k FROM h WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
             length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_ex
      FROM w LEFT JOIN p USING (r)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
      + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
      + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
      + CASE WHEN n_dup_lines > 1 AND 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
      + CASE WHEN 10 * n_ex > 5 * n_words THEN 16 ELSE 0 END)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures
FROM f
"""


@_query
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "shards")
    sharding.write(table(spark, sf_dir, "documents"), folder, shards=16)
    row = F.col("row")
    data = F.encode(F.coalesce(row["text"], F.lit("")), "UTF-8")
    return sharding.read(spark, folder).select(
        row["doc_id"].alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@_query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    proved = merkle.proved(docs, ["doc_id", "source", "lang", "n_chars", "text"], tree="lang", order="doc_id",
                           instead={"text": F.when(chosen, lower).otherwise(F.col("text"))})
    return proved.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _merkle_sql(levels: int = 9, top: int = 4) -> str:
    """The tree with its levels written out: enough for 8 to the power of ``levels`` leaves a language
    and of ``top`` languages."""
    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}) || ':' || {c} END"

    code = " || ".join(field(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "{t}"))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),"
           " lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),"
           " lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)")
    out = [f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, sha256({code.format(t="text")}) AS leaf,
 sha256({code.format(t=f"translate(text, '{letters}', '{letters.lower()}')")}) AS changed, {crc} % 3 = 0 AS chosen
 FROM documents),
p0 AS (SELECT r, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
 leaf AS h, CASE WHEN chosen THEN changed ELSE leaf END AS f, '' AS proof FROM d),
n0 AS (SELECT lang, i, h FROM p0)"""]

    def climb(k: int, p: str, n: str, key: str) -> None:
        # one level: runs of eight where a tree has more than one node, as it is where it has one
        out.append(f"""{n}r{k} AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS of FROM {n}{k}),
{n}{k + 1} AS (SELECT {key}, CASE WHEN of > 1 THEN i // 8 ELSE i END AS i,
 CASE WHEN any_value(of) > 1 THEN sha256(string_agg(h, '' ORDER BY {n}r{k}.i)) ELSE any_value(h) END AS h
 FROM {n}r{k} GROUP BY {key}, of, CASE WHEN of > 1 THEN i // 8 ELSE {n}r{k}.i END),
{n}s{k} AS (SELECT {key}, i // 8 AS up, list(h ORDER BY i) AS hs FROM {n}r{k} WHERE of > 1 GROUP BY {key}, up),
{p}{k + 1} AS (SELECT r, p.lang, CASE WHEN hs IS NULL THEN p.i ELSE p.i // 8 END AS i, p.h,
 CASE WHEN hs IS NULL THEN f ELSE sha256(array_to_string(hs[:p.i % 8], '') || f || array_to_string(hs[p.i % 8 + 2:], '')) END AS f,
 proof || CASE WHEN hs IS NULL THEN '' ELSE array_to_string(hs[:p.i % 8], '') || array_to_string(hs[p.i % 8 + 2:], '') END AS proof
 FROM {p}{k} p LEFT JOIN {n}s{k} s ON {" AND ".join(f"p.{c} IS NOT DISTINCT FROM s.{c}" for c in [key])} AND p.i // 8 = s.up)""")

    for k in range(levels):
        climb(k, "p", "n", "lang")
    out.append(f"""sub AS (SELECT lang, h AS subroot FROM n{levels}),
m0 AS (SELECT true AS one, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, subroot AS h, lang FROM sub),
q0 AS (SELECT r, true AS lang, m0.i, p.h, f, proof FROM p{levels} p JOIN m0 ON p.lang IS NOT DISTINCT FROM m0.lang),
t0 AS (SELECT true AS lang, i, h FROM m0)""")
    for k in range(top):
        climb(k, "q", "t", "lang")
    out.append(f"""e AS (SELECT q.r, q.f, q.proof, t.h AS root FROM q{top} q, t{top} t)
SELECT d.doc_id, d.leaf, sub.subroot, e.root, sha256(e.proof) AS proof_sha256, e.f AS folded_root, e.f = e.root AS verified
FROM d JOIN e ON d.r = e.r JOIN sub ON d.lang IS NOT DISTINCT FROM sub.lang""")
    return ",\n".join(out)


ORACLES["op12_merkle"] = _merkle_sql()


@_query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op13_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             min(doc_id) OVER (PARTITION BY t) AS first FROM d),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             [CASE WHEN len(ws) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' END,
              CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 'C' END,
              CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > first THEN 'E' END] AS fails
      FROM w LEFT JOIN g USING (doc_id)),
c AS (SELECT part, list_filter(fails, lambda x: x IS NOT NULL) AS fails, count(*) AS n,
             count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS earlier
      FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step)),
r AS (SELECT c.part, s.filter_order, s.step, s.x, c.n, c.good, c.toxic, list_contains(c.fails, s.x) AS here,
             len(list_filter(c.fails, lambda y: contains(s.earlier, y))) > 0 AS gone, c.fails = [s.x] AS alone FROM c, s),
a AS (SELECT part, filter_order, step, any_value(x) AS x,
             coalesce(sum(n) FILTER (NOT here AND NOT gone), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (here AND NOT gone), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (here AND gone), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (here AND NOT gone), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (here AND NOT gone), 0)::BIGINT AS toxic_lost
      FROM r GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM a
"""


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
