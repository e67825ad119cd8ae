"""The registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.llm import (
    bpe,
    chat,
    exact_dedup,
    hard_negatives,
    language_id,
    merkle,
    mixing,
    neighbours,
    quality,
    sharding,
    simhash,
    toxicity,
    url_rules,
)
from scribelake.session import apply_settings

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def bucket(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def prepare(spark: SparkSession) -> None:
    """The library's settings; whole documents go to Python, so fewer rows at a time."""
    apply_settings(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ------------------------------------------------------------------ 3: sharding

SHARDS = 40

# the checksum is spelled out, for want of a function: a table of 256 steps, then a fold
# over the bytes of the text
OP3_SQL = f"""
WITH RECURSIVE steps AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
bytes AS (
    SELECT *, list_transform(string_split_regex(rtrim(regexp_replace(hex(content), '(..)', '\\1 ', 'g')), ' '),
                             lambda h: ('0x' || h)::BIGINT) AS codes
    FROM (SELECT doc_id, coalesce(text, '') AS content FROM documents)),
facts AS (
    SELECT doc_id, strlen(content) + 16 AS size,
           CASE WHEN content = '' THEN 0 ELSE xor(4294967295, list_reduce(list_prepend(4294967295, codes),
               lambda c, byte: xor(c >> 8, t[(xor(c, byte) & 255) + 1]))) END AS text_crc32
    FROM bytes, steps),
chain(doc_id, word, stop) AS (
    SELECT DISTINCT doc_id,
           ((doc_id::HUGEINT + CASE WHEN doc_id < 0 THEN 18446744073709551616::HUGEINT ELSE 0 END)::UHUGEINT
             * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT, 0::BIGINT
    FROM documents
    UNION ALL
    SELECT doc_id,
           (word * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT,
           trunc((stop + 1)::DOUBLE * (2147483648.0::DOUBLE / ((word // 8589934592)::DOUBLE + 1)))::BIGINT
    FROM chain WHERE stop <= {SHARDS}),
owners AS (
    SELECT doc_id, max(stop) FILTER (WHERE stop < {SHARDS}) AS shard,
           max(stop) FILTER (WHERE stop <= {SHARDS}) AS grown_shard
    FROM chain GROUP BY doc_id)
SELECT f.doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(f.doc_id::VARCHAR), f.doc_id) - 1 AS slot,
       grown_shard::INTEGER AS grown_shard
FROM facts f JOIN owners o ON f.doc_id = o.doc_id"""


@register("op3_jump_shards", OP3_SQL)
def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 40 shards by their id."""
    return sharding.assign_shards(read(spark, sf_dir, "documents"), SHARDS)


# ------------------------------------------------------------------ 4: chat

CONTROL_TEXT = r"\### Assistant: </turn> ok"


def conversations_with_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that is made of control strings."""
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = F.array(*(F.struct(F.lit(k).alias("turn"), F.lit(role).alias("role"))
                      for k, role in enumerate(("user", "assistant"))))
    made = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.explode(turns).alias("t")
    ).select("conv_id", F.col("t.turn").cast("long").alias("turn"), "t.role", F.lit(CONTROL_TEXT).alias("text"))
    return given.unionByName(made)


_HALF_SQL = (
    f"greatest(floor(({chat.BUDGET} - {chat.HISTORY_TOKENS} - coalesce(system_tokens, 0)) / 2.0), 1)"
)
# what escaping adds: one for each backslash, each </turn>, and each # between two others
_ADDED_SQL = """(len({0}) - len(replace({0}, chr(92), '')) + (len({0}) - len(replace({0}, '</turn>', ''))) // 7
    + coalesce(list_sum(list_transform(regexp_extract_all({0}, '#+'), lambda r: greatest(len(r) - 2, 0))), 0))"""

OP4_SQL = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, k, r, '{CONTROL_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
sized AS (
    SELECT *, row_number() OVER o AS place,
           len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')) AS tokens,
           6 + len(role) + {_ADDED_SQL.format("role")} + (len(role) - len(replace(role, ':', '')))
             + len(text) + {_ADDED_SQL.format("text")} + 8 AS chars
    FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
placed AS (
    SELECT *, place = 1 AND role = 'system' AS is_system,
           max(CASE WHEN place = 1 AND role = 'system' THEN tokens END) OVER p AS system_tokens,
           max(CASE WHEN place = 1 AND role = 'system' THEN chars END) OVER p AS system_chars,
           CASE WHEN place = 1 AND role = 'system' THEN 0 ELSE tokens END AS own
    FROM sized WINDOW p AS (PARTITION BY conv_id)),
summed AS (
    SELECT *, sum(own) OVER (PARTITION BY conv_id ORDER BY place) - own AS before FROM placed),
halved AS (
    SELECT *, CASE WHEN NOT is_system THEN floor(before / {_HALF_SQL}) * 2
                        + CASE WHEN own > {_HALF_SQL} THEN 1 ELSE 0 END END AS half
    FROM summed),
opened AS (
    SELECT *, coalesce(half <> lag(half) OVER (PARTITION BY conv_id ORDER BY place), false) AS opens
    FROM halved),
-- a window that a turn opens repeats the system turn and what of the two turns before is near
repeated AS (
    SELECT *, CASE WHEN opens THEN coalesce(system_chars, 0)
             + CASE WHEN before - lag(before) OVER w <= {chat.HISTORY_TOKENS} AND NOT lag(is_system) OVER w
                    THEN lag(chars) OVER w ELSE 0 END
             + CASE WHEN before - lag(before, 2) OVER w <= {chat.HISTORY_TOKENS} AND NOT lag(is_system, 2) OVER w
                    THEN lag(chars, 2) OVER w ELSE 0 END
             ELSE 0 END AS again
    FROM opened WINDOW w AS (PARTITION BY conv_id ORDER BY place))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars + again)::BIGINT AS formatted_chars
FROM repeated GROUP BY conv_id"""


@register("op4_chat_windows", OP4_SQL)
def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted windows of every conversation say when they are read back."""
    windows = chat.read_windows(chat.format_windows(conversations_with_control(spark, sf_dir)))
    turns = F.array_join(
        F.transform("new_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    found = windows.select(
        "conv_id",
        F.struct(
            "window",
            F.size("new_turns").cast("long").alias("n"),
            turns.alias("turns"),
            F.array_join("loss_texts", "").alias("loss"),
            F.char_length("text").cast("long").alias("chars"),
        ).alias("w"),
    )
    whole = found.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"))

    def joined(field: str) -> Column:
        return F.array_join(F.transform("ws", lambda w: w[field]), "")

    def added(field: str) -> Column:
        return F.aggregate("ws", F.lit(0).cast("long"), lambda n, w: n + w[field])

    return whole.select(
        "conv_id",
        added("n").alias("n_turns"),
        F.sha2(joined("turns").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss").cast("binary"), 256).alias("loss_sha256"),
        added("chars").alias("formatted_chars"),
    )


# ------------------------------------------------------------------ 5: exact dedup


@register(
    "op5_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the copy that stays."""
    labels = exact_dedup.label_copies(read(spark, sf_dir, "documents"))
    return labels.withColumnRenamed("digest", "text_sha256")


# ------------------------------------------------------------------ 9: mixing

MIX = {"weights": (3.0, 1.0, 2.0), "total_share": 1.5, "max_copies": 2.0, "seed": "mix"}

OP9_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS draw
    FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight
    FROM sized GROUP BY source),
filled AS (
    SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS fill,
           (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS wanted, sum(weight) OVER () AS all_weights
    FROM sources),
levels AS (
    SELECT *, row_number() OVER by_fill AS nr,
           (wanted - (sum(cap) OVER by_fill - cap)) / (all_weights - (sum(weight) OVER by_fill - weight)) AS level
    FROM filled
    WINDOW by_fill AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
targets AS (
    SELECT source, source_size,
           least(cap, coalesce(weight * (SELECT arg_min(level, nr) FROM levels WHERE level < fill), cap)) AS target
    FROM levels),
times AS (
    SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS times FROM targets),
ranked AS (
    SELECT s.*, t.source_size, t.target, floor(times)::BIGINT AS certain, times - floor(times) AS chance,
           (('0x' || substr(draw, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
    FROM sized s JOIN times t ON s.source IS NOT DISTINCT FROM t.source),
ordered AS (
    SELECT *, sum(size) OVER (PARTITION BY source
                              ORDER BY (u / (1 - u)) / nullif(chance / (1 - chance), 0), draw
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0 AS middle
    FROM ranked)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       certain + CASE WHEN chance > 0 AND middle <= target - certain * source_size THEN 1 ELSE 0 END AS copies,
       (certain + CASE WHEN chance > 0 AND middle <= target - certain * source_size THEN 1 ELSE 0 END) * size::BIGINT AS taken
FROM ordered"""


@register("op9_mix_sources", OP9_SQL)
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes every document."""
    return mixing.mix_report(read(spark, sf_dir, "documents"), **MIX)


# ------------------------------------------------------------------ 2: BPE

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@register("op2_bpe_round_trip")
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents and what they decode to, as digests."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, VOCABULARY).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.ids_text("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


# ------------------------------------------------------------------ 8: SimHash


@register("op8_simhash_near_dedup")
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and the component they belong to."""
    labels = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return labels.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


# ------------------------------------------------------------------ 6: URL rules

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

OP6_SQL = rf"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(map(str, RULES))}),
urls AS (
    SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
    FROM pages),
parts AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT page_id, coalesce(rest, '') AS rest FROM urls)),
fits AS (
    SELECT p.page_id, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) AS won
    FROM parts p JOIN rules r
      ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
    GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, won.rule AS rule, coalesce(won.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id"""


@register("op6_url_rules", OP6_SQL)
def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's URL."""
    pages = read(spark, sf_dir, "pages")
    return url_rules.judge_urls(pages, url_rules.rule_table(spark, RULES))


# ------------------------------------------------------------------ 7: language


@register("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from four fifths of them."""
    docs = read(spark, sf_dir, "documents").withColumn(
        "held_out", F.coalesce(bucket("doc_id", 5) == 0, F.lit(True))
    )
    model = language_id.fit(docs.where("NOT held_out").select("text", "lang"))
    return language_id.predict(docs.select("doc_id", "text", "held_out"), model).drop("text")


# ------------------------------------------------------------------ 10: quality


@register("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents, learned from three quarters of the labels."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, bucket("doc_id", 4) != 2)
    held_out = F.coalesce(bucket("doc_id", 4) == 2, F.lit(True)).alias("held_out")
    return quality.predict(docs.select("doc_id", held_out, "text"), model).drop("text")


# ------------------------------------------------------------------ 1: neighbours


@register("op1_hilbert_neighbours")
def op1_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    vectors = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, F.col("id") % 50 == 0, dim=64)


# ------------------------------------------------------------------ 12: Merkle manifest


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || ({value}::VARCHAR), '-')"


_LEAF_SQL = "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", "{text}"))) + ")"


def _tree_sql(leaves: str, name: str) -> str:
    """CTEs of all nodes of the trees over ``leaves`` (tree, pos, n, hash), and of what stands
    beside each node of a run."""
    return f"""
{name}_nodes(tree, level, pos, n, hash) AS (
    SELECT tree, 0, pos, n, hash FROM {leaves}
    UNION ALL
    SELECT tree, level + 1, pos // {merkle.RUN}, any_value((n + {merkle.RUN - 1}) // {merkle.RUN}),
           sha256(string_agg(hash, '' ORDER BY pos))
    FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, pos // {merkle.RUN}),
{name}_beside AS (
    SELECT tree, level, pos,
           coalesce(string_agg(hash, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(hash, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {name}_nodes WHERE n > 1
    WINDOW run AS (PARTITION BY tree, level, pos // {merkle.RUN} ORDER BY pos))"""


OP12_SQL = f"""
WITH RECURSIVE steps AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
marked AS (
    SELECT *, CASE WHEN coalesce(xor(4294967295, list_reduce(
                  list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                  lambda c, byte: xor(c >> 8, t[(xor(c, byte) & 255) + 1]))), 1) % 3 = 0
              THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
              ELSE text END AS changed
    FROM documents, steps),
digests AS (
    SELECT doc_id, lang, {_LEAF_SQL.format(text="text")} AS hash, {_LEAF_SQL.format(text="changed")} AS shown
    FROM marked),
leaves AS (
    SELECT *, row_number() OVER () AS nr, lang AS tree, count(*) OVER (PARTITION BY lang) AS n,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, hash) - 1 AS pos
    FROM digests),{_tree_sql("leaves", "low")},
subroots AS (
    SELECT 0 AS tree, tree AS lang, hash, count(*) OVER () AS n, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos
    FROM low_nodes WHERE n = 1),{_tree_sql("subroots", "high")},
above AS (
    SELECT s.lang, s.hash AS subroot, (SELECT hash FROM high_nodes WHERE n = 1) AS root, b.level, b.l, b.r
    FROM subroots s LEFT JOIN high_beside b ON b.pos = s.pos // ({merkle.RUN} ** b.level)::BIGINT),
within AS (
    SELECT e.nr, b.level, b.l, b.r
    FROM leaves e JOIN low_beside b
      ON b.tree IS NOT DISTINCT FROM e.tree AND b.pos = e.pos // ({merkle.RUN} ** b.level)::BIGINT
    UNION ALL
    SELECT e.nr, 1000 + a.level, a.l, a.r FROM leaves e JOIN above a ON a.lang IS NOT DISTINCT FROM e.lang
    WHERE a.level IS NOT NULL),
stepped AS (SELECT *, row_number() OVER (PARTITION BY nr ORDER BY level) AS step FROM within),
folds(nr, step, node) AS (
    SELECT nr, 1, shown FROM leaves
    UNION ALL
    SELECT f.nr, f.step + 1, sha256(s.l || f.node || s.r) FROM folds f JOIN stepped s USING (nr, step)),
folded AS (SELECT nr, arg_max(node, step) AS folded_root FROM folds GROUP BY nr),
proofs AS (SELECT nr, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256 FROM stepped GROUP BY nr)
SELECT e.doc_id, e.hash AS leaf, a.subroot, a.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
       f.folded_root, f.folded_root = a.root AS verified
FROM leaves e
JOIN (SELECT DISTINCT lang, subroot, root FROM above) a ON a.lang IS NOT DISTINCT FROM e.lang
JOIN folded f USING (nr) LEFT JOIN proofs p USING (nr)"""


@register("op12_merkle_manifest", OP12_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, folded from texts of which a third were lower-cased."""
    docs = read(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = F.when(
        bucket("doc_id", 3) == 0, F.translate("text", upper, upper.lower())
    ).otherwise(F.col("text"))
    return merkle.manifest(docs, presented={"text": changed})


# ------------------------------------------------------------------ 11: toxicity


@register("op11_toxic_sentences")
def op11_toxic_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents and their offending sentences, learned from four fifths
    of the labels."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, bucket("doc_id", 5) != 0)
    held_out = F.coalesce(bucket("doc_id", 5) == 0, F.lit(True)).alias("held_out")
    return toxicity.predict(docs.select("doc_id", held_out, "text"), model).drop("text")


# ------------------------------------------------------------------ 13: hard negatives

OP13_SQL = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) = 64
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       (row_number() OVER best)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 5"""


@register("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of five positives of every hundredth vector."""
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0, dim=64, label=label)
