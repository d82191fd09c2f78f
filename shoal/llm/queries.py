"""The registered queries of the subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, embedding_dedup, line_dedup, merkle, mixing, ngram_join, quality, sharding, token_counts, url_filter, warc, whitening
from .common import new_path

TOKENIZER = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = TOKENIZER) -> bytes:
    """A public vocabulary file (half a megabyte), read by the driver and sent to the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("kept_bytes"),
                       F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("kept_crc32"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer())
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(read(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), url_filter.default_rules())


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.read_captures(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def domain_of(source: Column) -> Column:
    """The tables have no domain: sources fall into four by the remainder of the number in their names."""
    return F.concat(F.lit("domain"), F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 4").cast("string"), F.lit("")))


#: Weights of the mixture query: by domain, language and source; others weigh 1.
MIX_WEIGHTS = ({"domain0": 3, "domain1": 2}, {"en": 4, "de": 2, "fr": 2}, {"src0": 2, "src5": 3})


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), domain_of(F.col("source")), 1.0, MIX_WEIGHTS)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings"))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    at = sharding.shard(docs, 24, ["size"], ["lang", "source"], "doc_id")
    return at.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fields = lambda n_chars: merkle.leaf_of([F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")])
    # One more character is claimed where 7 divides the checksum of the id.
    claimed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, fields(F.col("n_chars").cast("decimal(37,0)") + 1)).otherwise(fields(F.col("n_chars")))
    tree = merkle.manifest(docs, fields(F.col("n_chars")), "lang", "doc_id", [F.col("doc_id"), claimed.alias("claimed")])
    out = tree.withColumn("folded_root", merkle.fold(F.col("claimed"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    models = whitening.fit(vectors, "embedding")
    rows = whitening.whiten(vectors, models, "vec_id", "embedding", 8)
    shares = F.create_map(*[x for width, m in models.items() for x in (F.lit(width), F.array(*[F.lit(float(e)) for e in m.explained[:8]]))]) if models else F.expr("cast(map() as map<int, array<double>>)")
    each = rows.select("vec_id", "width", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.element_at(shares, F.col("width"))[F.col("at")].alias("explained"),
                       F.lit(whitening.identity_error(rows)).alias("identity_error"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = tokenizer("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    back = byte_bpe.decode(encoded, ranks, public_tokenizers.PATTERN)
    return back.select("doc_id", "n_tokens", F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_line_dedup, op2_token_counts, op3_decontamination, op4_ngram_join, op5_url_filter, op6_warc, op7_source_mix, op8_embedding_dedup, op9_hilbert_shards, op10_quality,
        op11_merkle_manifest, op12_whitening, op13_byte_bpe)}


OP5_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), fit AS (
  SELECT *, ends_with('.' || host, '.net') AND starts_with(path, '/') AS net, ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') AS net_en,
    ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') AS com_de, ends_with('.' || host, '.org') AND starts_with(path, '/fr/') AS org_fr FROM parts
)
SELECT page_id, host, path,
  CASE WHEN net_en THEN 'example.net/en/' WHEN com_de THEN 'example.com/de/' WHEN org_fr THEN 'org/fr/' WHEN net THEN 'net/' END AS rule,
  CASE WHEN net_en THEN 'allow' WHEN com_de THEN 'block' WHEN org_fr THEN 'allow' WHEN net THEN 'block'
    WHEN (strpos(host, 'cheap-pills') > 0 OR strpos(host, 'casino') > 0) AND path <> '' THEN 'block'
    WHEN regexp_matches(host || path, '[.](exe|zip|jpg|png)$') THEN 'block' ELSE 'allow' END AS verdict
FROM fit
"""


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs WHERE 100 * shared >= 75 * (na + nb - shared)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(doc_id) OVER (PARTITION BY CASE WHEN len(s) = 0 THEN [CAST(doc_id AS VARCHAR)] ELSE list_sort(s) END, len(s) = 0) AS class_id, component_id
FROM sets JOIN least USING (doc_id)
"""

OP6_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM q
"""

OP11_SQL = """
WITH RECURSIVE said AS (
  SELECT doc_id, lang, n_chars, coalesce(CAST(strlen(CAST(doc_id AS VARCHAR)) AS VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce([4294967295] || list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),
      lambda c, b: list_reduce([xor(c, b)] || range(8), lambda d, i: xor(d >> 1, CASE WHEN d % 2 = 1 THEN 3988292384 ELSE 0 END))) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS other, xor(crc, 4294967295) % 7 = 0 AS touched FROM said
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos FROM leaves
), lower_ AS (
  SELECT lang, 0 AS lev, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM placed
  UNION ALL
  SELECT lang, lev + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM lower_ WHERE n > 1 GROUP BY lang, lev, pos // 2
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM lower_ WHERE n = 1
), upper_ AS (
  SELECT 0 AS lev, pos, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT lev + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM upper_ WHERE n > 1 GROUP BY lev, pos // 2
), fold_low AS (
  SELECT doc_id, lang, leaf, pos AS at, 0 AS lev, pos, CASE WHEN touched THEN other ELSE leaf END AS h, '' AS proof FROM placed
  UNION ALL
  SELECT f.doc_id, f.lang, f.leaf, f.at, f.lev + 1, f.pos // 2, sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), f.proof || coalesce(s.h, '')
  FROM fold_low f JOIN lower_ own ON own.lang IS NOT DISTINCT FROM f.lang AND own.lev = f.lev AND own.pos = f.pos AND own.n > 1
  LEFT JOIN lower_ s ON s.lang IS NOT DISTINCT FROM f.lang AND s.lev = f.lev AND s.pos = xor(f.pos, 1)
), fold_up AS (
  SELECT f.doc_id, f.leaf, s.subroot, f.h, f.proof, 0 AS lev, s.pos FROM fold_low f JOIN lower_ own ON own.lang IS NOT DISTINCT FROM f.lang AND own.lev = f.lev AND own.pos = f.pos AND own.n = 1
  JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang
  UNION ALL
  SELECT f.doc_id, f.leaf, f.subroot, sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), f.proof || coalesce(s.h, ''), f.lev + 1, f.pos // 2
  FROM fold_up f JOIN upper_ own ON own.lev = f.lev AND own.pos = f.pos AND own.n > 1 LEFT JOIN upper_ s ON s.lev = f.lev AND s.pos = xor(f.pos, 1)
)
SELECT f.doc_id, f.leaf, f.subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM fold_up f JOIN upper_ r ON r.n = 1 AND r.lev = f.lev
"""


def _level(k: int, keys: list[str], given: str, weights: dict[str, int]) -> str:
    """CTEs that share each parent's budget among the children of level k."""
    on, up = ", ".join(keys), keys[:-1]
    weight = " ".join(["CASE", keys[-1], *[f"WHEN '{n}' THEN {w}" for n, w in weights.items()], "ELSE 1 END"])
    part = f"PARTITION BY {', '.join(up)}" if up else ""
    order = f"{part} ORDER BY cap / w, {keys[-1]}"
    joined = f"JOIN b{k - 1} USING ({', '.join(up)})" if up else ""
    return f"""
n{k} AS (SELECT {on}, CAST(sum(cap) AS BIGINT) AS cap, CAST({weight} AS DOUBLE) AS w FROM leaves GROUP BY {on}),
g{k} AS (SELECT {on}, cap, w, {given} AS given FROM n{k} {joined}),
f{k} AS (SELECT *, greatest(0, given - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lft, sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl FROM g{k}),
e{k} AS (SELECT *, cap * wl <= lft * w AS sated FROM f{k}),
a{k} AS (SELECT *, first_value(CASE WHEN NOT sated THEN {{'lft': lft, 'wl': wl}} END IGNORE NULLS) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_open FROM e{k}),
b{k} AS (SELECT {on}, CASE WHEN sated THEN cap ELSE least(CAST(floor(first_open.lft * w / first_open.wl) AS BIGINT), cap) END AS budget FROM a{k}),"""


OP7_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, 'domain' || coalesce(CAST(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4 AS VARCHAR), '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS n_tokens FROM documents
), leaves AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(4 * sum(n_tokens) AS BIGINT) AS cap FROM d GROUP BY ALL
),"""
    + _level(1, ["domain"], "(SELECT CAST(least(sum(tokens), sum(cap)) AS BIGINT) FROM leaves)", MIX_WEIGHTS[0])
    + _level(2, ["domain", "lang"], "budget", MIX_WEIGHTS[1])
    + _level(3, ["domain", "lang", "source"], "budget", MIX_WEIGHTS[2])
    + """
plan AS (
  SELECT l.*, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole FROM leaves l JOIN b3 USING (domain, lang, source)
), r AS (
  SELECT doc_id, domain, lang, source, n_tokens, tokens AS leaf_tokens, budget AS leaf_budget, whole, budget - whole * tokens AS rest FROM d JOIN plan USING (domain, lang, source)
), run AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('0|' || whole || '|' || doc_id), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM r
)
SELECT doc_id, domain, lang, source, n_tokens, leaf_tokens, leaf_budget, unnest(range(whole)) AS epoch FROM r
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, leaf_tokens, leaf_budget, whole FROM run WHERE rest > 0 AND upto <= rest
"""
)

OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN n USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_join": OP4_SQL, "op5_url_filter": OP5_SQL, "op6_warc": OP6_SQL, "op7_source_mix": OP7_SQL, "op8_embedding_dedup": OP8_SQL,
            "op11_merkle_manifest": OP11_SQL}
