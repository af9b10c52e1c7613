"""The registered ``opN_*`` queries: each applies its operator to the whole of its table with
production parameters. ``SQL`` holds DuckDB statements for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import (
    chat_rotation,
    decontaminate,
    main_text,
    merkle_manifest,
    packing,
    perplexity,
    quality_trees,
    recurrent_lm,
    secret_scan,
    simhash,
    token_alignment,
    toxicity,
    url_cascade,
)
from sitelens.llm.common import ascii_lower, prepare, read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return deco


@query(
    "op1_perspective_rotation",
    """
    WITH said AS (SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS text FROM conversations),
    people AS (SELECT DISTINCT conv_id AS of, speaker AS perspective FROM said
               WHERE speaker IS NOT NULL AND speaker <> 'system'),
    cast_ AS (
      SELECT conv_id, perspective, turn, speaker, text,
             CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
             CASE WHEN coalesce(speaker, '') NOT IN ('system', perspective) THEN coalesce(speaker, 'unknown') END AS name
      FROM said JOIN people ON conv_id IS NOT DISTINCT FROM of),
    headed AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS header FROM cast_)
    SELECT conv_id, perspective, turn, speaker, role, name, header || text || '<|im_end|>' || chr(10) AS rendered,
           length(header)::BIGINT AS mask_start,
           (CASE WHEN role = 'assistant' THEN length(header) + length(text) + 10 ELSE length(header) END)::BIGINT AS mask_end,
           role = 'assistant' AS loss
    FROM headed
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner: the document's source; repository: its source and language."""
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "text", "source", F.concat_ws("/", "source", "lang").alias("repo")
    )
    found = secret_scan.scan(docs, "text", owner="source", repo="repo", keep_text=False)
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "mixed")
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["example"])).cast("long").alias("n_examples"),
        F.size(F.filter("spans", lambda s: ~s["example"])).cast("long").alias("n_live"),
    )


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of 3 words, at most 2 differing bits."""
    docs = simhash.link(read_table(spark, sf_dir, "documents"), "doc_id", "text", words=3, radius=2)
    return docs.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query(
    "op4_decontamination",
    """
    WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'),
                 lambda x: x <> '') AS w, row_number() OVER () AS rid FROM documents),
    b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'),
                 lambda x: x <> '') AS w FROM benchmark),
    phrases AS (SELECT item_id, unnest(list_transform(range(greatest(len(w) - 10, 0) + 1), lambda i: w[i + 1:i + 10])) AS p
                FROM b WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT len(p) AS n FROM phrases),
    at_ AS (SELECT rid, n, unnest(range(len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n),
    found AS (SELECT DISTINCT at_.rid, at_.n, at_.s, item_id FROM at_ JOIN d ON d.rid = at_.rid
              JOIN phrases ON phrases.p = d.w[at_.s + 1:at_.s + at_.n]),
    hit AS (SELECT rid, count(DISTINCT pos) AS n_hit
            FROM (SELECT rid, unnest(range(s, s + n)) AS pos FROM found) GROUP BY rid),
    named AS (SELECT rid, count(DISTINCT item_id) AS n_items,
                     string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM found GROUP BY rid),
    -- proximity: places by the rarest two terms at which another of the rarest three is close, then all terms counted
    words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
    win AS (SELECT p, row_number() OVER () AS wid FROM (SELECT DISTINCT p FROM phrases)),
    freq AS (SELECT word, count(*) AS freq FROM words GROUP BY word),
    ranked AS (SELECT wid, len(p) AS n, t.off, t.word, coalesce(freq, 0) AS freq,
                      row_number() OVER (PARTITION BY wid ORDER BY coalesce(freq, 0) = 0, freq, t.off) AS rank
               FROM (SELECT wid, p, unnest(p) AS word, generate_subscripts(p, 1) - 1 AS off FROM win) t LEFT JOIN freq USING (word)),
    cand AS (SELECT rid, wid, n, rank, pos - off AS start FROM ranked JOIN words USING (word) WHERE rank <= 2),
    place AS (SELECT DISTINCT c.rid, c.wid, c.n, c.start FROM cand c
              LEFT JOIN ranked r ON r.wid = c.wid AND r.rank <= 3 AND r.rank > c.rank
              LEFT JOIN words x ON x.rid = c.rid AND x.word = r.word AND abs(x.pos - (c.start + r.off)) <= 3
              WHERE x.pos IS NOT NULL OR (c.n = 1 AND c.rank = 1)),
    near AS (SELECT p.rid, p.wid, p.n, p.start, count(DISTINCT r.off) AS terms FROM place p JOIN ranked r USING (wid)
             JOIN words x ON x.rid = p.rid AND x.word = r.word AND abs(x.pos - (p.start + r.off)) <= 3
             GROUP BY ALL HAVING count(DISTINCT r.off) >= p.n - 2 AND count(DISTINCT r.off) >= least(p.n, 2)),
    exactly AS (SELECT DISTINCT rid, wid FROM found JOIN phrases USING (item_id) JOIN win USING (p)
                JOIN d USING (rid) WHERE d.w[found.s + 1:found.s + found.n] = p),
    only_near AS (SELECT DISTINCT rid, wid FROM near ANTI JOIN exactly USING (rid, wid)),
    close AS (SELECT rid, count(DISTINCT wid) AS n_near, count(DISTINCT item_id) AS n_near_items,
                     string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS near_items
              FROM only_near JOIN win USING (wid) JOIN phrases USING (p) GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near,
           coalesce(n_near_items, 0)::BIGINT AS n_near_items, sha256(coalesce(near_items, '')) AS near_sha256
    FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid) LEFT JOIN close USING (rid)
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "n_near",
        F.size("near_items").cast("long").alias("n_near_items"),
        F.sha2(F.array_join("near_items", ","), 256).alias("near_sha256"),
    )


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_trees.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op6_perplexity_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = perplexity.judge(read_table(spark, sf_dir, "documents"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *base, "base_failed", "kept", "log_ppl", "low", "high")


#: verdict, host, path
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query(
    "op7_url_cascade",
    r"""
    WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    u AS (SELECT page_id, row_number() OVER () AS rid,
                 translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
    rules(v, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                              ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
    best AS (SELECT rid, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
             FROM u JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY rid)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (rid)
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_cascade.judge(pages, "url", URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    pieces = packing.tokenize(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)
    return packing.pack(pieces, capacity=4096).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query("op9_main_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(read_table(spark, sf_dir, "pages"))


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op11_recurrent_lm")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    return recurrent_lm.report(read_table(spark, sf_dir, "documents"), remainder == 2)


@query(
    "op12_merkle_manifest",
    """
    WITH RECURSIVE raw AS (
      SELECT row_number() OVER () AS rid, *,
             coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
             || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
             -- crc32: each byte is mixed in, then eight shifts (marked by -1) follow
             list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
               lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS mixed
      FROM documents),
    hashed AS (
      SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
             sha256(head || coalesce(CASE WHEN xor(mixed, 4294967295) % 5 = 0 THEN strlen(lowered)::VARCHAR || ':' || lowered
                                     ELSE strlen(text)::VARCHAR || ':' || text END, '-')) AS given FROM raw),
    placed AS (
      SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
             count(*) OVER (PARTITION BY source) AS size FROM hashed),
    nodes(grp, level, idx, size, digest) AS (
      SELECT grp, 0, idx, size, leaf FROM placed
      UNION ALL
      SELECT grp, level + 1, idx // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes
      WHERE size > 1 GROUP BY grp, level, idx // 16, size),
    runs AS (SELECT grp, level, idx // 16 AS parent, list(digest ORDER BY idx) AS run FROM nodes WHERE size > 1 GROUP BY ALL),
    subroots AS (SELECT grp, level, digest, count(*) OVER () AS n FROM nodes WHERE size = 1),
    top_nodes(level, idx, size, digest) AS (
      SELECT 0, grp, n, digest FROM subroots
      UNION ALL
      SELECT level + 1, idx // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM top_nodes
      WHERE size > 1 GROUP BY level, idx // 16, size),
    top_runs AS (SELECT level, idx // 16 AS parent, list(digest ORDER BY idx) AS run FROM top_nodes WHERE size > 1 GROUP BY ALL),
    climb(rid, grp, level, idx, cur, proof) AS (
      SELECT rid, grp, 0, idx, given, '' FROM placed
      UNION ALL
      SELECT rid, c.grp, c.level + 1, idx // 16,
             sha256(array_to_string(list_concat(list_append(run[1:idx % 16], cur), run[idx % 16 + 2:]), '')),
             proof || array_to_string(list_concat(run[1:idx % 16], run[idx % 16 + 2:]), '')
      FROM climb c JOIN runs r ON r.grp = c.grp AND r.level = c.level AND r.parent = c.idx // 16),
    top_climb(rid, level, idx, cur, proof) AS (
      SELECT rid, 0, grp, cur, proof FROM climb JOIN subroots USING (grp, level)
      UNION ALL
      SELECT rid, c.level + 1, idx // 16,
             sha256(array_to_string(list_concat(list_append(run[1:idx % 16], cur), run[idx % 16 + 2:]), '')),
             proof || array_to_string(list_concat(run[1:idx % 16], run[idx % 16 + 2:]), '')
      FROM top_climb c JOIN top_runs r ON r.level = c.level AND r.parent = c.idx // 16),
    roots AS (SELECT level, digest AS root FROM top_nodes WHERE size = 1)
    SELECT doc_id, leaf, digest AS subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
    FROM top_climb JOIN roots USING (level) JOIN placed USING (rid) JOIN subroots USING (grp)
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id's crc32 5 divides come back with their text's A-Z lower-cased; a null id has no crc32."""
    docs = read_table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = merkle_manifest.leaf_digest(*fields[:-1], ascii_lower(F.col("text")))
    rows = docs.select("doc_id", "source", merkle_manifest.leaf_digest(*fields).alias("leaf"), F.when(tampered, lowered).alias("given"))
    rows = rows.withColumn("given", F.coalesce("given", "leaf"))
    return merkle_manifest.manifest(rows, "doc_id", "source", "leaf", "given")


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return token_alignment.report(docs, *paths).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
