"""Registered queries of the llm operators and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.core.session import scratch_path, tune
from cadenza.llm import (bit_planes, exact_dedup, jaccard_join, line_rules, max_score, mixing, packing, pii, prefix_trie, repeats, secrets, token_file,
                         url_filter)

# Bytes of a batch that Spark hands to Python; rows hold whole texts or file segments.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}

# Fixed values of the URL contract.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

# The mixture: domains by weight, languages within a domain, sources alike.
DOMAINS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGUAGES = {"en": 5, "fr": 2, "de": 2, "es": 1}
WEIGHTS = {(d,): w for d, w in DOMAINS.items()} | {(d, lang): w for d in DOMAINS for lang, w in LANGUAGES.items()}
SEED, EPOCHS, SHARE = 17, 2, (3, 4)
PACK_END, FILE_END = 1, 0
CENTROIDS, ROUNDS, CENTROID_SEED = 8, 10, 3
BEST, QUERY_EVERY = 20, 20


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def prepare(spark: SparkSession) -> SparkSession:
    tune(spark)
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def levels() -> dict:
    number = F.regexp_extract(F.col("source"), "[0-9]+", 0).try_cast("int")
    return {"domain": F.concat(F.lit("d"), (number % 4).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = line_rules.line_quality(table(spark, sf_dir, "documents"), with_text=False)
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), PACK_END, with_ids=False)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    taken = mixing.mix(docs, levels(), mixing.word_count(F.col("text")), WEIGHTS, SEED, EPOCHS, budget_share=SHARE)
    return taken.select("doc_id", *(c.alias(n) for n, c in levels().items()), F.col("_epoch").alias("epoch"), F.col("_tokens").alias("n_tokens"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "token-file")
    token_file.write_token_file(docs, path, tokenizer_path("byte_bpe_50k.json"), FILE_END)
    return token_file.read_token_file(spark, path)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    seen = secrets.scan_versions(docs, scratch_path(spark, "ledger"))
    listed = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["rule"], s["span_start"], s["span_end"])), ",")
    counts = [F.expr(f"cast(size(filter(found, s -> s.rule = '{r.name}')) as long)").alias(f"n_{r.name}") for r in secrets.RULES]
    return seen.select(F.col("path").alias("doc_id"), *counts, F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


def secrets_two_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run over a ledger: every document as it was scanned before, and a newer version of it, of which alone the text is read."""
    docs, ledger = table(spark, sf_dir, "documents"), scratch_path(spark, "ledger")
    name = lambda v: F.concat(F.col("doc_id").cast("string"), F.lit(f":{v}")).alias("path")
    first = docs.select(name(1), "text")
    secrets.scan_versions(first, ledger, "path")
    newer = docs.select(name(2), F.concat(F.coalesce("text", F.lit("")), F.lit("\nsecret="), F.md5(F.col("doc_id").cast("string"))).alias("text"))
    seen = secrets.scan_versions(first.unionByName(newer), ledger, "path")
    counts = [F.expr(f"cast(size(filter(found, s -> s.rule = '{r.name}')) as long)").alias(f"n_{r.name}") for r in secrets.RULES]
    return seen.select(F.col("path").alias("doc_id"), *counts)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_planes.cluster_report(table(spark, sf_dir, "embeddings"), CENTROIDS, ROUNDS, CENTROID_SEED)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_score.max_score(table(spark, sf_dir, "embeddings"), BEST, QUERY_EVERY)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, str(sf_dir).rstrip("/"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_line_rules, op3_jaccard_join, op4_url_aliases, op5_packing, op6_mixing, op7_token_file,
                                   op8_repeats, op9_secrets, op10_exact_dedup, op11_bit_planes, op12_prefix_trie, op13_max_score, secrets_two_versions, pipeline)}


# ---------------------------------------------------------------- SQL

_HEX = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _share_sql(level: str, parent: str, above: str) -> str:
    """Common tables that share the budgets of ``above`` among the children at one level."""
    return f"""
{level}_n AS (SELECT {parent} AS parent, {level}_p AS node, sum(cap)::HUGEINT AS cap FROM leaf_paths GROUP BY ALL),
{level}_w AS (SELECT n.*, coalesce(w.weight, 1)::HUGEINT AS weight, b.budget::HUGEINT AS budget FROM {level}_n n JOIN {above} b ON b.node = n.parent
  LEFT JOIN weights w ON w.node = n.node),
{level}_o AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before_,
    (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS open_
  FROM {level}_w WHERE weight > 0 AND cap > 0 WINDOW o AS (PARTITION BY parent ORDER BY cap / weight, node)),
{level}_f AS (SELECT *, cap * open_ <= weight * (budget - before_) AS full_ FROM {level}_o),
{level}_s AS (SELECT *, (budget - coalesce(sum(cap) FILTER (full_) OVER (PARTITION BY parent), 0))::HUGEINT AS left_,
    (sum(weight) FILTER (NOT full_) OVER (PARTITION BY parent))::HUGEINT AS sum_ FROM {level}_f),
{level}_r AS (SELECT *, CASE WHEN full_ THEN cap ELSE weight * left_ // sum_ END AS floor_ FROM {level}_s),
{level}_b AS (SELECT node, floor_ + CASE WHEN NOT full_ AND row_number() OVER (PARTITION BY parent, full_ ORDER BY node)
    <= left_ - sum(floor_) FILTER (NOT full_) OVER (PARTITION BY parent) THEN 1 ELSE 0 END AS budget FROM {level}_r)"""


def _mixing_sql() -> str:
    weights = ", ".join(f"('{'/'.join(k)}', {v})" for k, v in WEIGHTS.items())
    num, den = SHARE
    return f"""WITH docs AS (SELECT doc_id, 'd' || (regexp_extract(source, '[0-9]+')::INT % 4) AS domain, lang, source, len({_WORDS}) AS n FROM documents),
weights(node, weight) AS (VALUES {weights}),
leaves AS (SELECT domain, lang, source, sum(n)::BIGINT AS total FROM docs WHERE n > 0 GROUP BY ALL),
leaf_paths AS (SELECT *, total * {EPOCHS} AS cap, domain AS domain_p, domain || '/' || lang AS lang_p, domain || '/' || lang || '/' || source AS source_p FROM leaves),
root_b AS (SELECT '' AS node, least(sum(total)::HUGEINT * {num} // {den}, sum(cap)) AS budget FROM leaf_paths),
{_share_sql("domain", "''", "root_b")},
{_share_sql("lang", "domain_p", "domain_b")},
{_share_sql("source", "lang_p", "lang_b")},
plan AS (SELECT l.*, (b.budget // total)::BIGINT AS whole, (b.budget % total)::BIGINT AS rest FROM leaf_paths l JOIN source_b b ON b.node = l.source_p),
ordered AS (SELECT d.*, p.whole, p.rest, sum(n) OVER (PARTITION BY p.source_p ORDER BY {_HEX.format(f"'{SEED}:' || p.whole || ':' || doc_id")}, doc_id::VARCHAR
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM docs d JOIN plan p ON p.domain = d.domain AND p.lang = d.lang AND p.source = d.source WHERE d.n > 0)
SELECT doc_id, domain, lang, source, unnest(range(0, whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)) AS epoch, n AS n_tokens FROM ordered"""


def _jaccard_sql() -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair WHERE 100 * o >= 80 * (nx + ny - o)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.y) AS component_id FROM s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.s)"""


def _urls_sql() -> str:
    rules = ", ".join(f"('{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{a}')" for r, a in URL_RULES)
    host = lambda u: f"CASE WHEN instr({u}, '://') > 0 THEN lower(regexp_extract(substr({u}, instr({u}, '://') + 3), '^[^/?#]*')) ELSE '' END"
    path = lambda u: f"CASE WHEN instr({u}, '://') > 0 THEN regexp_extract(substr({u}, instr({u}, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"
    node = lambda u: f"lower(regexp_extract({u}, '^[^/?#]*://[^/?#]*')) || regexp_replace(regexp_replace({u}, '^[^/?#]*://[^/?#]*', ''), '#.*$', '', 's')"
    best = lambda what, t: f"(SELECT r.{what} FROM rules r WHERE ({t}.host = r.rhost OR ends_with({t}.host, '.' || r.rhost)) AND starts_with({t}.path, r.rpath) ORDER BY length(r.rule) DESC, r.rule LIMIT 1)"
    # A reference is cut into scheme, authority, path and query and put together with the parts of the page that it lacks.
    return f"""WITH RECURSIVE rules(rule, rhost, rpath, action) AS (VALUES {rules}),
t AS (SELECT page_id, {host("url")} AS host, {path("url")} AS path, CASE WHEN instr(url, '://') > 0 THEN {node("url")} END AS key FROM pages),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\s[^>]*>')) AS tag FROM pages WHERE instr(url, '://') > 0),
refs AS (SELECT url, replace(CASE WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(tag, '(?i)\\srel\\s*=\\s*["'']?\\s*canonical["''\\s/>]') THEN regexp_extract(tag, '(?i)\\shref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1)
  WHEN regexp_matches(tag, '(?i)^<meta') AND regexp_matches(tag, '(?i)\\shttp-equiv\\s*=\\s*["'']?\\s*refresh["''\\s/>]') THEN regexp_extract(tag, '(?i)[\\s;,"''=]url\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1) ELSE '' END, '&amp;', '&') AS ref FROM tags),
cut AS (SELECT url, regexp_extract(ref, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme, ref, regexp_extract(ref, '^[^?#]*') AS rpath, regexp_extract(ref, '\\?[^#]*') AS rquery,
  regexp_extract(url, '^[^/?#]*://[^/?#]*') AS origin, {path("url")} AS upath FROM refs WHERE ref <> '' AND NOT starts_with(ref, '#')),
joined AS (SELECT *, CASE WHEN starts_with(rpath, '/') THEN rpath WHEN instr(upath, '/') = 0 THEN '/' || rpath ELSE regexp_extract(upath, '^.*/') || rpath END AS whole FROM cut),
folded AS (SELECT *, list_reduce(list_transform(string_split(substr(whole, 2), '/'), lambda s: list_value(s)), lambda acc, s: CASE WHEN s[1] = '.' THEN acc WHEN s[1] = '..' THEN list_slice(acc, 1, len(acc) - 1) ELSE list_concat(acc, s) END, CAST([] AS VARCHAR[])) AS segs FROM joined),
target AS (SELECT url, CASE WHEN scheme <> '' AND starts_with(ref, scheme || '://') THEN ref WHEN scheme <> '' THEN NULL WHEN starts_with(ref, '//') THEN regexp_extract(url, '^[^/?#]*') || ref
  WHEN starts_with(ref, '?') THEN origin || upath || rquery ELSE origin || CASE WHEN instr(whole, '/.') = 0 THEN whole
    ELSE '/' || array_to_string(segs, '/') || CASE WHEN regexp_matches(whole, '/[.][.]?$') AND len(segs) > 0 THEN '/' ELSE '' END END || rquery END AS link_to FROM folded),
edge AS (SELECT {node("url")} AS a, {node("link_to")} AS b FROM target WHERE link_to IS NOT NULL),
sides AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT a AS x, a AS y FROM sides UNION SELECT r.x, e.b FROM reach r JOIN sides e ON e.a = r.y),
ruled AS (SELECT x, {best("action", "q")} AS action FROM (SELECT x, {host("y")} AS host, {path("y")} AS path FROM reach) q),
said AS (SELECT x, min(action) AS inherited FROM ruled WHERE action IS NOT NULL GROUP BY x)
SELECT page_id, host, path, {best("rule", "t")} AS rule, coalesce({best("action", "t")}, s.inherited, 'allow') AS verdict FROM t LEFT JOIN said s ON s.x = t.key"""


def _secrets_sql() -> str:
    def kind(rank: int, rule: secrets.Rule) -> str:
        p = rule.pattern.replace("'", "''")
        return f"""SELECT doc_id, {rank} AS k, '{rule.name}' AS kind, unnest(generate_series(1, len(w))) AS i, p, w, g FROM (SELECT doc_id,
    string_split_regex(coalesce(text, ''), '{p}') AS p, regexp_extract_all(coalesce(text, ''), '{p}') AS w, regexp_extract_all(coalesce(text, ''), '{p}', {rule.group}) AS g FROM documents)"""
    least = " ".join(f"WHEN '{r.name}' THEN {r.least}" for r in secrets.RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.name}') AS n_{r.name}" for r in secrets.RULES)
    return f"""WITH m AS ({" UNION ALL ".join(kind(i, r) for i, r in enumerate(secrets.RULES))}),
placed AS (SELECT doc_id, k, kind, len(g[i]) AS part, len(w[i]) AS size, list_sum(list_transform(p[1:i], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: len(x))), 0)::BIGINT AS a FROM m),
hit AS (SELECT doc_id, k, kind, a, a + size AS b FROM placed WHERE part >= CASE kind {least} END),
per AS (SELECT doc_id, {counts}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM hit GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.name}, 0) AS n_{r.name}" for r in secrets.RULES)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN per USING (doc_id)"""


def _centroids_sql() -> str:
    far = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    assign = lambda r: f"a{r} AS MATERIALIZED (SELECT rid, min(struct_pack(d := {far}, c := c.cluster)) AS best FROM v, c{r} c GROUP BY rid)"
    move = lambda r: f"""c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
  SELECT cluster, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (SELECT best.c AS cluster, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n
    FROM (SELECT a.best, unnest(v.v) AS x, unnest(range(64)) AS i FROM a{r} a JOIN v ON v.rid = a.rid) GROUP BY ALL) GROUP BY cluster) m ON m.cluster = c.cluster)"""  # noqa: E731
    rounds = ",\n".join(f"{assign(r)},\n{move(r)}" for r in range(ROUNDS))
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{CENTROID_SEED}:' || vec_id), v) - 1 AS cluster, v FROM v QUALIFY cluster < {CENTROIDS}),
{rounds},
{assign(ROUNDS)},
done AS (SELECT v.vec_id, best.c AS cluster, best.d AS distance FROM a{ROUNDS} a JOIN v ON v.rid = a.rid)
SELECT d.vec_id, d.cluster::INTEGER AS cluster, d.distance, (sum(d.distance) OVER (PARTITION BY d.cluster))::BIGINT AS cluster_inertia, (sum(d.distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM done d JOIN c{ROUNDS} c ON c.cluster = d.cluster"""


def _trie_sql() -> str:
    bits = "list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, {})"
    crc = f"xor(list_reduce(list_transform(string_split(c.conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT), lambda a, b: {bits.format('xor(a, b)')}, 4294967295), 4294967295)"
    return f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS own FROM t GROUP BY conv_id),
h AS (SELECT c.conv_id, c.own, c.conv_id - c.conv_id % 5 AS base, {crc} % 9 AS h FROM c),
w AS (SELECT h.*, least(h.h, coalesce(b.own, 0)) AS taken FROM h LEFT JOIN c b ON b.conv_id = h.base),
r AS (SELECT w.conv_id, t.pos AS d, t.role, t.text FROM w JOIN t ON t.conv_id = w.base AND t.pos <= w.h
  UNION ALL SELECT w.conv_id, w.taken + t.pos - w.h, t.role, t.text FROM w JOIN t ON t.conv_id = w.conv_id AND t.pos > w.h),
p AS (SELECT conv_id, d, list(struct_pack(role, text)) OVER (PARTITION BY conv_id ORDER BY d) AS seq, strlen(text) AS bytes FROM r UNION ALL SELECT conv_id, 0, [], 0 FROM c),
node AS (SELECT d, seq, min(conv_id) AS id, count(*) AS n_convs, min(bytes) AS bytes FROM p GROUP BY d, seq),
place AS MATERIALIZED (SELECT p.conv_id, p.d, n.id FROM p JOIN node n ON n.d = p.d AND n.seq = p.seq),
flat AS (SELECT n.id, n.d, n.n_convs, n.bytes, u.id AS up FROM node n LEFT JOIN place u ON u.conv_id = n.id AND u.d = n.d - 1),
kids AS (SELECT up AS id, d - 1 AS d, count(*) AS n FROM flat WHERE d > 0 GROUP BY ALL),
total AS (SELECT a.id, a.d, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((f.n_convs - 1) * f.bytes)::BIGINT AS saved
  FROM flat f JOIN place a ON a.conv_id = f.id AND a.d <= f.d LEFT JOIN kids k ON k.id = f.id AND k.d = f.d GROUP BY ALL),
last AS (SELECT id, d, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS top FROM place) WHERE d = top GROUP BY ALL)
SELECT f.id AS conv_id, f.d AS depth, f.up AS parent_conv_id, f.n_convs, coalesce(k.n, 0) AS n_children, t.n_leaves, t.saved AS saved_tokens, sha256(coalesce(l.ends, '')) AS ends_sha256
FROM flat f JOIN total t ON t.id = f.id AND t.d = f.d LEFT JOIN kids k ON k.id = f.id AND k.d = f.d LEFT JOIN last l ON l.id = f.id AND l.d = f.d"""


def _search_sql() -> str:
    return f"""WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1] * z[2], 0)))::BIGINT AS score
  FROM v q JOIN v c ON c.rid <> q.rid WHERE q.vec_id % {QUERY_EVERY} = 0)
SELECT query_id, (row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= {BEST}"""


def _two_versions_sql() -> str:
    both = """versions AS (SELECT doc_id || ':1' AS doc_id, text FROM documents UNION ALL SELECT doc_id || ':2', coalesce(text, '') || chr(10) || 'secret=' || md5(doc_id::VARCHAR) FROM documents)"""
    body = _secrets_sql().replace("FROM documents", "FROM versions").replace("WITH m AS", f"WITH {both}, m AS", 1)
    return f"SELECT doc_id, n_assign, n_access, n_hex FROM ({body})"


ORACLES: dict[str, str] = {
    "secrets_two_versions": _two_versions_sql(),
    "op11_bit_planes": _centroids_sql(),
    "op12_prefix_trie": _trie_sql(),
    "op13_max_score": _search_sql(),
    "op3_jaccard_join": _jaccard_sql(),
    "op4_url_aliases": _urls_sql(),
    "op6_mixing": _mixing_sql(),
    "op9_secrets": _secrets_sql(),
    "op10_exact_dedup": """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
