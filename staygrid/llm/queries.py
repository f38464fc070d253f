"""The registered queries of this subpackage: one for each operator, over the whole ``documents`` table.

Each takes its rows from its operator and derives the digest columns from them.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from staygrid.llm import blob_ledger, divergence, golomb_dedup, hmm, kd_shards, language_masks, merge_dropout, neighbours, periodic_runs, redirects, signature_trees, tier_packing, token_anchors
from staygrid.llm.shared import settle, work_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The table; tasks started from here on find this package where the driver has it, if it is not installed."""
    root = str(Path(__file__).resolve().parents[2])
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    return spark.read.parquet(f"{sf}/documents.parquet")


def tokenizer_file(name: str) -> str:
    """Where this machine has a public tokenizer; executors are expected to have it at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _spans_sql(kind: str, rank: int, pattern: str, keep: str) -> str:
    """Spans of one kind: matches and the pieces between them give the positions."""
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, m, s FROM (
        SELECT doc_id, unnest(ms) AS m, unnest(list_transform(generate_series(1, len(ms)), lambda i:
            list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS s
        FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM d) WHERE len(ms) > 0) WHERE {keep}"""


_WORDS = [("password", "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]"), ("passwd", "[Pp][Aa][Ss][Ss][Ww][Dd]"), ("secret", "[Ss][Ee][Cc][Rr][Ee][Tt]"),
          ("token", "[Tt][Oo][Kk][Ee][Nn]"), ("api_key", "[Aa][Pp][Ii]_?[Kk][Ee][Yy]")]
_ASSIGN = "(?:" + "|".join(p for _, p in _WORDS) + r""")["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
_VALUE = "^(?:" + "|".join(p for _, p in _WORDS) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({_spans_sql("assign", 0, _ASSIGN, f"length(regexp_extract(m, '{_VALUE}', 1)) >= 6")}
    UNION ALL {_spans_sql("access", 1, "AKIA[A-Z0-9]{16,}", "true")}
    UNION ALL {_spans_sql("hex", 2, "[0-9a-f]{24,}", "true")}
    UNION ALL {_spans_sql("pem", 3, "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true")}
    UNION ALL {_spans_sql("jwt", 4, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", "true")}
    UNION ALL {_spans_sql("hosted", 5, r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", "true")}
    UNION ALL {_spans_sql("login", 6, r"\b[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/@]+@", r"length(regexp_extract(m, '://[^\s/:@]{1,64}:([^\s/@]+)@', 1)) >= 6")}),
g AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(m) AS BIGINT), ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(m) AS BIGINT), ',' ORDER BY s, rank) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
""")
def op1_secret_ledger(spark: SparkSession, sf: str) -> DataFrame:
    found = blob_ledger.scanned(documents(spark, sf).select("doc_id", "text"), work_folder(spark))
    base = F.filter("spans", lambda f: f["kind"].isin([r.kind for r in blob_ledger.BASE[1]]))
    count = lambda kind: F.size(F.filter("spans", lambda f: f["kind"] == kind)).cast("long")
    return found.select("doc_id", F.col("findings").alias("spans")).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(blob_ledger.spans_text(base), 256).alias("base_sha256"), blob_ledger.spans_text("spans").alias("spans"))


@query()
def op2_kd_shards(spark: SparkSession, sf: str) -> DataFrame:
    shards = kd_shards.document_shards(documents(spark, sf))
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op3_tiered_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing_digest(tier_packing.packed(documents(spark, sf), tokenizer_file("word_bpe_49k.json")))


def packing_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_id")


@query()
def op4_hmm_scores(spark: SparkSession, sf: str) -> DataFrame:
    return hmm.hmm_scores(documents(spark, sf))


@query("""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i, len(words) AS n FROM d),
g AS (SELECT doc_id, i, n, CASE WHEN n >= 5 THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) END AS g
    FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, g FROM g WHERE n >= 5 AND i <= n - 4 UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM d WHERE len(words) BETWEEN 1 AND 4),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * both_n >= 80 * (x.n + y.n - both_n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT r.doc_id, coalesce(any_value(c.n), 0) AS n_shingles, min(other) AS component_id FROM r LEFT JOIN c ON c.doc_id = r.doc_id GROUP BY r.doc_id
""")
def op5_signature_tree_components(spark: SparkSession, sf: str) -> DataFrame:
    return signature_trees.jaccard_components(documents(spark, sf))


def _distance_sql(p: str, q: str, bins: int) -> str:
    parts = []
    for i in range(1, bins + 1):
        x, y = f"({p}[{i}] / list_sum({p}))", f"({q}[{i}] / list_sum({q}))"
        parts += [f"CASE WHEN {a} > 0 THEN 0.5 * {a} * log2(2 * {a} / ({x} + {y})) ELSE 0 END" for a in (x, y)]
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest({' + '.join(parts)}, 0)) ELSE 0 END"


def quality_sql(table: str = "documents") -> str:
    """Base counts, histograms, references and verdicts of a table of documents."""
    lists = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in divergence.COMMON.items())
    known = ", ".join(f"'{k}'" for k in divergence.COMMON)
    hits = ", ".join(f"len(list_filter(words, lambda w: w = common[{j}]))" for j in range(1, 11))
    return f"""
WITH d0 AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({known}) THEN lang ELSE 'other' END AS language FROM {table}),
d AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words, CASE language {lists} ELSE [] END AS common FROM d0),
w AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
win AS (SELECT doc_id, i, concat_ws(' ', w, {", ".join(f"lead(w, {k}) OVER o" for k in range(1, 8))}) AS g, lead(w, 7) OVER o AS final
    FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win WHERE final IS NOT NULL) WHERE n > 1),
r AS (SELECT doc_id, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n FROM
    (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
f0 AS (SELECT doc_id, language, t, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
        - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, length(t) AS chars, strlen(t) AS bytes, len(regexp_extract_all(t, '[A-Z]')) AS upper_n,
    len(regexp_extract_all(t, '[0-9]')) AS digit_n, len(regexp_extract_all(t, '[.,;:!?''"()-]')) AS punct_n,
    CASE WHEN language = 'other' THEN [0, 0, 0, 0, 0, 0, 0, 0, 0, 0] ELSE [{hits}] END AS named FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, list_transform([word_chars - upper_n - digit_n - punct_n - n_symbols, bytes - chars, chars - word_chars, upper_n, digit_n, punct_n, n_symbols], lambda x: CAST(x AS DOUBLE)) AS classes,
    list_transform(list_append(named, n_words - list_sum(named)), lambda x: CAST(x AS DOUBLE)) AS common FROM f0),
ref AS (SELECT language, [{", ".join(f"sum(classes[{i}])" for i in range(1, 8))}] AS rc, [{", ".join(f"sum(common[{i}])" for i in range(1, 12))}] AS rw FROM f GROUP BY language),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN chars >= {divergence.CLASS_CHARS} THEN {_distance_sql("classes", "rc", 7)} ELSE 0 END AS class_distance,
    CASE WHEN n_words >= {divergence.WORD_WORDS} AND language <> 'other' THEN {_distance_sql("common", "rw", 11)} ELSE 0 END AS word_distance FROM f JOIN ref USING (language))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND class_distance <= {divergence.CLASS_LIMIT} AND word_distance <= {divergence.WORD_LIMIT} AS kept FROM j"""


@query(quality_sql())
def op6_divergence_rules(spark: SparkSession, sf: str) -> DataFrame:
    measures = settle(divergence.measured(documents(spark, sf).select("doc_id", "text", "lang")).select("doc_id", "__q"))
    verdicts = divergence.judged(measures, divergence.references(measures))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return verdicts.select("doc_id", *[F.col(f"__q.{c}").alias(c) for c in counts], F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


@query("""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
""")
def op9_golomb_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    groups = golomb_dedup.exact_duplicates(documents(spark, sf))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


@query()
def op10_language_bitmask(spark: SparkSession, sf: str) -> DataFrame:
    return language_masks.held_out_languages(documents(spark, sf))


@query()
def op8_toxicity_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.toxicity(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query()
def op7_merge_dropout(spark: SparkSession, sf: str) -> DataFrame:
    coded = merge_dropout.encoded(documents(spark, sf), tokenizer_file("piece_bpe_32k.model"))
    return coded.select("doc_id", "variant", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "lossless")


@query()
def op11_anchored_alignment(spark: SparkSession, sf: str) -> DataFrame:
    names = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    coded = token_anchors.alignments(documents(spark, sf), *names)
    coded = settle(coded.withColumn("groups", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))))
    sums = token_anchors.link_sums(coded, token_anchors.piece_count(names[1]))
    return coded.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def _rule_sql(host: str, path: str, give) -> str:
    arms = [f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{give(v, h, p)}'" for v, h, p in redirects.by_length(redirects.RULES)]
    return f"CASE {' '.join(arms)} END"


def redirect_sql(extra: str = "SELECT '' AS source, '' AS target WHERE false") -> str:
    """Verdicts over the links that pages declare and ``extra`` pairs of urls."""
    rest = f"coalesce(regexp_extract({{0}}, '{redirects.REST}', 1), '')".format
    host = f"translate(regexp_extract({{0}}, '{redirects.HOST}', 1), '{redirects.UPPER}', '{redirects.LOWER}')".format
    path = f"regexp_extract({{0}}, '{redirects.PATH}', 1)".format

    def address(x: str) -> str:
        for pattern, by in redirects.CLEANING:
            x = f"regexp_replace({x}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
        return f"{host(x)} || regexp_extract({x}, '{redirects.TAIL}', 1)"

    one = r"""regexp_extract(tag, '(?is)[\s"'']{0}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', {1})"""
    attribute = lambda name: " || ".join(one.format(name, k) for k in (1, 2, 3))
    verdict = lambda h, p: _rule_sql(h, p, lambda v, *_: v)
    return rf"""
WITH RECURSIVE pg AS (SELECT page_id, {rest("url")} AS rest, html FROM pages),
tags AS (SELECT rest, unnest(regexp_extract_all(regexp_replace(html, '{redirects.HIDDEN}', '', 'g'), '{redirects.TAG}')) AS tag FROM pg),
named AS (SELECT rest, trim(replace(CASE WHEN regexp_matches({attribute("rel")}, '(?i)(^|\s)canonical(\s|$)') THEN {attribute("href")}
    WHEN lower({attribute("http-equiv")}) = 'refresh' THEN regexp_extract({attribute("content")}, '(?i)url\s*=\s*["'']?([^"'']*)', 1) END, '&amp;', '&')) AS t FROM tags),
full_ AS (SELECT rest, CASE WHEN t = '' OR starts_with(t, '#') THEN NULL WHEN regexp_matches(t, '{redirects.SCHEME}') THEN t WHEN starts_with(t, '//') THEN 'http:' || t
    WHEN regexp_matches(t, '{redirects.OTHER_SCHEME}') THEN NULL WHEN starts_with(t, '/') THEN 'http://' || {host("rest")} || t
    WHEN starts_with(t, '?') THEN 'http://' || {host("rest")} || {path("rest")} || t
    ELSE 'http://' || {host("rest")} || CASE WHEN regexp_extract({path("rest")}, '^(.*/)', 1) = '' THEN '/' ELSE regexp_extract({path("rest")}, '^(.*/)', 1) END || t END AS u FROM named),
pairs AS (SELECT {address("rest")} AS a, {address("r2")} AS b FROM (SELECT rest, {rest("u")} AS r2 FROM full_ UNION ALL SELECT {rest("source")}, {rest("target")} FROM ({extra}))),
links AS (SELECT DISTINCT a, b FROM pairs WHERE a <> b AND a <> '' AND b <> ''),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
r(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT node, min(other) AS alias_of, bool_or(coalesce({verdict(host("other"), path("other"))} = 'block', false)) AS blocked FROM r GROUP BY node),
p AS (SELECT page_id, {host("rest")} AS host, {path("rest")} AS path, {address("rest")} AS address FROM pg)
SELECT page_id, host, path, {_rule_sql("host", "path", lambda _, h, p: h + p)} AS rule,
    coalesce({verdict("host", "path")}, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, alias_of FROM p LEFT JOIN c ON c.node = p.address"""


@query(redirect_sql())
def op12_redirect_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    documents(spark, sf)
    return redirects.verdicts(spark.read.parquet(f"{sf}/pages.parquet"))


@query()
def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic_runs.periodic_runs(documents(spark, sf), loops=True)
    text = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    top = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
