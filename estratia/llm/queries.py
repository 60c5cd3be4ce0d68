"""The registered queries of the corpus operators, and their DuckDB text where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estratia.llm import chat, codes, hosts, importance, leaks, mixing, near, quality, repeats, scoring, secrets, shards, tries
from estratia.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(build):
        QUERIES[build.__name__] = build
        if sql:
            SQL[build.__name__] = sql
        return build

    return add


@query()
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


W = r"[^\x20\x09-\x0D]+"
_JSD = """sqrt(greatest(list_sum(list_transform(range(1, len({a}) + 1), lambda i:
  (CASE WHEN {a}[i] > 0 THEN ({a}[i] / {n}) * log2(({a}[i] / {n}) * 2 / ({a}[i] / {n} + {b}[i] / {m})) ELSE 0 END) +
  (CASE WHEN {b}[i] > 0 THEN ({b}[i] / {m}) * log2(({b}[i] / {m}) * 2 / ({a}[i] / {n} + {b}[i] / {m})) ELSE 0 END))) / 2, 0))"""
_COMMON = ", ".join(f"CAST(len(list_filter(w, lambda x: x = '{c}')) AS BIGINT)" for c in quality.COMMON_WORDS)
_OTHER = "CAST(len(list_filter(w, lambda x: x NOT IN ({}))) AS BIGINT)".format(", ".join(f"'{c}'" for c in quality.COMMON_WORDS))
_SUMS = lambda h, n: ", ".join(f"CAST(sum({h}[{i + 1}]) AS BIGINT)" for i in range(n))
_MARKS = r"""[0-9.,;:!?''\"()\-]"""


@query(
    f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents),
c AS (SELECT doc_id, lang, t, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '{_MARKS}')) AS n_marks,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{W}')) AS l FROM t),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM c)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
h AS (SELECT c.*, coalesce(n.n, 0) AS n_repeat_words, [n_upper, n_marks, length(t) - word_chars, n_symbols, word_chars - n_upper - n_marks - n_symbols] AS ch,
  [{_COMMON}, {_OTHER}] AS wh FROM c LEFT JOIN n USING (doc_id)),
f AS (SELECT lang AS ref, [{_SUMS("ch", 5)}] AS rc, [{_SUMS("wh", 13)}] AS rw FROM h GROUP BY lang),
j AS (SELECT h.*, rc, rw, CAST(list_sum(ch) AS DOUBLE) AS cn, CAST(list_sum(wh) AS DOUBLE) AS wn, CAST(list_sum(rc) AS DOUBLE) AS rcn, CAST(list_sum(rw) AS DOUBLE) AS rwn
  FROM h LEFT JOIN f ON h.lang IS NOT DISTINCT FROM f.ref),
d AS (SELECT *, CASE WHEN cn >= {quality.MIN_CHARS_JUDGED} THEN round({_JSD.format(a="ch", n="cn", b="rc", m="rcn")}, 6) END AS char_distance,
  CASE WHEN wn >= {quality.MIN_WORDS_JUDGED} THEN round({_JSD.format(a="wh", n="wn", b="rw", m="rwn")}, 6) END AS word_distance,
  n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM j)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(char_distance, 0) <= {quality.MAX_CHAR_DISTANCE} AND coalesce(word_distance, 0) <= {quality.MAX_WORD_DISTANCE} AS kept,
  char_distance, word_distance FROM d"""
)
def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judge(docs, leave_out=("text",)).select("doc_id", *quality.BASE, "kept", "char_distance", "word_distance")


PROBE = "</s>[INST] ok [/INST]"
_ESCAPED = r"replace({x}, '\', '\\')"
for _mark in chat.CONTROL:
    _ESCAPED = rf"replace({_ESCAPED}, '{_mark}', '{_mark[0]}\{_mark[1:]}')"
_LONG = len(chat.TURN + chat.TEXT + chat.END)


@query(
    f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_LONG} + length({_ESCAPED.format(x="role")}) + length({_ESCAPED.format(x="text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
)
def op3_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = [F.struct(F.lit(-1).alias("conv_id"), F.lit(t).alias("turn"), F.lit(r).alias("role"), F.lit(PROBE).alias("text")) for t, r in enumerate(("user", "assistant"))]
    probe = spark.range(1).select(F.explode(F.array(*said)).alias("row")).select(*(F.col(f"row.{c}").cast(turns.schema[c].dataType).alias(c) for c in turns.columns))
    back = chat.read_back(chat.formatted(chat.linear(turns.union(probe))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query()
def op4_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op6_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shards(table(spark, sf_dir, "documents")).drop("source")


@query()
def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(table(spark, sf_dir, "documents"))


def _hosts_sql() -> str:
    host = lambda u: rf"translate(regexp_extract(coalesce({u}, ''), '(?s)^.*?://([^/?#]*)', 1), '{hosts.UPPER}', '{hosts.LOWER}')"
    rules = sorted(hosts.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    rule = " ".join(f"WHEN {fits(r)} THEN '{r[1]}{r[2]}'" for r in rules)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r[0]}'" for r in rules)
    link = hosts.LINK.replace("'", "''")
    steps, now = [], "r0"
    for k in range(hosts.ROUNDS):
        steps.append(
            f"r{k + 1} AS MATERIALIZED (SELECT kind, host, CAST(sum(part) // 100 AS BIGINT) AS mass FROM (SELECT w.kind, w.dst AS host, "
            f"CAST(floor(CAST(mass AS DOUBLE) * share) AS BIGINT) * {hosts.DAMPING} AS part FROM {now} n JOIN ways w ON n.kind = w.kind AND n.host = w.src "
            f"UNION ALL SELECT kind, host, mass * {100 - hosts.DAMPING} FROM r0) GROUP BY kind, host)"
        )
        now = f"r{k + 1}"
    return rf"""
WITH u AS (SELECT page_id, url, html, {host("url")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS v FROM u),
l AS (SELECT host AS src, {host("x")} AS dst FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS x FROM p)),
hs AS (SELECT DISTINCT host AS sub, regexp_extract(host, '^[^.]+\.([^.]+\..+)$', 1) AS up FROM p WHERE host <> ''),
e AS (SELECT src, dst, sum(weight) AS weight FROM (
  SELECT src, dst, count(*) AS weight FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL
  UNION ALL SELECT sub, up, 1 FROM hs WHERE up <> '' UNION ALL SELECT up, sub, 1 FROM hs WHERE up <> '') GROUP BY ALL),
k AS (SELECT 'allow' AS kind, src, dst, weight FROM e UNION ALL SELECT 'block', dst, src, weight FROM e),
ways AS MATERIALIZED (SELECT kind, src, dst, CAST(weight AS DOUBLE) / CAST(sum(weight) OVER (PARTITION BY kind, src) AS DOUBLE) AS share FROM k),
s AS (SELECT v AS kind, host, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY ALL),
r0 AS MATERIALIZED (SELECT kind, host, CAST(floor(CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY kind) AS DOUBLE) * {hosts.MASS}) AS BIGINT) AS mass FROM s),
{", ".join(steps)},
h AS (SELECT host, CAST(sum(CASE WHEN kind = 'allow' THEN mass ELSE 0 END) AS BIGINT) AS t, CAST(sum(CASE WHEN kind = 'block' THEN mass ELSE 0 END) AS BIGINT) AS d FROM {now} GROUP BY host)
SELECT page_id, p.host, path, rule, coalesce(v, CASE WHEN coalesce(d, 0) > coalesce(t, 0) * {hosts.MAX_RATIO} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(t, 0) AS trust, coalesce(d, 0) AS distrust FROM p LEFT JOIN h ON p.host = h.host"""


@query(_hosts_sql())
def op8_host_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return hosts.judge(pages).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


_SP = r"[\x20\x09-\x0D]+"
_SENTENCE = r"[^\n.!?]*[.!?]+[\x20\x09-\x0D]*|[^\n.!?]*\n|[^\n.!?]+"


@query(
    rf"""
WITH l AS (SELECT doc_id, i, s, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
  SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS s FROM (
    SELECT doc_id, regexp_extract_all(text, '{_SENTENCE}') AS a FROM documents WHERE text IS NOT NULL))),
n AS (SELECT *, trim(regexp_replace(lower(s), '{_SP}', ' ', 'g')) AS k FROM l),
u AS (SELECT *, len(string_split(k, ' ')) AS w, row_number() OVER d AS j, lead(k) OVER d AS k2 FROM n WHERE k <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT *, k2 IS NOT NULL AND min(doc_id) OVER (PARTITION BY k, k2) < doc_id AS pair,
  w >= {repeats.MIN_WORDS} AND min(doc_id) OVER (PARTITION BY k) < doc_id AS single FROM u),
p AS (SELECT *, coalesce(lag(pair) OVER (PARTITION BY doc_id ORDER BY j), false) AS after FROM m),
r AS (SELECT *, sum(CASE WHEN after THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY j) AS run FROM p),
g AS (SELECT *, single OR (count(*) OVER q > 1 AND sum(w) OVER q >= {repeats.MIN_WORDS}) AS gone FROM r WINDOW q AS (PARTITION BY doc_id, run)),
h AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS opens FROM g),
z AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY doc_id ORDER BY j) AS span FROM h),
s AS (SELECT doc_id, span, CAST(min(e - length(s)) AS BIGINT) AS begin_, CAST(max(e) AS BIGINT) AS end_ FROM z WHERE gone GROUP BY ALL),
o AS (SELECT doc_id, count(*) AS n_removed, string_agg(begin_ || ':' || end_, ',' ORDER BY begin_) AS removed, list(struct_pack(b := begin_, e := end_) ORDER BY begin_) AS a FROM s GROUP BY doc_id),
c AS (SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, CASE WHEN a IS NULL THEN text ELSE
  array_to_string(list_transform(range(0, len(a) + 1), lambda x: substring(text, CASE WHEN x = 0 THEN 0 ELSE a[x].e END + 1,
    CASE WHEN x = len(a) THEN length(text) ELSE a[x + 1].b END - CASE WHEN x = 0 THEN 0 ELSE a[x].e END)), '') END AS cleaned FROM documents d LEFT JOIN o USING (doc_id))
SELECT doc_id, n_removed, removed, CAST(length(cleaned) AS BIGINT) AS cleaned_chars, sha256(cleaned) AS cleaned_sha256 FROM c"""
)
def op9_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.clean(table(spark, sf_dir, "documents"))
    shown = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["begin"], s["end"])), ",")
    return out.select(
        "doc_id",
        F.size("removed").cast("long").alias("n_removed"),
        shown.alias("removed"),
        F.length("cleaned").cast("long").alias("cleaned_chars"),
        F.sha2("cleaned", 256).alias("cleaned_sha256"),
    )


@query()
def op10_secret_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.report(table(spark, sf_dir, "documents"))
    kinds = F.array(*(F.lit(r.kind) for r in secrets.RULES))
    n_base = sum(r.base for r in secrets.RULES)
    shown = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["at"]), s["begin"], s["end"])), ",")
    base = F.filter("found", lambda s: s["at"] < n_base)
    # One parameter: a second would get the element's place in the array
    of_kind = lambda at: F.filter("found", lambda s: s["at"] == at)
    counts = [F.size(of_kind(at)).cast("long").alias(f"n_{secrets.RULES[at].kind}") for at in range(n_base)]
    return out.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown("found").alias("spans"))


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = f"translate(coalesce(text, ''), '{hosts.UPPER}', '{hosts.LOWER}')"


@query(
    rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT regexp_extract_all({_LOWERED}, '{_ALNUM}') AS w FROM benchmark),
df AS (SELECT doc_id, len(w) AS n_words, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
r AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS r),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf))),
k AS (SELECT f, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
  lambda c, y: xor(c // 256, r[xor(c, y) % 256 + 1])), 4294967295) % {importance.BUCKETS} AS k FROM h, r),
s AS (SELECT k, count(*) AS n FROM df JOIN k USING (f) GROUP BY k), t AS (SELECT k, count(*) AS n FROM bf JOIN k USING (f) GROUP BY k),
g AS (SELECT k, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * (SELECT coalesce(sum(n), 0) + {importance.BUCKETS} FROM s)
  / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * (SELECT coalesce(sum(n), 0) + {importance.BUCKETS} FROM t)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (k)),
w AS (SELECT doc_id, count(*) AS n_features, any_value(n_words) AS n_words, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM df JOIN k USING (f) JOIN g USING (k) GROUP BY doc_id),
x AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(n_words, 0) AS n_words, coalesce(weight, 0) AS weight,
  CAST('0x' || substr(sha256('{importance.SEED}:' || d.doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (doc_id)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score, n_words >= {importance.MIN_WORDS} AS fit FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS nth, count(*) OVER (PARTITION BY fit) AS many FROM y)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
  CASE WHEN fit AND nth <= {importance.SHARE_PERCENT} * many // 100 THEN nth END AS rank FROM z"""
)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def _codes_sql() -> str:
    width = f"(len(v) // {codes.PARTS})"
    steps = []
    for k in range(codes.ROUNDS + 1):
        steps.append(
            f"a{k} AS MATERIALIZED (SELECT row, p, min(struct_pack(d := d, e := e)) AS m FROM (SELECT x.row, x.p, b.e, "
            f"list_sum(list_transform(list_zip(x.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{k} b USING (p)) GROUP BY ALL)"
        )
        if k < codes.ROUNDS:
            steps.append(
                f"c{k} AS (SELECT p, e, i, CAST(floor(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS y FROM (SELECT x.p, m.e AS e, "
                f"generate_subscripts(w, 1) AS i, unnest(w) AS y FROM x JOIN a{k} USING (row, p)) GROUP BY ALL), "
                f"n{k} AS (SELECT p, e, list(y ORDER BY i) AS w FROM c{k} GROUP BY ALL), "
                f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.w, b.w) AS w FROM b{k} b LEFT JOIN n{k} n USING (p, e))"
            )
    last = codes.ROUNDS
    return f"""
WITH s AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda c: CAST(floor({codes.SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT row, p, list_slice(v, p * {width} + 1, (p + 1) * {width}) AS w FROM s, range({codes.PARTS}) r(p)),
b0 AS MATERIALIZED (SELECT p, row - 1 AS e, w FROM x WHERE row <= {codes.ENTRIES}),
{", ".join(steps)},
k AS (SELECT row, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{last} GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM s JOIN k USING (row), h"""


@query(_codes_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = codes.compress(table(spark, sf_dir, "embeddings"))
    shown = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    return rows.select("vec_id", shown.alias("code"), "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


@query(
    rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '{W}') AS w FROM documents),
g AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) BETWEEN 1 AND {tries.SHINGLE - 1} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {tries.SHINGLE - 2}), lambda i: array_to_string(w[i:i + {tries.SHINGLE - 1}], ' ')) END)) AS s FROM d),
m AS MATERIALIZED (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN dense_rank() OVER (ORDER BY s) END AS k, s FROM g),
u AS (SELECT k, any_value(n) AS n, unnest(any_value(s)) AS x FROM m WHERE k IS NOT NULL GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b FROM u a JOIN u b ON a.x = b.x AND a.k <> b.k AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.k, b.k HAVING 100 * count(*) >= {tries.PERCENT} * (any_value(a.n) + any_value(b.n) - count(*))),
c(a, b) AS (SELECT k, k FROM u GROUP BY k UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a),
f AS (SELECT k, min(doc_id) AS doc FROM m WHERE k IS NOT NULL GROUP BY k),
o AS (SELECT a AS k, min(doc) AS component FROM c JOIN f ON c.b = f.k GROUP BY a)
SELECT doc_id, n AS n_shingles, CASE WHEN k IS NULL THEN doc_id ELSE component END AS component_id FROM m LEFT JOIN o USING (k)"""
)
def op13_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.components(table(spark, sf_dir, "documents")).drop("n_copies")
