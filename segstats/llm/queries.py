"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segstats.llm import (
    decontaminate,
    divergence,
    html_text,
    packing,
    quality,
    resampling,
    secrets,
    sharding,
    simhash,
    token_counts,
    token_files,
    topk,
    urls,
)
from segstats.sources.tables import load_table

END_ID = 2
TOKEN_LIMIT = 2048
SHARDS, SEED = 16, 42
RULES = [
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
]


def vocabulary_file() -> str:
    """The public word BPE's vocabulary; the library takes any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 4096 tokens."""
    pieces = packing.pack(load_table(spark, sf_dir, "documents"), vocabulary_file(), 4096, END_ID)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to token files and read back."""
    folder = token_files.write_token_files(load_table(spark, sf_dir, "documents"), vocabulary_file(), END_ID)
    read = token_files.read_token_files(spark, folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold copies of: doc_id, item_id, score."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    found, name = decontaminate.with_matches(docs, load_table(spark, sf_dir, "benchmark"))
    each = found.select("doc_id", F.explode(name).alias("m"))
    return each.select("doc_id", F.col("m.item_id").alias("item_id"), F.col("m.score").alias("score"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate class."""
    found = simhash.near_duplicates(load_table(spark, sf_dir, "documents"), shingle=4, max_distance=4)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted, name = token_counts.with_token_counts(docs, vocabulary_file())
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(name).alias("n_tokens"),
        (F.col(name) > TOKEN_LIMIT).alias("over_limit"),
    )


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are never learnt from; a null id has no label and is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    measured = quality.measure(load_table(spark, sf_dir, "documents"))
    model = quality.train(measured, load_table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    scored = measured.select("doc_id", quality.score(F.col("features"), model).alias("score"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"),
    )


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    pages = load_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found, name = html_text.with_main_text(pages)
    return found.select("page_id", "url", F.col(name).alias("text"), F.length(name).cast("long").alias("n_chars"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors of every vector whose id is divisible by 100."""
    return topk.top_k(load_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secret spans: counts by base kind, digest of the base spans, and all spans."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    found, name = secrets.with_spans(docs)
    kinds = secrets.KINDS
    base = F.filter(F.col(name), lambda s: s["kind"] < len(secrets.BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter(F.col(name), lambda s: s["kind"] == kinds.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col(name)).alias("spans"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by its URL."""
    pages = load_table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16 and its slot there, with the size and digest of its text."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    placed, _, shard, slot = sharding.with_shards(docs, SHARDS, SEED)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col(shard).alias("shard"),
        F.col(slot).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score towards the benchmark, and the ranks of the drawn 5 in a hundred."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    weighted, name = resampling.with_weights(docs, load_table(spark, sf_dir, "benchmark"))
    return resampling.draw(weighted.drop("text"), name, percent=5, least_words=20, seed=SEED)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sets each source of a language apart: from every other source, and by which terms."""
    return divergence.audit(load_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing, op2_token_files, op3_decontamination, op4_simhash, op5_token_counts, op6_quality, op7_main_text,
        op8_top_k, op9_secrets, op10_url_filter, op11_sharding, op12_resampling, op13_divergence,
    )
}

def _top_k_sql(k: int = 10, scale: int = 1024) -> str:
    return f"""
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id,
                  list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS e
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id,
             CAST(coalesce(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(v.e) = len(q.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""


def _url_sql() -> str:
    """Rules, then Witten-Bell models of order 0 to 2 over the ruled URLs and the calibrated mean log ratio."""
    fits = [
        (f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))", r)
        for r in sorted(RULES, key=lambda r: -len(r.text))
    ]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r.text}'" for f, r in fits) + " END"
    said = "CASE " + " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in fits) + " END"
    size = urls.SYMBOLS

    def probability(side: str) -> str:
        """The chain of backed-off probabilities of one side, for each gram that any URL holds."""
        return f"""
{side}_c AS (SELECT g, CAST(sum(n) AS DOUBLE) AS n FROM grams WHERE said = '{side}' GROUP BY g),
{side}_0 AS (SELECT g % {size} AS s, sum(n) AS n FROM {side}_c GROUP BY 1),
{side}_1 AS (SELECT g % {size * size} AS s, sum(n) AS n FROM {side}_c GROUP BY 1),
{side}_t0 AS (SELECT sum(n) AS n, count(*) AS k FROM {side}_0),
{side}_t1 AS (SELECT s // {size} AS c, sum(n) AS n, count(*) AS k FROM {side}_1 GROUP BY 1),
{side}_t2 AS (SELECT g // {size} AS c, sum(n) AS n, count(*) AS k FROM {side}_c GROUP BY 1),
{side}_p0 AS (SELECT a.g, CASE WHEN t.n > 0 THEN (coalesce(o.n, 0) + t.k / {size}.0) / (t.n + t.k) ELSE 1 / {size}.0 END AS p
              FROM every a CROSS JOIN {side}_t0 t LEFT JOIN {side}_0 o ON o.s = a.g % {size}),
{side}_p1 AS (SELECT a.g, CASE WHEN t.n > 0 THEN (coalesce(o.n, 0) + t.k * a.p) / (t.n + t.k) ELSE a.p END AS p
              FROM {side}_p0 a LEFT JOIN {side}_t1 t ON t.c = (a.g % {size * size}) // {size}
              LEFT JOIN {side}_1 o ON o.s = a.g % {size * size}),
{side}_p2 AS (SELECT a.g, CASE WHEN t.n > 0 THEN (coalesce(o.n, 0) + t.k * a.p) / (t.n + t.k) ELSE a.p END AS p
              FROM {side}_p1 a LEFT JOIN {side}_t2 t ON t.c = a.g // {size} LEFT JOIN {side}_c o ON o.g = a.g)"""

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH a AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
b AS (SELECT *, {rule} AS rule, {said} AS said FROM a),
texts AS (SELECT host, path, said, count(*) AS n FROM b GROUP BY ALL),
codes AS (SELECT *, list_concat([1, 1], list_transform(
            string_split(replace(regexp_replace(lower(host || path), '[0-9]', '0', 'g'), '$', '?'), ''),
            lambda c: instr('{urls.ALPHABET}', c)), [1]) AS c0 FROM texts),
shaped AS (SELECT host, path, said, n, CASE WHEN host || path = '' THEN [1, 1, 1] ELSE c0 END AS c FROM codes),
grams AS (SELECT host, path, said, n,
                 unnest(list_transform(range(3, len(c) + 1), lambda i: (c[i - 2] * {size} + c[i - 1]) * {size} + c[i])) AS g
          FROM shaped),
every AS (SELECT DISTINCT g FROM grams),{probability('allow')},{probability('block')},
ratios AS (SELECT x.g, ln(x.p) - ln(y.p) AS r FROM allow_p2 x JOIN block_p2 y ON x.g = y.g),
scored AS (SELECT host, path, said, n, avg(r) AS score FROM grams JOIN ratios USING (g) GROUP BY ALL),
side AS (SELECT said, sum(n * score) / sum(n) AS m, sqrt(greatest(sum(n * score * score) / sum(n) - pow(sum(n * score) / sum(n), 2), 0)) AS d
         FROM scored WHERE said IS NOT NULL GROUP BY said),
cut AS (SELECT CASE WHEN x.d + y.d > 0 THEN (x.m * y.d + y.m * x.d) / (x.d + y.d) ELSE (x.m + y.m) / 2 END AS t
        FROM side x JOIN side y ON x.said = 'allow' AND y.said = 'block')
SELECT b.page_id, b.host, b.path, b.rule,
       CASE WHEN b.said IS NOT NULL THEN b.said
            WHEN (SELECT t FROM cut) IS NULL OR s.score >= (SELECT t FROM cut) THEN 'allow' ELSE 'block' END AS verdict
FROM b LEFT JOIN (SELECT * FROM scored WHERE said IS NULL) s ON b.host = s.host AND b.path = s.path"""


def _crc32_sql(hexed: str) -> str:
    """CRC-32 of bytes given as upper-case hex digits, by the byte-wise table ``crc_table.t``."""
    digit = "(instr('0123456789ABCDEF', x[{i}]) - 1)"
    byte = f"{digit.format(i=1)} * 16 + {digit.format(i=2)}"
    bytes_of = f"list_transform(regexp_extract_all({hexed}, '..'), lambda x: {byte})"
    step = "lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_of}), {step}), CAST(4294967295 AS BIGINT))"


_CRC_TABLE_SQL = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(
    [i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _sharding_sql() -> str:
    """Row numbers by doc_id, then the Feistel rounds one by one until the number is below the row count."""
    mixed = f"CAST('0x' || substr(md5('{SEED}:' || (k % {sharding.ROUNDS}) || ':' || r), 1, {sharding.DIGITS}) AS BIGINT)"
    return f"""
WITH RECURSIVE {_CRC_TABLE_SQL},
d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) - 1 AS x FROM documents),
size AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS m FROM d),
walk AS (SELECT x, x // m AS l, x % m AS r, 0 AS k, n, m FROM d, size
         UNION ALL
         SELECT x, r, (l + {mixed} % m) % m, k + 1, n, m FROM walk
         WHERE k = 0 OR k % {sharding.ROUNDS} <> 0 OR l * m + r >= n),
placed AS (SELECT x, l * m + r AS p FROM walk WHERE k > 0 AND k % {sharding.ROUNDS} = 0 AND l * m + r < n),
digest AS (SELECT doc_id, x, strlen(text) AS size, hex(encode(text)) AS h FROM d)
SELECT doc_id, CAST(size + 1 AS BIGINT) AS size, CAST({_crc32_sql("h")} AS BIGINT) AS text_crc32, 'rows' AS law,
       CAST(p % {SHARDS} AS INTEGER) AS shard, CAST(p // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM digest JOIN placed USING (x), crc_table"""


def _resampling_sql() -> str:
    size, scale = resampling.BUCKETS, resampling.SCALE
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = rf"""regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
    runs = """list_concat(w, list_concat(
        list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
        list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))"""
    return f"""
WITH {_CRC_TABLE_SQL},
words AS (SELECT 0 AS side, doc_id AS id, {split} AS w FROM documents
          UNION ALL SELECT 1, item_id, {split} FROM benchmark),
sized AS (SELECT id, len(w) AS n_words, greatest(3 * len(w) - 3, len(w) * (len(w) + 1) // 2 * (len(w) < 3)::INT) AS n_features
          FROM words WHERE side = 0),
f AS (SELECT side, id, f, count(*) AS n FROM (SELECT side, id, unnest({runs}) AS f FROM words) GROUP BY ALL),
b AS (SELECT f, CAST({_crc32_sql("h")} % {size} AS BIGINT) AS bucket
      FROM (SELECT DISTINCT f, hex(encode(f)) AS h FROM f), crc_table),
held AS (SELECT bucket, sum(CASE WHEN side = 0 THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 1 THEN n ELSE 0 END) AS t
         FROM f JOIN b USING (f) GROUP BY bucket),
total AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t FROM held),
gain AS (SELECT bucket, CAST(floor({scale} * ln((h.t + 1.0::DOUBLE) * (total.s + {size}) / ((h.s + 1.0::DOUBLE) * (total.t + {size})))) AS BIGINT) AS g
         FROM held h, total),
weight AS (SELECT id, CAST(sum(n * g) AS BIGINT) AS w FROM f JOIN b USING (f) JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (SELECT id AS doc_id, CAST(n_features AS BIGINT) AS n_features, coalesce(w, 0) AS weight, n_words,
                  coalesce(w, 0) + CAST(floor(-{scale} * ln(-ln((CAST(CAST('0x' || substr(sha256('{SEED}:' || id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
           FROM sized LEFT JOIN weight USING (id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS able FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN r <= 5 * able // 100 THEN r END AS BIGINT) AS rank
FROM scored LEFT JOIN ranked USING (doc_id)"""


def _divergence_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = rf"""regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"""

    def p(n: str, held: str) -> str:
        return f"CAST(1 + CAST({divergence.SCALE} AS HUGEINT) * ({n} + {divergence.PRIOR}) // ({held} + {divergence.PRIOR} * v) AS BIGINT)"

    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {split} AS w FROM documents),
each AS (SELECT doc_id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM each GROUP BY lang, term HAVING count(DISTINCT doc_id) >= {divergence.LEAST_DOCS}),
v AS (SELECT lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept k USING (lang) GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM each JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT o.lang, o.source, coalesce(h.held, 0) AS held, any_value(v) AS v
      FROM (SELECT DISTINCT lang, source FROM d) o JOIN v USING (lang)
      LEFT JOIN (SELECT lang, source, CAST(sum(n) AS BIGINT) AS held FROM c GROUP BY ALL) h ON h.lang = o.lang AND h.source = o.source
      GROUP BY ALL),
l AS (SELECT lang, CAST(sum(held) AS BIGINT) AS lang_held FROM g GROUP BY lang),
lt AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY ALL),
full_p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, {p("coalesce(c.n, 0)", "g.held")} AS p
           FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pair_sums AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
              FROM full_p a JOIN full_p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
q AS (SELECT lang, term, {p("lang_n", "lang_held")} AS q FROM lt JOIN l USING (lang) JOIN v USING (lang)),
terms AS (SELECT f.lang, f.source, 'term' AS part, f.term AS item, f.p - q.q AS value
          FROM full_p f JOIN q ON f.lang = q.lang AND f.term = q.term WHERE f.n > 0 AND f.p > q.q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}"""


def _secrets_sql() -> str:
    """Match places from the pieces between matches; windows of candidates one by one, their entropy from whole counts."""

    def quoted(pattern: str) -> str:
        return "'" + re.sub(r"(?<=[?*+}])\+|\(\?<!.*?\)\)?(?=\[)", "", pattern).replace("'", "''") + "'"

    def placed(place: int, pattern: str, group: int, least: int) -> str:
        p = quoted(pattern)
        return f"""SELECT doc_id, {place} AS kind, string_split_regex(t, {p}) AS pieces, regexp_extract_all(t, {p}) AS found,
            regexp_extract_all(t, {p}, {group}) AS measured, {least} AS least FROM d"""

    whole = [secrets.BASE[0][1], "AKIA[A-Z0-9]+", "[0-9a-f]+"]  # short matches are dropped by their length
    kinds = [placed(k, whole[k], group, least) for k, (_, _, group, least) in enumerate(secrets.BASE)]
    kinds.append(placed(len(secrets.BASE), secrets.CANDIDATE, 0, secrets.WINDOW))
    allowed = " OR ".join(f"regexp_matches(m, {quoted(form)})" for form in secrets.ALLOWED)
    bits = " ".join(f"WHEN regexp_matches(m, {quoted(p)}) THEN {b}" for p, b in secrets.CLASSES[:-1])
    names = ", ".join(f"'{k}'" for k in secrets.KINDS)
    window = secrets.WINDOW
    listed = "string_agg([{names}][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind)".replace("{names}", names)
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, (name, *_) in enumerate(secrets.BASE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS ({" UNION ALL ".join(kinds)}),
each AS (SELECT doc_id, kind, i, length(pieces[i]) AS gap, found[i] AS m, length(measured[i]) >= least AS fits
         FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM p)),
placed AS (SELECT doc_id, kind, i, m, fits, sum(gap + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM each),
base AS (SELECT doc_id, kind, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed
         WHERE kind < {len(secrets.BASE)} AND fits),
c AS (SELECT doc_id, i, m, CAST(e - length(m) AS BIGINT) AS s, CASE {bits} ELSE {secrets.CLASSES[-1][1]} END AS bits
      FROM placed WHERE kind = {len(secrets.BASE)} AND NOT ({allowed})),
w AS (SELECT doc_id, i, s + k AS s, bits, unnest(string_split(substr(m, CAST(k + 1 AS INTEGER), {window}), '')) AS x
      FROM (SELECT *, unnest(range(length(m) - {window - 1})) AS k FROM c)),
n AS (SELECT doc_id, i, s, bits, x, count(*) AS n FROM w GROUP BY ALL),
hot AS (SELECT doc_id, i, s FROM n GROUP BY doc_id, i, s, bits
        HAVING log2({window}) - sum(n * log2(n)) / {window} >= bits),
marked AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id, i ORDER BY s) <= {window} THEN 0 ELSE 1 END AS new FROM hot),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, i ORDER BY s) AS run FROM marked),
spans AS (SELECT doc_id, min(s) AS s, max(s) + {window} AS e FROM runs GROUP BY doc_id, i, run),
every AS (SELECT * FROM base UNION ALL
          SELECT doc_id, {len(secrets.BASE)}, s, e FROM spans x
          WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s <= x.s AND x.e <= b.e)),
told AS (SELECT doc_id, {counts}, string_agg(CASE WHEN kind < {len(secrets.BASE)} THEN [{names}][kind + 1] || ':' || s || ':' || e END, ',' ORDER BY s, kind) AS base,
                {listed} AS spans FROM every GROUP BY doc_id)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{name}, 0) AS BIGINT) AS n_{name}" for name, *_ in secrets.BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (doc_id)"""


#: DuckDB SQL of the queries it can express; the others are held against plain versions in tests.
ORACLE_SQL: dict[str, str] = {
    "op8_top_k": _top_k_sql(),
    "op9_secrets": _secrets_sql(),
    "op10_url_filter": _url_sql(),
    "op11_sharding": _sharding_sql(),
    "op12_resampling": _resampling_sql(),
    "op13_divergence": _divergence_sql(),
}
