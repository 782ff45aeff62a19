"""Registered queries of this package and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonecast.llm import (conversation_trie, decontaminate, fill_in_middle, jaccard_join, langid, licenses, packing, pii_crf,
                          quality_rules, setsketch, suffix_dedup, url_templates, warc)
from tonecast.llm.shingles import Similarity

QUERIES = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return keep


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_FORMS)
QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rn, coalesce(text, '') AS t, {_WORDS} AS w, {_LINES} AS l FROM documents),
g AS (SELECT rn, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) > 5),
r AS (SELECT rn, i, count(*) OVER (PARTITION BY rn, array_to_string(list_slice(w, i, i + 4), ' ')) AS n FROM g),
c AS (SELECT rn, least(5, i - coalesce(lag(i) OVER (PARTITION BY rn ORDER BY i), -5)) AS add FROM r WHERE n > 1),
s AS (SELECT rn, sum(add) AS n FROM c GROUP BY rn),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  length(regexp_replace(t, '[\x00-\x7F]+', '', 'g')) AS n_beyond_ascii,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(len(list_filter(w, lambda x: x IN ({_STOP}))) AS BIGINT) AS n_stop_words,
  CAST(coalesce(s.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN s USING (rn)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, concat_ws(',',
  CASE WHEN n_words >= 1 AND (word_chars / greatest(n_words, 1) < 2.0 OR word_chars / greatest(n_words, 1) > 16.0) THEN 'mean_word_length' END,
  CASE WHEN n_words >= 1 AND n_symbols / greatest(n_words, 1) > 0.3 THEN 'symbols' END,
  CASE WHEN n_words >= 50 AND 2 * n_beyond_ascii <= word_chars AND n_stop_words / greatest(n_words, 1) < 0.06 THEN 'stop_words' END,
  CASE WHEN n_words >= 1 AND n_dup_lines / greatest(n_lines, 1) > 0.5 THEN 'dup_lines' END) AS broken_rules FROM m)
"""


@query("op3_quality_rules", QUALITY_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, base_failed, broken_rules,
  (NOT base_failed AND broken_rules = '') AS kept FROM b""")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "n_stop_words", "base_failed", "broken_rules", "kept")


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op1_decontamination", rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {_ALNUM_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, k, k + size - 1), ' ') AS g FROM
  (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT rn, size, k, array_to_string(list_slice(w, k, k + size - 1), ' ') AS g FROM
  (SELECT rn, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
h AS (SELECT rn, size, k, item_id FROM dw JOIN iw USING (size, g)),
hw AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(k, k + size)) AS p FROM h) GROUP BY rn),
hi AS (SELECT rn, count(s) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM
  (SELECT DISTINCT rn, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (rn) LEFT JOIN hi USING (rn)""")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                        table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("hit_items", lambda x: x.cast("string")))
    return judged.select("doc_id", "n_words", "n_hit", "n_items",
                         F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _is(value: str):
    return lambda x: x == value


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_crf.find(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii_spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _is(k))).cast("long").alias(f"n_{k}") for k in pii_crf.KINDS]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"),
                        told(F.col("pii_spans")).alias("spans"))


def _linked_sql(part: int) -> str:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of ``part`` percent."""
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rn, doc_id, {_LOWER_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT rn, md5(array_to_string(list_slice(w, k, k + least(3, len(w)) - 1), ' ')) AS g FROM
  (SELECT rn, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT rn, count(*) AS n FROM s GROUP BY rn),
p AS (SELECT x.rn AS a, y.rn AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.rn <> y.rn GROUP BY x.rn, y.rn),
l AS (SELECT a, b FROM p JOIN n m ON m.rn = a JOIN n o ON o.rn = b WHERE 100 * common >= {part} * (m.n + o.n - common)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(doc_id) AS least FROM r JOIN d ON d.rn = r.b GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(doc_id, c.least), doc_id) AS component_id"""


_LINKED_END = " FROM d LEFT JOIN n USING (rn) LEFT JOIN c ON c.a = d.rn"
_LOWER_WORDS = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


@query("op8_jaccard_join", _linked_sql(90) + _LINKED_END)
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard_join.linked_groups(table(spark, sf_dir, "documents"), sim=Similarity(3, 90, 100))
    return groups.select("doc_id", F.col("size").alias("n_shingles"), "component_id")


@query("op13_setsketch", _linked_sql(85) + ", coalesce(least(doc_id, c.least), doc_id) = doc_id AS kept" + _LINKED_END)
def op13_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = setsketch.near_duplicates(table(spark, sf_dir, "documents"), sim=Similarity(3, 85, 100))
    return groups.select("doc_id", F.col("size").alias("n_shingles"), "component_id",
                         (F.col("doc_id") == F.col("component_id")).alias("kept"))


_HEX = ", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))


@query("op11_fill_in_middle", rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l,
  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, {_HEX} FROM d),
c AS (SELECT *, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS i, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS j,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
    WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
o AS (SELECT *, coalesce(array_to_string(list_slice(l, 1, i), ''), '') AS p, coalesce(array_to_string(list_slice(l, i + 1, j), ''), '') AS m,
  coalesce(array_to_string(list_slice(l, j + 1, len(l)), ''), '') AS s FROM c)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
  AS output_sha256, sha256(t) AS restored_sha256 FROM o""")
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


# CRC-32 of a decimal number, bit by bit
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) FOR i IN range(8)]),
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""


@query("op12_conversation_trie", rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
u AS (SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS code,
  len(list_filter(string_split_regex(text, '[ 	-
]+'), lambda x: x <> '')) AS w FROM t),
o AS (SELECT conv_id, list(code ORDER BY turn NULLS FIRST, code) AS c, list(w ORDER BY turn NULLS FIRST, code) AS w,
  {_CRC} % 4 AS h FROM u GROUP BY conv_id),
r AS (SELECT o.conv_id, list_concat(list_slice(coalesce(b.c, []), 1, o.h), list_slice(o.c, o.h + 1, len(o.c))) AS c,
  list_concat(list_slice(coalesce(b.w, []), 1, o.h), list_slice(o.w, o.h + 1, len(o.w))) AS w
  FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 20),
n AS (SELECT conv_id, d, list_slice(c, 1, d) AS p, CASE WHEN d = 0 THEN 0 ELSE w[d] END AS w, d = len(c) AS done FROM
  (SELECT conv_id, c, w, unnest(range(0, len(c) + 1)) AS d FROM r)),
g AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
  sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE done), '')) AS ends_sha256 FROM n GROUP BY p, d),
k AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1),
f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k USING (p)),
a AS (SELECT list_slice(p, 1, e) AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens
  FROM (SELECT p, n_children, n_convs, w, unnest(range(0, d + 1)) AS e FROM f) GROUP BY 1)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN a USING (p) LEFT JOIN f q ON f.d > 0 AND q.p = list_slice(f.p, 1, f.d - 1)""")
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.build(table(spark, sf_dir, "conversations"))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    model = langid.train(docs.where("NOT held_out AND doc_id IS NOT NULL"))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).select(
        "doc_id", "held_out", "lang_pred", "score", "accepted")


URL_RULES = [url_templates.Rule(False, "net"), url_templates.Rule(True, "example.net", "/en/"),
             url_templates.Rule(False, "example.com", "/de/"), url_templates.Rule(True, "org", "/fr/")]


@query("op7_url_filters")
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_templates.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[{g + 1}] // {d}) % 32 AS INT) + 1, 1)"
    for g in range(8) for d in (32768, 1024, 32, 1))


@query("op6_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS last, list_transform(range(0, 8), lambda i: list_sum(list_transform(range(0, 5),
  lambda j: (strpos('0123456789abcdef', substr(x, CAST(i * 5 + j + 1 AS INT), 1)) - 1) * CAST(pow(16, 4 - j) AS BIGINT)))) AS v FROM s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM m""")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))




@query("op4_suffix_dedup", f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {_LOWER_WORDS} AS w FROM documents),
t AS (SELECT w, min(rn) AS tid, count(*) AS n_copies FROM d WHERE len(w) >= 50 GROUP BY w),
g AS (SELECT tid, k, md5(array_to_string(list_slice(w, k, k + 49), ' ')) AS g FROM (SELECT tid, w, unnest(range(1, len(w) - 48)) AS k FROM t)),
m AS (SELECT g FROM g GROUP BY g HAVING count(DISTINCT tid) > 1),
s AS (SELECT tid, k FROM g JOIN m USING (g) UNION SELECT tid, k FROM (SELECT tid, unnest(range(1, len(w) - 48)) AS k FROM t WHERE n_copies > 1)),
i AS (SELECT tid, k, sum(new) OVER (PARTITION BY tid ORDER BY k) AS run FROM
  (SELECT tid, k, CASE WHEN k - lag(k) OVER (PARTITION BY tid ORDER BY k) <= 50 THEN 0 ELSE 1 END AS new FROM s)),
r AS (SELECT tid, run, min(k) - 1 AS a, max(k) + 49 AS b FROM i GROUP BY tid, run),
x AS (SELECT tid, CAST(sum(b - a) AS BIGINT) AS n_repeated, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM r GROUP BY tid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, n_copies, n_repeated, spans FROM d JOIN t USING (w) JOIN x USING (tid)""")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    repeated = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", "n_copies", repeated.alias("n_repeated"), told.alias("spans"))


def _templates_sql() -> str:
    """A row per template and bigram: number and name of the template, its bigrams, bigram, its occurrences."""
    rows = []
    for number, (name, own) in enumerate(licenses.ordered(licenses.TEMPLATES)):
        rows += [f"({number}, '{name}', {sum(own.values())}, '{a} {b}', {n})" for (a, b), n in sorted(own.items())]
    return ", ".join(rows)


@query("op2_license_scan", rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {_ALNUM_WORDS} AS w FROM documents),
b AS (SELECT rn, p, w[p] || ' ' || w[p + 1] AS g FROM (SELECT rn, w, unnest(range(1, len(w))) AS p FROM d)),
t AS (SELECT * FROM (VALUES {_templates_sql()}) AS x(t, name, n, g, often)),
k AS (SELECT rn, t, name, n, p, g, often, row_number() OVER (PARTITION BY rn, t, g ORDER BY p) AS k FROM b JOIN t USING (g)),
h AS (SELECT k.rn, k.t, k.name, k.n, k.p, coalesce(o.p, 0) AS pushed
  FROM k LEFT JOIN k o ON o.rn = k.rn AND o.t = k.t AND o.g = k.g AND o.k = k.k - k.often),
x AS (SELECT a.rn, a.t, a.name, a.p AS a, e.p + 1 AS e, CAST(2 * sum(CASE WHEN e.pushed < a.p THEN 1 ELSE 0 END) OVER
    (PARTITION BY a.rn, a.t, a.p ORDER BY e.p) AS DOUBLE) / (e.p - a.p + 1 + a.n) AS dice
  FROM h a JOIN h e ON e.rn = a.rn AND e.t = a.t AND e.p >= a.p AND e.p - a.p + 1 <= 1.5 * a.n),
m AS (SELECT * FROM x WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY rn, t, a ORDER BY dice DESC, e) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY dice DESC, e - a DESC, t, a) AS place FROM m),
u AS (SELECT * FROM r WHERE NOT EXISTS
  (SELECT 1 FROM r o WHERE o.rn = r.rn AND o.place < r.place AND o.a <= r.e AND o.e >= r.a)),
a AS (SELECT rn, count(*) AS n_notices, string_agg(DISTINCT name, ',' ORDER BY name) AS names, max(dice) AS best_dice FROM u GROUP BY rn)
SELECT doc_id, coalesce(n_notices, 0) AS n_notices, coalesce(names, '') AS licenses, coalesce(best_dice, 0.0) AS best_dice
FROM d LEFT JOIN a USING (rn)""")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["name"])))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_notices"), F.array_join(names, ",").alias("licenses"),
                        F.coalesce(F.array_max(F.transform("licenses", lambda x: x["dice"])), F.lit(0.0)).alias("best_dice"))
