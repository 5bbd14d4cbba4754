"""One query for each operator over the whole given tables, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm.common import table
from glosswork.plans import scratch_folder, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


@query
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from glosswork.llm.quality_rules import clean_lines

    cleaned = clean_lines(table(spark, folder, "documents").select("doc_id", "text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars"]
    return cleaned.select("doc_id", *counts)


ORACLE["op1_quality_rules"] = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM docs
),
places AS (
  SELECT doc_id, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM cut)
),
repeated AS (SELECT doc_id, p FROM places QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM repeated) GROUP BY doc_id),
judged AS (
  SELECT doc_id, list_filter(lines, lambda x: NOT (
      (length(x) - length(regexp_replace(x, '[#*$%&|<>{}~^=_\\]', '', 'g'))) * 100 > length(x) * 12
      OR (length(x) - length(regexp_replace(x, '[|»›→•·]', '', 'g')) >= 2
          AND (length(x) - length(regexp_replace(x, '[|»›→•·]', '', 'g'))) * 30 >= length(x))
      OR (NOT regexp_matches(x, '\p{Ll}') AND regexp_matches(x, '\p{Lu}{2}') AND regexp_matches(x, '\S\s+\S+\s+\S'))
      OR regexp_matches(x, '[!?]{2,}.*[!?]{2,}')
      OR regexp_matches(x, '(?i)^[^\p{L}]*(all rights reserved|privacy policy|terms of (use|service)|cookie|subscribe|share this|click here|copyright|powered by|enable javascript|lorem ipsum|read more|advertisement)[^.]{0,60}[.]?[^\p{L}]*$')
    )) AS kept_lines FROM cut
),
counted AS (
  SELECT c.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words,
    CAST(length(regexp_replace(array_to_string(kept_lines, chr(10)), '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS kept_chars
  FROM cut c JOIN judged j USING (doc_id) LEFT JOIN covered v USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept_chars,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND kept_chars * 100 >= word_chars * 60 AS kept
FROM counted
"""


@query
def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    from glosswork.llm.chat_format import format_paths, read_formatted, read_loss, threads

    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    formatted = format_paths(threads(turns.unionByName(trap)))
    back = formatted.select(
        F.col("tree").alias("conv_id"),
        "formatted",
        read_formatted(F.col("formatted")).alias("turns"),
        read_loss(F.col("formatted"), F.col("spans")).alias("losses"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLE["op5_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(replace(replace(role, '\', '\\'), '|', '\!')) + 5
                + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 8) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


@query
def op6_wavelet_ids(spark: SparkSession, folder: str) -> DataFrame:
    from glosswork.llm.encoding import encoded
    from glosswork.llm.wavelet import read_shards, write_shards

    documents = table(spark, folder, "documents").select("doc_id", "text")
    tokens = written(encoded(documents, public_tokenizers.path("byte_bpe_50k.json"), "byte", end_id=0), "ids")
    path = scratch_folder(spark, "shards")
    write_shards(tokens, path, planes=16)
    return read_shards(spark, path, digest=True)


@query
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    from glosswork.llm.encoding import encoded
    from glosswork.llm.packing import pack

    documents = table(spark, folder, "documents").select("doc_id", "source", "text")
    tokens = encoded(documents, public_tokenizers.path("word_bpe_49k.json"), "word", end_id=2)
    pieces = pack(written(tokens.withColumn("row", F.monotonically_increasing_id()), "ids"), row="row")
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source"
    )


@query
def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from glosswork.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), width=3, percent=85).drop("key", "text_hash")


ORACLE["op7_near_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
flat AS (SELECT doc_id, unnest(s) AS x FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * m >= 85 * (p.n + q.n - m)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), lowest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN lowest USING (doc_id)
"""


@query
def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from glosswork.llm.secret_scan import KINDS, scan, span_text

    scanned = scan(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS) - 1)
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("bigint")
    return scanned.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


@query
def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from glosswork.llm.decontaminate import leaks

    found = leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.drop("text_hash")


def _remainder(of: int):
    """crc32 of the id as text, divided."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of


@query
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from glosswork.llm.language_id import learn, predict

    documents = table(spark, folder, "documents")
    model = learn(documents.where(_remainder(3) != 1).select("lang", "text"))
    told = predict(documents.select("doc_id", (_remainder(3) == 1).alias("held_out"), "text"), model)
    return told.select("doc_id", "held_out", "lang_pred", "score", F.size("mixture").alias("n_languages"))


@query
def op10_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    from glosswork.llm.quality_model import learn, scored, with_features

    documents = table(spark, folder, "documents").select("doc_id", "text")
    features = written(with_features(documents), "features")
    labels = table(spark, folder, "labels").where(_remainder(5) != 0).select("doc_id", "quality")
    told = scored(features, learn(features, labels))
    return told.select(
        "doc_id", (_remainder(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


@query
def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: a folder for each source and hundred ids, its first document being named as its licence."""
    from glosswork.llm.license_scan import scan

    documents = table(spark, folder, "documents").select("doc_id", "source", "text")
    hundred = F.call_function("div", F.col("doc_id"), F.lit(100)).cast("string")
    name = F.when(F.col("doc_id") % 100 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), hundred, name)
    return scan(documents.withColumn("path", path))


def _crc32_sql(digits: str) -> str:
    """CRC-32 of a text of ASCII characters, bit by bit, in DuckDB SQL."""
    codes = f"list_transform(string_split({digits}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    step = "lambda a, k: xor(a >> 1, CAST(3988292384 AS BIGINT) * (a & 1))"
    zeros = "[CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]"
    return (
        f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), "
        f"lambda crc, code: list_reduce(list_prepend(xor(crc, code), {zeros}), {step})), CAST(4294967295 AS BIGINT))"
    )


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs in all documents; every tenth by the check sum of its id first repeats a stretch of its words up to the end."""
    from glosswork.llm.common import word_list
    from glosswork.llm.periodic_runs import find_runs

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.call_function("div", h, F.lit(10))
    words = table(spark, folder, "documents").select("doc_id", "text", g.alias("g"), (h % 10 == 0).alias("planted"))
    words = words.withColumn("words", F.when(F.col("planted"), word_list(F.col("text"))).otherwise(F.array().cast("array<string>")))
    n = F.size("words").cast("bigint")
    placed = words.withColumn("n", n).withColumn("a", F.when(n > 0, F.col("g") % n))
    placed = placed.withColumn("p", 1 + F.call_function("div", F.col("n") - F.col("a"), 3 + F.col("g") % 8))
    left = F.col("n") - F.col("a")
    stretch = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    times = F.ceil(left / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(stretch, times)), F.lit(1), left.cast("int"))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), " ")
    found = find_runs(placed.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text")))
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short")))
    )
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    told = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), text.alias("lines"), "collapsed")
    length, period = F.col("best.length"), -F.col("best.short")
    return told.select(
        "doc_id",
        "n_runs",
        (-F.col("best.before")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.call_function("div", 1000 * length, period).alias("exponent_milli"),
        F.sha2(F.col("lines"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


ORACLE["op13_periodic_runs"] = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents
), placed AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM docs
), planted AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM placed
), words AS (
  SELECT doc_id, n, i, CASE WHEN a IS NULL OR i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM planted)
), met AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND 2 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM met)
  GROUP BY doc_id, q, island HAVING count(*) >= greatest(q, 12 - q)
), runs AS (
  SELECT * FROM stretches a WHERE NOT EXISTS (
    SELECT 1 FROM stretches b WHERE b.doc_id = a.doc_id AND b.q < a.q AND a.q % b.q = 0 AND b.s <= a.s AND b.s + b.l >= a.s + a.l)
), dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words LEFT JOIN (SELECT *, TRUE AS gone FROM dropped) USING (doc_id, i)
  WHERE gone IS NULL GROUP BY doc_id
), told AS (
  SELECT doc_id, count(*) AS n_runs, arg_max({{'s': s, 'l': l, 'q': q}}, l * 1000000000000 - s * 1000000 - q) AS best,
    string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, CAST(best.l AS BIGINT) AS length, best.q AS period,
  CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM docs LEFT JOIN told USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


@query
def op12_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    from glosswork.llm.mixing import mix

    return mix(table(spark, folder, "documents").select("doc_id", "source", "text")).drop("source")


ORACLE["op12_source_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS lines,
    length(coalesce(text, '')) AS n, length(regexp_replace(coalesce(text, ''), '[0-9#*$%&|<>{}~^=_\\]', '', 'g')) AS plain
  FROM documents
), keyed AS (
  SELECT doc_id, source, size,
    -ln((CAST('0x' || substr(md5('12:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496)
    / greatest(5, 100 - 300 * (n - plain) // greatest(n, 1) - 60 * (len(lines) - len(list_distinct(lines))) // greatest(len(lines), 1)) AS key
  FROM sized
), owned AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS BIGINT)] AS weight, sum(source_size) OVER () AS total FROM owned
), ordered AS (
  SELECT *, row_number() OVER ranked AS place, total - coalesce(sum(3 * source_size) OVER (ranked ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains,
    sum(weight) OVER (ranked ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS parts
  FROM weighed WINDOW ranked AS (ORDER BY 3 * source_size / weight, source IS NULL, source)
), open AS (SELECT min(place) AS first, arg_min(remains, place) AS remains, arg_min(parts, place) AS parts FROM ordered WHERE weight * remains <= 3 * source_size * parts
), aimed AS (
  SELECT source, source_size, CASE WHEN place < first THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight * open.remains AS DOUBLE) / CAST(open.parts AS DOUBLE) END AS target
  FROM ordered, open
), budgets AS (SELECT *, CAST(least(floor(target + 0.5), 3 * source_size) AS BIGINT) AS budget FROM aimed
), joined AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, CASE WHEN b.source_size > 0 THEN budget // b.source_size ELSE 0 END AS epochs, budget,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source
), cut AS (SELECT *, CAST(greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS part FROM joined)
SELECT doc_id, size, source_size, target, epochs, part, CAST(epochs * size + part AS BIGINT) AS taken FROM cut
"""


@query
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The trie of all conversations, each rebuilt to begin like the first one of its hundred."""
    from glosswork.llm.prefix_trie import numbered_turns, prefix_trie
    from glosswork.plans import hot_lookup

    turns = written(numbered_turns(table(spark, folder, "conversations")), "numbered")
    sizes = written(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own")), "sizes")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    convs = sizes.select("conv_id", "n_own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    lead = F.least(F.col("h"), F.coalesce("n_base", F.lit(0)))
    convs = convs.join(bases, "base", "left").withColumn("lead", lead)
    convs = written(convs.withColumn("length", F.col("lead") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))), "convs")
    kept = hot_lookup(turns, convs.withColumn("rows", F.col("n_own")).drop("base", "n_base"), ["conv_id"], ["place"]).where("place > h")
    kept = kept.select("conv_id", (F.col("lead") + F.col("place") - F.col("h")).alias("place"), "digest", "chars", "length")
    heads = turns.where("conv_id % 100 = 0 AND place <= 5").withColumnRenamed("conv_id", "base")
    heads = heads.join(convs.select("conv_id", "base", "lead", "length"), "base").where("place <= lead")
    return prefix_trie(kept.unionByName(heads.select(*kept.columns)), convs.select("conv_id", "length"))


ORACLE["op11_prefix_trie"] = rf"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, count(*) AS n_own, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h, conv_id - conv_id % 100 AS base FROM own GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, o.place, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base WHERE o.place <= c.h
  UNION ALL
  SELECT o.conv_id, o.place - c.h + least(c.h, coalesce(b.n_own, 0)), o.role, o.text
  FROM own o JOIN convs c USING (conv_id) LEFT JOIN convs b ON b.conv_id = c.base WHERE o.place > c.h
), chain AS (
  SELECT conv_id, place AS depth, length(text) AS chars, count(*) OVER (PARTITION BY conv_id) AS length,
    md5(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY place)) AS prefix
  FROM rebuilt
  UNION ALL SELECT c.conv_id, 0, 0, (SELECT count(*) FROM rebuilt r WHERE r.conv_id = c.conv_id), '' FROM convs c
), nodes AS (
  SELECT depth, prefix, min(conv_id) AS m, count(*) AS n, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends
  FROM chain GROUP BY depth, prefix
), met AS (SELECT c.conv_id, depth, m FROM chain c JOIN nodes USING (depth, prefix)
), hung AS (SELECT x.*, p.m AS up FROM nodes x LEFT JOIN met p ON p.conv_id = x.m AND p.depth = x.depth - 1
), children AS (SELECT up AS m, depth - 1 AS depth, count(*) AS n_children FROM hung WHERE depth > 0 GROUP BY 1, 2
), full_nodes AS (SELECT h.*, coalesce(n_children, 0) AS n_children FROM hung h LEFT JOIN children USING (m, depth)
), below AS (
  SELECT a.m, a.depth, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n - 1) * x.chars) AS saved
  FROM full_nodes x JOIN met a ON a.conv_id = x.m AND a.depth <= x.depth GROUP BY a.m, a.depth
)
SELECT m AS conv_id, depth, up AS parent_conv_id, n AS n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256 FROM full_nodes JOIN below USING (m, depth)
"""
