"""The operators' registered queries, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sameas.llm import (byte_bpe, conversation_repair, embedding_dedup, impact_search, language_crf, line_dedup, lz_fingerprint,
                        mixing, quality, simhash, spelling, token_counts, toxicity)
from sameas.llm.packing import fold_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select("doc_id")
    scored = quality.score_quality(docs, quality.fit_quality(docs, trusted, held_out=2, folds=4), threshold=0.7)
    return scored.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), held_out=0, folds=5)
    scored = toxicity.score_toxicity(docs, model, threshold=0.5)
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted",
                         F.col("language").alias("threshold_of"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), limit=4096).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_crf.fit_languages(docs.select("doc_id", "text", "lang"), held_out=2, folds=4)
    return language_crf.identify_languages(docs, model).select(
        "doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "n_switches")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_repeated_lines(docs)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), width=3, bits=2).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op10_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.top_matches(table(spark, sf_dir, "embeddings"), queries="id % 50 = 0", k=5)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(conversation_repair.damage(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_toxicity, op3_token_counts, op4_language, op5_line_dedup, op6_simhash,
                            op7_byte_bpe, op8_mixing, op9_embedding_dedup, op10_lz_fingerprint, op11_impact_search, op12_spelling,
                            op13_conversation_repair)}

# crc32 of UTF-8 text: a table by rule, then a step for every byte of the hex text `h`.
CRC_TABLE = """bits AS (SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT CAST(unnest(range(0, 256)) AS BIGINT) AS i)),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits)"""
CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) FOR i IN range(0, len(h) // 2)]),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"""


def _repair_sql() -> str:
    """The cheapest edits by a table that grows forward row by row: for the state after no
    role, system, user or assistant (s1 to s4) the least (cost, letters, lines)."""
    def to(state: str, cost: str, letter: str, line: str | None = None, when: str = "true") -> str:
        lines = f"{state}.t" if line is None else f"{state}.t || chr(10) || {line}"
        return f"CASE WHEN {when} AND {state} IS NOT NULL THEN struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letter}', t := {lines}) END"

    insert = lambda state, role: to(state, "5", "I", f"'{role}:'")
    least = lambda *options: "list_min([" + ", ".join(options) + "])"
    opened = least("s3", insert("s1", "user"), insert("s2", "user"), insert("s4", "user"))
    drop = lambda state: to(state, "2", "D")
    extra = "(CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END)"
    able = "fault NOT IN ('blank', 'duplicate')"
    keep = lambda state, initial: to(state, extra, "K", "role || ':' || text", f"{able} AND initial = '{initial}'")
    rerole = lambda state, role: to(state, f"(1 + {extra})", "R", f"'{role}:' || text", able)
    before_user = ("s1", "s2", "s4")
    with_inserts = f"SELECT * REPLACE ({least('s4', insert('s3', 'assistant'))} AS s4) FROM (SELECT * REPLACE ({opened} AS s3) FROM %s)"
    moved = ", ".join([drop("s1") + " AS s1", least(drop("s2"), keep("s1", "s")) + " AS s2",
                       least(drop("s3"), *[keep(x, "u") for x in before_user], *[rerole(x, "user") for x in before_user]) + " AS s3",
                       least(drop("s4"), keep("s3", "a"), rerole("s3", "assistant")) + " AS s4"])
    return f"""
WITH RECURSIVE {CRC_TABLE},
keyed AS (SELECT *, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
fated AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC} % 20 AS fate FROM keyed, tab),
damaged AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
  CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(0, CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS nth FROM fated),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), nth) AS n,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
judged AS (SELECT *, left(role, 1) AS initial, CASE WHEN bare = '' THEN 'blank' WHEN n > min(n) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
  WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS two FROM placed),
step AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, struct_pack(c := CAST(0 AS BIGINT), a := '', t := '') AS s1, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS s2,
    CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS s3, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS s4 FROM (SELECT DISTINCT conv_id FROM judged)
  UNION ALL
  SELECT conv_id, n, {moved} FROM ({with_inserts % "(SELECT step.conv_id, judged.n, s1, s2, s3, s4, role, text, fault, initial FROM step JOIN judged ON judged.conv_id IS NOT DISTINCT FROM step.conv_id AND judged.n = step.n + 1)"})),
ended AS (SELECT conv_id, {least("s1", "s4")} AS s FROM ({with_inserts % "(SELECT * FROM step QUALIFY n = max(n) OVER (PARTITION BY conv_id))"})),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
  count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(s.c, 0) AS BIGINT) AS cost, coalesce(s.a, '') AS audit, sha256(substr(coalesce(s.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM e.conv_id
"""


BARE = "trim(x, ' ' || chr(9) || chr(13))"
ORACLE: dict[str, str] = {
    "op5_line_dedup": f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
k AS (SELECT source, unnest(list_distinct(list_filter([{BARE} FOR x IN ls], lambda x: x <> ''))) AS line FROM d),
n AS (SELECT source, count(*) AS total FROM d GROUP BY source),
c AS (SELECT source, line, count(*) AS pages FROM k GROUP BY source, line),
bad AS (SELECT c.source, list(c.line) AS bad FROM c JOIN n ON c.source = n.source
  WHERE c.pages >= {line_dedup.LEAST_PAGES} AND c.pages > CAST({line_dedup.RATIO} AS DOUBLE) * n.total GROUP BY c.source),
f AS (SELECT d.*, bad, list_filter(ls, lambda x: NOT list_contains(bad, {BARE})) AS kept FROM d LEFT JOIN bad ON d.source = bad.source)
SELECT doc_id, source, CASE WHEN bad IS NULL OR text IS NULL THEN text ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text,
  CAST(CASE WHEN bad IS NULL OR text IS NULL THEN 0 ELSE len(ls) - len(kept) END AS BIGINT) AS lines_dropped FROM f
""",
    "op11_impact_search": """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(256 * CAST(x AS DOUBLE)))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum([coalesce(x[1] * x[2], 0) FOR x IN list_zip(q.e, c.e)]), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op13_conversation_repair": _repair_sql(),
    "op12_spelling": f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL),
coded AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs),
marked AS (SELECT run, n, {CRC} AS crc FROM coded, tab),
counted AS (SELECT CASE WHEN crc % {spelling.DAMAGED} = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM marked),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY word HAVING length(word) >= {spelling.LEAST_LETTERS} AND sum(n) >= {spelling.LEAST_COUNT}),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (SELECT word, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM places),
near AS (SELECT a.word, b.word AS other FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT h.word, w.word FROM holes h JOIN words w ON h.less = w.word UNION SELECT w.word, h.word FROM holes h JOIN words w ON h.less = w.word),
rated AS (SELECT near.word, count(*) AS n_near, arg_min(other, (-w.n, other)) AS best, max(w.n) AS best_n FROM near JOIN words w ON w.word = other GROUP BY near.word),
formed AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {spelling.RATIO} * words.n THEN best END AS form,
  CASE WHEN best_n >= {spelling.RATIO} * words.n THEN best_n END AS form_n FROM words LEFT JOIN rated USING (word)),
way AS (SELECT word, coalesce(form, word) AS root FROM formed UNION SELECT way.word, f.form FROM way JOIN formed f ON f.word = way.root WHERE f.form IS NOT NULL),
last AS (SELECT way.word, arg_max(root, f.n) AS root FROM way JOIN formed f ON f.word = way.root GROUP BY way.word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN last USING (word)
""",
    "op8_mixing": f"""
WITH RECURSIVE s AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 0.5) AS w FROM documents GROUP BY source),
u AS (SELECT source, (n + {mixing.BLOCK_ROWS - 1}) // {mixing.BLOCK_ROWS} AS blocks, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place,
  greatest(1, CAST(floor(w / max(w) OVER () * {mixing.UNITS} / count(*) OVER () + 0.5) AS BIGINT)) AS units FROM s),
t AS (SELECT CAST(sum(units) AS HUGEINT) AS total, CAST(greatest({mixing.PERIOD}, count(*)) AS HUGEINT) AS p FROM u),
m AS (SELECT CAST(max((blocks * total + units * p - 1) // (units * p)) AS BIGINT) AS periods FROM u, t),
b AS (SELECT k, place, units, blocks, (k * p * units) // total AS low, (k * p * units) % total AS rest, p
  FROM u, t, (SELECT unnest(range(0, periods + 1)) AS k FROM m)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rest DESC, place) AS nth, k * p - sum(low) OVER (PARTITION BY k) AS spare FROM b),
q AS (SELECT k, place, units, blocks, low + CASE WHEN nth <= spare THEN 1 ELSE 0 END AS quota FROM r),
f AS (SELECT e.k AS frame, e.place, e.units, o.quota AS first, least(e.quota, e.blocks) - o.quota AS n,
    o.quota * total - (e.k - 1) * p * e.units AS owed
  FROM q e JOIN q o ON e.place = o.place AND e.k = o.k + 1, t WHERE least(e.quota, e.blocks) > o.quota),
w AS (SELECT frame, place, first, n, [struct_pack(rel := CAST((owed + i * total - ((owed + i * total) % units + units) % units) // units AS BIGINT),
    due := CAST((owed + (i + 1) * total + ((-owed - (i + 1) * total) % units + units) % units) // units AS BIGINT))
    FOR i IN range(0, CAST(n AS BIGINT))] AS win FROM f, t),
a AS (SELECT frame, list(struct_pack(place := place, first := CAST(first AS BIGINT), n := CAST(n AS BIGINT), win := win) ORDER BY place) AS src,
  CAST(sum(n) AS BIGINT) AS every FROM w GROUP BY frame),
step AS (
  SELECT frame, src, every, CAST(-1 AS BIGINT) AS slot, [CAST(0 AS BIGINT) FOR x IN src] AS done, CAST(NULL AS BIGINT) AS pick FROM a
  UNION ALL
  SELECT frame, src, every, slot + 1, [done[i] + CASE WHEN i = go THEN 1 ELSE 0 END FOR i IN range(1, len(src) + 1)], go
  FROM (SELECT *, CASE WHEN best.early = 0 OR every - list_sum(done) >= p - (slot + 1) THEN best.i END AS go
    FROM (SELECT *, list_min([CASE WHEN done[i] < src[i].n THEN struct_pack(early := CASE WHEN src[i].win[done[i] + 1].rel > slot + 1 THEN 1 ELSE 0 END,
        due := src[i].win[done[i] + 1].due, i := i) END FOR i IN range(1, len(src) + 1)]) AS best FROM step, t WHERE slot < p - 1))),
g AS (SELECT src[pick].place AS place, src[pick].first + done[pick] - 1 AS block, CAST((frame - 1) * p + slot AS BIGINT) AS mix_slot
  FROM step, t WHERE pick IS NOT NULL),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS num
  FROM documents)
SELECT d.doc_id, d.source, CAST(num // {mixing.BLOCK_ROWS} AS BIGINT) AS mix_block, g.mix_slot, CAST(num % {mixing.BLOCK_ROWS} AS BIGINT) AS mix_row
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source JOIN g ON g.place = u.place AND g.block = num // {mixing.BLOCK_ROWS}
""",
}
