"""Every operator as a query over the given tables, with its SQL where SQL can
state it. Doubles are rounded to six places on both sides."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sameas.functions import text as X, vectors as V
from sameas.operators import candidates as C, graph as G, matching as D, metrics as M, sampling as S, serialize as P
from sameas.operators.copies import top_k
from sameas.operators.editdistance import levenshtein_nearest
from sameas.operators.knn import knn_embedding
from sameas.operators.tfidf import knn_tfidf
from sameas.plans import runs
from sameas.plans.tasks import Tasks, encode_sql, hash_number_sql, knn_between_sql, knn_sql, tfidf_sql, with_views
from sameas.session import ensure_checkpoint_dir
from sameas.sources import entities, pairs, results

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PAIR = ["a_id", "b_id"]
K = 5


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tasks], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tasks(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c) if t == "double" else c for c, t in df.dtypes])


def near_passages(t: Tasks, k: int = K) -> DataFrame:
    return knn_tfidf(t.passages, t.documents, k)


def decided_orgs(t: Tasks) -> DataFrame:
    return t.scored_orgs.withColumn("pred", V.decide(F.col("score"), 0.65))


def option_scores(t: Tasks) -> DataFrame:
    """Scored pairs under 2 x 2 x 2 options, data = market segment."""
    shift = F.when(F.col("model") == "m2", 0.9).otherwise(1.0) - F.when(F.col("order_cols"), 0.05).otherwise(0.0) \
        - F.when(F.col("remove_col_names"), 0.1).otherwise(0.0)
    options = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(o).alias("order_cols"), F.lit(r).alias("remove_col_names"))
                        for m in ("m1", "m2") for o in (False, True) for r in (False, True)])
    wide = t.scored_orgs.select(F.col("segment").alias("data"), "y", "score", F.inline(options))
    return wide.withColumn("score", F.col("score") * shift)


CONFIG = ["data", "model", "order_cols", "remove_col_names"]

# ---------------------------------------------------------------- SQL pieces
PASSAGES = with_views("passages", "docs", "gold_passages") + ",\n" + tfidf_sql("passages", "docs", K)
DECIDED = with_views("scored_orgs") + ", decided AS (SELECT *, CAST(score > 0.65e0 AS INTEGER) AS pred FROM scored_orgs)"
COUNTS = """CAST(count(*) FILTER (WHERE y = 1 AND pred = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE y <> 1 AND pred = 1) AS BIGINT) AS fp,
CAST(count(*) FILTER (WHERE y = 1 AND pred <> 1) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE y <> 1 AND pred <> 1) AS BIGINT) AS tn"""
RATES = """round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""
GRID = with_views("scored_orgs") + f""", grid AS (SELECT segment AS data, model, order_cols, remove_col_names, y,
  CAST(score * ((CASE WHEN model = 'm2' THEN 0.9e0 ELSE 1e0 END) - (CASE WHEN order_cols THEN 0.05e0 ELSE 0e0 END) - (CASE WHEN remove_col_names THEN 0.1e0 ELSE 0e0 END)) > 0.65e0 AS INTEGER) AS pred
  FROM scored_orgs, (VALUES ('m1'), ('m2')) m(model), (VALUES (false), (true)) o(order_cols), (VALUES (false), (true)) q(remove_col_names)),
summary AS (SELECT data, model, order_cols, remove_col_names, tp, fp, fn, tn, {RATES} FROM (SELECT data, model, order_cols, remove_col_names, {COUNTS} FROM grid GROUP BY ALL))"""
STRONG = with_views("strong_trades")
CLUSTERS = STRONG + """, links AS (SELECT 'a:' || a_id AS u, 'b:' || b_id AS v FROM strong_trades UNION SELECT 'b:' || b_id, 'a:' || a_id FROM strong_trades),
reach AS (SELECT u AS id, u AS other FROM links UNION SELECT r.id, l.v FROM reach r JOIN links l ON r.other = l.u),
clusters AS (SELECT id, min(other) AS cluster_id FROM reach GROUP BY id)"""
SPLIT_OF = """CASE WHEN {rank} <= floor(0.7e0 * {n}) THEN 'train' WHEN {rank} <= floor(0.7e0 * {n}) + floor(0.15e0 * {n}) THEN 'val' ELSE 'test' END"""
COMPONENT_SPLIT = CLUSTERS + """, shuffled AS (SELECT cluster_id, row_number() OVER (ORDER BY md5(concat_ws(':', '42', cluster_id)), cluster_id) AS rank FROM (SELECT DISTINCT cluster_id FROM clusters)),
positives AS (SELECT a_id, b_id, cluster_id, """ + SPLIT_OF.format(rank="rank", n="(SELECT count(*) FROM shuffled)") + """ AS split
  FROM strong_trades JOIN clusters ON id = 'a:' || a_id JOIN shuffled USING (cluster_id))"""
NEGATIVES = COMPONENT_SPLIT + f""", ends AS (SELECT split, b_id, row_number() OVER (PARTITION BY split ORDER BY md5(concat_ws(':', '42', b_id)), b_id) AS rank
  FROM (SELECT DISTINCT split, b_id FROM positives)),
sizes AS (SELECT split, count(*) AS size FROM ends GROUP BY split),
own AS (SELECT split, a_id, count(*) AS own FROM positives GROUP BY split, a_id),
walks AS (SELECT split, a_id, own, {hash_number_sql("'42'", "split", "a_id")} % size AS place, size FROM own JOIN sizes USING (split)),
met AS (SELECT w.split, w.a_id, e.b_id, own, (e.rank - 1 - place + size) % size AS step FROM walks w JOIN ends e USING (split)
  WHERE NOT EXISTS (SELECT 1 FROM positives p WHERE p.split = w.split AND p.a_id = w.a_id AND p.b_id = e.b_id)),
negatives AS (SELECT a_id, b_id, split FROM (SELECT *, row_number() OVER (PARTITION BY split, a_id ORDER BY step) AS n FROM met) WHERE n <= 2 * own)"""


def closing(rounds: int) -> str:
    """m0 = matches, add_i = pairs of round i, m_i = all up to round i."""
    out = ["m0 AS (SELECT a_id, b_id FROM strong_trades)"]
    for i in range(1, rounds + 1):
        out.append(f"""add{i} AS (SELECT DISTINCT c.a_id, c.b_id FROM m{i-1} e12 JOIN m{i-1} e32 ON e32.b_id = e12.b_id
  JOIN m{i-1} e34 ON e34.a_id = e32.a_id JOIN trades c ON c.a_id = e12.a_id AND c.b_id = e34.b_id
  WHERE NOT EXISTS (SELECT 1 FROM m{i-1} k WHERE k.a_id = c.a_id AND k.b_id = c.b_id)),
m{i} AS (SELECT * FROM m{i-1} UNION ALL SELECT * FROM add{i})""")
    return ", ".join(out)


ROUNDS = 6
CLOSED = STRONG + ", " + closing(ROUNDS)
SWEEP = """sweep AS (SELECT threshold, tp, fp, fn, tn, {rates} FROM (SELECT threshold, {counts}
  FROM (SELECT i / 99e0 AS threshold, y, CAST(score > i / 99e0 AS INTEGER) AS pred FROM {source}, range(0, 100) r(i)) GROUP BY threshold))"""
SWEEP_ORGS = with_views("scored_orgs") + ", " + SWEEP.format(rates=RATES, counts=COUNTS, source="scored_orgs")
ROC = """sums AS (SELECT score, sum(y) AS pos, count(*) - sum(y) AS neg FROM {source} GROUP BY score),
curve AS (SELECT score AS threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp FROM sums WINDOW w AS (ORDER BY score DESC)
  UNION ALL SELECT NULL, 0, 0),
roc AS (SELECT threshold, tp, fp, tp / (SELECT sum(y) FROM {source})::DOUBLE AS tpr, fp / (SELECT count(*) - sum(y) FROM {source})::DOUBLE AS fpr FROM curve)"""
AUC = """(SELECT round((sum(CASE WHEN y = 1 THEN r ELSE 0e0 END) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * (count(*) - sum(y)))::DOUBLE, 6)
  FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS r FROM {source}))"""
BLOCKING = """n_candidates, n_found, n_gold, round(1 - n_candidates / space, 6) AS reduction_ratio, round(n_found / n_gold, 6) AS recall,
round(2 * (1 - n_candidates / space) * (n_found / n_gold) / nullif((1 - n_candidates / space) + n_found / n_gold, 0), 6) AS f1"""


# ---------------------------------------------------------------- sources
@query("read_entities", "SELECT p_partkey AS id, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def _(t): return entities.read_entities(t.spark, f"{t.sf_dir}/part.parquet", "p_partkey")


@query("gold_pairs", with_views("gold_products") + " SELECT * FROM gold_products")
def _(t): return t.gold_products


@query("split_pairs", with_views("gold_orgs") + f""", ranked AS (SELECT a_id, b_id, matching, row_number() OVER (ORDER BY md5(concat_ws(':', '42', a_id, b_id)), a_id, b_id) AS rank FROM gold_orgs)
SELECT a_id, b_id, matching, {SPLIT_OF.format(rank='rank', n='(SELECT count(*) FROM ranked)')} AS split FROM ranked""")
def _(t): return pairs.split_gold(t.gold_orgs, None, None)


@query("export_candidates", with_views("vectors") + ", " + knn_sql(K) +
       " SELECT a_id, string_agg(CAST(b_id AS VARCHAR), ',' ORDER BY b_id) AS b_ids FROM near_vector GROUP BY a_id")
def _(t): return pairs.candidate_lines(knn_embedding(t.vectors, t.vectors, K, same_table=True))


@query("scored_pairs", with_views("trades") + " SELECT a_id, b_id, score FROM trades")
def _(t): return t.trades.select(*PAIR, "score")


@query("export_results", with_views("trades") + ' SELECT a_id AS "Entity A", b_id AS "Entity B", score AS "Score" FROM trades')
def _(t): return results.export_form(t.trades)


@query("result_dataset_name", """WITH f AS (SELECT regexp_extract('results_' || source || '_' || lang || '.csv', '^results_(.+)\\.csv$', 1) AS n FROM documents)
SELECT CASE WHEN n IN ('src0_en', 'src1_de', 'src2_fr') THEN n END AS dataset, count(*) AS n FROM f GROUP BY 1""")
def _(t):
    name = F.concat(F.lit("out/results_"), "source", F.lit("_"), "lang", F.lit(".csv"))
    known = ["src0_en", "src1_de", "src2_fr"]
    return t.table("documents").groupBy(results.dataset_name(name, known).alias("dataset")).agg(F.count(F.lit(1)).alias("n"))


@query("grid_pending", GRID + " SELECT DISTINCT data, model, order_cols, remove_col_names FROM grid WHERE (data, model) NOT IN (SELECT data, model FROM summary WHERE f1 >= 0.07)")
def _(t):
    scored = option_scores(t)
    done = M.grid_summary(scored, CONFIG).filter(F.round("f1", 6) >= 0.07)
    return results.pending(scored.select(*CONFIG).distinct(), done, ["data", "model"])


# ---------------------------------------------------------------- projections
@query("resolve_pairs", """SELECT DISTINCT l_suppkey AS a_id, l_partkey AS b_id, l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_partkey IN (SELECT c_custkey FROM customer) AS resolved FROM lineitem""")
def _(t):
    named = t.table("lineitem").select(F.col("l_suppkey").alias("a_id"), F.col("l_partkey").alias("b_id")).distinct()
    return pairs.resolve_pairs(named, t.suppliers, t.customers)


@query("drop_columns", with_views("customers") + " SELECT id, name, nation, balance FROM customers")
def _(t): return P.drop_columns(t.customers, ["segment", "no_such_column"])


def widths_sql(table: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS name, CAST(max(length(coalesce(CAST({n} AS VARCHAR), 'nan'))) AS INTEGER) AS width FROM {table}" for n in names)


@query("schema_compare", with_views("suppliers", "customers") + f""", wa AS ({widths_sql('suppliers', ['name', 'nation', 'balance'])}),
wb AS ({widths_sql('customers', ['name', 'nation', 'balance', 'segment'])})
SELECT n.name, n.in_a, n.in_b, n.pos_a, n.pos_b, wa.width AS width_a, wb.width AS width_b
FROM (VALUES ('name', true, true, 1, 1), ('nation', true, true, 2, 2), ('balance', true, true, 3, 3), ('segment', false, true, NULL, 4)) n(name, in_a, in_b, pos_a, pos_b)
LEFT JOIN wa ON wa.name = n.name LEFT JOIN wb ON wb.name = n.name""")
def _(t):
    wa = P.column_widths(t.suppliers).withColumnRenamed("width", "width_a")
    wb = P.column_widths(t.customers).withColumnRenamed("width", "width_b")
    return P.schema_compare(t.suppliers, t.customers).join(wa, "name", "left").join(wb, "name", "left")


@query("column_widths", with_views("customers") + " " + widths_sql("customers", ["name", "nation", "balance", "segment"]))
def _(t): return P.column_widths(t.customers)


TAGGED = "concat('[COL] name [VAL] ', {t}.name, ' [COL] nation [VAL] ', {t}.nation, ' [COL] balance [VAL] ', {t}.balance)"


@query("serialize_tagged", with_views("customers") + " SELECT id, concat(" + TAGGED.format(t="customers") + ", ' [COL] segment [VAL] ', segment) AS text FROM customers")
def _(t): return P.serialize(t.customers)


@query("serialize_values", with_views("customers") + " SELECT id, concat_ws(' ', name, nation, balance, segment) AS text FROM customers")
def _(t): return P.serialize(t.customers, column_names=False)


@query("serialize_ordered", with_views("suppliers", "customers") + """
SELECT 'a' AS side, id, concat_ws(' ', nation, balance, name) AS text FROM suppliers UNION ALL
SELECT 'b', id, concat_ws(' ', nation, balance, segment, name) FROM customers""")
def _(t):
    a, b = runs.prepare(t.suppliers, t.customers, order=True)
    return a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))


@query("serialize_pair", with_views("strong_trades", "suppliers", "customers") + " SELECT a_id, b_id, concat(" + TAGGED.format(t="a") + ", ' [SEP] ', " +
       TAGGED.format(t="b") + ", ' [COL] segment [VAL] ', segment) AS text FROM strong_trades JOIN suppliers a ON a.id = a_id JOIN customers b ON b.id = b_id")
def _(t): return P.serialize_pairs(t.strong_trades, P.serialize(t.suppliers), P.serialize(t.customers))


@query("deserialize", with_views("customers") + " " + " UNION ALL ".join(
    f"SELECT id, '{c}' AS key, CAST({c} AS VARCHAR) AS value FROM customers" for c in ("name", "nation", "balance", "segment")))
def _(t): return P.deserialize(P.serialize(t.customers)).select("id", F.explode("entity_a"))


@query("pair_texts", with_views("gold_products", "product_texts") + """ SELECT a_id, b_id, matching, split, a.text AS a_text, b.text AS b_text
FROM gold_products JOIN product_texts a ON a.id = a_id JOIN product_texts b ON b.id = b_id""")
def _(t): return P.pair_texts(t.gold_products, t.product_texts, t.product_texts)


@query("get_entity", with_views("customers") + " SELECT * FROM customers WHERE id = 12")
def _(t): return P.get_entity(t.customers, 12)


@query("label_norm", """SELECT doc_id, CASE WHEN quality = 1 THEN 1 WHEN toxic = 1 THEN NULL ELSE 0 END AS matching FROM labels""")
def _(t):
    raw = F.when(F.col("quality") == 1, "True").when(F.col("toxic") == 1, "unsure").otherwise("0")
    return pairs.label_norm(t.table("labels").select("doc_id", raw.alias("matching")))


@query("threshold_matches", DECIDED + " SELECT a_id, b_id, score, pred FROM decided")
def _(t): return decided_orgs(t).select(*PAIR, "score", "pred")


@query("search_entities", with_views("passages", "docs") + """ (SELECT 'a' AS side, id, text FROM passages WHERE contains(text, 'the ') ORDER BY id LIMIT 10)
UNION ALL (SELECT 'b', id, text FROM docs WHERE contains(text, 'tion ') ORDER BY id LIMIT 10)""")
def _(t):
    a, b = P.search_entities(t.passages, "the "), P.search_entities(t.documents, "tion ")
    return a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))


@query("append_labels", with_views("gold_products") + " SELECT a_id, b_id, CASE WHEN split = 'val' THEN 1 ELSE matching END AS label FROM gold_products")
def _(t):
    labelled = t.gold_products.withColumnRenamed("matching", "label")
    return pairs.append_labels(labelled, t.gold_products.filter(F.col("split") == "val"), 1)


@query("column_preview", with_views("customers") + ", f AS (SELECT * FROM customers ORDER BY id LIMIT 1) " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS example FROM f" for c in ("name", "nation", "balance", "segment")))
def _(t): return P.column_preview(t.customers)


@query("pair_preview", with_views("gold_products", "product_texts") + """, few AS (SELECT * FROM gold_products ORDER BY a_id, b_id LIMIT 20)
SELECT a_id, b_id, matching, a.text AS a_text, b.text AS b_text FROM few JOIN product_texts a ON a.id = a_id JOIN product_texts b ON b.id = b_id""")
def _(t): return P.pair_texts(t.gold_products.orderBy(*PAIR).limit(20).drop("split"), t.product_texts, t.product_texts)


@query("entity_diff", with_views("strong_trades", "suppliers", "customers") + ", p AS (SELECT a_id, b_id, a, b FROM strong_trades JOIN suppliers a ON a.id = a_id JOIN customers b ON b.id = b_id) " + " UNION ALL ".join(
    [f"SELECT a_id, b_id, '{c}' AS feature, 'common' AS part, CAST(a.{c} AS VARCHAR) AS a_value, CAST(b.{c} AS VARCHAR) AS b_value FROM p" for c in ("name", "nation", "balance")]
    + ["SELECT a_id, b_id, 'segment', 'only b', NULL, b.segment FROM p"]))
def _(t): return P.entity_diff(t.strong_trades, t.suppliers, t.customers)


@query("example_pairs", DECIDED + """, n AS (SELECT *, row_number() OVER (PARTITION BY pred ORDER BY a_id, b_id) AS n FROM decided),
o AS (SELECT a_id, b_id, y, pred, row_number() OVER (ORDER BY n > CASE WHEN pred = 1 THEN 3 ELSE 2 END, pred DESC, n) AS place FROM n WHERE n <= 5)
SELECT a_id, b_id, y, pred, CAST(place AS INTEGER) AS place FROM o WHERE place <= 5""")
def _(t): return M.example_pairs(decided_orgs(t).select(*PAIR, "y", "pred"))


# ---------------------------------------------------------------- candidates
NEAR = " SELECT a_id, b_id, '{source}' AS source, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM {view}"


@query("knn_embedding", with_views("vectors") + ", " + knn_sql(K) + NEAR.format(source="embedding", view="near_vector"))
def _(t): return rounded(knn_embedding(t.vectors, t.vectors, K, same_table=True))


@query("knn_tfidf", PASSAGES + NEAR.format(source="tfidf", view="near_text"))
def _(t): return rounded(near_passages(t))


@query("knn_tfidf_l2", PASSAGES + " SELECT a_id, b_id, CAST(rank AS INTEGER) AS rank, round(sqrt(greatest(2 - 2 * score, 0)), 6) AS distance FROM near_text")
def _(t):
    near = knn_tfidf(t.passages, t.documents, K, metric="l2")
    return near.select(*PAIR, "rank", F.round("score", 6).alias("distance"))


@query("levenshtein_nearest", with_views("product_texts") + """ SELECT a_id, arg_min(b_id, (d, b_id)) AS b_id, CAST(min(d) AS INTEGER) AS distance
FROM (SELECT a.id AS a_id, b.id AS b_id, levenshtein(a.text, b.text) AS d FROM product_texts a JOIN product_texts b ON a.id <> b.id) GROUP BY a_id""")
def _(t): return levenshtein_nearest(t.product_texts, t.product_texts, same_table=True)


MERGED = PASSAGES + ", merged AS (SELECT a_id, b_id, string_agg(source, '+' ORDER BY source) AS sources FROM (SELECT a_id, b_id, 'tfidf' AS source FROM near_text UNION SELECT a_id, b_id, 'sentence' FROM gold_passages) GROUP BY 1, 2)"


def merged_passages(t: Tasks) -> DataFrame:
    return C.merge_candidates(near_passages(t), t.gold_passages.withColumn("source", F.lit("sentence")))


@query("merge_candidates", MERGED + " SELECT * FROM merged")
def _(t): return merged_passages(t).withColumn("sources", F.array_join("sources", "+"))


@query("blocker_overlap", MERGED + " SELECT sources, count(*) AS n_pairs FROM merged GROUP BY sources")
def _(t): return C.blocker_overlap(merged_passages(t))


@query("explode_candidates", with_views("vectors") + ", " + knn_sql(K) + " SELECT a_id, b_id FROM near_vector")
def _(t): return C.explode_lists(C.neighbour_lists(knn_embedding(t.vectors, t.vectors, K, same_table=True)))


@query("label_candidates", PASSAGES + " SELECT a_id, b_id, coalesce(matching, 0) AS matching FROM near_text LEFT JOIN gold_passages USING (a_id, b_id)")
def _(t): return C.label_candidates(near_passages(t).select(*PAIR), t.gold_passages)


@query("gold_missed", PASSAGES + " SELECT a_id, b_id FROM gold_passages ANTI JOIN near_text USING (a_id, b_id)")
def _(t): return C.gold_missed(near_passages(t), t.gold_passages)


@query("gold_found", PASSAGES + " SELECT a_id, b_id FROM gold_passages SEMI JOIN near_text USING (a_id, b_id)")
def _(t): return C.gold_found(near_passages(t), t.gold_passages)


@query("pair_cosine", with_views("vectors", "vector_steps") + """ SELECT a_id, b_id, matching, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS score
FROM vector_steps JOIN vectors a ON a.id = a_id JOIN vectors b ON b.id = b_id""")
def _(t): return rounded(D.pair_cosine(t.vector_steps, t.vectors, t.vectors))


@query("dedup_candidates", with_views("docs") + ", " + tfidf_sql("docs", "docs", K, same_table=True) +
       " SELECT DISTINCT least(a_id, b_id) AS a_id, greatest(a_id, b_id) AS b_id FROM near_text")
def _(t): return C.undirected(knn_tfidf(t.documents, t.documents, K, same_table=True))


@query("k_sweep", with_views("passages", "docs", "gold_passages") + ",\n" + tfidf_sql("passages", "docs", 20) + """,
per_k AS (SELECT k, count(a_id) AS n_candidates, count(matching) AS n_found FROM range(1, 21) r(k) LEFT JOIN near_text ON rank <= k LEFT JOIN gold_passages USING (a_id, b_id) GROUP BY k),
s AS (SELECT *, (SELECT count(*) FROM gold_passages) AS n_gold, (SELECT count(*) FROM passages) * (SELECT count(*) FROM docs)::DOUBLE AS space FROM per_k)
SELECT CAST(k AS INTEGER) AS k, n_candidates, n_found, space - n_candidates AS saved, round(1 - n_candidates / space, 6) AS reduction_ratio, round(n_found / n_gold, 6) AS recall,
round(2 * (1 - n_candidates / space) * (n_found / n_gold) / nullif((1 - n_candidates / space) + n_found / n_gold, 0), 6) AS f1 FROM s""")
def _(t): return rounded(C.k_sweep(near_passages(t, 20), t.gold_passages, runs.count_of(t.passages), runs.count_of(t.documents), 20))


LEAK = with_views("strong_trades", "gold_orgs") + ", g AS (SELECT a_id, b_id FROM gold_orgs WHERE matching = 1), c AS (SELECT a_id, b_id FROM trades WHERE score > 0.3e0)"


@query("precision_leak", LEAK + """ SELECT coalesce(g.a_id, m.a_id) AS a_id, coalesce(g.b_id, m.b_id) AS b_id, CASE WHEN g.a_id IS NOT NULL AND m.a_id IS NOT NULL THEN 'correct' WHEN m.a_id IS NOT NULL THEN 'false match'
WHEN EXISTS (SELECT 1 FROM c WHERE c.a_id = g.a_id AND c.b_id = g.b_id) THEN 'missed in matching' ELSE 'lost in blocking' END AS outcome
FROM g FULL JOIN strong_trades m ON g.a_id = m.a_id AND g.b_id = m.b_id""")
def _(t): return C.error_attribution(t.gold_orgs, t.trades.filter(F.col("score") > 0.3), t.strong_trades)


@query("topk_candidates", with_views("trades") + """ SELECT a_id, b_id, score, CAST(rank AS INTEGER) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS rank FROM trades) WHERE rank <= 10""")
def _(t): return top_k(t.trades.select(*PAIR, "score"), 10)


@query("true_matches", with_views("gold_orgs") + " SELECT DISTINCT a_id, b_id FROM gold_orgs WHERE matching = 1")
def _(t): return C.true_matches(t.gold_orgs)


# ---------------------------------------------------------------- metrics
@query("blocking_metrics", PASSAGES + f""", s AS (SELECT count(*) AS n_candidates, count(matching) AS n_found, (SELECT count(*) FROM gold_passages) AS n_gold,
(SELECT count(*) FROM passages) * (SELECT count(*) FROM docs)::DOUBLE AS space FROM near_text LEFT JOIN gold_passages USING (a_id, b_id)) SELECT {BLOCKING} FROM s""")
def _(t): return rounded(C.blocking_metrics(near_passages(t), t.gold_passages, runs.count_of(t.passages), runs.count_of(t.documents)))


@query("avg_neighbors", with_views("passages", "gold_passages") + """ SELECT (SELECT count(*) FROM passages) AS n_a, count(*) AS n_candidates,
round(count(*) / (SELECT count(*) FROM passages), 6) AS avg_neighbors FROM gold_passages""")
def _(t): return rounded(C.average_neighbours(t.gold_passages, t.passages))


@query("classification_metrics", DECIDED + f" SELECT tp, fp, fn, tn, {RATES} FROM (SELECT {COUNTS} FROM decided)")
def _(t): return rounded(M.classification_metrics(decided_orgs(t)))


@query("match_set_metrics", LEAK + """, n AS (SELECT (SELECT count(*) FROM strong_trades m SEMI JOIN g USING (a_id, b_id)) AS tp,
(SELECT count(*) FROM strong_trades m ANTI JOIN g USING (a_id, b_id)) AS fp, (SELECT count(*) FROM g ANTI JOIN strong_trades m USING (a_id, b_id)) AS fn)
SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS accuracy FROM n""")
def _(t): return rounded(M.match_set_metrics(t.strong_trades, C.true_matches(t.gold_orgs)))


@query("confusion_matrix", DECIDED + " SELECT v.y, v.pred, count(d.y) AS n FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(y, pred) LEFT JOIN decided d ON d.y = v.y AND d.pred = v.pred GROUP BY 1, 2")
def _(t): return M.confusion_matrix(decided_orgs(t))


@query("classification_report", DECIDED + f""", n AS (SELECT {COUNTS} FROM decided),
c AS (SELECT '0' AS class, coalesce(tn / nullif(tn + fn, 0), 0) AS p, coalesce(tn / nullif(tn + fp, 0), 0) AS r, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f, tn + fp AS s FROM n
UNION ALL SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn FROM n),
a AS (SELECT (tp + tn) / (tp + fp + fn + tn) AS acc, tp + fp + fn + tn AS s FROM n)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s AS support FROM c
UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), s FROM a
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(s) AS BIGINT) FROM c
UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM c""")
def _(t): return rounded(M.classification_report(decided_orgs(t)))


@query("roc_curve", with_views("scored_orgs") + ", " + ROC.format(source="scored_orgs") + " SELECT threshold, tp, fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM roc")
def _(t): return M.roc_curve(t.scored_orgs).withColumn("tpr", r6("tpr")).withColumn("fpr", r6("fpr"))


@query("roc_auc", with_views("scored_orgs") + " SELECT " + AUC.format(source="scored_orgs") + " AS roc_auc")
def _(t): return rounded(M.roc_auc(t.scored_orgs))


@query("auc_trapezoid", with_views("scored_docs") + ", " + ROC.format(source="scored_docs") + """ SELECT round(sum((fpr - pf) * (tpr + pt) / 2), 6) AS auc
FROM (SELECT fpr, tpr, lag(fpr) OVER w AS pf, lag(tpr) OVER w AS pt FROM roc WINDOW w AS (ORDER BY fpr, tpr))""")
def _(t): return rounded(M.auc_of_curve(M.roc_curve(t.scored_docs)))


@query("threshold_sweep", SWEEP_ORGS + " SELECT * REPLACE (round(threshold, 6) AS threshold) FROM sweep")
def _(t): return rounded(M.threshold_sweep(t.scored_orgs))


@query("best_threshold", SWEEP_ORGS + " SELECT round(threshold, 6) AS threshold, f1 FROM sweep ORDER BY f1 DESC, sweep.threshold LIMIT 1")
def _(t): return rounded(M.best_threshold(M.threshold_sweep(t.scored_orgs)))


@query("log_loss", with_views("scored_docs") + """, p AS (SELECT y, greatest(least(score, 1e0 - 1e-15), 1e-15) AS p FROM scored_docs)
SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM p""")
def _(t): return rounded(M.log_loss(t.scored_docs))


@query("grid_summary", GRID + " SELECT * FROM summary")
def _(t): return rounded(M.grid_summary(option_scores(t), CONFIG))


@query("best_f1", GRID + " SELECT data, model, max(f1) AS best_f1 FROM summary GROUP BY 1, 2")
def _(t): return rounded(M.best_f1(M.grid_summary(option_scores(t), CONFIG), ["data", "model"]))


@query("best_config", GRID + """ SELECT data, model, order_cols, remove_col_names, f1 FROM (
SELECT *, row_number() OVER (PARTITION BY data ORDER BY f1 DESC, model, order_cols, remove_col_names) AS n FROM summary) WHERE n = 1""")
def _(t): return M.best_config(rounded(M.grid_summary(option_scores(t), CONFIG)), ["data"], CONFIG[1:])


@query("label_balance", with_views("gold_orgs") + " SELECT matching AS label, count(*) AS n FROM gold_orgs GROUP BY 1")
def _(t): return M.label_balance(t.gold_orgs)


@query("text_length", "SELECT CAST(max(length(text)) AS INTEGER) AS max_length FROM documents")
def _(t): return M.text_length(t.documents)


# ---------------------------------------------------------------- sampling
@query("shuffle_pairs", with_views("gold_orgs") + " SELECT a_id, b_id, row_number() OVER (ORDER BY md5(concat_ws(':', '42', a_id, b_id)), a_id, b_id) AS position FROM gold_orgs")
def _(t): return S.shuffled(t.gold_orgs.select(*PAIR))


@query("split_candidates", with_views("gold_orgs") + """, ranked AS (SELECT a_id, b_id, matching, row_number() OVER (ORDER BY md5(concat_ws(':', '42', a_id, b_id)), a_id, b_id) AS rank FROM gold_orgs)
SELECT a_id, b_id, matching, CASE WHEN rank <= floor(0.8e0 * (SELECT count(*) FROM ranked)) THEN 'train' ELSE 'test' END AS split FROM ranked""")
def _(t): return S.split_candidates(t.gold_orgs.select(*PAIR, "matching"))


@query("few_shot_sample", with_views("gold_orgs") + """ SELECT a_id, b_id, matching FROM (SELECT *, row_number() OVER (PARTITION BY matching ORDER BY md5(concat_ws(':', '0', a_id, b_id)), a_id, b_id) AS n FROM gold_orgs)
WHERE n <= CASE WHEN matching = 1 THEN 10 ELSE 30 END""")
def _(t): return S.few_shot_sample(t.gold_orgs.select(*PAIR, "matching"), 10, 30)


@query("few_shot_draws", with_views("gold_orgs") + f""", ranked AS (SELECT a_id, b_id, matching, row_number() OVER (PARTITION BY matching ORDER BY md5(concat_ws(':', '0', a_id, b_id)), a_id, b_id) AS rank,
count(*) OVER (PARTITION BY matching) AS size FROM gold_orgs),
draws AS (SELECT DISTINCT matching, draw, {hash_number_sql("'0'", "matching", "draw")} % size + 1 AS rank FROM ranked, range(1, 6) d(draw))
SELECT a_id, b_id, matching, CAST(draw AS INTEGER) AS draw FROM ranked JOIN draws USING (matching, rank)""")
def _(t): return S.few_shot_sample(t.gold_orgs.select(*PAIR, "matching"), replacement=True)


@query("component_split", COMPONENT_SPLIT + " SELECT * FROM positives")
def _(t): return S.component_split(t.strong_trades)


@query("negative_samples", NEGATIVES + " SELECT * FROM negatives")
def _(t): return S.negative_samples(S.component_split(t.strong_trades), ratio=2)


@query("assembled_split", NEGATIVES + """, everything AS (SELECT a_id, b_id, split, 1 AS matching FROM positives UNION ALL SELECT a_id, b_id, split, 0 FROM negatives)
SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5(concat_ws(':', '42', a_id, b_id)), a_id, b_id) AS position FROM everything""")
def _(t):
    positives = S.component_split(t.strong_trades)
    return S.assembled_split(positives, S.negative_samples(positives, ratio=2))


# ---------------------------------------------------------------- graph
@query("transitive_round", STRONG + ", " + closing(1) + " SELECT a_id, b_id FROM add1")
def _(t): return G.transitive_round(t.strong_trades, t.trades)


@query("transitive_closure", CLOSED + " SELECT a_id, b_id, 0 AS round FROM m0 " + " ".join(
    f"UNION ALL SELECT a_id, b_id, {i} FROM add{i}" for i in range(1, ROUNDS + 1)))
def _(t): return G.transitive_closure(t.strong_trades, t.trades)


@query("connected_components", CLUSTERS + " SELECT * FROM clusters")
def _(t): return G.connected_components(G.two_sided_nodes(t.strong_trades))


@query("match_clusters", CLUSTERS + " SELECT id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS size FROM clusters")
def _(t): return G.match_clusters(t.strong_trades)


# ---------------------------------------------------------------- scalar functions
@query("scalar_text", """SELECT p_partkey AS id, CAST(p_retailprice AS VARCHAR) AS price_text, CAST(length(p_name) AS INTEGER) AS name_length, array_to_string(list_reverse(string_split(p_name, ' ')), '_') AS turned,
contains(p_name, 'ring') AS has_ring, starts_with(p_name, 'red') AS is_red, ends_with(p_name, 'bolt') AS is_bolt, CAST(levenshtein(p_name, p_type) AS INTEGER) AS distance FROM part""")
def _(t):
    p = t.table("part")
    return p.select(
        F.col("p_partkey").alias("id"), X.value_text(F.col("p_retailprice"), p.schema["p_retailprice"].dataType).alias("price_text"),
        F.length("p_name").alias("name_length"), F.array_join(F.reverse(F.split("p_name", " ")), "_").alias("turned"),
        F.col("p_name").contains("ring").alias("has_ring"), F.startswith("p_name", F.lit("red")).alias("is_red"),
        F.endswith("p_name", F.lit("bolt")).alias("is_bolt"), F.levenshtein("p_name", "p_type").alias("distance"))


@query("scalar_regex", """SELECT doc_id AS id, CAST(len(w) AS INTEGER) AS n_tokens, CASE WHEN len(w) > 0 THEN w[1] END AS first_token, CAST(len(list_distinct(w)) AS INTEGER) AS n_distinct,
regexp_matches(text, '[0-9]{3,}') AS has_number, regexp_extract(source, '^src([0-9]+)$', 1) AS source_number
FROM (SELECT *, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents)""")
def _(t):
    words = t.table("documents").withColumn("w", X.tokens(F.col("text")))
    return words.select(F.col("doc_id").alias("id"), F.size("w").alias("n_tokens"), F.get("w", F.lit(0)).alias("first_token"),
                        F.size(F.array_distinct("w")).alias("n_distinct"), F.col("text").rlike("[0-9]{3,}").alias("has_number"),
                        F.regexp_extract("source", "^src([0-9]+)$", 1).alias("source_number"))


@query("scalar_vector", with_views("vectors", "vector_steps") + """ SELECT a_id, b_id, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS cosine,
round(1 - list_cosine_similarity(a.embedding, b.embedding), 6) AS cosine_distance, round(list_distance(a.embedding, b.embedding), 6) AS euclidean,
round(list_inner_product(a.embedding, b.embedding), 6) AS dot FROM vector_steps JOIN vectors a ON a.id = a_id JOIN vectors b ON b.id = b_id""")
def _(t):
    side = lambda n: t.vectors.select(F.col("id").alias(f"{n}_id"), F.col("embedding").alias(n))
    both = t.vector_steps.join(side("a"), "a_id").join(side("b"), "b_id")
    a, b = F.col("a"), F.col("b")
    return both.select(*PAIR, F.round(V.cosine_similarity(a, b), 6).alias("cosine"), F.round(1 - V.cosine_similarity(a, b), 6).alias("cosine_distance"),
                       F.round(V.euclidean_distance(a, b), 6).alias("euclidean"), F.round(V.dot(a, b), 6).alias("dot"))


@query("scalar_logit", with_views("scored_docs") + """, x AS (SELECT id, y, score, score * 6 - 3 AS x1, 1 - score AS x0 FROM scored_docs)
SELECT id, round(1 / (1 + exp(-x1)), 6) AS sigmoid, round(exp(x1) / (exp(x0) + exp(x1)), 6) AS softmax, CAST(x1 > x0 AS INTEGER) AS class,
round(coalesce(2 * score * y / nullif(score + y, 0), 0), 6) AS harmonic, round(CAST(floor(score * 10) AS INTEGER) / 10e0, 6) AS step FROM x""")
def _(t):
    x0, x1 = 1 - F.col("score"), F.col("score") * 6 - 3
    steps = F.array(*[F.lit(v) for v in V.linspace(0.0, 1.0, 11)])
    return t.scored_docs.select(
        "id", F.round(V.sigmoid(x1), 6).alias("sigmoid"), F.round(V.softmax_positive(x0, x1), 6).alias("softmax"),
        V.argmax_class(x0, x1).alias("class"), F.round(F.coalesce(V.harmonic_mean(F.col("score"), F.col("y")), F.lit(0.0)), 6).alias("harmonic"),
        F.round(F.get(steps, F.floor(F.col("score") * 10).cast("int")), 6).alias("step"))


# ---------------------------------------------------------------- matchers
@query("encode_text", with_views("docs") + ",\n" + encode_sql("docs", 64, "coded") + """
SELECT id, CAST(i AS INTEGER) AS slot, round(embedding[i + 1], 6) AS value FROM coded, range(0, 64) r(i) WHERE embedding[i + 1] > 0""")
def _(t): return rounded(D.encode_text(t.documents, dim=64).select("id", F.posexplode("embedding").alias("slot", "value")).filter("value > 0"))


ZERO_SHOT = with_views("vectors", "vector_steps") + """, scored AS (SELECT a_id, b_id, matching AS y, round(list_cosine_similarity(a.embedding, b.embedding), 9) AS score
FROM vector_steps JOIN vectors a ON a.id = a_id JOIN vectors b ON b.id = b_id)"""


@query("zero_shot_match", ZERO_SHOT + " SELECT a_id, b_id, y AS matching, round(score, 6) AS score, CAST(score > 0.1e0 AS INTEGER) AS pred FROM scored")
def _(t): return rounded(D.zero_shot_match(t.vector_steps, t.vectors, t.vectors, 0.1))


TOKENS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]{{2,}}'))"


@query("pair_features", with_views("gold_products", "product_texts") + ", " + encode_sql("product_texts", 512, "coded") + f""", p AS (SELECT a_id, b_id, matching, a.text AS x, b.text AS y, list_cosine_similarity(ca.embedding, cb.embedding) AS c
FROM gold_products JOIN product_texts a ON a.id = a_id JOIN product_texts b ON b.id = b_id JOIN coded ca ON ca.id = a_id JOIN coded cb ON cb.id = b_id),
q AS (SELECT *, {TOKENS.format('x')} AS tx, {TOKENS.format('y')} AS ty FROM p)
SELECT a_id, b_id, matching, round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 6) AS edit_ratio,
round(len(list_intersect(tx, ty)) / len(list_distinct(list_concat(tx, ty))), 6) AS token_jaccard, round(least(length(x), length(y)) / greatest(length(x), length(y)), 6) AS length_ratio, round(c, 6) AS text_cosine FROM q""")
def _(t): return rounded(D.pair_features(t.gold_products.select(*PAIR, "matching"), t.product_texts, t.product_texts))


@query("supervised_match")
def _(t): return rounded(runs.supervised_run(t.gold_products, t.product_texts, t.product_texts))


FOLDS = 3
BLOCKED = with_views("gold_products", "product_texts") + ",\n" + tfidf_sql("product_texts", "product_texts", K, same_table=True) + f""",
families AS (SELECT a_id, b_id FROM gold_products WHERE matching = 1),
blocked AS (SELECT DISTINCT n.a_id, n.b_id, CAST(f.a_id IS NOT NULL AS INTEGER) AS matching, CAST({hash_number_sql("'42'", "'fold'", "n.a_id")} % {FOLDS} AS INTEGER) AS fold
  FROM near_text n LEFT JOIN families f ON f.a_id = n.a_id AND f.b_id = n.b_id)"""


def supervised_candidates(t: Tasks) -> DataFrame:
    near = knn_tfidf(t.product_texts, t.product_texts, K, same_table=True)
    return runs.supervised_candidates_run(t.product_texts, t.product_texts, near, t.gold_products.filter("matching = 1"), FOLDS)


@query("supervised_candidates", BLOCKED + " SELECT a_id, b_id, matching, fold, true AS rated, true AS decided FROM blocked")
def _(t):
    """Pairs, labels and folds are determined; scores are probabilities and decide the pair."""
    rated = F.col("score").between(0.0, 1.0)
    return supervised_candidates(t).select(*PAIR, "matching", "fold", rated.alias("rated"), (
        (F.col("score") > 0.65) == (F.col("pred") == 1)).alias("decided"))


@query("supervised_report", BLOCKED + " SELECT count(*) AS n_pairs, sum(matching)::BIGINT AS n_matching, count(DISTINCT fold) AS n_folds, true AS separates FROM blocked")
def _(t):
    scored = supervised_candidates(t)
    auc = M.roc_auc(scored, "matching").scalar()
    return scored.agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("matching").cast("bigint").alias("n_matching"),
                      F.countDistinct("fold").alias("n_folds")).withColumn("separates", auc >= 0.8)


def few_shot(t: Tasks) -> tuple[DataFrame, DataFrame]:
    scored = D.pair_cosine(t.vector_steps, t.vectors, t.vectors)
    return scored, S.few_shot_sample(scored, 10, 30)


FEW_SHOT = ZERO_SHOT + """, sample AS (SELECT y, score FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws(':', '0', a_id, b_id)), a_id, b_id) AS n FROM scored)
WHERE n <= CASE WHEN y = 1 THEN 10 ELSE 30 END), """ + SWEEP.format(rates=RATES, counts=COUNTS, source="sample") + \
    ", best AS (SELECT threshold, f1 FROM sweep ORDER BY f1 DESC, threshold LIMIT 1)"


@query("few_shot_threshold", FEW_SHOT + " SELECT round(threshold, 6) AS threshold, f1 FROM best")
def _(t): return rounded(D.few_shot_threshold(few_shot(t)[1]))


@query("few_shot_match", FEW_SHOT + " SELECT a_id, b_id, y AS matching, round(score, 6) AS score, CAST(score > (SELECT threshold FROM best) AS INTEGER) AS pred FROM scored")
def _(t):
    scored, sample = few_shot(t)
    return rounded(D.few_shot_match(scored, sample))


@query("pair_scorer", with_views("strong_trades", "suppliers", "customers") + """ SELECT a_id, b_id, round(least(length(x), length(y)) / greatest(length(x), length(y)), 6) AS score FROM (
SELECT a_id, b_id, concat_ws(' ', a.name, a.nation, a.balance) AS x, concat_ws(' ', b.name, b.nation, b.balance, b.segment) AS y FROM strong_trades JOIN suppliers a ON a.id = a_id JOIN customers b ON b.id = b_id)""")
def _(t):
    def length_scorer(a_texts, b_texts):
        a, b = np.array([len(x) for x in a_texts]), np.array([len(x) for x in b_texts])
        return np.minimum(a, b) / np.maximum(a, b)

    a, b = runs.prepare(t.suppliers, t.customers)
    return rounded(D.score_with(P.pair_texts(t.strong_trades, a, b), length_scorer))


@query("validation_metrics", with_views("scored_orgs", "gold_orgs") + ", val AS (SELECT y, score FROM scored_orgs JOIN gold_orgs USING (a_id, b_id) WHERE split = 'val'), " +
       SWEEP.format(rates=RATES, counts=COUNTS, source="val") + " SELECT round(threshold, 6) AS threshold, f1 FROM sweep ORDER BY f1 DESC, sweep.threshold LIMIT 1")
def _(t):
    scored = t.gold_orgs.filter(F.col("split") == "val").join(t.trades.select(*PAIR, "score"), PAIR)
    return rounded(D.validation_metrics(scored))


# ---------------------------------------------------------------- whole runs
@query("blocking_run", with_views("passages", "docs", "gold_passages") + ",\n" + tfidf_sql("passages", "docs", 15) + f""", s AS (SELECT count(*) AS n_candidates, count(matching) AS n_found, (SELECT count(*) FROM gold_passages) AS n_gold,
(SELECT count(*) FROM passages) * (SELECT count(*) FROM docs)::DOUBLE AS space FROM (SELECT a_id, b_id FROM near_text) LEFT JOIN gold_passages USING (a_id, b_id)) SELECT {BLOCKING} FROM s""")
def _(t):
    found = knn_tfidf(t.passages, t.documents, 15)
    return rounded(C.blocking_metrics(C.merge_candidates(found), t.gold_passages, runs.count_of(t.passages), runs.count_of(t.documents)))


@query("blocking_run_merged", with_views("passages", "docs", "gold_passages") + ",\n" + tfidf_sql("passages", "docs", 15) + ",\n"
       + encode_sql("passages", 512, "coded_a") + ",\n" + encode_sql("docs", 512, "coded_b") + ",\n" + knn_between_sql("coded_a", "coded_b", 15, "near_coded") + f""",
s AS (SELECT count(*) AS n_candidates, count(matching) AS n_found, (SELECT count(*) FROM gold_passages) AS n_gold,
(SELECT count(*) FROM passages) * (SELECT count(*) FROM docs)::DOUBLE AS space
FROM (SELECT a_id, b_id FROM near_text UNION SELECT a_id, b_id FROM near_coded) LEFT JOIN gold_passages USING (a_id, b_id)) SELECT {BLOCKING} FROM s""")
def _(t): return rounded(runs.blocking_run(t.passages, t.documents, t.gold_passages, k=15))


def grid_variant(removed: bool, blocker: str = "tfidf", ks: tuple[int, ...] = (5, 8, 11), orders: str = "(false), (true)") -> str:
    """Sweep over k for one serialization; the column order moves neither words nor letter triples."""
    tag = (lambda c: "") if removed else (lambda c: f"[COL] {c} [VAL] ")
    side_a = f"SELECT item_id AS id, concat('{tag('text')}', text) AS text FROM benchmark"
    side_b = "SELECT doc_id AS id, concat_ws(' ', " + ", ".join(f"concat('{tag(c)}', {c})" for c in ("text", "lang", "source")) + ") AS text FROM documents"
    near = tfidf_sql("side_a", "side_b", max(ks), name="near") if blocker == "tfidf" else ",\n".join(
        [encode_sql("side_a", 512, "coded_a"), encode_sql("side_b", 512, "coded_b"), knn_between_sql("coded_a", "coded_b", max(ks), "near")])
    return f"""SELECT '{blocker}' AS blocker, o.order_cols, {str(removed).lower()} AS remove_col_names, CAST(s.k AS INTEGER) AS k, n_candidates, n_found, space - n_candidates AS saved,
round(1 - n_candidates / space, 6) AS reduction_ratio, round(n_found / n_gold, 6) AS recall,
round(2 * (1 - n_candidates / space) * (n_found / n_gold) / nullif((1 - n_candidates / space) + n_found / n_gold, 0), 6) AS f1
FROM (VALUES {orders}) o(order_cols), (WITH side_a AS ({side_a}), side_b AS ({side_b}), {near}
SELECT k, count(near.a_id) AS n_candidates, count(matching) AS n_found, (SELECT count(*) FROM gold_passages) AS n_gold,
(SELECT count(*) FROM benchmark) * (SELECT count(*) FROM documents)::DOUBLE AS space
FROM (VALUES {", ".join(f"({k})" for k in ks)}) r(k) LEFT JOIN near ON rank <= k LEFT JOIN gold_passages USING (a_id, b_id) GROUP BY k) s"""


def grid_tables(t: Tasks) -> tuple[DataFrame, DataFrame]:
    return t.table("benchmark").withColumnRenamed("item_id", "id"), t.table("documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


@query("blocking_grid", with_views("gold_passages") + " " + grid_variant(True) + " UNION ALL " + grid_variant(False))
def _(t): return rounded(runs.blocking_grid(*grid_tables(t), t.gold_passages, [5, 8, 11], blockers=["tfidf"]))


@query("blocking_grid_resumed", with_views("gold_passages") + " " + " UNION ALL ".join(
    grid_variant(removed, blocker, (5, 10), "(false)") for blocker in ("tfidf", "embedding") for removed in (True, False)))
def _(t):
    """Both blockers; the run breaks off after three cells and is resumed."""
    ensure_checkpoint_dir(t.spark)
    path = f"{t.spark.sparkContext.getCheckpointDir()}/grid-{uuid.uuid4().hex}"
    run = lambda most: runs.blocking_grid(*grid_tables(t), t.gold_passages, [5, 10], orders=[False], blockers=["embedding", "tfidf"], path=path, most=most)
    run(3)
    return rounded(run(None))


@query("blocking_run_vectors", with_views("vectors", "gold_vectors") + ", " + knn_sql(15) + f""", once AS (SELECT DISTINCT least(a_id, b_id) AS a_id, greatest(a_id, b_id) AS b_id FROM near_vector),
s AS (SELECT count(*) AS n_candidates, count(matching) AS n_found, (SELECT count(*) FROM gold_vectors) AS n_gold, (SELECT count(*) FROM vectors) * (SELECT count(*) FROM vectors)::DOUBLE AS space
FROM once LEFT JOIN gold_vectors USING (a_id, b_id)) SELECT {BLOCKING} FROM s""")
def _(t):
    found = C.undirected(knn_embedding(t.vectors, t.vectors, 15, same_table=True))
    return rounded(C.blocking_metrics(found, t.gold_vectors, runs.count_of(t.vectors), runs.count_of(t.vectors)))


UNSUPERVISED = with_views("vectors", "gold_vectors") + ", " + knn_sql(K) + """, scored AS (SELECT n.a_id, n.b_id, list_cosine_similarity(a.embedding, b.embedding) AS score
FROM near_vector n JOIN vectors a ON a.id = n.a_id JOIN vectors b ON b.id = n.b_id),
decided AS (SELECT a_id, b_id, score, CAST(score > 0.65e0 AS INTEGER) AS pred, coalesce(matching, 0) AS y FROM scored LEFT JOIN gold_vectors USING (a_id, b_id))"""


def unsupervised(t: Tasks) -> DataFrame:
    near = knn_embedding(t.vectors, t.vectors, K, same_table=True)
    return runs.unsupervised_run(near, t.vectors, t.vectors, t.gold_vectors)


@query("unsupervised_run", UNSUPERVISED + " SELECT a_id, b_id, round(score, 6) AS score, pred, y AS matching FROM decided")
def _(t): return rounded(unsupervised(t))


@query("evaluation_report", DECIDED + f" SELECT tp, fp, fn, tn, {RATES}, " + AUC.format(source="decided") + f" AS roc_auc FROM (SELECT {COUNTS} FROM decided)")
def _(t): return rounded(runs.evaluation_report(decided_orgs(t).withColumnRenamed("y", "matching")))


@query("evaluation_table", DECIDED + ", n AS (SELECT " + COUNTS + " FROM decided), r AS (SELECT *, " + RATES + " FROM n), " + ROC.format(source="decided") + ", " +
       SWEEP.format(rates=RATES, counts=COUNTS, source="decided") + """, best AS (SELECT threshold, f1 FROM sweep ORDER BY f1 DESC, threshold LIMIT 1),
e AS (SELECT *, row_number() OVER (PARTITION BY pred ORDER BY a_id, b_id) AS n FROM decided),
o AS (SELECT a_id, b_id, y, pred, row_number() OVER (ORDER BY n > CASE WHEN pred = 1 THEN 3 ELSE 2 END, pred DESC, n) AS place FROM e WHERE n <= 5),
long AS (
SELECT 'count' AS section, unnest(['pairs', 'matches', 'positives', 'negatives']) AS item, unnest([tp + fp + fn + tn, tp + fp, tp + fn, fp + tn])::DOUBLE AS x, NULL::DOUBLE AS y FROM n
UNION ALL SELECT 'cell', unnest(['tp', 'fp', 'fn', 'tn']), unnest([tp, fp, fn, tn])::DOUBLE, NULL FROM n
UNION ALL SELECT 'rate', unnest(['accuracy', 'precision', 'recall', 'f1']), unnest([accuracy, precision, recall, f1]), NULL FROM r
UNION ALL SELECT 'auc', 'roc_auc', """ + AUC.format(source="decided") + """, NULL
UNION ALL SELECT 'roc', 'point', fpr, tpr FROM roc UNION ALL SELECT 'best', 'threshold', threshold, f1 FROM best
UNION ALL SELECT 'example', a_id || ':' || b_id, pred, y FROM o WHERE place <= 5)
SELECT section, item, round(x, 6) AS x, round(y, 6) AS y FROM long""")
def _(t): return rounded(runs.evaluation_table(decided_orgs(t), "y"))


@query("resolve_entities", CLUSTERS + """, everyone AS (SELECT 'a:' || s_suppkey AS id FROM supplier UNION SELECT 'b:' || c_custkey FROM customer UNION SELECT id FROM clusters),
whole AS (SELECT id, coalesce(cluster_id, id) AS cluster_id FROM everyone LEFT JOIN clusters USING (id)),
m AS (SELECT x.cluster_id, count(*) AS n_matches FROM strong_trades JOIN whole x ON x.id = 'a:' || a_id JOIN whole y ON y.id = 'b:' || b_id WHERE x.cluster_id = y.cluster_id GROUP BY 1),
c AS (SELECT x.cluster_id, count(*) AS n_candidates FROM trades JOIN whole x ON x.id = 'a:' || a_id JOIN whole y ON y.id = 'b:' || b_id WHERE x.cluster_id = y.cluster_id GROUP BY 1)
SELECT id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS size, coalesce(n_matches, 0) AS n_matches, coalesce(n_candidates, 0) AS n_candidates
FROM whole LEFT JOIN m USING (cluster_id) LEFT JOIN c USING (cluster_id)""")
def _(t):
    ids = lambda name, key: t.table(name).select(F.col(key).alias("id"))
    return runs.resolve_entities(t.trades, t.strong_trades, ids("supplier", "s_suppkey"), ids("customer", "c_custkey"))
