"""Linkage tasks over the given tables, stated twice: as DataFrames and as SQL.

products   part linked with itself; families share name, brand and type
orgs       supplier (A) against customer (B); candidates are the pairs that traded
passages   benchmark (A) against documents (B); gold pairs share a sentence
copies     documents linked with themselves; gold pairs have the same text
vectors    embeddings linked with themselves; gold pairs share the label

Gold pairs of a group are stars (smallest id with each other id), never all pairs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from sameas.functions.text import text_fingerprint
from sameas.operators.sampling import hashed_split
from sameas.operators.serialize import serialize

SENTENCE_BREAK = "[.\n]+"
SENTENCE_ROWS = 4096       # documents of a sentence that meet its passages in one task, about


class Tasks:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # products
    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
            F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))

    @cached_property
    def product_texts(self) -> DataFrame:
        return serialize(self.products.drop("price"), column_names=False)

    @cached_property
    def gold_products(self) -> DataFrame:
        """(a_id, b_id, matching, split): family stars and non-family neighbours in id order."""
        p = self.products.select("id", "name", "brand", "type")
        first = p.groupBy("name", "brand", "type").agg(F.min("id").alias("a_id"))
        family = p.join(first, ["name", "brand", "type"]).select("a_id", F.col("id").alias("b_id"))
        stars = family.filter(F.col("a_id") != F.col("b_id")).withColumn("matching", F.lit(1))
        here = p.select(F.col("id").alias("a_id"), *[F.col(c).alias(f"{c}_a") for c in ("name", "brand", "type")])
        there = p.select((F.col("id") - 1).alias("a_id"), F.col("id").alias("b_id"), "name", "brand", "type")
        same = (F.col("name") == F.col("name_a")) & (F.col("brand") == F.col("brand_a")) & (F.col("type") == F.col("type_a"))
        steps = here.join(there, "a_id").filter(~same).select("a_id", "b_id", F.lit(0).alias("matching"))
        return hashed_split(stars.unionByName(steps))

    # orgs
    @cached_property
    def suppliers(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"),
            F.col("s_acctbal").alias("balance"))

    @cached_property
    def customers(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
            F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))

    @cached_property
    def trades(self) -> DataFrame:
        """(a_id, b_id, score, strong): one row per supplier and customer that traded."""
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        strong = (F.col("l_quantity") >= 50) & (F.col("l_discount") >= 0.08)
        return lines.join(orders, "l_orderkey").groupBy(
            F.col("l_suppkey").alias("a_id"), F.col("o_custkey").alias("b_id")
        ).agg(F.least(F.max("l_extendedprice") / 100000.0, F.lit(1.0)).alias("score"), F.max(strong).alias("strong"))

    @cached_property
    def scored_orgs(self) -> DataFrame:
        """(a_id, b_id, score, strong, y, segment): y = 1 if both sit in one nation."""
        s = self.suppliers.select(F.col("id").alias("a_id"), F.col("nation").alias("nation_a"))
        c = self.customers.select(F.col("id").alias("b_id"), F.col("nation").alias("nation_b"), "segment")
        return self.trades.join(s, "a_id").join(c, "b_id").select(
            "a_id", "b_id", "score", "strong", (F.col("nation_a") == F.col("nation_b")).cast("int").alias("y"), "segment")

    @cached_property
    def gold_orgs(self) -> DataFrame:
        return hashed_split(self.scored_orgs.select("a_id", "b_id", F.col("y").alias("matching")))

    @cached_property
    def strong_trades(self) -> DataFrame:
        return self.trades.filter("strong").select("a_id", "b_id")

    # passages and copies
    @cached_property
    def passages(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("id"), "text")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("id"), "text")

    @cached_property
    def gold_passages(self) -> DataFrame:
        def sentences(df: DataFrame, name: str) -> DataFrame:
            parts = df.select(F.col("id").alias(name), F.explode(F.split("text", SENTENCE_BREAK)).alias("s"))
            return parts.select(name, F.trim("s").alias("s")).filter(F.col("s") != "")

        # documents that hold a sentence of many are dealt to parts, its passages go to every part
        passages, documents = sentences(self.passages, "a_id").distinct(), sentences(self.documents, "b_id")
        wanted = documents.join(passages.select("s").distinct(), "s", "left_semi").distinct()
        parts = wanted.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / SENTENCE_ROWS).cast("int").alias("parts"))
        left = passages.join(parts, "s").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = wanted.join(parts, "s").withColumn("part", F.pmod(F.xxhash64("b_id"), "parts").cast("int"))
        shared = left.join(right, ["s", "part"])
        return shared.select("a_id", "b_id").distinct().select("a_id", "b_id", F.lit(1).alias("matching"))

    @cached_property
    def gold_copies(self) -> DataFrame:
        docs = self.documents.select("id", text_fingerprint(F.col("text")).alias("fp"))
        first = docs.groupBy("fp").agg(F.min("id").alias("a_id"))
        return docs.join(first, "fp").filter(F.col("id") != F.col("a_id")).select(
            "a_id", F.col("id").alias("b_id"), F.lit(1).alias("matching"))

    # vectors
    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")

    @cached_property
    def gold_vectors(self) -> DataFrame:
        v = self.vectors.select("id", "label")
        first = v.groupBy("label").agg(F.min("id").alias("a_id"))      # one row per label
        return v.join(first, "label").filter(F.col("id") != F.col("a_id")).select(
            "a_id", F.col("id").alias("b_id"), F.lit(1).alias("matching"))

    @cached_property
    def vector_steps(self) -> DataFrame:
        """(a_id, b_id, matching): each vector with the next id; same label or not."""
        v = self.vectors.select("id", "label")
        there = v.select((F.col("id") - 1).alias("id"), F.col("id").alias("b_id"), F.col("label").alias("other"))
        return v.join(there, "id").select(
            F.col("id").alias("a_id"), "b_id", (F.col("label") == F.col("other")).cast("int").alias("matching"))

    # scored documents
    @cached_property
    def scored_docs(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "n_chars")
        return self.table("labels").join(docs, "doc_id").select(
            F.col("doc_id").alias("id"), F.col("quality").alias("y"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"))


def _hash(*parts: str) -> str:
    return "md5(concat_ws(':', " + ", ".join(parts) + "))"


def hash_number_sql(*parts: str) -> str:
    return f"CAST('0x' || substr({_hash(*parts)}, 1, 8) AS BIGINT)"


def hashed_split_sql(alias: str = "") -> str:
    at = hash_number_sql("'42'", f"{alias}a_id", f"{alias}b_id") + " / 4294967296e0"
    return f"CASE WHEN {at} < 0.7e0 THEN 'train' WHEN {at} < 0.7e0 + 0.15e0 THEN 'val' ELSE 'test' END"


# The same views as SQL, to be put after WITH.
SQL = {
    "products": "products AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size, p_retailprice AS price FROM part)",
    "product_texts": "product_texts AS (SELECT p_partkey AS id, concat_ws(' ', p_name, p_brand, p_type, CAST(p_size AS VARCHAR)) AS text FROM part)",
    "gold_products": f"""first_of AS (SELECT p_name, p_brand, p_type, min(p_partkey) AS a_id FROM part GROUP BY ALL),
gold_rows AS (
  SELECT f.a_id, p.p_partkey AS b_id, 1 AS matching FROM part p JOIN first_of f USING (p_name, p_brand, p_type) WHERE f.a_id <> p.p_partkey
  UNION ALL
  SELECT p.p_partkey, q.p_partkey, 0 FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1
  WHERE NOT (p.p_name = q.p_name AND p.p_brand = q.p_brand AND p.p_type = q.p_type)),
gold_products AS (SELECT a_id, b_id, matching, {hashed_split_sql()} AS split FROM gold_rows)""",
    "suppliers": "suppliers AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation, s_acctbal AS balance FROM supplier)",
    "customers": "customers AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer)",
    "trades": """trades AS (SELECT l_suppkey AS a_id, o_custkey AS b_id, least(max(l_extendedprice) / 100000e0, 1e0) AS score,
  max(l_quantity >= 50 AND l_discount >= 0.08e0) AS strong FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)""",
    "scored_orgs": """scored_orgs AS (SELECT a_id, b_id, score, strong, CAST(s_nationkey = c_nationkey AS INTEGER) AS y, c_mktsegment AS segment
  FROM trades JOIN supplier ON a_id = s_suppkey JOIN customer ON b_id = c_custkey)""",
    "gold_orgs": f"gold_orgs AS (SELECT a_id, b_id, y AS matching, {hashed_split_sql()} AS split FROM scored_orgs)",
    "strong_trades": "strong_trades AS (SELECT a_id, b_id FROM trades WHERE strong)",
    "passages": "passages AS (SELECT item_id AS id, text FROM benchmark)",
    "docs": "docs AS (SELECT doc_id AS id, text FROM documents)",
    "gold_passages": """sentences_a AS (SELECT DISTINCT id, trim(s) AS s FROM (SELECT item_id AS id, unnest(regexp_split_to_array(text, '[.\\n]+')) AS s FROM benchmark) WHERE trim(s) <> ''),
sentences_b AS (SELECT DISTINCT id, trim(s) AS s FROM (SELECT doc_id AS id, unnest(regexp_split_to_array(text, '[.\\n]+')) AS s FROM documents) WHERE trim(s) <> ''),
gold_passages AS (SELECT DISTINCT a.id AS a_id, b.id AS b_id, 1 AS matching FROM sentences_a a JOIN sentences_b b USING (s))""",
    "gold_copies": """gold_copies AS (SELECT f.a_id, d.doc_id AS b_id, 1 AS matching FROM documents d
  JOIN (SELECT text, min(doc_id) AS a_id FROM documents GROUP BY text) f USING (text) WHERE d.doc_id <> f.a_id)""",
    "vectors": "vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings)",
    "gold_vectors": """gold_vectors AS (SELECT f.a_id, e.vec_id AS b_id, 1 AS matching FROM embeddings e
  JOIN (SELECT label, min(vec_id) AS a_id FROM embeddings GROUP BY label) f USING (label) WHERE e.vec_id <> f.a_id)""",
    "vector_steps": """vector_steps AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, CAST(a.label = b.label AS INTEGER) AS matching
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""",
    "scored_docs": "scored_docs AS (SELECT doc_id AS id, quality AS y, (n_chars % 1000) / 1000e0 AS score FROM labels JOIN documents USING (doc_id))",
}

NEEDS = {"scored_orgs": ["trades"], "gold_orgs": ["scored_orgs"], "strong_trades": ["trades"]}


def with_views(*names: str) -> str:
    """'WITH RECURSIVE v1 AS (...), ...' for the named views and what they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in ordered)


def tfidf_sql(a: str, b: str, k: int, same_table: bool = False, name: str = "near_text") -> str:
    """View `name` (a_id, b_id, score, rank) of the k nearest by TF-IDF cosine."""
    count = lambda v: f"(SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS token FROM {v}) GROUP BY ALL)"
    other = "x.id <> y.id" if same_table else "true"
    return f"""terms_a AS {count(a)}, terms_b AS {count(b)},
idf AS (SELECT token, ln((1e0 + (SELECT count(*) FROM {a})) / (1e0 + count(*))) + 1e0 AS idf FROM terms_a GROUP BY token),
raw_a AS (SELECT id, token, tf * idf AS w FROM terms_a JOIN idf USING (token)),
raw_b AS (SELECT id, token, tf * idf AS w FROM terms_b JOIN idf USING (token)),
unit_a AS (SELECT id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw_a),
unit_b AS (SELECT id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw_b),
text_sims AS (SELECT x.id AS a_id, y.id AS b_id, round(sum(x.w * y.w), 9) AS score FROM unit_a x JOIN unit_b y USING (token) WHERE {other} GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS rank FROM text_sims) WHERE rank <= {k})"""


def knn_sql(k: int, name: str = "near_vector") -> str:
    """View `name` of the k nearest other vectors by cosine."""
    return f"""vector_sims AS (SELECT a.id AS a_id, b.id AS b_id, round(list_cosine_similarity(a.embedding, b.embedding), 9) AS score
  FROM vectors a JOIN vectors b ON a.id <> b.id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS rank FROM vector_sims) WHERE rank <= {k})"""


def encode_sql(view: str, dim: int, name: str) -> str:
    """View `name` (id, embedding) of the hashed words and letter triples, unit length."""
    words = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}')"
    return f"""{name}_pieces AS (SELECT id, list_concat(ws, flatten([[substr(w, i, 3) FOR i IN range(1, greatest(length(w) - 2, 1) + 1)] FOR w IN ws])) AS ps
  FROM (SELECT id, {words} AS ws FROM {view})),
{name}_counts AS (SELECT id, slot, count(*) AS n FROM (SELECT id, CAST('0x' || substr(md5(unnest(ps)), 1, 8) AS BIGINT) % {dim} AS slot FROM {name}_pieces) GROUP BY ALL),
{name}_maps AS (SELECT id, map_from_entries(list((slot, n))) AS m, sqrt(sum(n * n)) AS norm FROM {name}_counts GROUP BY id),
{name} AS (SELECT v.id, [coalesce(m[i] / norm, 0e0) FOR i IN range(0, {dim})] AS embedding FROM {view} v LEFT JOIN {name}_maps USING (id))"""


def knn_between_sql(a: str, b: str, k: int, name: str) -> str:
    """View `name` (a_id, b_id, score, rank) of the k nearest B vectors of every A vector."""
    return f"""{name}_sims AS (SELECT x.id AS a_id, y.id AS b_id, round(coalesce(CASE WHEN isnan(c) THEN 0 ELSE c END, 0), 9) AS score
  FROM (SELECT x, y, list_cosine_similarity(x.embedding, y.embedding) AS c FROM {a} x, {b} y)),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS rank FROM {name}_sims) WHERE rank <= {k})"""
