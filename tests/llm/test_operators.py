"""Each dealt operator against a plain version, and on odd tables."""

import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F

from sameas.llm import (byte_bpe, embedding_dedup, language_crf, line_dedup, lz_fingerprint, mixing, packing, quality,
                        queries, simhash, token_counts, toxicity)

DOCS = "/root/testdata/sf0.001"
ODD = [(1, "The  same text\nNav", "a"), (2, "The  same text\nNav", "a"), (2, "The  same text\nNav", "a"), (3, None, "a"),
       (4, "", None), (None, "no id\nNav", "a"), (5, "x" * 60_000, "b"), (6, "Ünï çödé 漢字 😀  \x1c²½", "a"),
       (7, "!?", "a"), (8, "word " * 3000 + "Nav", "a"), (9, "a\n\n b\n Nav ", "a")]
COLUMNS = ["doc_id", "text", "source"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and repeated texts, and columns whose names clash with the operators' own."""
    rows = [(i, t, s, "en", 1, 2, 3.0, "x", 4, 5, None) for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, Score int, fp int, predicted double, "
                                 "Text2 string, component_id int, lines_dropped int, n_chars bigint")


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DOCS}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 7 ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def ranks():
    import base64
    with open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(real, odd, none, ranks):
    for table in (real, odd):
        expected = sorted((d is None, d, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(),
                           hashlib.sha256((t or "").encode()).hexdigest())
                          for d, t in texts_of(table) for e in [ranks.encode_ordinary(t or "")])
        assert sorted((r[0] is None, *r) for r in byte_bpe.encode(table).collect()) == expected
    assert byte_bpe.encode(none).collect() == []


def test_bpe_plain_pattern_cuts_alike():
    tool = byte_bpe.encoder(public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)
    for sign in map(chr, range(0x250)):
        text = f"a{sign}b {sign}{sign}1 {sign}\n {sign}"
        assert tool.cut(text) == tool.find(text), hex(ord(sign))


def test_bpe_round_trip(odd):
    coded = byte_bpe.encode(odd, ids=True)
    back = byte_bpe.decode(coded)
    assert sorted(bytes(r["text"]) for r in back.collect()) == sorted((t or "").encode() for _, t, _ in ODD)


def test_merges_of_long_pieces(ranks):
    tool = byte_bpe.encoder(public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)
    texts = ["ab" * 700, "=" * 999, "straßenbahnhaltestelle" * 40, "aé" * 300]
    assert [np.frombuffer(c, "<u4").tolist() for c in tool.encode_block(texts)] == [ranks.encode_ordinary(t) for t in texts]


# 3 ---------------------------------------------------------------------------

def test_token_counts_equal_the_library(real, odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    for table in (real, odd):
        expected = sorted((d is None, d, len((t or "").encode()), n, n > 50) for d, t in texts_of(table) for n in [len(library.encode(t or ""))])
        got = token_counts.count_tokens(table, limit=50)
        assert sorted((r["doc_id"] is None, r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect()) == expected
    assert token_counts.count_tokens(none).collect() == []


def test_every_prefix_count_and_budget(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    rows = [(i, t) for i, t in enumerate(["Hello there, world!\n\tNext  line ▁ x²y", "aaaa" * 20, "漢字 ünï ½ 😀", "", "straßenbahn." * 9])]
    for r in token_counts.count_tokens(spark.createDataFrame(rows, "doc_id int, text string"), limit=7, prefixes=True).collect():
        text = rows[r["doc_id"]][1]
        counts = [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        assert r["prefix_tokens"] == counts
        assert r["fit_chars"] == max(i for i, n in enumerate(counts) if n <= 7)


# 1, 2, 4 ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def larger(spark):
    return "/root/testdata/sf0.01"


def held_out(spark, sf_dir, name, column):
    scored = queries.QUERIES[name](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored.join(labels, "doc_id").filter("held_out").select(F.col(column).alias("y"), "score", "predicted").toPandas()


def auc(rows):
    rank = rows["score"].rank()
    good = (rows["y"] == 1).sum()
    return (rank[rows["y"] == 1].sum() - good * (good + 1) / 2) / (good * (len(rows) - good))


def test_quality_on_held_out_documents(spark, larger):
    rows = held_out(spark, larger, "op1_quality", "quality")
    assert auc(rows) > 0.95
    assert (rows["predicted"] == rows["y"]).mean() > 0.93


def test_quality_prior_and_odd_tables(spark, odd, none, real):
    rng = np.random.default_rng(0)
    good, bad = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    assert abs(quality.class_prior(good[:2000], np.r_[good[2000:], bad[:1000]]) - 2 / 3) < 0.06
    trusted = real.select("doc_id").filter("doc_id % 2 = 0")
    model = quality.fit_quality(real.select("doc_id", "text"), trusted)
    rows = quality.score_quality(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert quality.score_quality(none, model).collect() == [] and quality.keep_good(odd, model).columns == odd.columns
    untaught = quality.fit_quality(real.select("doc_id", "text"), trusted.filter("false"))
    assert {r["score"] for r in quality.score_quality(odd, untaught).collect()} == {1.0}


def test_toxicity_on_held_out_documents(spark):
    rows = held_out(spark, "/root/testdata/sf0.1", "op2_toxicity", "toxic")
    assert auc(rows) > 0.95
    bad = rows["y"] == 1
    assert rows["predicted"][bad].mean() > 0.8 and rows["predicted"][~bad].mean() < 0.05


def test_toxicity_odd_tables(spark, odd, none, real):
    labels = spark.read.parquet(f"{DOCS}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit_toxicity(real.select("doc_id", "text"), labels)
    rows = toxicity.score_toxicity(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_toxicity(none, model).collect() == []
    nothing = toxicity.fit_toxicity(real.select("doc_id", "text"), labels.filter("toxic = 0"))
    assert {r["predicted"] for r in toxicity.score_toxicity(odd, nothing).collect()} == {0}


def test_thresholds_take_the_widest_gap():
    assert toxicity.best_threshold(np.array([0.0, 1, 2, 6, 7]), np.array([False, False, False, True, True])) == 4


def test_languages_on_held_out_documents(spark, larger):
    found = queries.op4_language(spark, larger).filter("held_out")
    right = found.join(spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert right.filter("lang = lang_pred").count() / right.count() > 0.97


def test_language_odd_tables_and_switches(spark, odd, none, real):
    model = language_crf.fit_languages(real.select("doc_id", "text", "lang"))
    rows = language_crf.identify_languages(odd, model).collect()
    assert len(rows) == len(ODD)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 7)} == {"und"}
    assert language_crf.identify_languages(none, model).collect() == []
    untaught = language_crf.fit_languages(real.select("doc_id", "text", "lang").filter("false"))
    assert {r["lang_pred"] for r in language_crf.identify_languages(odd, untaught).collect()} == {"und"}
    text = {lang: real.filter(F.col("lang") == lang).orderBy(F.desc("n_chars")).first()["text"][:600] for lang in ("en", "de")}
    mixed = spark.createDataFrame([(1, text["en"] + " " + text["de"])], "doc_id int, text string")
    row = language_crf.identify_languages(mixed, model, runs=True).first()
    assert row["runs"][0]["lang"] == "en" and row["runs"][-1]["lang"] == "de"
    assert row["runs"][0]["first"] < row["runs"][0]["end"] <= row["runs"][-1]["first"]


def test_only_letters_are_words():
    texts = ["😀🎉", "→✓€", "。、「」", "１２３", "٣٤٥", "ª", "µº", "é", "漢字。かな", "हिन्दी भाषा", "\u0301", "ab1c x", "×÷ ß", ""]
    data, offsets = packing.pack(pa.array(texts))
    starts, ends = language_crf.word_spans(data, offsets)
    words = [[] for _ in texts]
    for row, a, b in zip(packing.row_of(offsets, starts), starts, ends):
        words[row].append(data[a:b].tobytes().decode())
    assert words == [[], [], [], [], [], ["ª"], ["µº"], ["é"], ["漢字", "かな"], ["हिन्दी", "भाषा"], [], ["ab", "c", "x"], ["ß"], []]


def test_long_runs_are_read_whole():
    texts = ["漢字" * 500, "x" * 32, "é" + "x" * 32, "a" * 33 + "。" + "한국어" * 20, "ab"]
    data, offsets = packing.pack(pa.array(texts))
    starts, ends = language_crf.word_spans(data, offsets)
    words = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert b"".join(words).decode() == "".join(texts).replace("。", "") and max(map(len, words)) <= 32
    assert all(w.decode() for w in words) and b"x" * 32 in words
    spell = packing.SpanHash(data)
    _, of = language_crf.word_features(spell, starts, ends)
    grams = sum(max(0, len(w) - n + 1) for w in words for n in (2, 3, 4))
    edges = sum(2 * (len(w) > n) for w in words for n in (1, 2, 3, 4))
    assert len(of) == len(words) + grams + edges


def test_forward_backward_equals_the_plain_one():
    rng = np.random.default_rng(0)
    model = language_crf.LanguageModel(["a", "b", "c"], None, rng.normal(size=(3, 3)), np.zeros(3))
    lengths = [1, 5, 64, 65, 130, 3]
    scores, at, expected = rng.normal(size=(sum(lengths), 3)) * 2, 0, []
    for n in lengths:
        e, ahead, behind = scores[at:at + n], np.zeros((n, 3)), np.zeros((n, 3))
        ahead[0] = e[0]
        for t in range(1, n):
            ahead[t] = np.logaddexp.reduce(ahead[t - 1][:, None] + model.transitions, axis=0) + e[t]
        for t in range(n - 2, -1, -1):
            behind[t] = np.logaddexp.reduce(model.transitions + e[t + 1] + behind[t + 1], axis=1)
        expected.append(np.exp(ahead + behind - np.logaddexp.reduce(ahead[-1])))
        at += n
    got = model.marginals(scores, np.repeat(np.arange(len(lengths)), lengths), len(lengths))
    assert np.allclose(got, np.concatenate(expected))


# 5, 8 ------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DOCS}/{table}.parquet'")
    result = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, DOCS).select(*columns).collect())) == sorted(result.fetchall())


def test_lines_of_odd_tables(odd, none, monkeypatch):
    expected = {1: "The  same text", 3: None, 4: "", 9: "a\n\n b"}
    for bound in (line_dedup.BROADCAST_LINES, -1):       # both ways back to the pages
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", bound)
        out = line_dedup.drop_repeated_lines(odd, ratio=0.5, least_pages=3)
        assert out.columns == odd.columns + ["lines_dropped_"]
        rows = {r["doc_id"]: r for r in out.collect()}
        assert {i: rows[i]["text"] for i in expected} == expected
        assert rows[1]["lines_dropped_"] == 1 and rows[5]["lines_dropped_"] == 0 and out.count() == len(ODD)
    assert line_dedup.drop_repeated_lines(none).collect() == []


def test_mix_is_within_a_block(spark):
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    rows = [(i, s) for s, n in (("a", 400), ("b", 240), ("c", 160)) for i in range(n)]
    docs = spark.createDataFrame([(f"{s}{i}", s) for i, s in rows], "doc_id string, source string")
    weights = spark.createDataFrame(list(shares.items()), "source string, weight double")
    out = mixing.mix_sources(docs, weights, period=20, block_rows=4).select("source", "mix_slot").distinct().toPandas().sort_values("mix_slot")
    assert sorted(out["mix_slot"]) == list(range(200))
    for source, weight in shares.items():
        lag = (out["source"] == source).cumsum().to_numpy() - weight * np.arange(1, 201)
        assert abs(lag).max() < 1


def furthest(out, weights):
    """Largest distance of any source from its exact share, until the first one runs out."""
    slots = out.select("source", "mix_slot").distinct().toPandas().sort_values("mix_slot")
    total, until = sum(weights.values()), slots.groupby("source")["mix_slot"].max().min()
    slots = slots[slots["mix_slot"] <= until]
    assert slots["mix_slot"].tolist() == list(range(until + 1))
    steps = np.arange(1, until + 2)
    return max(abs((slots["source"] == s).cumsum().to_numpy() - w / total * steps).max() for s, w in weights.items()), until


@pytest.mark.parametrize("weights,rows,given", [
    ({"a": 1.0, "b": 1.0, "c": 1.0}, 20_500, True), ({"a": 3**0.5, "b": 2**0.5, "c": 1.0}, 9_000, True), ({"a": 1.0, "b": 1.0, "c": 1.0}, 20_500, False),
    ({f"s{i:03}": 1.0 + i % 7 for i in range(600)}, 8, True), ({f"s{i:03}": 1.0 for i in range(600)}, 8, False),
    ({**{f"f{i}": 10.0 for i in range(5)}, **{f"s{i}": 1.0 for i in range(50)}}, 1000, True)])
def test_mix_follows_true_weights_over_many_periods(spark, weights, rows, given):
    names = F.array(*[F.lit(s) for s in weights])
    docs = spark.range(len(weights) * rows).select(F.col("id").alias("doc_id"), F.get(names, (F.col("id") % len(weights)).cast("int")).alias("source"))
    table = spark.createDataFrame(list(weights.items()), "source string, weight double")
    out = mixing.mix_sources(docs, table if given else None, block_rows=4 if rows > 8 else 1).cache()
    distance, slots = furthest(out, weights)
    assert distance < 1 and slots > 0
    assert out.select("doc_id").distinct().count() == docs.count() == out.count()
    out.unpersist()


def test_mix_names_sources_without_a_weight(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id int, source string")
    for rows in ([("a", 1.0), ("b", 2.0)], [("a", 1.0), ("b", 0.0), (None, 1.0)], [("a", 1.0), ("a", 1.0), ("b", 1.0), (None, 1.0)]):
        with pytest.raises(ValueError, match="weight above 0"):
            mixing.mix_sources(docs, spark.createDataFrame(rows, "source string, weight double"))


def test_mix_keeps_all_rows_of_a_skewed_table(spark):
    docs = spark.range(2_100).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2_000, "huge").otherwise(
        F.concat(F.lit("s"), F.col("id"))).alias("source"))
    weights = docs.select("source").distinct().withColumn("weight", F.when(F.col("source") == "huge", 3162.0).otherwise(1.0))
    assert sorted(r["doc_id"] for r in mixing.mix_sources(docs, weights).collect()) == list(range(2_100))


def test_mix_of_odd_tables(odd, none):
    out = mixing.mix_sources(odd)
    assert out.count() == len(ODD) and out.columns[:len(odd.columns)] == odd.columns
    assert out.select("source", "mix_block", "mix_row").distinct().count() == len(ODD)
    assert mixing.mix_sources(none).collect() == []


# 6 ---------------------------------------------------------------------------

def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(ids, near):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_simhash_equals_brute_force(spark, real, none):
    rows = texts_of(real)
    fps = {d: plain_fingerprint(t) for d, t in rows}
    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    root = plain_groups(list(fps), near)
    got = queries.op6_simhash(spark, DOCS).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((d, f"{f:016x}", root[d]) for d, f in fps.items())
    assert simhash.simhash_groups(none).collect() == []


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_anchors_find_every_pair(spark, bits):
    rng = np.random.default_rng(bits)
    base = [int(x) for x in rng.integers(0, 2**63, 150)]
    fps = set(base)
    for x in base:
        for _ in range(3):
            y = x
            for place in rng.choice(64, rng.integers(1, 5), replace=False):
                y ^= 1 << int(place)
            fps.add(y)
    fps = sorted(fps)
    table = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)], "fp bigint, rep bigint")
    got = {tuple(r) for r in simhash.links(table, bits).collect()}
    assert got == {(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps) if i < j and (a ^ b).bit_count() <= bits}


def test_simhash_visits_are_not_broadcast(spark):
    """Behind the Python step that lists them Spark takes the visits, some 60 a fingerprint, for as few as the fingerprints."""
    found = simhash.links(spark.createDataFrame([(i << 40 | i, i) for i in range(50)], "fp bigint, rep bigint"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_simhash_odd_tables(odd, spark):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert {r["fp"] for r in rows if r["doc_id"] in (3, 4)} == {0}
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 5, 6, 7, 8, 9]


# 9 ---------------------------------------------------------------------------

def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(600, 16))
    turned = [b + rng.normal(size=16) * s for b in base for s in (0.03, 0.05)]
    m = np.concatenate([base, turned, np.tile(base[0], (40, 1)), 3 * base[:5]])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16), (9005, [1.0, 2.0]), (9006, []),
           (9007, [float("inf")] + [1.0] * 15), (None, [float(x) for x in base[1]])]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").withColumn("n_links", F.lit("x"))
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_groups(table).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    counts = np.array([got[i]["n_links"] for i in range(len(m))])
    assert (counts <= near.sum(axis=1)).all() and counts.sum() >= 0.9 * near.sum()
    root = plain_groups(range(len(m)), np.argwhere(near).tolist())
    assert np.mean([got[i]["component_id"] == root[i] for i in range(len(m))]) > 0.95
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _ in odd[:-1])
    assert got[None]["n_links"] == 0
    assert embedding_dedup.embedding_groups(table.filter("false")).collect() == []


def test_embeddings_of_any_length_and_scale(spark):
    rng = np.random.default_rng(4)
    vectors = [rng.normal(size=w) for w in (1, 1, 2, 2, 3, 5, 8, 8, 30) for _ in range(6)]
    vectors += [v * f for v in vectors[::2] for f in (1e200, 1e-200, -1e-300, 3.0)] + [[1e-200, 1e-200], [1e200, 1e200], [5e-324], [-1.0]]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    unit = [np.array(v) / np.abs(v).max() for _, v in rows]
    unit = [v / np.linalg.norm(v) for v in unit]
    near = [(i, j) for i, a in enumerate(unit) for j, b in enumerate(unit) if i != j and len(a) == len(b) and a @ b >= 0.95]
    root = plain_groups(range(len(rows)), near)
    for i in range(len(rows)):
        assert got[i]["n_links"] == sum(a == i for a, _ in near) and got[i]["component_id"] == root[i] and got[i]["kept"] == (root[i] == i)


def test_cells_come_by_rising_distance():
    rng = np.random.default_rng(5)
    for one, two, margin in [(np.sort(rng.random(9)), np.sort(rng.random(7)), 1.1), ([0.0] * 5, [0.0] * 4, 0.0), ([0.0], [0.0, 2.0], 1.0), ([], [0.0], 1.0)]:
        found = list(embedding_dedup.frontier(list(one), list(two), margin))
        sums = [one[i] + two[j] for i, j in found]
        assert sums == sorted(sums) and set(found) == {(i, j) for i in range(len(one)) for j in range(len(two)) if one[i] + two[j] <= margin}


@pytest.mark.parametrize("rows", [48, 1024])
def test_tiles_of_crowded_cells(spark, monkeypatch, rows):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", rows)
    monkeypatch.setattr(embedding_dedup, "TILE_ROWS", 64)
    rng = np.random.default_rng(6)
    m = np.concatenate([rng.normal(size=8) + 0.2 * rng.normal(size=(300, 8)), rng.normal(size=(700, 8))])
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_groups(table).collect()}
    m = m.astype(np.float32).astype(float)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    counts = np.array([got[i]["n_links"] for i in range(len(m))])
    assert (counts <= near.sum(axis=1)).all() and counts.sum() >= 0.95 * near.sum()


# 10 --------------------------------------------------------------------------

def plain_phrases(text):
    symbols, known, at = lz_fingerprint.cut_symbols(text.encode()), set(), 0
    while at < len(symbols):
        stop = at + 1
        while stop < len(symbols) and b"".join(symbols[at:stop]) in known:
            stop += 1
        known.add(b"".join(symbols[at:stop]))
        at = stop
    return known


def test_phrases_and_edits_equal_the_plain_ones(spark, real, monkeypatch):
    monkeypatch.setattr(lz_fingerprint, "RANGE_ROWS", 30)          # several ranges with guests
    rows = sorted(texts_of(real), reverse=True)
    got = {r["doc_id"]: r for r in lz_fingerprint.fingerprint_edits(real.repartition(3)).collect()}
    assert len(got) == len(rows)
    for (d, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        third = len(text) // 3
        edited = text[:len(text) - third] + following[:third]
        prints = [lz_fingerprint.fingerprint(t) for t in (text, edited, following)]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple(prints[:2])
        assert r["near_edited"] == pytest.approx(lz_fingerprint.compare(*prints[:2]))
        assert r["near_next"] == pytest.approx(lz_fingerprint.compare(prints[0], prints[2]))
    text = rows[0][1]
    one = lz_fingerprint.Document(None, text)
    assert {one.data[a:b] for a, b in zip(one.starts, one.ends)} == plain_phrases(text)


def test_likeness_estimates_shared_phrases(real):
    texts = [t for _, t in texts_of(real) if len(t) > 3000][:8]
    for a, b in zip(texts, [texts[0] + t for t in texts[1:]]):
        x, y = plain_phrases(a), plain_phrases(b)
        assert abs(lz_fingerprint.compare(lz_fingerprint.fingerprint(a), lz_fingerprint.fingerprint(b)) - len(x & y) / len(x | y)) < 0.2


def test_lz_odd_tables(odd, none):
    rows = lz_fingerprint.fingerprint_edits(odd).collect()
    assert len(rows) == len(ODD)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[3]["fingerprint"] == "" and by_id[3]["near_edited"] == 1.0 and by_id[4]["near_next"] == 1.0
    assert lz_fingerprint.fingerprint_edits(none).collect() == []


# helpers ---------------------------------------------------------------------

def test_exact_column_is_picked(spark):
    table = spark.createDataFrame([(1, "right", "wrong")], "doc_id int, text string, other string").toDF("doc_id", "text", "TEXT")
    assert packing.pick(table, "doc_id", "text").collect() == [(1, "right")]
