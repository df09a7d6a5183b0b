import random
import re
import zlib
from collections import Counter

import pytest

from sameas.llm import spelling


def plain_counts(rows, damaged=199):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            mark = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damaged and mark % damaged == 0:
                place = mark % len(run)
                run = run[:place] + run[place + 1:]
            if run:
                counts[run] += 1
    return counts


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_groups(rows, letters=6, least=5, ratio=5, damaged=199):
    counts = {w: n for w, n in plain_counts(rows, damaged).items() if n >= least and len(w) >= letters}
    found = {w: [v for v in counts if near(w, v)] for w in counts}
    forms = {}
    for w, vs in found.items():
        if vs:
            best = min(vs, key=lambda v: (-counts[v], v))
            if counts[best] >= ratio * counts[w]:
                forms[w] = best

    def root(w):
        while w in forms:
            w = forms[w]
        return w

    return {(w, forms.get(w), root(w), n, len(found[w]), counts.get(forms.get(w))) for w, n in counts.items()}


def groups(spark, rows, **how):
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {tuple(r) for r in spelling.variant_groups(table, **how).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_neighbours_of_short_alphabets(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abç", k=rng.randint(1, 7))) for _ in range(500)})
    found = {tuple(r) for r in spelling.neighbours(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert found == {(a, b) for a in words for b in words if near(a, b)}


def test_long_words_and_chains(spark):
    base = "".join(random.Random(2).choices("abcdé", k=4000))
    words = [base, base[:2000] + base[2001:], "x" + base, base[:-1] + "z", base + "q", *["a" * n for n in range(1, 30)], "b" + "a" * 9]
    words = sorted(set(words))
    found = {tuple(r) for r in spelling.neighbours(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert found == {(a, b) for a in words for b in words if near(a, b)}


@pytest.mark.parametrize("damaged", [199, 3, 0])
def test_groups_agree_with_all_pairs(spark, damaged):
    rng = random.Random(3)
    words = ["Straßen", "straßen", "étionneur", "letters", "lettres", "letter", "lettters", "ÀÉÎõü", "wordless", "worldless", "wordles"]
    rows = [(i, " ".join(rng.choices(words, weights=[1, 9, 30, 300, 40, 5, 7, 3, 60, 12, 2], k=40)) + "1x, y_z") for i in range(60)]
    giant = "".join(rng.choices("abcdefg", k=6_000))
    rows += [(100 + i, f"{giant[:i // 5 * 2_000]}{giant} {giant[:4_000]}z{giant[4_000:]}") for i in range(10)]
    rows += [(None, "lettersx " * 6), (7, None), (7, ""), (8, "12 !? \n"), (9, "q" * 50_000)] + [(10, "lettres étionneurs")] * 7
    assert groups(spark, rows, damaged=damaged) == plain_groups(rows, damaged=damaged)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = {tuple(r) for r in spelling.variant_groups(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert found == plain_groups(rows)


def test_empty_tables_and_clashing_names(spark):
    assert groups(spark, []) == set()
    assert groups(spark, [(1, None), (2, "short")]) == set()
    table = spark.createDataFrame([(1, "several " * 9, "x", 3)], "doc_id bigint, text string, word string, n int")
    assert [tuple(r) for r in spelling.variant_groups(table, damaged=0).collect()] == [("several", None, "several", 9, 0, None)]
