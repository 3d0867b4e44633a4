"""Phrases, quality and spelling variants: against brute force on small tables with nulls, empty and long texts, ties,
repeated rows, empty tables and columns whose names clash."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import TINY
from tillroll.llm import collocation, quality, spelling

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_with_everything():
    rng = random.Random(3)
    words = ["the", "of", "and", "x", "ü", "new", "york", "city", "a b", "--", "\x00", "ice", "cream"]
    rows = [(1, None, "en"), (2, "", "en"), (3, " \t\n.,", None), (None, None, None), (None, "new york", None), (4, "New", "fr")]
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(90)))
        text = re.sub("(ice|x) ", lambda m: m[1] + rng.choice([" ", "\t ", ". ", "\r\n", ";"]), text)
        rows.append((10 + i, text, [None, "und", "en", "fr"][i % 4]))
    rows += [(100, "New York City. " * 700, "en"), (101, "na " * 9000, "de"), (102, "w" * 30_000 + " of", "de")]
    copy = " ".join(rng.choice(words) for _ in range(400))
    rows += [(200 + i, f"lead {i}, {copy}", "en") for i in range(40)] + [(200, f"lead 0, {copy}", "en")] * 3
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(texts_with_everything(), "doc_id long, text string, lang string")
    clash = "chunk words copies phrase n a l r k left right score rank size at cut most word form root near near_n cell home bucket label vec slots vals".split()
    return df.withColumns({c: F.lit(f"other {c}") for c in clash}).repartition(3)


# ---- 11 ---------------------------------------------------------------------------


def collocations(rows, least, top, covered=80):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(A_Z)):
            w = re.findall("[^ \t]+", piece)
            lang = "und" if lang is None else lang
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    most = defaultdict(int)
    for (lang, *w), a in candidates.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                part = (lang, *w[i : i + size])
                most[part] = max(most[part], a)
    by_lang = defaultdict(list)
    for p, a in candidates.items():
        lang, *w = p
        if 100 * most[p] < covered * a:
            sides = [(f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
            score, k = min((2_000_000 * a // (x + y), i) for i, (x, y) in enumerate(sides))
            by_lang[lang].append((-score, -a, " ".join(w).encode(), *sides[k]))
    return sorted(
        (lang, i + 1, phrase.decode(), -a, x, y, n[lang], -score)
        for lang, found in by_lang.items() for i, (score, a, phrase, x, y) in enumerate(sorted(found)[:top])
    )


FIELDS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("least, top, covered", [(30, 2000, 80), (3, 25, 80), (1, 2000, 100)])
def test_collocations_equal_brute_force(docs, least, top, covered):
    got = collocation.collocations(docs, least, top, covered)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5
    want = collocations(texts_with_everything(), least, top, covered)
    assert sorted(tuple(r) for r in got.select(*FIELDS).collect()) == want and len(want) > 20


def test_collocations_of_nothing(docs):
    assert collocation.collocations(docs.limit(0)).count() == 0
    assert collocation.collocations(docs.where("text is null")).count() == 0


def test_chunks_hold_every_phrase_once():
    rows = texts_with_everything()
    texts = [(t or "").encode() for _, t, _ in rows]
    found = defaultdict(list)
    for owner, chunk, n in collocation.chunks(texts):
        found[owner].append((chunk, n))
    for i, text in enumerate(texts):
        pieces = [re.findall(rb"[^ \t]+", p) for p in re.split(rb"[.,;:!?\n-\r]", text.lower() if text.isascii() else text.decode().translate(A_Z).encode())]
        want = Counter(tuple(w[j : j + 4]) for w in pieces for j in range(len(w)))
        got = Counter()
        for chunk, n in found[i]:
            start = 0
            for line in chunk.split(b"\n"):
                w = line.split(b" ") if line else []
                got.update(tuple(w[j : j + 4]) for j in range(len(w)) if start + j < n)
                start += len(w)
        assert got == want
    assert max(len(c) for c in found.values()) > 5


def test_copies_are_one_dictionary(spark):
    text = " ".join(f"w{i}" for i in range(5000))
    once = collocation.dictionary(spark.createDataFrame([("en", text)], "lang string, text string"))
    often = collocation.dictionary(spark.createDataFrame([("en", text)] * 50 + [("en", "other words. " + text)], "lang string, text string"))
    assert often.count() <= once.count() + 2
    assert often.agg(F.sum("copies")).first()[0] >= 51 * (once.count() - 1)


def test_a_full_filter_changes_no_count(docs, monkeypatch):
    want = collocation.collocations(docs, 5, 100).select(*FIELDS).collect()
    monkeypatch.setattr(collocation, "bloom", lambda frequent, size: np.full((collocation.SEGMENTS, 64), 255, dtype=np.uint8))
    assert sorted(map(tuple, collocation.collocations(docs, 5, 100).select(*FIELDS).collect())) == sorted(map(tuple, want))


# ---- 12 ---------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{TINY}/../sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.scores(docs, labels)
    assert got.count() == docs.count() and dict(got.dtypes)["predicted"] == "int"
    held = got.join(labels, "doc_id").where("held_out").toPandas()
    assert len(held) > 1000 and held.score.between(0, 1).all()
    assert (held.predicted == held.quality).mean() > 0.95
    order = held.score.rank().to_numpy()
    bad, good = order[held.quality == 0], order[held.quality == 1]
    assert (good.sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad)) > 0.97


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame(
        [(i, i % 2, "x") for i in range(10, 70)] + [(10, 1, "x"), (None, 0, "x"), (11, None, "x"), (999, 1, "x"), (12, 5, "x")],
        "doc_id long, quality int, score string",
    )
    rows = quality.scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add(r.score)
        want = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1
        assert r.held_out == want
    assert len(by_id[200]) == 1 and by_id[1] == by_id[2]
    assert quality.scores(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.scores(docs, labels.limit(0)).collect()} == {0.5}
    one_class = quality.scores(docs, labels.where("quality = 1")).collect()
    assert all(r.score == 1.0 for r in one_class)


def test_labels_of_held_out_rows_change_nothing(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 70)], "doc_id long, quality int")
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: round(r.score, 4) for r in quality.scores(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_votes_are_exact_cosines():
    rng = np.random.default_rng(1)
    voters = quality.latent(rng.standard_normal((300, quality.DIMS)).astype(np.float32), np.eye(quality.DIMS, dtype=np.float32))
    labels = rng.integers(0, 2, 300).astype(float)
    v = rng.standard_normal((quality.WIDTH, quality.DIMS)).astype(np.float32)
    model = quality.Model(np.ones(quality.WIDTH, dtype=np.float32), v, voters, labels, 0.5)
    texts = [rng.bytes(rng.integers(3, 400)) for _ in range(200)]
    got = np.concatenate([model.scores(t) for t in quality.term_counts(texts)])
    for text, score in zip(texts, got):
        x = (quality.weighted(next(quality.term_counts([text])), model.idf) @ v)[0].astype(float)
        cosine = voters.astype(float) @ x / np.linalg.norm(x)
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        weight = np.maximum(cosine[near], 0) ** quality.SHARPNESS
        assert abs(score - (weight * labels[near]).sum() / weight.sum()) < 1e-4


# ---- 13 ---------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows, every=199, least=6, least_n=5, times=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(A_Z)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= least_n}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(x, key=lambda v: (-n[v], v)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= times * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w) or "", root(w), n[w], len(near[w]), n[form[w]] if w in form else 0) for w in n)


def word_rows(seed, letters, count):
    rng = random.Random(seed)
    base = ["".join(rng.choices(letters, k=rng.randrange(6, 11))) for _ in range(count)]
    for w in base[: count // 3]:
        i = rng.randrange(len(w))
        base += [w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :], w[::-1]]
    rows = [(i, " ".join(rng.choice([w, w.capitalize()]) for w in rng.choices(base, weights=[1 / (k + 1) for k in range(len(base))], k=700))) for i in range(12)]
    rows += [(60 + i, "kettle " * 2 + "kettla " * 11 + "kattla " * 70) for i in range(4)]  # a form's form
    return rows + [(None, rows[0][1]), (None, None), (50, ""), (51, "Àÿ×÷ßéÀÿ " * 9 + "ǅabcdef abcdefĀ​" * 9), (3, rows[3][1]), (52, ("long" * 5000 + " ") * 6 + ("long" * 4999 + "lon ") * 40)]


@pytest.mark.parametrize("letters, cell", [("abé", None), ("abé", 10), ("abcdefghijklmnopqrstuvwxyzàéÿ", 20), ("ab", 3)])
def test_variants_equal_brute_force(spark, letters, cell):
    rows = word_rows(len(letters), letters, 300)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("word", "n", "form", "cell", "home", "near")})
    got = spelling.spelling_variants(df.repartition(3), cell=cell)
    assert sorted(got.columns) == sorted(["word", "form", "root", "n", "n_near", "form_n"])
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in got.collect())
    want = variants(rows)
    assert got == want
    assert [w[2] for w in want if w[0] == "kettle"] == ["kattla"]


def test_variants_of_nothing(spark):
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert spelling.spelling_variants(empty).count() == 0 and spelling.spelling_variants(empty.limit(0)).count() == 0


def test_crc_and_one_edit():
    texts = [b"abcdef \xc3\xa9\xc3\xa0xyz Q" * 3, b"", b"x"]
    buf, starts, ends, points, owner = spelling.runs(texts)
    words = [buf[a:b].tobytes() for a, b in zip(starts, ends)]
    state = np.array([zlib.crc32(f"{o}:".encode()) for o in owner], dtype=np.uint32)
    assert spelling.crc32_from(state, buf, starts, ends).tolist() == [zlib.crc32(f"{o}:".encode() + w) for o, w in zip(owner, words)]
    assert points.tolist() == [len(w.decode()) for w in words]
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randrange(6, 9))) for _ in range(2))
        assert spelling.one_edit(a.encode(), b.encode()) == one_edit(a, b)
