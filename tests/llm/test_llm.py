"""Operators for training data: against brute force on small tables, with nulls, empty and long texts, ties,
repeated rows, empty tables and columns whose names clash."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import canonical
from tests.conftest import TINY
from tillroll.llm import (
    decontam, embed_dedup, graph, jaccard_join, mixing, sharding, suffix_dedup, token_count, toxicity, url_filter, warc,
)
from tillroll.llm.oracles import ORACLES
from tillroll.llm.queries import QUERIES

PIECES = public_tokenizers.path("piece_bpe_32k.model")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def edge_rows():
    rng = random.Random(7)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"word{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(4)]
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "Two words", "b"), (5, "two WORDS", "b"), (None, base[0], "c"), (None, None, None)]
    rows += [(6, base[0], "a"), (6, base[0], "a"), (7, base[0].upper(), "b"), (6, base[1], "a"), (8, " ".join(vocabulary * 30), None)]
    for i in range(12):  # near copies, one word apart
        words = base[i % 3].split()
        words[rng.randrange(60)] = f"new{i}"
        rows.append((20 + i, " ".join(words), "a" if i % 2 else "d"))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(edge_rows(), "doc_id long, text string, source string")
    clash = "n node token size block first key pack rank bytes a b component check toxic score text_crc32 shard slot order bucket "
    clash += "_key _bucket _at _before _n _times _copy _source row own id mark key its_key times slots"
    clash = clash.split()
    return df.withColumns({c: F.lit(f"other {c}") for c in clash}).repartition(3)


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    got, want = QUERIES[name](spark, TINY).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_operator_is_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES


# ---- 1 ---------------------------------------------------------------------------


def test_rules_and_ratio(spark):
    urls = [
        (1, "http://a.example.com/en/1", "example.com/en/", "block"), (2, "https://www.example.com/en/x?y#z", "www.example.com/en/", "allow"),
        (3, "http://X.Example.COM/de/1", "com/", "allow"), (4, "http://b.net/fr/2", "net/fr/", "block"), (5, "ftp://notcom/", None, None),
        (6, None, None, None), (7, "no scheme com/en/", None, None), (8, "http://com", None, None), (9, "http://q.com/", "com/", "allow"),
        (9, "http://q.com/", "com/", "allow"), (None, "http://q.net/es/#f", "net/es/", "block"),
    ]
    pages = spark.createDataFrame([(i, u, "x") for i, u, _, _ in urls], "page_id long, url string, rule string")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(urls)
    by_id = {r.page_id: r for r in got}
    for i, _, rule, verdict in urls:
        assert by_id[i].rule == rule and by_id[i].verdict in ([verdict] if verdict else ["allow", "block"])
    assert (by_id[3].host, by_id[3].path) == ("x.example.com", "/de/1") and (by_id[6].host, by_id[6].path) == ("", "")
    assert (by_id[8].host, by_id[8].path) == ("com", "")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_queries_of_urls_are_read(spark):
    urls = [f"http://a{i}.net/es/?{w}={i}" for i in range(200) for w in ("casino", "poker")]
    urls += [f"http://a{i}.com/de/?{w}={i}" for i in range(200) for w in ("garden", "school")]
    free = ["http://z.org/a?casino=1&poker", "http://z.org/a?garden"]
    df = spark.createDataFrame(list(enumerate(urls + free)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(df).where("host = 'z.org'").collect()}
    casino, garden = got[len(urls)], got[len(urls) + 1]
    assert casino.ratio < garden.ratio and (casino.path, garden.path) == ("/a", "/a")


def test_models_tell_urls_apart(spark):
    rng = random.Random(1)
    urls = [f"http://{rng.choice(['bets', 'casino', 'poker'])}{rng.randrange(99)}.net/es/{i}" for i in range(300)]
    urls += [f"http://{rng.choice(['news', 'garden', 'school'])}{rng.randrange(99)}.com/de/{i}" for i in range(300)]
    free = [f"http://{w}{i}.org/x/{i}" for i in range(40) for w in ("casino", "garden")]
    df = spark.createDataFrame(list(enumerate(urls + free)), "page_id long, url string")
    got = url_filter.judge(df).where("host like '%.org'").collect()
    right = [(r.verdict == "block") == r.host.startswith("casino") for r in got]
    assert len(right) == 80 and np.mean(right) > 0.9


def test_ratios_use_every_count(spark):
    rng, order = random.Random(4), url_filter.ORDER
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    urls = [f"http://{word(8)}.{end}/{word(70)}" for _ in range(4000) for end in ("com", "net/es")]
    free = [f"http://{word(8)}.org/{word(9)}" for _ in range(20)] + [u.replace(".com/", ".org/") for u in urls[:400:20]]
    df = spark.createDataFrame(list(enumerate(urls + free)), "page_id long, url string").repartition(5)
    got = url_filter.judge(df).withColumn("text", F.concat("host", "path"))
    got = got.withColumn("aside", F.pmod(F.xxhash64("text"), F.lit(url_filter.HELD_OUT)) == 0).collect()
    places = lambda t: (lambda s: ((s[i - j : i + 1], s[i - j : i]) for i in range(order, len(s)) for j in range(order + 1)))(
        "\x02" * order + t + "\x03"
    )
    counts = defaultdict(lambda: [0, 0])
    for r in got:
        if r.rule is not None and not r.aside:
            for gram, context in places(r.text):
                for key in ((gram, 1), (context, 0)):
                    counts[key][r.verdict == "block"] += 1
    assert len(counts) > 1 << 20
    seen = dict(counts)
    for r in got:
        if r.rule is None:
            ratio, n = 0.0, len(r.text) + 1
            steps = list(places(r.text))
            for i in range(n):
                p = [1 / 256, 1 / 256]
                for gram, context in steps[i * (order + 1) : (i + 1) * (order + 1)]:
                    g, c = seen.get((gram, 1), [0, 0]), seen.get((context, 0), [0, 0])
                    p = [(g[k] + url_filter.SMOOTHING * p[k]) / (c[k] + url_filter.SMOOTHING) for k in (0, 1)]
                ratio += np.log(p[0]) - np.log(p[1])
            assert r.ratio == pytest.approx(ratio / n, abs=1e-9)


# ---- 2 ---------------------------------------------------------------------------


def brute_contamination(rows, items, size=13):
    cut = lambda t: ALNUM.findall((t or "").translate(A_Z))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(i)
    out = []
    for i, t in rows:
        w, hit, found = cut(t), set(), set()
        for g, owners in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found |= owners
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_contamination_against_brute_force(spark, docs):
    text = edge_rows()[7][1]
    items = [(1, " ".join(text.split()[5:30])), (2, "WORDS"), (3, None), (4, ""), (5, "two words"), (10, "never there at all"), (2, "words"), (None, "two")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, wid int")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = brute_contamination([r[:2] for r in edge_rows()], items)
    assert values(decontam.contamination(docs, bench), *columns) == want
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.clean(docs, bench).columns == docs.columns


def test_small_blocks_and_proximity(spark):
    df = spark.createDataFrame([(i, "a b c d e" if i % 2 else "a x b c x d e") for i in range(50)], "doc_id long, text string")
    wanted = decontam.windows(spark.createDataFrame([(1, "b c d")], "item_id long, text string"))
    index = decontam.build_index(df, block_bytes=64)
    assert index.select("block").distinct().count() > 5
    assert decontam.find(index, wanted).count() == 25
    near = decontam.find(index, wanted, slop=1)
    assert near.count() == 50 and near.where("exact").count() == 25


# ---- 3 ---------------------------------------------------------------------------


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(160):
        v = rng.normal(size=16) if i % 4 else np.array(rows[-3][1] if len(rows) > 2 else rng.normal(size=16)) + rng.normal(size=16) * 0.03
        rows.append((i, [float(x) for x in v], i % 3))
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, rows[0][1], None), (204, rows[0][1], 0), (205, rows[0][1], 0)]
    rows += [(206, [1e-300] * 16, 2), (207, [3e300] * 16, 2), (208, [1.0] * 8, 2), (209, [], 2), (None, [1.0] * 16, 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, id string, copies int")
    ok = [(i, np.array(v) / np.abs(v).max(), lab) for i, v, lab in rows if i is not None and v and lab is not None and np.isfinite(v).all() and any(v)]
    links = defaultdict(set)
    for i, x, a in ok:
        for j, y, b in ok:
            if i != j and a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[i].add(j)
    want = []
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        c = min(seen) if i is not None else None
        want.append((i, len(links[i]) if i is not None else 0, c, i == c))
    assert sum(len(x) for x in links.values()) > 40
    for block in (2048, 8):
        got = values(embed_dedup.near_duplicates(df, block=block), "vec_id", "n_links", "component_id", "kept")
        assert got == sorted(want, key=repr)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


# ---- 4 ---------------------------------------------------------------------------


def test_mixing(spark, docs):
    got = mixing.mixed_rows(docs)
    rows = got.collect()
    want = sorted(((i, len(SPACED.findall(t or ""))) for i, t, _ in edge_rows()), key=repr)
    assert values(got, "doc_id", "size") == want
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    total = sum(n for _, n in want)
    assert abs(sum(r.taken for r in rows) - total) <= 0.02 * total
    assert values(mixing.mixed_rows(docs.repartition(5)), *got.columns) == values(got, *got.columns)
    targets = {(r.source_size, round(r.target, 6)) for r in rows}
    sizes = defaultdict(int)
    for _, t, s in edge_rows():
        sizes[s] += len(SPACED.findall(t or ""))
    names = sorted([s for s in sizes if s is not None]) + [None]
    weight, left, goal = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set(names), {}
    while True:
        spare = total - sum(goal.values())
        share = {s: spare * weight[s] / sum(weight[x] for x in left) for s in left}
        full = {s for s in left if share[s] > 3 * sizes[s]}
        if not full:
            goal.update(share)
            break
        goal.update({s: 3 * sizes[s] for s in full})
        left -= full
    assert targets == {(sizes[s], round(goal[s], 6)) for s in names}
    assert mixing.mixed_rows(docs.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mixed_rows(nothing).collect()] == [(0, 0.0), (0, 0.0)]
    assert mixing.mix(docs).columns == docs.columns


def test_mixing_follows_its_schedule(spark):
    rows = [(i, "w " * 10, "abc"[0 if i % 3 else 1 + i % 2]) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert 90_000 // 10 > mixing.SLOTS  # slots of 10 words

    def unevenness(got):
        """How many slots the sources taken once are off their shares, at worst, in any run from the start."""
        worst = 0
        for s in "ac":
            slots = sorted(r.first_slot for r in got if r.source == s)
            worst = max(worst, *(abs(seen - k * len(slots) / 9000) for seen, k in enumerate(slots)))
        return worst

    first = lambda **kw: mixing.mixed_rows(df, block=10, **kw).join(df.select("doc_id", "source"), "doc_id").where("taken > 0").collect()
    drawn = lambda slot: F.pmod(F.xxhash64(slot), F.lit(mixing.POINTS))
    even, random_ = unevenness(first()), unevenness(first(point=drawn))
    assert even < random_ / 2

    # the schedule itself, in plain Python
    goals = mixing.targets(df.groupBy("source").agg(F.sum(mixing.words_in("text")).alias("source_size")))
    plan = {r.source: r for r in goals.collect()}
    block, slots = 10, 9000
    got = sorted((r.slot, r.source, r.rank) for r in mixing.schedule(goals, block, slots).collect())
    edges, at = [], 0.0
    for s in "abc":
        edges.append((s, int(plan[s].upto / plan["c"].upto * mixing.POINTS)))
    ranks, want = defaultdict(int), []
    need = {s: -(-plan[s].quota // block) for s in "abc"}
    for k in range(slots):
        s = next(s for s, high in edges if k * mixing.GOLDEN % mixing.POINTS < high)
        if ranks[s] < need[s]:
            want.append((k, s, ranks[s]))
        ranks[s] += 1
    behind = slots
    for s in "abc":
        for r in range(ranks[s], need[s]):
            want.append((behind, s, r))
            behind += 1
    assert got == sorted(want) and behind - slots < 30

    placed = mixing.mix(df, block=10, slot="place")
    assert placed.columns == [*df.columns, "place"]
    assert placed.agg(F.max("place")).first()[0] < behind
    big = spark.range(5).select((F.col("id") * (1 << 40) + 3).alias("id"))
    assert [r[0] for r in big.select(mixing.golden_point(F.col("id"))).collect()] == [((i << 40) + 3) * mixing.GOLDEN % mixing.POINTS for i in range(5)]


def test_mixing_gives_small_sources_their_targets(spark):
    # few slots make blocks of a thousand words: larger than, or a few times, the small sources
    sizes = {"a": 30, "b": 60_000, "c": 700, "d": 2500, None: 90}
    rows = [(s, i) for s, n in sizes.items() for i in range(n // 10)]
    df = spark.createDataFrame([(k, "w " * 10, s) for k, (s, _) in enumerate(rows)], "doc_id long, text string, source string")
    for block in (1, 7, mixing.BLOCK):
        taken, target = defaultdict(int), {}
        for r in mixing.mixed_rows(df, block=block).collect():
            taken[r.source_size] += r.taken
            target[r.source_size] = r.target
            assert 0 <= r.taken <= 3 * r.size
        assert all(abs(taken[n] - target[n]) < 1 for n in sizes.values()) and sum(taken.values()) == sum(sizes.values())
    mixed = mixing.mix(df, block=9)
    assert mixed.where("source = 'a'").count() == 9 and mixed.where("source = 'd'").select("doc_id").distinct().count() == 250


# ---- 5 ---------------------------------------------------------------------------


def brute_removals(rows):
    smallest, out = {}, []
    rank = lambda i: suffix_dedup.NO_ID if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            smallest[b[p : p + 50]] = min(smallest.get(b[p : p + 50], rank(i)), rank(i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if smallest[b[p : p + 50]] < rank(i):
                gone[p : p + 50] = b"\1" * 50
        spans = len(re.findall(rb"\x01+", gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, x in zip(b, gone) if not x)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"pack_bytes": 500, "hot": 1}])
def test_suffix_dedup_against_brute_force(spark, docs, options):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert values(suffix_dedup.removals(docs, **options), *columns) == brute_removals([r[:2] for r in edge_rows()])
    assert suffix_dedup.removals(docs.limit(0), **options).count() == 0
    runs = [(1, "ab" * 100), (2, "x" + "ab" * 60 + "y"), (3, "é" * 60), (4, "a" * 49), (5, "a" * 300), (6, "a" * 50)]
    df = spark.createDataFrame(runs, "doc_id long, text string")
    assert values(suffix_dedup.removals(df, **options), *columns) == brute_removals(runs)


def test_deep_shallow_order():
    rng = random.Random(3)
    for _ in range(200):
        tail = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 12))) for _ in range(40)]
        strings = list({b"x" * rng.choice([0, 20, 30, 40]) + t for t in tail})
        order, lcp = suffix_dedup.deep_shallow(strings)
        got = [strings[i] for i in order]
        assert got == sorted(strings)
        assert all(suffix_dedup.common(a, b) == n for a, b, n in zip(got, got[1:], lcp[1:]))


# ---- 6 ---------------------------------------------------------------------------


def test_token_counts_are_the_librarys(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    odd = [(100 + i, t, "x") for i, t in enumerate([
        "<s>hi</s> <unk>", "  a  b ", "▁▁x ▁", "\n\t x", "日本語 ﬁ ①", "ha" * 3000, " " * 40 + "x", "\0a\0", "no" + "space" * 500,
    ])]
    df = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame(odd, "doc_id long, text string, source string"))
    want = sorted(((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t, _ in edge_rows() + odd), key=repr)
    for chunk in (token_count.CHUNK, 7, 64):
        assert values(token_count.token_counts(df, PIECES, chunk=chunk), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_count.token_counts(df.limit(0), PIECES).count() == 0


def test_maps_compose_in_any_grouping():
    t = token_count.transducer(PIECES)
    text = t.model.normalize("some  words, and a\nfew   more words here  ")
    want = t.count(text)
    for k in (1, 2, 3, 5, 8, 100):
        maps = [token_count.chunk_map(t, text[i : i + k]) for i in range(0, len(text), k)]
        assert token_count.combined(t, maps) == want
        one = maps[0]
        for m in maps[1:]:
            one = token_count.compose(t, one, m)
        assert t.count(one.head) + one.inner + t.count(one.tail or "") == want


# ---- 7 ---------------------------------------------------------------------------


def brute_components(rows, size, num, den):
    sets, ids = [], []
    for i, t in rows:
        w = SPACED.findall((t or "").translate(A_Z))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()})
        ids.append(i)
    # an id is one node; a row without id is a node that only its equals lend a component
    to = {i: i for i in ids if i is not None}

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and None not in (ids[a], ids[b]) and den * len(x & y) >= num * len(x | y):
                p, q = root(ids[a]), root(ids[b])
                to[max(p, q)] = min(p, q)
    out = []
    for i, s in zip(ids, sets):
        equal = [root(j) for j, o in zip(ids, sets) if j is not None and o == s and s]
        out.append((i, len(s), root(i) if i is not None and s else i if i is not None else min(equal, default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size, num, den, hot", [(4, 85, 100, 50_000), (5, 4, 5, 50_000), (4, 85, 100, 1)])
def test_jaccard_components_against_brute_force(spark, docs, size, num, den, hot):
    rows = [r[:2] for r in edge_rows() if r[0] != 6 or r[1] == edge_rows()[7][1]]
    df = docs.where(~((F.col("doc_id") == 6) & (F.col("text") != edge_rows()[7][1])) | F.col("doc_id").isNull())
    got = jaccard_join.jaccard_components(df, size, num, den, hot)
    assert values(got, "doc_id", "n_shingles", "component_id") == brute_components(rows, size, num, den)
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0
    assert jaccard_join.keep_one(docs).columns == docs.columns


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 200), (7, 7), (5, 4), (None, 3)]
    got = values(graph.components(spark.createDataFrame(links, "a long, b long")), "node", "component")
    assert got == sorted([(i, 0) for i in range(51)] + [(i, 100) for i in range(100, 140)], key=repr)


# ---- 8 ---------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    big = "payload\r\n\r\nWARC/1.1 é" * 60
    rows = [(1, "http://b.org/x", big), (2, "http://a.org/", big), (3, None, None), (4, "http://a.org/\r\nX: y", ""), (5, "u", "small"), (6, "u", "small"),
            (7, "http://A.org:80/q?z#f", big + "!"), (7, "http://a.org/q?z", big + "!"), (None, "n", big), (8, "x", "e" * 999), (9, "x", "e" * 999)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    largest = {h: max(i for i, _, x in rows if x == h and i is not None) for _, _, h in rows if h and len(h.encode()) >= 1000}
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        other = largest.get(h) if largest.get(h, i) != i else None
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if other is not None else "response", other))
    path = str(tmp_path / "archives")
    got = warc.round_trip(pages, path=path)
    assert values(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    headers = []
    for part in (tmp_path / "archives").glob("*.gz"):
        headers += [h for _, h, _ in warc.records(warc.inflated(part.read_bytes()))]
    responses = {h["WARC-Record-ID"] for h in headers if h["WARC-Type"] == "response"}
    revisits = [h["WARC-Refers-To"] for h in headers if h["WARC-Type"] == "revisit"]
    assert revisits and set(revisits) <= responses
    captures = warc.history(warc.read_archives(spark, path)).collect()
    keys = [(r.url_key, r.captured) for r in captures]
    assert keys == sorted(keys) and len(keys) == len(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_loser_tree_merges():
    rng = random.Random(4)
    for k in range(9):
        runs = [sorted(("f", j, f"k{rng.randrange(30)}", "t", rng.randrange(9), "u", "response", 1, "d", None) for j in range(rng.randrange(12))) for _ in range(k)]
        runs = [sorted(r, key=warc.order) for r in runs]
        got = [warc.order(x) for x in warc.LoserTree([iter(r) for r in runs])]
        assert got == sorted(warc.order(x) for r in runs for x in r)


# ---- 9 ---------------------------------------------------------------------------


def test_sharding(spark, docs):
    got = sharding.shard_rows(docs, 4).collect()
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in edge_rows())
    assert sorted((r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    whole = sharding.shard(docs, 4)
    assert whole.groupBy("text").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
    assert set(whole.columns) == set(docs.columns) and sharding.shard(docs.limit(0), 4).count() == 0


def test_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(50):
        sizes = sorted((rng.randrange(1, 60) for _ in range(rng.randrange(1, 80))), reverse=True)
        room, want = [], []
        for s in sizes:
            fits = [(r, i) for i, r in enumerate(room) if r >= s]
            if fits:
                i = min(fits)[1]
            else:
                i = len(room)
                room.append(max(100, s))
            room[i] -= s
            want.append(i)
        assert sharding.best_fit(sizes, 100) == want
        bins, capacity = sharding.fewest(sizes, 5)
        assert max(bins) < 5


@pytest.mark.parametrize("share", [1 / 3, 1 / 10])
def test_sharding_with_a_large_group(spark, share):
    copies = int(6000 * share)
    rows = [(i, "x" * 99) for i in range(copies)] + [(i, f"{i:099}") for i in range(copies, 6000)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    loads, hot = defaultdict(int), {r.shard for r in got if r.doc_id < copies}
    for r in got:
        loads[r.shard] += r["size"]
    assert sorted(loads) == list(range(16)) and len(hot) == 1
    assert loads.pop(hot.pop()) == 100 * copies
    assert max(loads.values()) - min(loads.values()) <= 0.05 * (6000 - copies) * 100 / 15


def test_fewest_with_sizes_beyond_the_mean():
    bins, capacity = sharding.fewest([1000, 500] + [1] * 100, 6)
    assert bins[:2] == [0, 1] and capacity == 25
    assert sorted(bins[2:].count(b) for b in range(6)) == [0, 0, 25, 25, 25, 25]


# ---- 10 --------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(6)
    words = ["garden", "river", "stone", "cloud", "paper", "market", "winter", "bridge", "music", "letter"]
    rows = []
    for i in range(600):
        w = [rng.choice(words) for _ in range(rng.choice([5, 40, 300]))]
        if i % 5 == 0:
            w[rng.randrange(len(w))] = rng.choice(["Idiot", "scumbag"])
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    df = spark.createDataFrame([(i, t, 9, 9) for i, t, _ in rows] + [(None, None, 9, 9), (700, "", 9, 9), (5, rows[5][1], 9, 9)], "doc_id long, text string, toxic int, score int")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(5, None, 1), (None, 1, 1), (701, 1, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.scores(df, labels).collect()
    assert len(got) == 603
    truth = {i: y for i, _, y in rows}
    wrong = [r for r in got if r.held_out and r.doc_id in truth and r.predicted != truth[r.doc_id]]
    assert len(wrong) <= 2
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert {r.predicted for r in got if r.doc_id in (None, 700)} == {0}
    # labels that are held out change nothing
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted((r.doc_id or -1, r.score) for r in toxicity.scores(df, flipped).collect()) == sorted((r.doc_id or -1, r.score) for r in got)
    assert {r.score for r in toxicity.scores(df, labels.limit(0)).collect()} == {0.5}
    assert toxicity.scores(df.limit(0), labels).count() == 0
    assert toxicity.without_toxic(df, labels).columns == df.columns


def test_toxicity_of_long_texts(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    long = spark.createDataFrame([(1, "river " * 500_000 + "idiot"), (2, "river " * 500_000)], "doc_id long, text string")
    assert sorted(r.doc_id for r in toxicity.without_toxic(long, labels).collect()) == [1, 2]


# ---- pipeline --------------------------------------------------------------------


def test_stages_judge_rows_by_their_own_texts(spark, docs):
    a, c = " ".join(f"a{i}" for i in range(40)), " ".join(f"c{i}" for i in range(40))
    df = spark.createDataFrame([(1, a), (1, " ".join(f"b{i}" for i in range(40))), (2, c), (None, c), (None, None), (3, ""), (3, "")], "doc_id long, text string")
    df = df.withColumns({n: F.lit(n) for n in "_copy _times _key row key id own mark slot".split()})
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    assert values(kept, "doc_id", "text") == sorted([(i, t) for i, t in values(df, "doc_id", "text") if (i, t) != (None, c)], key=repr)
    # rows that agree in id and text are told apart by their other columns
    twice = df.where("doc_id = 2").unionAll(df.where("doc_id = 2").withColumn("_copy", F.lit("A"))).unionAll(df.where("doc_id = 2"))
    assert [r["_copy"] for r in jaccard_join.keep_one(twice).collect()] == ["A"]

    bench = spark.createDataFrame([("i", c)], "item_id string, text string")
    clean = decontam.clean(df.unionAll(df.where("doc_id = 2").withColumn("doc_id", F.lit(1).cast("long"))), bench)
    assert clean.columns == df.columns
    assert values(clean, "doc_id", "text") == sorted([(i, t) for i, t in values(df, "doc_id", "text") if t != c], key=repr)

    mixed = mixing.mix(df.withColumn("source", F.lit(None).cast("string")))
    assert set(df.columns) <= set(mixed.columns) and mixed.where("_copy = '_copy' and _times = '_times'").count() == mixed.count() == 4
    sharded = sharding.shard(df, 3)
    assert set(df.columns) <= set(sharded.columns) and sharded.where("_key = '_key'").count() == df.count()
    assert sharding.shard(docs, 3).count() == docs.count()


def test_stages_take_any_rows(spark, docs):
    docs = docs.withColumn("lang", F.lit(None).cast("string"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, TINY)
        assert set(docs.columns) <= set(out.columns), name
        assert out.select("_key", "text").join(docs.select("_key", "text"), F.expr("true") & out["text"].eqNullSafe(docs["text"]), "left_anti").count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    out = corpus_pipeline.run(spark, TINY)
    assert set(docs.columns) <= set(out.columns) and 0 < out.count()
    assert out.join(docs, docs.columns, "left_anti").count() == 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, TINY)
        assert empty.count() == 0
