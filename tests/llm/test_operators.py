"""Each operator on small tables: brute force or exact rules, and the edge cases that its docstring defines."""

import base64
import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievestone.llm import contamination, lm, packing, quality, rules, sharding, simhash, token_counts, toxicity, warc
from sievestone.llm.components import components
from oracle import DATA
from sievestone.llm.queries import TOKENIZER, UNIGRAM, vocabulary_file

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, shard string, k string, fp string, `n` int"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
WORDS = "the of and to in is that for it was on with as by at from".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ly", "er", "ing"]) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def corpus():
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    texts += [None, "", " \n\t ", LONG, texts[0], texts[0], texts[1] + " tail", "é漢字   x", "a\nb\na\nb\n\n", "one two", "x" * 20_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, texts[5]), (None, texts[7]), (None, None)]
    return rows


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5, "c", "c", "c", 1) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table_of(spark, corpus())


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i):
    return -1 if i is None else i


# 1 ----------------------------------------------------------------------------------------------------------------
def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary_file(TOKENIZER)
    tok, cap = Tokenizer.from_file(path), 512
    rows = packing.pack(packing.pieces(docs, path, cap, with_ids=True), cap, max_docs=cap, max_cost=cap * cap, group=16).collect()
    by = collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= cap and r.start == r.piece * cap
        by[r.sequence_id].append(r)
    for s in by.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == list(np.cumsum([0] + [r.length for r in s])[:-1]) and sum(r.length for r in s) <= cap
    want = collections.Counter()
    for i, t in corpus():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.update((key(i), k // cap, tuple(ids[k : k + cap])) for k in range(0, len(ids), cap))
    assert collections.Counter((key(r.doc_id), r.piece, tuple(r.ids)) for r in rows) == want
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // cap) + 2
    assert packing.pack(packing.pieces(empty, path)).count() == 0


def test_packing_constraints():
    sizes = np.array(sorted(random.Random(1).choices(range(1, 100), k=300), reverse=True))
    for select in ("norm", "dot"):
        bins, offsets = packing.best_fit(sizes, 200, 5, 12_000, (1.0, 0.5, 0.5), select)
        for b in set(bins.tolist()):
            own = sizes[bins == b]
            assert own.sum() <= 200 and len(own) <= 5 and (own**2).sum() <= 12_000
    with pytest.raises(ValueError):
        packing.best_fit(np.array([300]), 200, 5, 12_000, (1, 0, 0))


def brute_best_fit(sizes, caps, weights, dot):
    """Plain lists: every open bin is looked at for every item."""
    bins, where = [], []
    for x in sizes:
        need, best = (x, 1, x * x), None
        for i, b in enumerate(bins):
            left = [r - n for r, n in zip(b, need, strict=True)]
            if min(left) < 0:
                continue
            if dot:
                value = -sum(w * r * n / c**2 for w, r, n, c in zip(weights, b, need, caps, strict=True))
            else:
                value = sum(w * (r / c) ** 2 for w, r, c in zip(weights, left, caps, strict=True))
            if best is None or value < best[0] - 1e-12:
                best = value, i
        if best is None:
            bins.append(list(caps))
            best = 0, len(bins) - 1
        bins[best[1]] = [r - n for r, n in zip(bins[best[1]], need, strict=True)]
        where.append(best[1])
    return where, bins


@pytest.mark.parametrize("select", ["norm", "dot"])
def test_best_fit_brute_force(select):
    rng = random.Random(4)
    for weights in ((1.0, 0.25, 0.25), (0.2, 1.0, 0.5)):
        sizes = sorted({rng.randint(1, 4000) for _ in range(150)}, reverse=True)
        caps = (4096, 6, 9_000_000 + 7_000_000)
        got, _ = packing.best_fit(np.array(sizes), *caps, weights, select)
        want, bins = brute_best_fit(sizes, caps, weights, select == "dot")
        loads = lambda of: sorted(sorted(x for x, b in zip(sizes, of, strict=True) if b == k) for k in set(of))
        assert loads(list(got)) == loads(want) and len(set(got)) == len(bins)


def test_weights_choose_without_cost():
    rng = random.Random(8)
    sizes = np.array(sorted((min(4096, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(4000)), reverse=True))
    runs = {w: packing.best_fit(sizes, 4096, 4096, 4096**2, w)[0] for w in ((1.0, 1e-9, 1e-9), packing.WEIGHTS, (0.1, 1.0, 1.0))}
    bound = -(-int(sizes.sum()) // 4096)
    assert all(len(set(b.tolist())) <= bound + 1 for b in runs.values())
    assert not np.array_equal(runs[1.0, 1e-9, 1e-9], runs[packing.WEIGHTS])


@pytest.mark.parametrize("sizes", [[2200] * 90 + [1500] * 90, [3000] * 50 + [1096] * 50, [1] * 300 + [4000] * 40, [4096] * 20 + [1]])
def test_many_groups_cost_nothing(spark, sizes):
    rows = spark.createDataFrame([(f"d{i}", 0, 0, n, i, "x", 5) for i, n in enumerate(sizes)], "doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint, __g string, offset int")
    got = packing.pack(rows, group=40).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        ends = [0] + list(np.cumsum([n for _, n in sorted(s)]))
        assert [a for a, _ in sorted(s)] == ends[:-1] and ends[-1] <= 4096
    alone = len(set(packing.best_fit(np.array(sorted(sizes, reverse=True)), 4096, 4096, 4096**2, packing.WEIGHTS)[0].tolist()))
    assert len(got) == len(sizes) and len(by) <= alone + 1 and all(r["__g"] == "x" for r in got)


def test_word_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    path, rng = vocabulary_file(TOKENIZER), random.Random(5)
    tok, own = Tokenizer.from_file(path), packing.WordIds(path)
    own.words.most = own.parts.most = 40
    for _ in range(600):
        s = "".join(rng.choices("abcXYZ éÀßñ'’s.,!#12²½ªºİΣσςйЁ漢★§\t\n-_|<>", k=rng.randint(0, 50))) + rng.choice(["", "it's I'LL", "<|endoftext|>"])
        assert list(own([s.encode(), b""])) == [np.array(tok.encode(s, add_special_tokens=False).ids, "<u4").tobytes(), b""]


def test_distinct_words_are_looked_up_once_a_block():
    class Counted(dict):
        calls = 0

        def __getitem__(self, key):
            Counted.calls += 1
            return super().__getitem__(key)

    from tokenizers import Tokenizer

    path = vocabulary_file(TOKENIZER)
    tok, own = Tokenizer.from_file(path), packing.WordIds(path)
    own.words.now = Counted()
    texts = [" the house, \x0b\x0c the House \r\n" * 500, "", "\t", "the\x1chouse\x85the\u2028the house"] * 2
    assert list(own([t.encode() for t in texts])) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert Counted.calls <= 10


def test_blocks_of_texts():
    path = vocabulary_file(TOKENIZER)
    whole, texts = packing.WordIds(path), [(t or "").encode() for _, t in corpus()]
    own = packing.WordIds(path)
    own.size = 50
    assert list(own(texts)) == list(whole(texts)) == [whole.encoded([t.decode()])[0] for t in texts]
    assert list(own([])) == []


# 2 ----------------------------------------------------------------------------------------------------------------
def test_contamination_brute_force(spark, empty):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randint(1, 60))) for i in range(25)] + [(25, None), (26, ""), (27, "Two words"), (3, "again")]
    rows = corpus() + [(100 + i, prose(rng, 300) + " " + (items[i][1] or "") + "\n" + prose(rng, 300)) for i in range(25)] + [(200, " ".join((items[4][1] + " zz").split()[2:])), (201, "say TWO  Words now")]
    got = contamination.contained(table_of(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"), block=400)
    want = collections.Counter()
    for j, item in items:
        ws = (item or "").lower().encode().split()
        w = min(5, len(ws))
        own = contamination.shingles(ws, w) if w else set()
        for i, t in rows:
            n = len(own & contamination.shingles((t or "").lower().encode().split(), w)) if own else 0
            if own and n >= 0.8 * len(own) - 1e-9:
                want[key(i), j, len(own), n] += 1
    assert collections.Counter((key(r.doc_id), r.item_id, r.n_shingles, r.n_found) for r in got.collect()) == want
    items_df = spark.createDataFrame(items, "item_id bigint, text string")
    kept = contamination.decontaminated(table_of(spark, rows), items_df, block=400)
    bad = {k[0] for k in want}
    assert sorted(key(r.doc_id) for r in kept.collect()) == sorted(key(i) for i, _ in rows if key(i) not in bad or i is None and not any(k[0] == -1 for k in want))
    assert contamination.contained(empty, items_df).count() == 0
    assert contamination.contained(table_of(spark, rows), items_df.limit(0)).count() == 0
    assert contamination.decontaminated(table_of(spark, rows), items_df.limit(0)).count() == len(rows)
    for kind in ("smallint", "double", "string", "date"):
        some = items_df.limit(5).select(F.when(F.lit(kind == "date"), F.lit("2020-01-01")).otherwise(F.lit("7")).cast(kind).alias("item_id"), "text")
        assert contamination.contained(table_of(spark, rows), some).schema["item_id"].dataType.simpleString() == kind
        assert contamination.contained(table_of(spark, rows), some).count() > 0
    odd = table_of(spark, rows).withColumn("item_id", F.lit("c")).withColumn("n_found", F.lit(1))
    assert contamination.decontaminated(odd, items_df, block=400).columns == odd.columns


# 3 ----------------------------------------------------------------------------------------------------------------
def brute_components(fps, radius):
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    fs = sorted(fps)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                up[find(b)] = find(a)
    return {f: find(f) for f in fs}


@pytest.mark.parametrize("tile,hot", [(4096, 16384), (8, 16), (4, 4), (100, 6)])
def test_links_connect_all(spark, tile, hot):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(150)}
    fps |= {0x1234 << 48 | rng.getrandbits(48) for _ in range(40)} | {0x77 << 8 | rng.getrandbits(8) | rng.getrandbits(24) << 40 for _ in range(60)}  # blocks that many share
    for f in list(fps)[:60]:
        for _ in range(6):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 6)):
                g ^= 1 << b
            fps.add(g)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    got = {r.node: r.root for r in components(simhash.links(df, len(signed), 4, tile, hot)).collect()}
    want = brute_components(signed, 4)
    group = lambda of: {frozenset(g) for g in _groups({f: of.get(f, f) for f in signed}).values()}
    assert group(got) == group(want)


def _groups(of):
    out = collections.defaultdict(set)
    for k, v in of.items():
        out[v].add(k)
    return out


def plain_fingerprint(text):
    """Bit by bit, with no code of the operator."""
    from xxhash import xxh64

    words = [w.decode() for w in re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()).split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64(x.encode(), 42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_brute_force():
    rng = random.Random(5)
    texts = [prose(rng, n) for n in (1, 2, 3, 4, 5, 6, 7, 8, 50, 51, 400)] + ["É Ü é A\tB\x0bc D", "a b c d a b c d a b c d", "x y", LONG, " ".join(f"q{i % 70001}" for i in range(70_000))]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("count", [1, 5_000, 3_000_000, 10**9, 10**12])
def test_close_pairs_share_a_key(count):
    rng = random.Random(count)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for i in rng.sample(range(64), 4):
            b ^= 1 << i
        shared = [m for m in simhash.masks(count, 4) if a & m == b & m]
        assert shared and all(any(a & x == b & x for x in simhash.finer(m, 4)) for m in shared)


def test_near_duplicates(spark, docs, empty):
    rows = [(key(r.doc_id), r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert len(rows) == len(corpus())
    fp = collections.defaultdict(set)
    for i, t in corpus():
        f = simhash.fingerprint((t or "").encode())
        fp[f - 2**64 if f >> 63 else f].add(key(i))
    comp = brute_components(list(fp), 4)
    least = {c: min([i for f in fs for i in fp[f] if i >= 0], default=None) for c, fs in _groups(comp).items()}
    assert collections.Counter(rows) == collections.Counter((key(i), f, least[comp[f]]) for i, t in corpus() for f in [next(f for f in fp if key(i) in fp[f] and _same(f, t))])
    kept = simhash.representatives(docs).collect()
    assert len(kept) == len(set(comp.values())) and {key(r.doc_id) for r in kept} == {i for i in least.values() if i is not None}
    assert kept[0].__fields__ == docs.columns
    assert simhash.near_duplicates(empty).count() == simhash.representatives(empty).count() == 0
    odd = docs.withColumns({n: F.lit(n) for n in ("__id", "__own", "part", "place", "root", "node", "component_id", "first")})
    again = simhash.representatives(odd)
    assert again.columns == odd.columns and again.count() == len(kept)


def test_hot_fingerprints(spark):
    rng = random.Random(6)
    rows = [(i, "" if i % 3 == 0 else "the same words again" if i % 3 == 1 else prose(rng, 30)) for i in range(900)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table_of(spark, rows)).collect()}
    assert all(got[i] == i % 3 for i in got if i % 3 < 2) and len(got) == 900
    where = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.representatives(where).collect()) == sorted(set(got.values()))


def _same(f, t):
    g = simhash.fingerprint((t or "").encode())
    return f == (g - 2**64 if g >> 63 else g)


def test_fingerprint():
    from xxhash import xxh64_intdigest as h

    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"A b") == h(b"a b", 42)
    two = [h(x, 42) for x in (b"a b c d", b"b c d e")]
    assert simhash.fingerprint(b"a  B\nc d e") == two[0] & two[1]


def test_components_chain(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(7, 7), (500, 501), (501, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# 4, 5 -------------------------------------------------------------------------------------------------------------
def labelled_corpus(spark):
    rng, rows, labels = random.Random(11), [], []
    for i in range(900):
        bad, toxic = i % 5 == 0, i % 3 == 0
        t = prose(rng, rng.randint(20, 150))
        if bad:
            t = " ".join(w + "###" for w in t.split())
        elif toxic:
            ws = t.split()
            for _ in range(3):
                ws.insert(rng.randrange(len(ws)), rng.choice(["zorblat", "zorbing", "idiot"]))
            t = " ".join(ws)
        rows.append((i, t))
        labels.append((i, 0 if bad else 1, 1 if toxic and not bad else 0))
    return table_of(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None), (4, 7, 7)], "doc_id bigint, quality int, toxic int"), labels


@pytest.mark.parametrize("module,column,at", [(quality, "quality", 1), (toxicity, "toxic", 2)])
def test_held_out(spark, docs, empty, module, column, at):
    df, labels, truth = labelled_corpus(spark)
    model = module.fit(df, labels)
    folds, held = (5, 0) if module is quality else (4, 2)
    got = {r.doc_id: r.score for r in module.score(df, model).collect()}
    out = [(got[t[0]] >= 0.3, t[at] == 1) for t in truth if zlib.crc32(str(t[0]).encode()) % folds == held]
    assert sum(a == b for a, b in out) >= 0.97 * len(out) and all(0 <= s <= 1 for s in got.values())
    edge = module.score(docs, model)
    assert edge.count() == len(corpus()) and edge.filter("score is null").count() == 0
    odd = docs.withColumns({"__score": F.lit("x"), "__label": F.lit(1)})
    all_kept = module.kept(odd, model, 2.0 if module is toxicity else -1.0)
    assert all_kept.columns == odd.columns and sorted(map(str, all_kept.collect())) == sorted(map(str, odd.collect()))
    want = [key(r.doc_id) for r in edge.collect() if (r.score >= 0.3) == (module is quality)]
    assert sorted(key(r.doc_id) for r in module.kept(odd, model, 0.3).collect()) == sorted(want)
    assert module.score(empty, model).count() == 0
    none = module.fit(df, labels.limit(0))
    assert 0 <= module.score(df, none).first().score <= 1
    assert module.score(docs, module.fit(empty, labels)).count() == len(corpus())


def test_rare_marks_are_learned(spark):
    df, labels, truth = labelled_corpus(spark)
    rows, own = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], [t[0] for t in truth if t[2] == 1][:20]
    extra = {i: prose(random.Random(i), 60) + " kwelmig " + prose(random.Random(-i), 60) for i in own}  # 20 toxic rows hold this word alone
    df = table_of(spark, [(i, extra.get(i, t)) for i, t in rows])
    train = [i for i in own if zlib.crc32(str(i).encode()) % 4 != 2]
    assert 8 <= len(train) < 24
    got = {r.doc_id: r.score for r in toxicity.score(df, toxicity.fit(df, labels)).collect()}
    assert all(got[i] >= 0.3 for i in own) and sum(got[t[0]] >= 0.3 for t in truth if t[2] == 0) <= 6


def test_cutoff():
    assert toxicity.cutoff({10: 50, 20: 5}, 1000, 0.1) is None
    assert toxicity.cutoff({10: 50, 150: 5, 90: 10}, 1000, 0.1) == 90  # 1000 e^-9 is 0.12, under a tenth of 15


def test_stems_need_several_words(spark):
    rows = [("only*", 30, 0), ("onlyone", 30, 0), ("zor", 9, 0), ("zorba*", 30, 0)] + [(f"zorba{c}", 8, 0) for c in "abcd"] + [(f"clean{i}", 0, 40) for i in range(50)]
    rows += [("hitting", 20, 0), ("hitting>", 15, 0), ("named", 20, 0), ("named>", 2, 0)]
    counts = spark.createDataFrame(rows, "mark string, pos bigint, neg bigint")
    words, stems = toxicity.telling(counts, {0: 400, 1: 60}, 0.1, 0.95, 3)
    assert list(stems) == ["zorba"] and words["hitting"] == toxicity.THREAT and words["named"] == words["onlyone"] == toxicity.INSULT
    assert not any(w.startswith("clean") for w in words)


def side_by_side(codes):
    """The five machines run on their own, each arc's numbers applied word by word."""
    states, total = {n: next(iter(m)) for n, m in toxicity.MACHINES.items()}, 0.0
    symbols = [s for c in codes for s in ([c & 15] + [toxicity.COMMA] * bool(c & toxicity.AFTER_COMMA))]
    for c in symbols:
        add, damp, scale = 0.0, 1.0, 1.0
        for n, m in toxicity.MACHINES.items():
            to, x = m[states[n]][c] if c in m[states[n]] else m[states[n]]["*"]
            damp, scale = damp * toxicity.damped(n, states[n]), scale * toxicity.scaled(n, states[n], c)
            states[n], add = to, add + x
        total = total * scale + damp * add
    return total


def test_composition():
    rng = random.Random(1)
    for _ in range(3000):
        codes = [rng.randrange(toxicity.COMMA) + rng.choice([0, 0, 0, toxicity.AFTER_COMMA]) for _ in range(rng.randint(1, 12))]
        assert toxicity.weight(codes) == pytest.approx(side_by_side(codes), abs=1e-12)


def normal_equations(rows, model):
    z = model.random(np.array([r["x"] for r in rows]))
    w, y = np.array([r["w"] for r in rows]), np.array([r["__label"] for r in rows], float)
    return (z * w[:, None]).T @ z, (z * w[:, None]).T @ y


def test_normal_equations(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.random() < 0.4), rng.normal(size=quality.N_STATS).tolist(), float(rng.random())) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, __label int, x array<double>, w double").repartition(7)
    model = quality.Model(np.zeros(quality.N_STATS), np.ones(quality.N_STATS), rng.normal(size=(quality.N_STATS, 40)), rng.uniform(0, 6, 40), None, None)
    for a, b in zip(quality._sums(df, model), normal_equations(df.collect(), model), strict=True):
        assert np.allclose(a, b, atol=1e-9)


def test_random_features_are_a_kernel():
    rng = np.random.default_rng(3)
    n = quality.N_STATS
    model = quality.Model(np.zeros(n), np.ones(n), rng.normal(0, 1 / (2 * n**0.5), (n, 60_000)), rng.uniform(0, 2 * np.pi, 60_000), None, None)
    x = rng.normal(size=(6, n))
    z = model.random(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 4 * n))
    assert np.abs(z @ z.T - exact).max() < 0.03


@pytest.mark.parametrize("module,folds,held", [(quality, 5, 0), (toxicity, 4, 2)])
def test_held_out_labels_are_not_counted(spark, module, folds, held):
    df, labels, _ = labelled_corpus(spark)
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held
    flip = [F.when(out, F.lit(1)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")]
    a, b = (module.score(df, module.fit(df, x)).orderBy("doc_id").collect() for x in (labels, labels.select("doc_id", *flip)))
    assert np.allclose([r.score for r in a], [r.score for r in b], atol=1e-9)


def test_isotonic():
    from sievestone.llm.learning import isotonic

    x, y = isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]), np.ones(5))
    assert list(y) == sorted(y) and y[0] == 0 and 0.5 in y
    tied = [isotonic(np.array([1.0, 1, 1, 2])[list(p)], np.array([0.0, 1, 0, 1])[list(p)], np.ones(4)) for p in ((0, 1, 2, 3), (3, 1, 0, 2), (2, 0, 1, 3))]
    assert all(list(x) == [1, 2] and y == pytest.approx([1 / 3, 1]) for x, y in tied)


def isotonic_brute(y, w):
    """min over later ends of max over earlier starts of the means."""
    mean = lambda a, b: sum(p * q for p, q in zip(y[a:b], w[a:b], strict=True)) / sum(w[a:b])
    return [max(min(mean(a, b) for b in range(i + 1, len(y) + 1)) for a in range(i + 1)) for i in range(len(y))]


def test_isotonic_brute_force():
    from sievestone.llm.learning import isotonic

    rng = np.random.default_rng(2)
    for _ in range(100):
        n = int(rng.integers(1, 12))
        s, y, w = np.arange(n) * 1.0, rng.integers(0, 2, n) * 1.0, rng.random(n) + 0.1
        x, p = isotonic(s, y, w)
        want = isotonic_brute(list(y), list(w))
        assert sorted(set(np.round(p, 9))) == sorted(set(np.round(want, 9)))


def test_grammar():
    lex = toxicity.Lexicon(toxicity.base_lexicon(), {})
    clauses = lambda s: lex.clauses(s.encode())[1]
    matched = lambda s: any(w >= toxicity.MATCH for w in clauses(s))
    for s in ("you are an idiot.", "idiot, you are.", "you stupid idiot", "he is, i think, a moron", "i will kill you.", "kill them all", "we'll hurt your friends", "ich werde dich töten", "tu es un idiota crétin"):
        assert matched(s), s
    for s in ("an idiot came.", "trash day is monday.", "kill the process and tell them.", "he burn the toast you like", "i did not say you are an idiot.", "you are not an idiot.", "she said you are an idiot.", "you are an idiot, he wrote.", "they kill time.", "kill the lights.", "hello there. fine!", "you threw out the trash"):
        assert not matched(s), s
    assert matched("i am not sure, you are an idiot") and matched("he said nothing but you are an idiot")
    assert lex.features(b"") == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0] and lex.features(b"an idiot came.") == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    assert len(clauses("you are an idiot. hello. you are scum\nyou moron; fine")) == 3
    fixed = toxicity.Model({}, {}, toxicity.FIXED)
    low, high = fixed.score([b"an idiot came. hello."]), fixed.score([b"you are an idiot."])
    assert low < 0.3 < high


def test_copies_teach_nothing(spark):
    rng = random.Random(2)
    clean = [prose(rng, 80) for _ in range(300)]
    base = prose(rng, 80) + " blorptag sits here " + prose(rng, 80)
    copies = [(base + f" tail{i}" if i % 2 else f"head{i} " + base, 1) for i in range(60)]
    other = [(prose(rng, 30) + " grumbix " + prose(rng, 30), 1) for _ in range(30)]
    rows = spark.createDataFrame([(t, 0) for t in clean] + copies + other, "text string, __label int").withColumn("doc_id", F.monotonically_increasing_id())
    once = toxicity.one_of_copies(rows)
    size = {r["__label"]: r["n"] for r in once.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    words, _ = toxicity.telling(toxicity._counts(once), size, 0.1, 0.95, 3)
    assert "grumbix" in words and "blorptag" not in words and once.filter("text like '%blorptag%'").count() <= 2


# 6 ----------------------------------------------------------------------------------------------------------------
def test_sharding_rules(spark, docs, empty):
    rows = sharding.shard(docs, 4).collect()
    assert collections.Counter((key(r.doc_id), r["size"], r.text_crc32) for r in rows) == collections.Counter((key(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in corpus())
    of = collections.defaultdict(set)
    slots = collections.defaultdict(list)
    for r in rows:
        of[r["size"], r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in of.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty).count() == 0


def least_largest(weights, shards):
    """The smallest largest sum of a contiguous partition, by dynamic programming over all cuts."""
    ends = [0, *np.cumsum(weights).tolist()]
    best = [0] + [10**18] * len(weights)
    for _ in range(shards):
        best = [min([best[j]] + [max(best[i], ends[j] - ends[i]) for i in range(j)]) for j in range(len(ends))]
    return best[-1]


@pytest.mark.parametrize("heavy", [[], [900], [400, 300, 200], [60] * 12, [5000]])
def test_cuts_are_minimax(spark, heavy):
    rng = random.Random(len(heavy))
    groups = [(rng.getrandbits(64) - 2**63, rng.choice([1, 2, 3, 5, 8])) for _ in range(200)] + [(5 << 20 | i, 3) for i in range(60)] + [(rng.getrandbits(63), w) for w in heavy]
    of, starts = sharding.cuts(spark.createDataFrame(groups, "h bigint, weight bigint"), 4)
    order = sorted((of.get(h, h), w) for h, w in groups)
    shard = [sum(p >= x for x in starts) for p, _ in order]
    assert shard == sorted(shard) and shard[-1] < 4  # contiguous in the order of places
    loads = [sum(w for (_, w), s in zip(order, shard, strict=True) if s == k) for k in range(4)]
    assert max(loads) == least_largest([w for _, w in order], 4)
    if heavy == [5000]:  # the rest is divided by the same rule
        assert sorted(loads)[-2] <= sorted(loads)[0] + 8


def test_divided_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        weights = [rng.choice([1, 1, 2, 3, 5, 8, 40, 100][: rng.randint(1, 8)]) for _ in range(rng.randint(1, 12))]
        shards, ends = rng.randint(1, 6), np.cumsum(weights).tolist()
        got = sharding.divided(ends, [False] * len(ends), shards)
        loads = np.diff([0, *got]).tolist()
        assert got[-1] == ends[-1] and set(got) <= set(ends) and len(got) <= shards and max(loads) == least_largest(weights, shards)


def test_hot_group_leaves_others_even(spark):
    rows = [(i, "same text " * 50) for i in range(300)] + [(1000 + i, f"own {i} " * 40) for i in range(700)]
    got = sharding.shard(table_of(spark, rows), 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = sorted(r.b for r in got)
    assert len(sizes) == 8 and sizes[-2] <= 1.05 * sizes[0]


# 7 ----------------------------------------------------------------------------------------------------------------
def brute_base(text):
    words = [w.decode() for w in (text or "").encode().split()]
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    at = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(at), len(words) < 20 or 100 * len(at) > 30 * len(words)


def test_rules(spark, docs, empty):
    rng = random.Random(6)
    extra = [(300 + i, " ".join(rng.choices("abc", k=rng.randint(0, 40)))) for i in range(60)]
    df = docs.unionByName(table_of(spark, extra))
    got = rules.apply_rules(df)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collections.Counter((key(r.doc_id), *(r[n] for n in names)) for r in got.collect()) == collections.Counter((key(i), *brute_base(t)) for i, t in corpus() + extra)
    assert got.filter("base_failed and kept").count() == 0 and rules.apply_rules(empty).count() == 0
    base = rules.base(df).filter("n_words > 0")
    order = list(rules.RULES)
    with pytest.raises(ValueError):
        rules.base(df.withColumn("n_words", F.lit(1)), carry=("n_words",))
    assert rules.base(df, carry=("k", "score")).columns[:3] == ["doc_id", "k", "score"]
    a = {(r.doc_id, r.n_words): r.rejected_by is None for r in rules.cascade(base, rules.RULES, order).collect()}
    b = {(r.doc_id, r.n_words): r.rejected_by is None for r in rules.cascade(base, rules.RULES, order[::-1]).collect()}
    assert a == b


def test_windows_are_compared_by_words(spark, monkeypatch):
    monkeypatch.setattr(rules.F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))  # all hashes meet
    rows = [(i, t) for i, t in corpus() if len(t or "") < 3000]
    got = rules.base(table_of(spark, rows)).select("doc_id", "n_words", "n_repeat_words").collect()
    assert collections.Counter((key(r.doc_id), r.n_words, r.n_repeat_words) for r in got) == collections.Counter((key(i), brute_base(t)[0], brute_base(t)[4]) for i, t in rows)


def test_costs_are_measured(spark, docs):
    some = rules.cut(rules.base(docs).filter("n_words > 5"))
    own = {"cheap": "n_words > 1000000", "dear": "length(regexp_replace(__text, '([a-z]+) +([a-z]+)', '$2 $1')) < 20"}
    got = rules.measured(some, own)
    assert got["dear"][1] > 5 * got["cheap"][1] > 0 and got["cheap"][0] == 0
    assert rules.ordered(some, {"never": "false", "always": "true"}) == ["always", "never"]
    assert rules.ordered(some.limit(0), own) == list(own)
    chosen = rules.sampled(table_of(spark, [(1, f"text {i}") for i in range(3000)]), 100)  # one id for all rows
    assert 50 < chosen.count() < 170 and rules.sampled(docs.limit(0)).count() == 0


# 8 ----------------------------------------------------------------------------------------------------------------
def brute_count(text, vocab, unknown):
    s = (" " + text).replace(" ", "▁") if text else ""
    best = [(0, 0)] + [None] * len(s)
    for a in range(len(s)):
        for b in range(a + 1, min(len(s), a + 20) + 1):
            p = s[a:b]
            if p in vocab:
                got = best[a][0] + vocab[p], best[a][1] + 1
            elif b == a + 1:
                got = best[a][0] + unknown, best[a][1] + len(p.encode())
            else:
                continue
            if best[b] is None or got[0] > best[b][0]:
                best[b] = got
    return best[-1][1]


def test_token_counts(spark, docs, empty):
    from sentencepiece import SentencePieceProcessor

    path = vocabulary_file(UNIGRAM)
    proto = token_counts.unigram(token_counts.load(path))
    vocab = {p.piece: p.score for p in proto.pieces if p.type == 1}
    count, library = token_counts.Counter(proto), SentencePieceProcessor(model_proto=proto.SerializeToString())
    rng = random.Random(8)
    texts = [t for _, t in corpus() if t and len(t) < 3000] + ["".join(rng.choices("the in an ñé漢▁\n  ", k=40)) for _ in range(200)]
    assert [count(t.encode()) for t in texts] == [brute_count(t, vocab, min(vocab.values()) - 10) for t in texts]
    texts += [t for _, t in corpus() if t] + [" ".join(texts) * 20]
    assert [count(t.encode()) for t in texts] == [len(library.encode(t)) for t in texts]
    got = token_counts.token_counts(docs, path).collect()
    assert collections.Counter((key(r.doc_id), r.n_tokens) for r in got) == collections.Counter((key(i), len(library.encode(t or ""))) for i, t in corpus())
    assert token_counts.token_counts(empty, path).count() == 0
    before, count.cache.most = count(texts[0].encode()), 3
    assert [count(t.encode()) for t in texts[:50]] == [len(library.encode(t)) for t in texts[:50]] and before == count(texts[0].encode())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_token_counts_of_a_table(spark):
    from sentencepiece import SentencePieceProcessor

    path = vocabulary_file(UNIGRAM)
    library = SentencePieceProcessor(model_proto=token_counts.unigram(token_counts.load(path)).SerializeToString())
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(rows, path).collect()}
    assert got == {r.doc_id: len(library.encode(r.text or "")) for r in rows.select("doc_id", "text").collect()}


# 9 ----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("least", [0, 6])
def test_warc(spark, tmp_path, least):
    pages = [(i, f"http://x/{i} é", h) for i, h in enumerate(["<p>a</p>", "", None, "<p>a</p>", "b\r\n\r\nc", "<p>a</p>", "long " * 9000, "é", ""])] + [(3, "again", "<p>a</p>"), (None, None, "b\r\n\r\nc")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id bigint, url string, html string, digest string, offset int").repartition(3)
    where = f"file://{tmp_path}/w{least}"
    index = warc.write(df, where, least, roll=200)
    assert index.count() == len(pages)
    got = warc.read(index, where, payloads=True, gap=0, most=500).collect()
    assert len(got) == len(pages)
    raw = lambda h: (h or "").encode()
    sha = lambda h: base64.b32encode(hashlib.sha1(raw(h)).digest()).decode()
    assert collections.Counter((key(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == collections.Counter((key(i), len(raw(h)), sha(h)) for i, _, h in pages)
    for h in {raw(h) for _, _, h in pages}:
        own = [r for r in got if r.payload_digest == base64.b32encode(hashlib.sha1(h).digest()).decode()]
        first = [r for r in own if r.record_type == "response"]
        if len(h) < least:
            assert len(first) == len(own)
        else:
            top = max(key(r.page_id) for r in own)
            assert [key(r.page_id) for r in first] == [top] and all(key(r.refers_to) == top for r in own if r.record_type == "revisit")
        assert all(bytes(r.payload) == h for r in first)
    some = index.filter("page_id in (4, 6)")
    assert sorted(r.page_id for r in warc.read(some, where).collect()) == [4, 6]
    assert warc.read(warc.write(df.limit(0), where + "e"), where + "e").count() == 0


def test_warc_with_names(spark, tmp_path):
    pages = [("a/b c", "u", "x"), ("ü>", "u", "x"), (None, "u", "y"), ("z", None, None)]
    df = spark.createDataFrame([(*p, 1, "c") for p in pages], "page_id string, url string, html string, `__row` int, `__digest` string")
    index = warc.write(df, f"file://{tmp_path}/w")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read(index, f"file://{tmp_path}/w").collect()}
    assert got == {"a/b c": ("revisit", "ü>"), "ü>": ("response", None), None: ("response", None), "z": ("response", None)}
    with pytest.raises(ValueError):
        warc.write(df.withColumn("page_id", F.lit(1.5)), f"file://{tmp_path}/v")


def test_warc_of_equal_pages(spark, tmp_path):
    df = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("p"), "id")).alias("html")).repartition(6)
    where = f"file://{tmp_path}/w"
    got = warc.read(warc.write(df, where, roll=30_000), where, most=4000)
    assert got.rdd.getNumPartitions() > 4
    rows = got.collect()
    assert len(rows) == 4000 and {r.refers_to for r in rows} == {None, 3999} and sum(r.record_type == "revisit" for r in rows) == 1333


# 10 ---------------------------------------------------------------------------------------------------------------
def test_language_models(spark, docs, empty):
    good, rest = docs.filter("doc_id < 30"), docs.filter("doc_id is null or doc_id >= 30")
    size, weight = 12, 0.7
    got = lm.score(docs, lm.fit(good, rest, size, weight)).collect()
    words = lambda t: (t or "").lower().encode().split()
    uni = collections.Counter(w for _, t in corpus() for w in words(t))
    vocab = sorted(uni, key=lambda w: (-uni[w], w))[:size]
    code = {w: i + 2 for i, w in enumerate(vocab)}
    counts = [collections.Counter(), collections.Counter()]
    enc = lambda t: [0, *(code.get(w, 1) for w in words(t))]
    for i, t in corpus():
        x = enc(t)
        counts[0 if i is not None and i < 30 else 1].update(zip(x, x[1:], strict=False))
    v, totals = size + 2, [sum(c.values()) for c in counts]

    def loss(k, t):
        scale = totals[0] / totals[1] if k else 1.0
        out, x = 0.0, enc(t)
        for a, b in zip(x, x[1:], strict=False):
            n = sum(c for (p, _), c in counts[k].items() if p == a) * scale
            u = (sum(c for (_, q), c in counts[k].items() if q == b) * scale + 1) / (totals[0] + v)
            out -= np.log(weight * counts[k][a, b] * scale / n + (1 - weight) * u if n else u)
        return out

    small = [(i, t) for i, t in corpus() if len(t or "") < 3000 and i is not None and i not in (5,)]
    of = {r.doc_id: r for r in got}
    for i, t in small:
        n = len(words(t))
        assert of[i].n_tokens == n
        if n:
            assert of[i].score == pytest.approx((loss(0, t) - loss(1, t)) / n, abs=1e-5)
        else:
            assert of[i].score is None
    assert len(got) == len(corpus())
    assert lm.score(empty, lm.fit(good, docs, size)).count() == 0
    assert lm.score(docs, lm.fit(empty, docs, size)).count() == len(corpus())
    assert lm.score(docs, lm.fit(good, empty, 500)).count() == len(corpus())


def test_language_models_of_all_words(spark, monkeypatch):
    rng = random.Random(9)
    rare = lambda c: " ".join(f"{c}{rng.randrange(4000)}" for _ in range(150))
    texts = [prose(rng, 300) + " " + rare(c) for c in "ab" * 20]
    near, far = prose(rng, 20), prose(rng, 20)
    texts += [near + " " + texts[0][-400:], near + " " + texts[1][-400:], far + " neverseen", "", None]
    df, good = table_of(spark, list(enumerate(texts))), [t for t in texts[:40:2]]
    target = table_of(spark, list(enumerate(good)))
    words = lambda t: (t or "").lower().encode().split()
    pairs = lambda t: list(zip([b"", *words(t)], words(t), strict=False))
    counts = [collections.Counter(p for t in c for p in pairs(t)) for c in (good, texts)]
    v, totals = len({w for t in texts for w in words(t)}) + 2, [c.total() for c in counts]
    assert v > 2048 + 500
    before, uni = ([collections.Counter() for _ in counts] for _ in range(2))
    for k, c in enumerate(counts):
        for (p, q), n in c.items():
            before[k][p] += n
            uni[k][q] += n

    def loss(k, t):
        scale, out = totals[0] / totals[1] if k else 1.0, 0.0
        for p, q in pairs(t):
            u = (uni[k][q] * scale + 1) / (totals[0] + v)
            out -= np.log(0.7 * counts[k][p, q] / before[k][p] + 0.3 * u if before[k][p] else u)
        return out

    for tokens, size in ((2_000_000, 8 << 20), (500, 1000)):  # one chunk and bucket, and many
        monkeypatch.setattr(lm, "CHUNK_TOKENS", tokens, raising=False)
        monkeypatch.setattr(lm, "BUCKET_BYTES", size, raising=False)
        for scored in (df, df.filter("true")):  # the background itself, and other rows
            of = {r.doc_id: r for r in lm.score(scored, lm.fit(target, df)).collect()}
            assert len(of) == len(texts)
            for i, t in enumerate(texts):
                assert of[i].n_tokens == len(words(t))
                if t:
                    assert of[i].target_loss == pytest.approx(loss(0, t)) and of[i].background_loss == pytest.approx(loss(1, t))
    assert of[40].score < of[41].score - 0.1  # they differ in rare words only


# pipeline ---------------------------------------------------------------------------------------------------------
def test_workers_drop_what_a_stage_held(spark, docs):
    from sievestone.session import map_arrow

    def live(batches):
        import gc

        import pyarrow as pa

        n = sum(type(x).__name__ == "WordIds" for x in gc.get_objects())
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n] * b.num_rows, pa.int64())], ["n"])

    assert packing.pieces(docs, vocabulary_file(TOKENIZER)).count() > 0
    assert [r.n for r in map_arrow(spark.range(0, 64, 1, 8), live, "n bigint").distinct().collect()] == [0]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    df, labels, truth = labelled_corpus(spark)
    rng = random.Random(1)
    item = prose(rng, 40)
    extra = [(2000, prose(rng, 80) + " " + item), (2001, prose(rng, 90)), (None, None), (2002, "")]
    extra += [(2003, extra[1][1]), (2003, extra[1][1])]
    table_of(spark, extra).unionByName(df).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({key(r.doc_id) for r in docs.select("doc_id").collect()})
    toxic = {t[0] for t in truth if t[2]}
    bad = {t[0] for t in truth if not t[1]}
    assert len(kept[0] & toxic) <= 0.03 * len(toxic) and len(kept[1] & bad) <= 0.03 * len(bad)
    clean = {t[0] for t in truth} - toxic - bad
    assert len(clean & kept[1]) >= 0.97 * len(clean)
    assert 2003 not in kept[2] and 2001 in kept[2] and 2000 in kept[2] and 2000 not in kept[3] and 2001 in kept[3]
    assert kept[3] == kept[4]
    # each stage again, from the rows that the one before it kept, by plain code
    at = lambda k: spark.read.parquet(f"{tmp_path}/{k}")
    all_docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    ids = lambda df: collections.Counter(key(r.doc_id) for r in df.select("doc_id").collect())
    assert ids(at(0)) == ids(toxicity.score(all_docs, toxicity.fit(all_docs, labels)).filter("score < 0.3"))
    assert ids(at(1)) == ids(quality.score(at(0), quality.fit(at(0), labels)).filter("score >= 0.3"))
    rows = [(r.doc_id, r.text) for r in at(1).collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    comp = brute_components(list(set(prints)), 4)
    best = {}
    for (i, _), f in zip(rows, prints, strict=True):
        best[comp[f]] = min(best.get(comp[f], (True, 0)), (i is None, i or 0))
    assert ids(at(2)) == collections.Counter(-1 if none else i for none, i in best.values())
    own = contamination.shingles(item.lower().encode().split(), 5)
    clean = [(r.doc_id, r.text) for r in at(2).collect() if len(own & contamination.shingles((r.text or "").lower().encode().split(), 5)) < 0.8 * len(own)]
    assert ids(at(3)) == collections.Counter(key(i) for i, _ in clean)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_file(TOKENIZER))
    want = collections.Counter()
    for i, t in clean:
        raw = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        want.update((key(i), k // 16384, len(raw[k : k + 16384]) // 4, zlib.crc32(raw[k : k + 16384])) for k in range(0, len(raw), 16384))
    assert collections.Counter((key(r.doc_id), r.piece, r.length, r.ids_crc32) for r in at(4).collect()) == want
