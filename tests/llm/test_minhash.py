import random

import numpy as np
from helpers import components, corpus, empty, frame, shingle_set, words

from cuewright.llm import minhash as M


def check(spark, scratch, rows, clash=False):
    comp, sizes = components(rows)
    got = M.near_duplicates(frame(spark, rows, clash), scratch).collect()
    assert {r.doc_id: r.component_id for r in got} == comp
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return comp


def test_equals_all_pairs(spark, scratch):
    comp = check(spark, scratch, corpus(), clash=True)
    assert len(set(comp.values())) < len(comp)


def test_large_group_of_near_copies(spark, scratch, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 16)
    rnd = random.Random(2)
    base = words(rnd, 150, 10_000)
    rows = []
    for i in range(90):
        v = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4, 5])):
            v[rnd.randrange(len(v))] = f"x{i}"
        rows.append((i, " ".join(v), "en", "s", 0))
    check(spark, scratch, rows)


def test_frequent_text_in_large_buckets(spark, scratch, monkeypatch):
    """Texts that share most of their words but are not linked meet no more; near copies among them are found."""
    monkeypatch.setattr(M, "BLOCK", 8)
    met, ranked = [], M.rarest

    def seen(*args):
        out = ranked(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(M, "rarest", seen)
    rnd = random.Random(4)
    common = words(rnd, 140, 10_000)
    rows = [(i, " ".join([*common, *words(rnd, 45, 10**6)]), "en", "s", 0) for i in range(60)]
    comp = check(spark, scratch, rows)
    assert len(set(comp.values())) == 60 and met == [0]
    for i in range(0, 60, 4):
        w = rows[i][1].split(" ")
        w[150 + i // 4] = f"x{i}"
        rows.append((100 + i, " ".join(w), "en", "s", 0))
    comp = check(spark, scratch, rows)
    assert len(set(comp.values())) == 60 and len(met) == 2


def test_rarest_shingles_lose_no_link(spark, scratch):
    rnd = random.Random(9)
    pool = rnd.sample(range(10**6), 130)
    sets = [sorted(rnd.sample(pool, len(pool) - rnd.randrange(0, 16))) for _ in range(30)]
    members = spark.createDataFrame([(i, i, len(s), i) for i, s in enumerate(sets)], "rep long, tk long, n long, comp long")
    held = spark.createDataFrame([(i, i, s) for i, s in enumerate(sets)], "rep long, tk long, s array<long>")
    keys = {}
    for r in M.rarest(scratch, members, held, 85).collect():
        keys.setdefault(r.rep, set()).add(r.key)
    near = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            n = len(set(a) & set(b))
            if 100 * n >= 85 * (len(a) + len(b) - n):
                near += 1
                assert keys[i] & keys[j]
    assert near > 20


def test_block_links_against_pairs():
    rnd = random.Random(6)
    pool = np.array(sorted(rnd.sample(range(10**6), 120)), dtype=np.uint64)
    sets = [np.sort(np.delete(pool, rnd.sample(range(120), rnd.randrange(0, 22)))) for _ in range(40)]
    rep = np.arange(40)
    for second in (np.zeros(40, dtype=bool), rep % 2 == 1):
        a, b = M.block_links(rep, rep.copy(), second, sets, 85)
        parent = list(range(40))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(40):
            for j in range(i):
                if second.any() and second[i] == second[j]:
                    continue
                n = len(np.intersect1d(sets[i], sets[j]))
                if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
        assert dict(zip(a.tolist(), b.tolist())) == {i: find(i) for i in range(40) if find(i) != i}


def test_estimate_is_near_the_truth(spark):
    import pyarrow as pa

    rnd = random.Random(8)
    a = words(rnd, 400, 10**6)
    b = list(a)
    for k in rnd.sample(range(400), 12):
        b[k] = f"y{k}"
    sig = M.sketch_batch(pa.array([" ".join(a), " ".join(b)])).field("sig").to_pylist()
    got = spark.createDataFrame([sig], "x array<long>, y array<long>").select(M.estimate("x", "y").alias("e")).first().e
    s, t = shingle_set(" ".join(a)), shingle_set(" ".join(b))
    assert abs(got - len(s & t) / len(s | t)) < 0.15
    same = spark.createDataFrame([(sig[0], sig[0])], "x array<long>, y array<long>").select(M.estimate("x", "y").alias("e")).first().e
    assert same == 1.0


def test_repeated_rows_null_ids_and_empty(spark, scratch):
    rows = corpus(n=10)
    rows += [rows[0], (None, rows[0][1], "en", "s", 1), (None, None, None, None, None)]
    got = M.near_duplicates(frame(spark, rows), scratch).collect()
    assert len(got) == len(rows)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert M.near_duplicates(empty(spark), scratch).count() == 0


def test_deduplicate_keeps_one_of_each_group(spark, scratch):
    rows = corpus(seed=3)
    comp, _ = components(rows)
    df = frame(spark, [*rows, rows[0]], clash=True)
    out = M.deduplicate(df, scratch)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, c in comp.items() if i == c)
    assert M.deduplicate(empty(spark), scratch).count() == 0


def test_equals_all_pairs_at_080(spark, scratch):
    rnd = random.Random(12)
    rows = []
    for i in range(30):  # a run of c changed words takes c + 4 of 196 shingles: similarities from 0.79 to 0.85
        w = words(rnd, 200, 10**6)
        c = 12 + i % 8
        rows += [(2 * i, " ".join(w), "en", "s", 0), (2 * i + 1, " ".join(w[:60] + [f"x{i}_{k}" for k in range(c)] + w[60 + c :]), "en", "s", 0)]
    comp, _ = components(rows, 80)
    assert len(set(components(rows)[0].values())) > len(set(comp.values())) < len(rows)
    df = frame(spark, rows)
    assert {r.doc_id: r.component_id for r in M.near_duplicates(df, scratch, percent=80).collect()} == comp
    kept = sorted(i for i, c in comp.items() if i == c)
    assert sorted(r.doc_id for r in M.deduplicate(df, scratch, percent=80).collect()) == kept


def test_screen_is_four_deviations_below_the_threshold():
    for percent in (50, 80, 85, 95):
        agree = 1 / 16 + 15 / 16 * percent / 100
        assert percent / 100 - M.screen(percent) >= 4 * (agree * (1 - agree) / 128) ** 0.5 * 16 / 15
    assert M.screen(85) <= 0.70


def test_hopeful_rows_have_a_partner_that_the_screen_allows(monkeypatch):
    monkeypatch.setattr(M, "TILE", 7)
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 63, (3, M.LANES), dtype=np.uint64)
    sig, n = base[rnd.integers(0, 3, 60)], rnd.integers(80, 130, 60)
    for i in range(60):  # some lanes of each differ
        for lane in rnd.choice(M.HASHES, rnd.integers(0, 50), replace=False):
            sig[i, lane // 16] ^= np.uint64(int(rnd.integers(1, 16)) << (4 * int(lane % 16)))
    comp = rnd.integers(0, 20, 60)

    def near(i, j):
        same = sum((int(a) >> 4 * k) & 15 == (int(b) >> 4 * k) & 15 for a, b in zip(sig[i], sig[j], strict=True) for k in range(16)) / M.HASHES
        return comp[i] != comp[j] and (same - 1 / 16) / (15 / 16) >= M.screen(85) and 100 * min(n[i], n[j]) >= 85 * max(n[i], n[j])

    for second in (np.zeros(60, dtype=bool), np.arange(60) % 2 == 1):
        want = [any(near(i, j) for j in range(60) if not second.any() or second[i] != second[j]) for i in range(60)]
        assert M.hopeful(comp, second, n, sig, 85).tolist() == want and 5 < sum(want) < 55


def test_templated_texts_send_few_sets(spark, scratch, monkeypatch):
    """Pages of shared paragraphs, none linked, end at the screen; near copies among them are found."""
    monkeypatch.setattr(M, "BLOCK", 64)
    held, inner = [], M.in_blocks

    def seen(rows, blocks_of):
        held.append(rows)
        return inner(rows, blocks_of)

    monkeypatch.setattr(M, "in_blocks", seen)
    rnd = random.Random(1)
    paragraphs = [words(rnd, 40, 10**6) for _ in range(12)]
    rows = []
    for i in range(300):
        shared = [w for p in rnd.sample(paragraphs, 5) for w in p]
        rows.append((i, " ".join([*shared, *words(rnd, 60, 10**7)]), "en", "s", 0))
        if i % 50 == 0:
            rows.append((1000 + i, rows[-1][1] + " more", "en", "s", 0))
    comp = check(spark, scratch, rows)
    assert len(set(comp.values())) == 300
    met, full = held[0].count(), held[1].count()
    assert met > 300 and 10 * full < met
