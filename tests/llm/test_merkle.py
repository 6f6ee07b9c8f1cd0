"""The manifest against a tree built node by node."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import helpers
import pytest

from cuewright.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    d, _, lang, source, n = row
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (d, source, lang, n, text)])


def climb(nodes):
    """The root, and for each node its siblings' digests on each level, before and after it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k // 8 * 8
            paths[i].append((nodes[run:k], nodes[k + 1 : run + 8]))
        nodes = [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
        at = [k // 8 for k in at]
    return nodes[0], paths


def brute(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    keys = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    made = {k: climb([x[2] for x in sorted(trees[k], key=lambda x: x[:3])]) for k in keys}
    root, tops = climb([made[k][0] for k in keys]) if keys else (None, [])
    out = []
    for k, top in zip(keys, tops, strict=True):
        subroot, paths = made[k]
        for (_, _, own, r), path in zip(sorted(trees[k], key=lambda x: x[:3]), paths, strict=True):
            now = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                now = leaf(r, r[1] and r[1].translate(helpers.LOWER))
            for a, b in path + top:
                now = h(*a, now, *b)
            out.append((r[0], own, subroot, root, h(*[x for a, b in path + top for x in a + b]), now, now == root))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_odd_rows(spark, scratch):
    rows = helpers.corpus()
    rows += [rows[3], rows[3], (None, "No Id", "en", None, 3), (None, None, None, None, None), (7, "Aé" * 30_000, "ünd", "s", 1)]
    assert got(merkle.manifest(helpers.frame(spark, rows, clash=True), scratch)) == brute(rows)


@pytest.mark.parametrize("n", [8, 9, 65, 513])
def test_sizes_of_one_tree_beside_a_lone_leaf(spark, scratch, n):
    rows = [(i * 7 - 50, f"Text {i}", "en", "s", i) for i in range(n)] + [(5, "x", "fr", None, None)]
    random.Random(n).shuffle(rows)
    assert got(merkle.manifest(helpers.frame(spark, rows), scratch)) == brute(rows)


def test_many_languages(spark, scratch):
    rows = [(i, f"T{i}", f"l{i % 21}" if i % 21 else None, "s", i) for i in range(60)]
    assert got(merkle.manifest(helpers.frame(spark, rows), scratch)) == brute(rows)


def test_one_document_is_its_own_root(spark, scratch):
    (row,) = merkle.manifest(helpers.frame(spark, [(1, "a", None, None, 1)]), scratch).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == h()


def test_empty_table(spark, scratch):
    assert got(merkle.manifest(helpers.empty(spark), scratch)) == []
