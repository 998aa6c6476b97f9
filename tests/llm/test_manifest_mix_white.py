import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthmill.llm import merkle, mixing, whitening
from tests.llm.data import corpus, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sourced(spark, rows, extra=True):
    df = documents(spark, rows, extra)
    name = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 5 < 3, "hot").otherwise(F.concat(F.lit("sé"), F.col("doc_id") % 7))
    return df.withColumn("source", name)


ODD = [(None, "no id at all"), (None, None), (3, "the same row"), (3, "the same row"), (3, "the same row")]


# mixing

def shares(sizes, weights, share, passes):
    """Targets by sharing the excess again until nothing is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        got = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if got[s] > passes * sizes[s]]
        if not above:
            return {**stopped, **got}
        stopped |= {s: passes * sizes[s] for s in above}


def fair_queue(rows, weights, share, passes):
    size = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target, packets = shares(sizes, weights, share, passes), []
    key = lambda i: hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()
    for s in sizes:
        own = sorted(((key(i), i is not None, i or 0, size(t), n) for n, (i, t, x) in enumerate(rows) if x == s), key=lambda r: r[:4])
        upto = 0
        for p in range(passes):
            for k, some, i, z, n in own:
                upto += z
                if z:
                    packets.append((upto / target[s], s is None, s or "", k, i, z, p, n))
    taken, words = [0] * len(rows), 0
    for *_, z, p, n in sorted(packets):
        words += z
        if words > share * sum(sizes.values()):
            break
        taken[n] += z
    return [(i, size(t), sizes[s], target[s], taken[n]) for n, (i, t, s) in enumerate(rows)], sizes, target


@pytest.mark.parametrize("weights,share,passes", [((5, 2, 1), 1.5, 2), ((1,), 0.3, 1), ((1, 9), 2.5, 3)])
def test_mix_against_a_plain_queue(spark, weights, share, passes):
    docs = sourced(spark, corpus(n=80) + ODD)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want, sizes, target = fair_queue(rows, weights, share, passes)
    out = mixing.taken(docs, weights, share, passes).collect()
    got = [(r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in out]
    order = lambda r: (str(r[0]), r[1], r[2], r[4])
    assert [order(r) for r in sorted(got, key=order)] == [order(r) for r in sorted(want, key=order)]
    assert all(math.isclose(a[3], b[3]) for a, b in zip(sorted(got, key=order), sorted(want, key=order)))
    for s, z in sizes.items():
        words = sum(r.taken for r in out if r.source == s)
        longest = max(r["size"] for r in out if r.source == s)
        assert abs(words - target[s]) <= longest + 1
    assert all(r.taken <= passes * r["size"] for r in out)
    assert 0 <= share * sum(sizes.values()) - sum(r.taken for r in out) <= max(r["size"] for r in out)


def test_mix_is_in_order_and_agrees_with_taken(spark):
    docs = sourced(spark, corpus(n=80))
    mix = mixing.mix(docs).collect()
    assert [r.ahead for r in mix] == sorted(r.ahead for r in mix)
    assert [r.finish for r in mix] == sorted(r.finish for r in mix)
    ahead = 0
    for r in mix:
        assert r.ahead == ahead
        ahead += r["size"]
    words = {}
    for r in mix:
        words[r.doc_id] = words.get(r.doc_id, 0) + r["size"]
    assert {r.doc_id: r.taken for r in mixing.taken(docs).collect() if r.taken} == words


def test_mix_of_nothing(spark):
    assert mixing.taken(documents(spark, [])).collect() == [] and mixing.mix(documents(spark, [])).collect() == []
    empty = mixing.taken(documents(spark, [(1, None), (2, " \n")])).collect()
    assert [(r.doc_id, r["size"], r.target, r.taken) for r in sorted(empty)] == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_mix_takes_repeated_rows_evenly(spark):
    docs = documents(spark, [(1, "a b")] * 7 + [(2, "c d e f")] * 3)
    out = mixing.taken(docs, share=1.2).collect()
    assert sum(r.taken for r in out) in (28, 30) and {r.taken // r["size"] for r in out} <= {1, 2}


# whitening

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int, key string, n int")


def directly(xs):
    fit = np.unique(xs, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    return n, total, e[::-1], q[:, ::-1]


def whiten(df, **more):
    out = {}
    for r in whitening.whitened(df, **more).collect():
        out.setdefault(r.component, []).append(r)
    return {c: sorted(rows, key=lambda r: (str(r.vec_id), r.whitened)) for c, rows in out.items()}


@pytest.mark.parametrize("d,n,spread", [(12, 200, 1.0), (12, 200, 0.5), (3, 40, 1.0), (1, 9, 1.0)])
def test_whitening_against_eigenvectors(spark, d, n, spread):
    rng = np.random.default_rng(d)
    data = (rng.standard_normal((n, d)) * spread ** np.arange(d) + 3).astype(np.float32)
    rows = [(i, v.tolist(), 1, "k", 2) for i, v in enumerate(data)] + [(5, data[7].tolist(), 1, "k", 2), (None, data[8].tolist(), 1, "k", 2)]
    bad = [(900, None, 1, "k", 2), (901, [None] + data[0].tolist()[1:], 1, "k", 2), (902, [float("nan")] * d, 1, "k", 2), (903, [float("-inf")] * d, 1, "k", 2)]
    got = whiten(vectors(spark, rows + bad))
    xs = np.floor(256 * np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)).astype(np.int64)
    count, total, e, q = directly(xs)
    k = min(4, d)
    assert sorted(got) == list(range(1, k + 1)) and len(got[1]) == len(rows)
    order = sorted(range(len(rows)), key=lambda i: str(rows[i][0]))
    for c in range(k):
        want = (xs - total / count) @ q[:, c] / np.sqrt(e[c])
        by = {}
        for i in order:
            by.setdefault(str(rows[i][0]), []).append(want[i])
        values = {}
        for r in got[c + 1]:
            values.setdefault(str(r.vec_id), []).append(r.whitened)
        flat = [(a, b) for key in by for a, b in zip(sorted(by[key]), sorted(values[key]))] if len(by) == len(rows) else [
            (by[key][0], values[key][0]) for key in by if len(by[key]) == 1]
        sign = np.sign(sum(a * b for a, b in flat))
        assert max(abs(a - sign * b) for a, b in flat) < 1e-8
        assert {round(r.explained / (e[c] / e.sum()), 9) for r in got[c + 1]} == {1.0}
        assert all(r.n == count and r.identity_error < 1e-9 for r in got[c + 1])
    exact = sorted((str(rows[i][0]), sum((count * int(a) - int(s)) ** 2 for a, s in zip(xs[i], total))) for i in range(len(rows)))
    assert sorted((str(r.vec_id), r.deviation) for r in got[1]) == exact


def test_whitening_with_equal_eigenvalues(spark):
    """The Krylov space of a vector has one direction of each eigenvalue; restarts find the others."""
    rows = [(2 * i + s, [float((2 if i < 3 else 1) * (1 - 2 * s)) if j == i else 0.0 for j in range(8)], 1, "k", 2) for i in range(8) for s in range(2)]
    got = whiten(vectors(spark, rows))
    e = [got[c][0].explained for c in (1, 2, 3, 4)]
    assert np.allclose(e, [4 / 17] * 3 + [1 / 17]) and got[1][0].identity_error < 1e-12


def test_whitening_of_few_vectors(spark):
    assert whitening.whitened(vectors(spark, [])).collect() == []
    assert whitening.whitened(vectors(spark, [(1, None, 1, "k", 2)])).collect() == []
    assert whitening.whitened(vectors(spark, [(1, [0.5, 1.0], 1, "k", 2), (2, [0.5, 1.0], 1, "k", 2)])).collect() == []
    line = whiten(vectors(spark, [(i, [0.5 * i, 1.0 * i, 0.0], 1, "k", 2) for i in range(5)]))
    assert list(line) == [1] and abs(line[1][0].explained - 1) < 1e-12
    # shorter vectors are filled up; huge entries end at the bounds of a long and have no deviation
    odd = whiten(vectors(spark, [(1, [], 1, "k", 2), (2, [1.0], 1, "k", 2), (3, [3.0, 3e38], 1, "k", 2)]))
    assert [r.deviation for r in odd[1]] == [None] * 3 and len(odd[1]) == 3


# Merkle manifest

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])


def climb(nodes):
    """Root, and for each node the siblings on the way up with its place among them."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + 3, len(nodes))) for a in range(0, len(nodes), 3)]
        for run in runs:
            for i in run:
                for leaf in owners[i]:
                    paths[leaf].append((i - run[0], [nodes[j] for j in run if j != i]))
        owners = [[x for i in run for x in owners[i]] for run in runs]
        nodes = [sha(*[nodes[i] for i in run]) for run in runs]
    return nodes[0], paths


def plain_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r.source, []).append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = []
    for s in names:
        ordered = sorted(trees[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
        built.append((ordered, *climb([leaf_of(r, r.text) for r in ordered])))
    root, above = climb([b[1] for b in built])
    out = []
    for (ordered, sub, paths), upper in zip(built, above):
        for r, path in zip(ordered, paths):
            odd = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            h = leaf_of(r, r.text.replace("\n", "") if odd and r.text is not None else r.text)
            for place, others in path + upper:
                h = sha(*others[:place], h, *others[place:])
            proof = sha(*[x for _, others in path + upper for x in others])
            out.append((r.doc_id, leaf_of(r, r.text), sub, root, proof, h, h == root))
    return sorted(out, key=str)


def shown(rows):
    text = lambda b: b.hex()
    return sorted(((r.doc_id, text(r.node), text(r.subroot), text(r.root), sha(text(r.witness + r.source_witness)), text(r.folded),
                    r.folded == r.root) for r in rows.collect()), key=str)


@pytest.mark.parametrize("block", [3, 9, 729])
def test_manifest_against_a_plain_tree(spark, block):
    docs = sourced(spark, corpus(n=90) + ODD).withColumn("lang", F.when(F.col("doc_id") % 4 > 0, F.col("lang")))
    want = plain_manifest(docs.collect())
    got = shown(merkle.verified(merkle.manifest(docs, merkle.tampered(), block)))
    assert got == want and 0 < sum(not r[-1] for r in got) < len(got)


def test_manifest_of_few_rows(spark):
    assert merkle.manifest(documents(spark, [])).collect() == []
    one = documents(spark, [(1, None)])
    r = merkle.verified(merkle.manifest(one)).first()
    assert r.node == r.subroot == r.root == r.folded and r.witness == r.source_witness == b""
    two = merkle.manifest(documents(spark, [(1, None), (1, "")])).collect()
    assert two[0].node != two[1].node and {bytes(r.witness) for r in two} == {bytes(r.node) for r in two}


def test_roots_do_not_depend_on_the_order_of_rows(spark):
    docs = sourced(spark, corpus(n=60) + ODD)
    roots = {r.root for order in ("doc_id", "text") for r in merkle.manifest(docs.orderBy(order), block=9).select("root").distinct().collect()}
    assert len(roots) == 1


def test_witnesses_grow_as_siblings_arrive():
    nodes, grow = [hashlib.sha256(bytes([i])).digest() for i in range(11)], merkle.Appender()
    for i, node in enumerate(nodes):
        grow.append(node)
        assert sum(len(run) for run in grow.open) <= 2 * len(grow.open)
        assert len(grow.witness[0]) == 64 * sum(i + 1 >= 3 ** k for k in (1, 2))
    top = grow.finish(merkle.height(len(nodes)))
    assert all(merkle.fold(node, i, len(nodes), bytes(w)) == top for i, (node, w) in enumerate(zip(nodes, grow.witness)))
    assert merkle.fold(nodes[0], 1, len(nodes), bytes(grow.witness[1])) != top


