import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from monthmill.llm import components, decontaminate, simhash
from tests.llm.data import by_id, corpus, documents


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, k) for k in range(2001, 2200)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    # a node linked only to itself has no link
    assert got == {n: c for n, c in label.items() if n in got} and set(label) - set(got) <= {a for a, b in edges if a == b}


def reference_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reference_groups(rows, radius):
    fps = [reference_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    while True:
        new = [min(label[j] for j in range(len(rows)) if bin(fps[i] ^ fps[j]).count("1") <= radius) for i in range(len(rows))]
        if new == label:
            break
        label = new
    least = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted(((i, fp.to_bytes(8, "big"), least.get(c)) for (i, _), fp, c in zip(rows, fps, label)), key=str)


@pytest.mark.parametrize("block", [3, 4096])
def test_simhash_groups(spark, block):
    rows = corpus()
    base = rows[11][1]
    words = base.split(" ")
    rows += [(400 + i, " ".join(words[:i] + ["changed"] + words[i + 1:])) for i in range(min(12, len(words)))]
    rows += [(None, base), (3, rows[3][1])]
    got = by_id(simhash.near_groups(documents(spark, rows), 3, 3, block=block), "fp", "component_id")
    assert [(i, bytes(f), c) for i, f, c in got] == reference_groups(rows, 3)


def test_simhash_small_distances(spark):
    """Fingerprints, not texts: every pair within the radius meets, whatever the partitions."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 40, dtype=np.int64).astype(np.uint64)
    near = [int(v) ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for v in x]
    fps = spark.createDataFrame([(int(v).to_bytes(8, "big"),) for v in [*x, *near]], "fp binary")
    for groups_, thresholds in [simhash.plan(fps, 64, 3, (m,)) for m in (2, 3, 4)] + [([list(range(32)), list(range(32, 64))], [1, 1])]:
        assert sum(thresholds) == 3 - len(groups_) + 1
        found = {frozenset((bytes(r.a), bytes(r.b))) for r in simhash.links(simhash.entries(fps, 64, groups_, thresholds), 1, 3).collect()}
        assert {frozenset((int(a).to_bytes(8, "big"), b.to_bytes(8, "big"))) for a, b in zip(x, near)} <= found


def test_allocation():
    assert simhash.allocate([[0, 1, 5], [0, 1, 50], [0, 9, 90]], 0) == (6, [1, 0, -1])


def test_simhash_empty(spark):
    assert simhash.near_groups(documents(spark, []), 3, 3).collect() == []


def distance(a, b):
    """Edit distance of a to any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(1, 14)))
        b = "".join(rng.choice("abé") for _ in range(rng.randint(0, 25)))
        assert decontaminate.edits_within(a, b, 99) == distance(a, b)
        assert decontaminate.edits_within(a, b, 1) == (distance(a, b) if distance(a, b) <= 1 else None)


def test_decontaminate_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, say(rng.randint(8, 30)).capitalize()) for i in range(20)]

    def edited(text, share):
        out = list(text)
        for _ in range(int(share * len(text))):
            out[rng.randrange(len(out))] = rng.choice(["", "z", "qq"])
        return "".join(out)

    rows = [(i, say(rng.randint(0, 60))) for i in range(40)]
    rows += [(100 + i, say(15) + "\n" + edited(t, 0.06) + "  " + say(9)) for i, t in items]
    rows += [(200, items[0][1]), (200, items[0][1]), (None, say(5) + " " + items[1][1]), (300, None), (301, ""), (302, "x" * 50000)]
    short = [(51, "too short"), (52, "Qx"), (53, "a phrase of thirty characters")]
    rows += [(210, "this is  TOO  sho\trt, or toshort"), (211, say(4) + " a phrase ofthirtyy charakters " + say(3)), (212, "qx")]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items + short + [(50, None), (54, " "), (0, items[0][1])]], "item_id long, text string, edits int")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_items(documents(spark, rows), benchmark, block=7).collect()}
    want = {}
    for d, t in rows:
        if d == 302:
            continue
        text = decontaminate.normal(t or "")
        for i, item in items + short:
            q = decontaminate.normal(item)
            e = distance(q, text)
            if e <= int(0.2 * len(q)):
                want[(d, i)] = e
    assert set(got) <= set(want)
    assert len(set(got)) >= 0.95 * len(want) and {(200, 0), (None, 1), (210, 51), (211, 53), (212, 52)} <= set(got)
    assert {k for k in want if k[1] > 50} <= set(got)  # short items are found exactly
    assert all(got[k] == want[k] for k in got)
    assert decontaminate.find_items(documents(spark, []), benchmark).collect() == []
    assert decontaminate.find_items(documents(spark, rows[:3]), benchmark.limit(0)).collect() == []


@pytest.mark.parametrize("share,least", [(0.1, 0.98), (0.15, 0.95), (0.2, 0.9)])
def test_edited_items_are_found_up_to_the_limit(share, least):
    """Copies with as many random edits as the search allows, inside other text, in blanks and in scripts without."""
    rng = random.Random(int(100 * share))
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    signs = [chr(0x4E00 + i) for i in range(600)]
    items = [(i, say(rng.randint(20, 50))) for i in range(120)] + [(200 + i, "".join(rng.choice(signs) for _ in range(120))) for i in range(20)]
    tables = decontaminate.ItemTables(items, decontaminate.ANCHORS, decontaminate.RECALL, decontaminate.MAX_EDITS)
    run, docs = decontaminate.search(tables, [], decontaminate.MAX_EDITS), []
    for i, text in items:
        out = list(text)
        for p in rng.sample(range(len(out)), int(share * len(out))):
            out[p] = rng.choice(["", "z", out[p] + "q", "k"])
        docs.append((i, say(30) + " " + "".join(out) + " " + say(20)))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])
    found = {(r["doc_id"], r["item_id"]) for b in run([batch]) for r in b.to_pylist()}
    within = [(i, i) for (i, t), (_, d) in zip(items, docs)
              if decontaminate.edits_within(decontaminate.normal(t), decontaminate.normal(d), int(0.2 * len(decontaminate.normal(t)))) is not None]
    assert len(within) >= 120 and len(found & set(within)) >= least * len(within)
    assert found <= set(within)


def test_an_unreachable_recall_is_an_error():
    with pytest.raises(ValueError, match="tables find"):
        decontaminate.ItemTables([(i, "word" + " longer words here %d" % i * 4) for i in range(30)], 1, 0.99, 0.45)


def similar_sets(rng, n, similarity):
    """Two word lists whose sets of five-word shingles have about the similarity: one has a changed stretch."""
    text = ["w%d" % rng.randrange(10 ** 6) for _ in range(n)]
    changed = max(1, round(n * (1 - similarity) / (1 + similarity)) - 4)
    at = rng.randrange(n - changed)
    return " ".join(text), " ".join(text[:at] + ["v%d" % rng.randrange(10 ** 6) for _ in range(changed)] + text[at + changed:])


@pytest.mark.parametrize("band", [0.80, 0.82, 0.85, 0.90])
def test_pairs_of_every_band_are_found(spark, band):
    """Of pairs of similarity 0.8 and more, nine of ten or more are joined, in each band and for short and long texts."""
    rng, rows, wanted = random.Random(int(100 * band)), [], []
    for k in range(240):
        for _ in range(200):
            a, b = similar_sets(rng, (60, 200, 900)[k % 3], band + 0.01)
            x, y = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (a, b))
            if band <= len(x & y) / len(x | y) < band + 0.04:
                break
        else:
            continue
        rows += [(2 * k, a), (2 * k + 1, b)]
        wanted.append(k)
    assert len(wanted) > 150
    out = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, rows), **corpus_pipeline.NEAR).collect()}
    found = sum(out[2 * k + 1] == 2 * k for k in wanted)
    assert found >= 0.95 * len(wanted)
    assert all(c // 2 == i // 2 for i, c in out.items())


def test_close_fingerprints_meet_without_a_shared_key(spark):
    """Pairs at every distance up to the reach are found by the partitions alone."""
    rng, reach = np.random.default_rng(4), 12
    pairs = []
    for k in range(52):
        a = rng.integers(0, 2, 256, dtype=np.uint8)
        b = a.copy()
        b[rng.choice(256, k % 13, replace=False)] ^= 1
        pairs.append((np.packbits(a).tobytes(), np.packbits(b).tobytes()))
    fps = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})], "fp binary")
    groups_, thresholds = simhash.plan(fps, 256, reach, (13,))
    found = {frozenset((bytes(r.a), bytes(r.b))) for r in simhash.links(simhash.entries(fps, 256, groups_, thresholds), 4, 52).collect()}
    assert {frozenset(p) for p in pairs if p[0] != p[1]} <= found


@pytest.mark.parametrize("block", [3, 40, 4096])
def test_buckets_of_any_size_are_handed_on_whole(spark, block):
    """A bucket larger than a block, over several batches, gives the same pairs as a small one."""
    rng = np.random.default_rng(6)
    rows = [(0, 5, True, rng.bytes(8) + bytes(15) + bytes([k % 3])) for k in range(120)]
    rows += [(0, 6 + k // 2, True, rng.bytes(8) + bytes(15) + bytes([k % 2])) for k in range(60)]
    df = spark.createDataFrame(rows, simhash.ENTRY)
    got = {frozenset((bytes(r.a), bytes(r.b))) for r in simhash.links(df, 1, 24, block, labelled=True).collect()}
    number = lambda f: int.from_bytes(f[:8], "big")
    want = {frozenset((a[3], b[3])) for i, a in enumerate(rows) for b in rows[:i]
            if a[1] == b[1] and a[3][8:] != b[3][8:] and (number(a[3]) ^ number(b[3])).bit_count() <= 24}
    assert got == want and len(want) > 20


@pytest.mark.parametrize("block", [3, 4096])
def test_similar_groups_against_brute_force(spark, block):
    """Components of the pairs within the radius whose shingle sets are similar, and of no others."""
    rng, near = random.Random(8), corpus_pipeline.NEAR
    words = ["w%d" % i for i in range(500)]
    rows = []
    for base in range(3):
        text = [rng.choice(words) for _ in range(120)]
        for k in range(10):
            copy = list(text)
            for _ in range(k // 2):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((10 * base + k, " ".join(copy)))
    repeated = " ".join(["a b c d e f g"] * 60)
    rows += [(90, None), (91, ""), (92, rows[0][1]), (93, repeated), (94, repeated + " " + rows[5][1]), (95, "x y")]
    fps = {i: int.from_bytes(simhash.fingerprint(t or "", 5, 4), "big") for i, t in rows}
    sets = {i: set(simhash.shingle_hashes(t or "", 5).tolist()) for i, t in rows}

    def close(i, j):
        return (fps[i] ^ fps[j]).bit_count() <= near["radius"]

    def alike(i, j):
        return sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])

    ids = [i for i, _ in rows]
    assert any(close(i, j) and not alike(i, j) for i in ids for j in ids)
    label = {i: i for i in ids}
    while True:
        new = {i: min(label[j] for j in ids if close(i, j) and alike(i, j)) for i in ids}
        if new == label:
            break
        label = new
    out = simhash.similar_groups(documents(spark, rows), **near, block=block).collect()
    assert {r.doc_id: r.component_id for r in out} == label and len(out) == len(rows)
    assert simhash.similar_groups(documents(spark, []), **near).collect() == []


def test_parities_never_rule_out_similar_sets():
    """The bound holds for sets of any size and overlap, and rules out most pairs that are not similar enough."""
    import pandas as pd

    rng, out = np.random.default_rng(5), []
    for n in (1, 5, 20, 80, 300, 2000):
        for share in (0.5, 0.7, 0.79, 0.8, 0.81, 0.9, 1.0):
            common = rng.integers(0, 2 ** 63, max(1, round(n * share)))
            a, b = (np.unique(np.r_[common, rng.integers(0, 2 ** 63, n - len(common))[: (n - len(common)) // 2 + k]]) for k in (0, 1))
            both, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            fp = pd.Series([bytes(8) + simhash.parities(x) + bytes(16) for x in (a, b)])
            possible = bool(simhash.Members(fp, 1, 0.8).possible(np.array([0]), 1)[0])
            assert possible or both < 0.8 * union
            out.append((n, both / union, possible))
    low = [p for n, j, p in out if 20 <= n <= 300 and j < 0.72]
    assert low and not any(low)
