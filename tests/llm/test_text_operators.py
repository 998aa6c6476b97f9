import hashlib
import re
from collections import Counter

import pytest

from monthmill.llm import exact_dedup, line_dedup, pii
from tests.llm.data import by_id, corpus, documents

BLANK = " \t\n\x0b\f\r"


def exact_reference(rows):
    groups = {}
    for i, t in rows:
        key = "".join(c for c in t or "" if c not in BLANK)
        groups.setdefault(key, []).append((-len(t or ""), i is None, i if i is not None else 0, i, t or ""))
    out = []
    for i, t in rows:
        key = "".join(c for c in t or "" if c not in BLANK)
        best = min(groups[key])
        out.append((i, best[3], len(groups[key]), i == best[3] and len(t or "") == -best[0], hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("counters", [1, 3, 512])
def test_exact_dedup(spark, counters):
    rows = corpus() + [(None, "a b"), (None, "ab"), (7, corpus()[7][1]), (200, "ab")] + [(300 + i, "x y" + " " * (i % 3)) for i in range(90)]
    got = by_id(exact_dedup.exact_dedup(documents(spark, rows), counters), "keep_id", "group_size", "kept", "text_sha256")
    assert got == exact_reference(rows)


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(documents(spark, [])).collect() == []


def test_misra_gries_bounds():
    values = [i % 7 if i % 3 else "hot" for i in range(3000)] + list(range(100, 400))
    sketch = exact_dedup.MisraGries(5)
    for at in range(0, len(values), 100):
        sketch.add(Counter(values[at:at + 100]))
    true = Counter(values)
    assert len(sketch.counts) <= 5
    for v, n in true.items():
        assert n - len(values) / 6 <= sketch.counts.get(v, 0) <= n


def line_reference(rows, min_chars=20, min_docs=3):
    fold = {ord(a): ord(a) + 32 for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    key = lambda line: line.strip(BLANK).translate(fold)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    bad = {k: max(ids) for k, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or bad.get(key(x), i) == i]
        text = t if len(keep) == len(lines) else "\n".join(keep)
        out.append((i, text, len(lines), len(lines) - len(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (6, 3)])
def test_line_dedup(spark, batches, fanout):
    rows = corpus() + [(None, corpus()[0][1]), (3, corpus()[0][1]), (3, "another row of document three")]
    out = line_dedup.line_dedup(documents(spark, rows), batches=batches, fanout=fanout)
    assert by_id(out, "text", "_n_lines", "_n_dropped") == line_reference(rows)
    assert {"_gone", "lang", "key"} <= set(out.columns)
    assert out.filter("_gone <> 7 or lang <> 'en'").count() == 0


def test_line_dedup_empty(spark):
    assert line_dedup.line_dedup(documents(spark, [])).collect() == []


def test_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(1, 1, 2, 50 - k), (k + 10, 0, 1, 50 - k)], "h1 long, h2 long, n long, doc_id long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    total = {r.h1: (r.n, r.keeper) for r in runs.merged(runs.rows()).collect()}
    assert total[1] == (10, 50) and total[14] == (1, 46)


REGEX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text):
    out = []
    for kind, pattern in REGEX.items():
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) < 256 for p in m[0].split(".")) \
                    or kind == "card" and 16 <= len(number) <= 19 and luhn(number) or kind == "phone" and 8 <= len(number) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


TRICKY = ["a@b.c_x@d.e f@g", "x@y.zz@w.vv", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.1.1.1000", "4111 1111 1111 1111 and 4111-1111-1111-1112",
          "call +1 (555) 010-9999. or +49 5 or +123456789012345678", "é+44 20 7946 0958é ü.ä@ex-am.co.uk,", "9" * 5000, "a.b@" * 3000, "+1 " + "(" * 4000,
          "12 " * 3000, None, "", "mail me: jöhn@exa.mple 127.0.0.1", "a" * 30000 + "@b.c", "1." * 4000, "k@" + "a." * 4000 + "b"]


def test_base_spans(spark):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(None, TRICKY[0]), (0, TRICKY[0]), (0, TRICKY[3])]
    out = pii.sanitise(documents(spark, rows))
    got = sorted(((r.doc_id, r.text, [(s.kind, s.start, s.end) for s in r._base]) for r in out.collect()), key=str)
    assert got == sorted(((i, t, personal(t)) for i, t in rows), key=str)
    clean = {(r.doc_id, r.text): r._clean for r in out.collect()}
    assert clean[(12, TRICKY[12])] == "mail me: jöhn@exa.mple <ip>".replace("jöhn@exa.mple", "jö<email>")
    assert clean[(10, None)] == ""


def test_disclosing_terms(spark):
    filler = [(100 + i, f"nothing about {w} here and plain words follow") for i, w in enumerate(["alpha", "bravo", "delta"] * 40)]
    rows = filler + [(i, f"plain zanzibar words, write to boss@corp.example today quickly {i}") for i in range(5)]
    out = {r.doc_id: r for r in pii.sanitise(documents(spark, rows)).collect()}
    for i in range(5):
        told = {out[i].text[s.start:s.end] for s in out[i]._terms}
        assert "zanzibar" in told and "plain" not in told and "words" not in told
        assert "zanzibar" not in out[i]._clean and "<email>" in out[i]._clean
    assert all(not out[i]._terms and not out[i]._base for i, _ in filler)
    # fewer documents than the support disclose nothing
    few = pii.sanitise(documents(spark, rows[:-3])).collect()
    assert all(not r._terms for r in few)


def test_pii_empty(spark):
    assert pii.sanitise(documents(spark, [])).collect() == []


def test_entity_counts_are_of_all_documents(spark):
    """A document that holds the value without any term near it counts among the documents with the value."""
    held = [(i, f"zanzibar boss@corp.example {i}") for i in range(4)] + [(10 + i, f"{i} boss@corp.example {i}") for i in range(12)]
    rows = pii.row_key(pii.texts(documents(spark, held + [(100 + i, "zanzibar") for i in range(4)] + [(200 + i, "plain") for i in range(44)])))
    found = pii.base_spans(rows).filter("size(base) > 0")
    got = pii.disclosing(pii.mentions(found, 120), found, rows, 3, 0.0).collect()
    # 64 documents, 16 with the value, 8 with the term, 4 with both: 1 - log(8 / 4) / log(64 / 16)
    assert [round(r.share, 9) for r in got] == [0.5]
