import re
from collections import Counter, defaultdict

import numpy as np

from codeloom.llm import divergence as dv
from codeloom.llm.divergence import divergence_audit
from tests.llm.data import documents

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def slow_audit(rows, least_docs, k):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall(lowered(text))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, k)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def got(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_awkward_rows_match_brute_force(spark):
    docs = documents(spark)
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    for least_docs, k in ((10, 10), (1, 3), (1000, 10)):
        assert got(divergence_audit(docs, least_docs, k)) == slow_audit(rows, least_docs, k)
    assert divergence_audit(docs.limit(0)).count() == 0


def test_many_sources_and_terms_in_several_tiles(spark, monkeypatch):
    pick = np.random.default_rng(3)
    rows = [("en" if i % 5 else None, f"s{pick.zipf(1.5) % 12}", " ".join(f"T{chr(97 + x % 26)}{chr(97 + x // 26 % 26)}Ü" for x in pick.zipf(1.3, 60) % 500)) for i in range(150)]
    rows += [("de", "bare", "1 2 3"), ("de", "none", None), ("xx", None, "")]
    monkeypatch.setattr(dv, "SOURCES", 3)
    monkeypatch.setattr(dv, "TERMS", 40)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert got(divergence_audit(df, 2, 4)) == slow_audit(rows, 2, 4)


def test_skyband_keeps_rows_with_few_dominators(monkeypatch):
    monkeypatch.setattr(dv, "BLOCK", 7)
    pick = np.random.default_rng(1)
    for n in (0, 1, 200):
        count, other, place = pick.integers(0, 9, n), pick.integers(0, 9, n), pick.permutation(n)
        for k in (1, 3):
            behind = [sum((count[j] >= count[i]) & (other[j] <= other[i]) & (place[j] < place[i]) for j in range(n)) for i in range(n)]
            assert sorted(dv.skyband(count, other, place, k).tolist()) == [i for i in range(n) if behind[i] < k]


def test_waiting_rows_are_cut_in_turn(spark, monkeypatch):
    """Skybands of pieces hold that of the whole, so the leading terms are the same however rows are dealt."""
    pick = np.random.default_rng(5)
    rows = [("l", f"s{i % 2}", f"t{i:04d}", int(pick.integers(1, 50)), 60) for i in range(3000)]
    df = spark.createDataFrame(rows, "lang string, source string, term string, n long, total long").selectExpr("*", "n * 100 p", "total * 10 q")
    leaders = lambda parts: sorted(map(tuple, dv.leading_terms(df.repartition(parts), 10).collect()))
    want = leaders(1)
    assert len(want) == 20 and leaders(7) == want
