"""URL filter, periodic runs and phrases against plain versions; odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np

from provenia.llm import periods, phrases, queries, urls

LONG = "word " * 30_000


def wide(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x", "y", 3.0) for i, t, lang in rows], "doc_id long, text string, lang string, n long, runs string, words string, a double")


# -- URLs --------------------------------------------------------------------------------------------------------------


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return host.translate(str.maketrans(urls.UPPER, urls.LOWER)), path


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls_are_parsed_and_ruled(spark):
    given = [
        None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.net/en/1", "https://a.EXAMPLE.NET/en/", "https://example.net/en", "https://net/", "https://net", "https://xnet/", "https://a.net?x=/",
        "https://a.net#/", "https://example.com/de/x?y#z", "https://notexample.com/de/", "https://x.example.com/de", "http://b.org/fr/a://c/d", "x://y://org/fr/", "ftp://org/fr/é?ü", "https://ÄB.org/fr/", "https://a.net:80/", "https://a.b/c d\n/e#f",
        "https://q.org/fr/" + "seg/" * 20_000, "https://a.net/1", "https://a.net/1",
    ]
    pages = spark.createDataFrame([(i, u, "h", "r", 0.5) for i, u in enumerate(given)] + [(None, "https://e.net/x", "h", "r", 0.5)], "page_id long, url string, host string, rule string, score double")
    rows = urls.judge_urls(pages).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(given) + 1
    for i, u in enumerate(given):
        host, path = plain_parts(u)
        rule, verdict = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if rule else got[i].verdict in ("allow", "block")
        assert 0 <= got[i].score <= 1
    assert urls.judge_urls(pages.limit(0)).count() == 0
    lone = urls.judge_urls(pages.where("page_id = 2")).first()
    assert (lone.rule, lone.verdict) == (None, "allow")


def test_url_query(spark, data):
    rows = {r.page_id: r for r in queries.op11_urls(spark, data).collect()}
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        r, (host, path) = rows[p.page_id], plain_parts(p.url)
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)


def test_trees_learn_what_urls_look_like(spark):
    """Labels that depend on digits, depth and a domain; held-out URLs are told apart, and a second fit is the same."""
    rng = random.Random(4)

    def one():
        bad = rng.random() < 0.4
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(6, 12) if bad else rng.randint(0, 3)))
        host = rng.choice(["shop.bad-deals.biz", "a1.bad-deals.biz"] if bad and rng.random() < 0.5 else ["news.site.org", "www.blog.com", "cheap.store.com"])
        return f"https://{host}/{'/'.join(['p'] * rng.randint(1, 3))}/{digits}", int(bad)

    rows = [one() for _ in range(1500)]
    train = spark.createDataFrame(rows[:1000] + [(None, 1)], "url string, blocked int")
    model = urls.fit_urls(train)
    assert model.trees == urls.fit_urls(train.repartition(5)).trees and 1 <= len(model.trees) <= urls.TREES
    test = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows[1000:])], "page_id long, url string")
    got = {r.page_id: r.verdict == "block" for r in urls.judge_urls(test, model, rules=()).collect()}
    assert np.mean([got[i] == bool(b) for i, (_, b) in enumerate(rows[1000:])]) > 0.95


# -- periodic runs -----------------------------------------------------------------------------------------------------


def plain_runs(w):
    """Every maximal stretch of every period, its smallest period found by trying all."""
    out = set()
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            n = j - i + p
            if n >= max(6, 4 * p) and not any(all(w[k] == w[k + q] for k in range(i, i + n - q)) for q in range(1, p)):
                out.add((i, n, p))
            i = max(j, i + 1) if j > i else i + 1
    return sorted(r for r in out if not (r[0] and w[r[0] - 1] == w[r[0] - 1 + r[2]]))


def test_runs_by_brute_force():
    rng = random.Random(8)
    for trial in range(400):
        w = [rng.randrange(rng.choice((1, 2, 3, 30))) for _ in range(rng.randint(0, 20))]
        for _ in range(rng.randint(0, 4)):
            root = [rng.randrange(rng.choice((2, 3, 50))) for _ in range(rng.randint(1, 12))]
            w += (root * rng.randint(1, 9))[: rng.randint(1, 90)] + [rng.randrange(50) for _ in range(rng.randint(0, 6))]
        got = periods.find_runs(np.array(w, np.int32))
        want = plain_runs(w)
        assert [tuple(r) for r in got.tolist()] == sorted(want, key=lambda r: (r[0], r[2])), (trial, w)


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, runs and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept)))


def test_periodic_query_by_hand(spark, tmp_path):
    rng = random.Random(2)
    texts = ["", None, " \t\n", "a", "ha ha ha ha ha ha", "ha ha ha ha ha", "x y x y x y x y", "A a A a A a A a b", "é\u00a0é é é é é é é"]
    texts += [" ".join(rng.choice("abcde") * rng.randint(1, 2) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(4, "ha ha ha ha ha ha", "en")]
    wide(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op12_periodic(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((plain_row(i, t) for i, t, _ in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 15


def test_periodic_runs_of_odd_rows(spark):
    rows = wide(spark, [(None, "b b b b b b b", "en"), (1, LONG, None), (1, "x", "en"), (1, None, "en")])
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.text) for r in periods.periodic_runs(rows).collect()), key=repr)
    assert got == [(1, 0, [], None, ""), (1, 1, [], None, "x"), (1, 30_000, [(0, 30_000, 1)], (0, 30_000, 1), "word"), (None, 7, [(0, 7, 1)], (0, 7, 1), "b")]
    assert periods.periodic_runs(rows.limit(0)).count() == 0


# -- phrases -----------------------------------------------------------------------------------------------------------


def plain_phrases(rows, least, top):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(str.maketrans(urls.UPPER, urls.LOWER))):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            counts = f.setdefault(lang, Counter())
            for m in range(1, 5):
                counts.update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        scored = []
        for p, a in found.items():
            if not (longer[p] and 100 * longer[p] >= 80 * a):
                score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out, key=repr)


def test_phrases_by_brute_force(spark, monkeypatch):
    """Small slabs and parts, so that pivots are split and fragments of many slabs meet; ties, breaks, letter case, a language of no name."""
    monkeypatch.setattr(phrases, "SLAB", 3000)
    monkeypatch.setattr(phrases, "SPLIT", 40)
    monkeypatch.setattr(phrases, "MINED", 64)
    rng = random.Random(6)
    words = ["the", "The", "a", "of", "b", "é", "x-y", "zz", "\u00a0", "q1"] + [f"w{i}" for i in range(25)]
    rows = [(i, "".join(rng.choice(words[: rng.choice((4, 10, 35))]) + rng.choice((" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b")) for _ in range(rng.randint(0, 60))), rng.choice(("en", "de", None, "und", "en"))) for i in range(500)]
    rows += [(1, None, "en"), (None, "the the the the the a of", "fr"), (3, "", None), (7, "ab ab ab ab ab ab. " * 12, "fr")]
    for least, top in ((8, 2000), (20, 5)):
        got = sorted((tuple(r) for r in phrases.collocations(wide(spark, rows), least, top).collect()), key=repr)
        assert got == plain_phrases(rows, least, top)
        assert len(got) > (60 if top > 5 else 8)


def test_phrases_of_odd_tables(spark):
    none = wide(spark, [(1, None, None)])
    assert phrases.collocations(none.limit(0)).count() == 0 and phrases.collocations(none).count() == 0
    got = [tuple(r) for r in phrases.collocations(wide(spark, [(1, LONG, None)])).collect()]
    assert [r[:5] for r in got] == [("und", 1, "word word word word", 29_997, 30_000)]
