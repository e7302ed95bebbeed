"""Filter audit, sort-means and the path-template tree, held against plain versions."""

import hashlib
import itertools
import math
import random
import re
import string
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lotespark.llm import centroids, filter_audit, queries, url_filter

SF = "/root/testdata/sf0.001"


# Filter audit


def plain_audit(docs, labels):
    good, toxic = {k for k, q, _ in labels if q == 1}, {k for k, _, t in labels if t == 1}
    least = {}
    for k, text, _ in docs:
        if k is not None:
            least[text or ""] = min(k, least.get(text or "", k))
    rows = defaultdict(list)
    for k, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * sum(c in string.ascii_uppercase for c in t) > 2 * len(t):
            fails.add("C")
        if any(c in "#$%&*|" for c in t):
            fails.add("D")
        if k is not None and k > least[t]:
            fails.add("E")
        rows[source or ""].append((fails, k is not None and k in good, k is not None and k in toxic))
    out = []
    for part, of in rows.items():
        steps, shapley = [], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for i, f in enumerate(order):
                before = set(order[:i])
                removed = [r for r in of if f in r[0] and not r[0] & before]
                shapley[f] += len(removed)
                steps.append((part, order, i + 1, sum(not r[0] & (before | {f}) for r in of), len(removed), sum(f in r[0] and bool(r[0] & before) for r in of), sum(r[0] == {f} for r in of), sum(r[1] for r in removed), sum(r[2] for r in removed)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return out


LONG = " ".join(f"w{k}" for k in range(250))
AUDIT = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG + " #", "b"), (4, None, "a"), (5, "", None), (6, "AB c", "a"), (7, "word " * 300, "b"), (8, ("é" * 40 + " ") * 3, ""), (None, LONG, "a"), (1, LONG, "b"),
    (9, LONG.upper(), "c"), (10, " \t\n", "c"), (11, "x\u2028y z", "a"), (12, " ".join(["dup", "Dup"] * 50), "b"), (2, LONG, "a"), (13, "Z" * 3 + "z" * 147, "b"), (14, "same | text", "a"), (15, "same | text", "b"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (3, 1, 1), (7, None, 1), (None, 1, 1), (99, 1, 1), (14, 1, None), (15, 1, 0), (2, 1, 0)]


def audit(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3).withColumns({"part": F.lit("clash"), "good": F.lit(7), "digest": F.lit("clash"), "quality": F.lit(1)})
    return filter_audit.filter_audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("clash")))


def test_audit_is_brute_force(spark):
    got = audit(spark, AUDIT, LABELS)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_audit(AUDIT, LABELS))


def test_audit_of_random_rows_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 3)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["ka", "LO", "mi#", "ta", "é"]) for _ in range(rng.choice([3, 150, 260]))) for _ in range(40)] + [LONG]
    docs = [(rng.randint(1, 150), rng.choice(texts), f"s{rng.randint(0, 12)}") for _ in range(200)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 150, 2)]
    assert sorted(map(tuple, audit(spark, docs, labels).collect())) == sorted(plain_audit(docs, labels))


def test_audit_of_empty_tables(spark):
    assert audit(spark, [], []).count() == 0
    assert audit(spark, AUDIT[:3], []).agg(F.sum("good_lost")).first()[0] == 0


def test_bit_sets_of_parts_do_not_mix():
    rng = np.random.default_rng(1)
    part, failing = rng.integers(0, 5, 77), rng.integers(0, 32, 77)
    part[:5] = range(5)
    good, toxic = rng.random(77) < 0.5, rng.random(77) < 0.2
    counts = filter_audit.part_counts(part, 5, failing, good, toxic)
    for p, s in itertools.product(range(5), range(32)):
        left = (part == p) & (failing & s == 0)
        assert counts[p, s].tolist() == [left.sum(), (left & good).sum(), (left & toxic).sum()]


# Sort-means


def plain_means(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [list(v) for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[near(v)[1]].append(v)
        for j, vs in of.items():
            cents[j] = [sum(col) // len(vs) for col in zip(*vs)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in found]


def clustered(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3).withColumns({"cluster": F.lit("clash"), "v": F.lit(1), "distance": F.lit(0)})
    return sorted(map(tuple, centroids.cluster_report(*centroids.sort_means(df)).collect()), key=str)


def vectors(n, seed, coarse=False):
    rng = np.random.default_rng(seed)
    v = rng.integers(-2, 3, (n, 64)) / 4 if coarse else rng.normal(0, 0.5, (n, 64)).astype(np.float32)
    return [(int(k), [float(x) for x in row]) for k, row in enumerate(v)]


def test_means_are_brute_force(spark):
    rows = vectors(300, 1)
    odd = [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [1.0] * 63 + [None]), (1004, [1.0] * 63 + [float("nan")]), (1005, [float("inf")] + [0.0] * 63), (None, [0.25] * 64), (7, rows[7][1]), (7, [0.5] * 64)]
    assert clustered(spark, rows + odd) == sorted(plain_means(rows + odd), key=str)


def test_ties_and_repeated_vectors(spark):
    rows = vectors(150, 2, coarse=True)
    rows += [(1000 + k, rows[3][1]) for k in range(80)]  # equal first centroids too, and those without vectors
    assert clustered(spark, rows, "double") == sorted(plain_means(rows), key=str)


def test_few_and_no_vectors(spark):
    assert clustered(spark, vectors(5, 3)) == sorted(plain_means(vectors(5, 3)), key=str)
    assert clustered(spark, []) == []
    with pytest.raises(Exception, match="out of range in vector 3"):
        clustered(spark, [(3, [1e30] * 64)])


def test_scan_stops_strictly_beyond_twice_the_distance():
    # the vector is 1 from its start 1 and 1 from centroid 0, which is exactly twice as far from the start: 0 wins the tie
    cents = np.array([[0, 0], [2, 0], [5, 0]])
    best, far, looked = centroids.nearest(np.array([[1, 0]]), np.array([1]), cents)
    assert (best[0], far[0], looked) == (0, 1, 2)
    rng = np.random.default_rng(0)
    points, cents = rng.integers(-9, 9, (400, 3)), rng.integers(-9, 9, (25, 3))
    start = rng.integers(0, 25, 400)
    best, far, looked = centroids.nearest(points, start, cents)
    full = ((points[:, None] - cents[None]) ** 2).sum(2)
    assert (best == full.argmin(1)).all() and (far == full.min(1)).all() and looked < 400 * 25


# URL filter


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain_kind(seg):
    if seg is None:
        return "end"
    stem = re.sub(r"\.[A-Za-z]{1,5}$", "", seg)
    for name, pattern in (("", ""), ("{date}", r"[12][0-9]{3}[-_.]?[01][0-9]([-_.]?[0-3][0-9])?"), ("{n}", "[0-9]+"), ("{hex}", "(?=.*[0-9])[0-9A-Fa-f-]{8,}"), ("{word}", "[^0-9]+")):
        if re.fullmatch(pattern, stem, re.S):
            return name
    return "{mixed}"


def plain_tree(rows):
    """{(host, path): (template, share)} from (url, label) rows, node by node."""
    L, P = url_filter.LEAST, url_filter.PRIOR
    paths = {}
    for url, label in rows:
        g, b = paths.setdefault(plain_split(url), [0, 0])
        paths[plain_split(url)] = [g + (label is True), b + (label is False)]
    bad, all_ = sum(b for _, b in paths.values()), sum(g + b for g, b in paths.values())
    out = {}

    def share(items, prior):
        g, b = sum(i[2] for i in items), sum(i[3] for i in items)
        return (b + P * prior) / (g + b + P)

    def visit(items, node, prior):  # items: key, rest, good, bad
        own = share(items, prior)
        if len(items) < L or len({i[1] for i in items}) == 1:
            for key, rest, *_ in items:
                out[key] = (node + "/**" if rest is not None else node, own)
            return
        segs, kids = defaultdict(list), defaultdict(list)
        for key, rest, g, b in items:
            if rest is None:
                out[key] = (node, own)
            else:
                seg, _, after = rest.partition("/")
                segs[seg].append((key, after if "/" in rest else None, g, b))
        groups = defaultdict(list)
        for seg, of in segs.items():
            if len(of) >= L and len(of) >= url_filter.SHARE * len(items):
                ahead = Counter(plain_kind(None if i[1] is None else i[1].partition("/")[0]) for i in of)
                kind = max(ahead, key=lambda k: (ahead[k], k))
                groups[kind].append((share(of, own), seg, sum(i[2] for i in of), sum(i[3] for i in of)))
        label = {}
        for of in groups.values():
            now, joined = None, []
            for _, seg, g, b in sorted(of):
                if now:
                    n, m = now[1] + now[2], g + b
                    pooled = (now[2] + b) / (n + m) if n + m else 0
                    same = not (n and m and 0 < pooled < 1) or (now[2] / n - b / m) ** 2 <= url_filter.QUANTILE**2 * pooled * (1 - pooled) * (1 / n + 1 / m)
                if now and same:
                    now = (now[0] + [seg], now[1] + g, now[2] + b)
                    joined[-1] = now
                else:
                    now = ([seg], g, b)
                    joined.append(now)
            for names, *_ in joined:
                plain = [s.replace("{", "%7B").replace("}", "%7D").replace("|", "%7C") for s in names]
                for s in names:
                    label[s] = "{" + "|".join(sorted(plain)) + "}" if len(names) > 1 else plain[0]
        for seg, of in segs.items():
            ext = re.search(r"\.[A-Za-z]{1,5}$", seg)
            kids[label.get(seg, plain_kind(seg) + (ext[0].lower() if ext else ""))] += of
        for name, of in kids.items():
            visit(of, f"{node}/{name}", own)

    hosts = defaultdict(list)
    for (host, path), (g, b) in paths.items():
        hosts[host].append(((host, path), path[1:] if path else None, g, b))
    for items in hosts.values():
        visit(items, "", (bad + 1) / (all_ + 2))
    return out


def plain_judged(rows):
    tree, out = plain_tree([r[1:] for r in rows]), []
    for k, url, _ in rows:
        key = plain_split(url)
        rule, verdict = plain_rule(*key)
        template, share = tree[key]
        out.append((k, *key, rule, template, round(1 - share, 9), verdict or ("block" if 1 - share < url_filter.PURITY else "allow")))
    return sorted(out, key=str)


def judged(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, good boolean").repartition(3).withColumns({"host": F.lit("clash"), "seg": F.lit(1), "n": F.lit(2)})
    got = url_filter.judged(df, "good")
    assert got.columns == ["page_id", "host", "path", "rule", "template", "purity", "verdict"]
    return sorted(((*r[:5], round(r.purity, 9), r.verdict) for r in got.collect()), key=str)


ODD_URLS = [
    None, "", "no scheme", "http://", "HTTP://Ex.COM", "http://ex.com?x=1", "http://ex.com#f/a", "ftp://ex.com/", "http://a://b/c", "http://www.Example.com/en/x?y#z", "http://sub.www.example.com/en/1", "https://badexample.com/en/", "https://example.com/en",
    "http://x.net/es/1", "http://net/fr/", "http://x.net.org/es/", "http://É.com/É", "http://h.org//a//b/", "http://h.org/" + "deep/" * 300, "x\n://n.net/es/\n1", "http://h.org/{n}/{a|b}",
]


def url_rows():
    rng, rows = random.Random(5), [(k, u, k % 2 == 0 if k % 3 else None) for k, u in enumerate(ODD_URLS)]
    bad = {"casino": 0.95, "news": 0.05, "blog": 0.07, "shop": 0.1}
    for host in ("a.org", "b.org", "c.io"):
        for section, p in bad.items():
            for _ in range(70 if host != "c.io" else 8):
                leaf = rng.choice([f"{rng.randint(1, 9999)}.html", f"2024-0{rng.randint(1, 9)}-11/{rng.randint(1, 99)}", f"{rng.getrandbits(60):x}", "about/us", "index.PHP", "", "page" + str(rng.randint(1, 30))])
                rows.append((len(rows), f"https://{host}/{section}/{leaf}?q={rng.random()}", rng.random() > p if rng.random() < 0.8 else None))
    return rows + rows[30:60] + [(len(rows) + k, "http://deep.org/" + "d/" * 120, False) for k in range(50)]


def test_urls_are_brute_force(spark):
    rows = url_rows()
    got = judged(spark, rows)
    assert got == plain_judged(rows)
    templates = {r[4] for r in got if r[1] == "a.org"}
    assert any("{blog|" in t for t in templates) and any("/casino/{n}.html" == t for t in templates)
    assert {r[6] for r in got if r[1] == "a.org" and r[2].startswith("/casino/") and r[4].startswith("/casino")} == {"block"}
    assert {r[6] for r in got if r[1] == "a.org" and r[2].startswith("/news/")} == {"allow"}


def test_urls_without_labels_and_without_rows(spark):
    rows = [(k, u, None) for k, u in enumerate(ODD_URLS)]
    assert judged(spark, rows) == plain_judged(rows)
    assert {r[6] for r in judged(spark, rows) if r[3] is None} == {"allow"}
    assert judged(spark, []) == []


# The registered queries


def test_registered_queries_on_the_smallest_tables(spark):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("op11_filter_audit", "op12_centroids"):
        got = queries.QUERIES[name](spark, SF)
        want = con.sql(queries.ORACLE_SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


def test_registered_url_query_is_brute_force(spark):
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = []
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        m = re.search(r"/([0-9]+)(\.html)?/?$", plain_split(r.url)[1])
        q, t = labels.get(int(m[1]), (None, None)) if m else (None, None)
        rows.append((r.page_id, r.url, None if q is None and t is None else not (q == 0 or t == 1)))
    got = queries.op13_url_filter(spark, SF).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.template, round(r.purity, 9), r.verdict) for r in got), key=str) == plain_judged(rows)
