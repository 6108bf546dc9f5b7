"""Spelling variants, importance resampling and WARC transactions against brute force, with odd inputs."""

import collections
import gzip
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import pytest
from pyspark.sql import functions as F

from docblocks.llm import pulearn, resampling, variants, warc
from docblocks.llm.tables import lookup, shared_folder

RNG = random.Random(5)
ODD = "doc_id long, text string, n int, word string, s int, gain int, row int, key string"


def frame(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def words_of(n, alphabet="abcdé", rng=RNG):
    return list({"".join(rng.choice(alphabet) for _ in range(rng.randint(6, 9))) for _ in range(n)})


# 11
def brute_group(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        others = [(-counts[o], o) for o in counts if near(w, o)]
        best = min(others, default=None)
        form = best[1] if best and -best[0] >= ratio * n else None
        out[w] = (form, n, len(others), counts[form] if form else None)
    found = {}
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        found[w] = (form, root, n, k, m)
    return found


@pytest.mark.parametrize("block", [2, 5, 32])
def test_groups_of_crowded_blocks(spark, block):
    rng = random.Random(block)
    words = words_of(60, rng=rng) + ["constant" + w for w in words_of(40, "ab", rng)] + [w + "endings" for w in words_of(40, "ab", rng)]
    words += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaab", "baaaaa", "ÀÀÀÀÀÀ", "àÀÀÀÀÀ"]
    counts = {w: rng.choice([5, 6, 25, 30, 150, 800, 4000]) for w in words}
    got = variants.group(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3), block=block).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == brute_group(counts)
    assert len(got) == len(counts)


def test_long_words_are_compared_in_pairs():
    base = "".join(RNG.choices("abcÀ", k=6000))
    at = 4000
    alike = [(base, 9), (base[:at] + "x" + base[at + 1 :], 5), (base[:at] + "xx" + base[at + 2 :], 5)]
    longer = [(base, 9), (base[:at] + "x" + base[at:], 5), (base[:-1] + "xx", 5)]
    tracemalloc.start()
    found = [list(variants.near_in_block(alike, True, 6000, 3000, 0)), list(variants.near_in_block(longer, False, 6000, 3000, 0))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [[(alike[0], alike[1]), (alike[1], alike[2])], [(longer[0], longer[1])]]
    assert peak < 2_000_000


def test_blocks_of_words_beyond_a_million_letters_stay_apart(spark):
    rows = spark.createDataFrame([("abc", 5, True, m, 0, 0) for m in (100_000, 1_000_000, 1_000_001)], variants._ROW)
    assert variants._keyed(rows).select("key").distinct().count() == 3


def test_chains_reach_their_root(spark):
    counts = {"aaaaaa": 3125 * 5, "aaaaab": 3125, "aaaabb": 625, "aaabbb": 125, "aabbbb": 25, "abbbbb": 5, "zzzzzz": 7}
    got = {r["word"]: r["root"] for r in variants.group(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == {w: "aaaaaa" if w != "zzzzzz" else w for w in counts}


def test_word_counts(spark):
    texts = [(i, " ".join(RNG.choice(["Language", "langUage", "Èrean×x", "straße", "short", "ÀÉÎÕÜÿ", "word-breaking", "under_scored", "a" * 400]) for _ in range(300))) for i in range(25)]
    texts += [(None, "Language"), (3, None), (4, ""), (5, "\t\n"), (1, "Language"), (1, "Language")]
    expected = collections.Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 7 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                expected[run] += 1
    docs = frame(spark, [(i, t, 1, "w", 2, 3, 4, "k") for i, t in texts], ODD)
    assert {r["word"]: r["n"] for r in variants.word_counts(docs, planted=7).collect()} == dict(expected)
    plain = {r["word"]: r["n"] for r in variants.word_counts(docs).collect()}
    assert plain["language"] > 3 and sum(plain.values()) >= sum(expected.values())


def test_no_words(spark):
    assert variants.group(variants.word_counts(frame(spark, []))).collect() == []
    assert variants.group(variants.word_counts(frame(spark, [(1, "one word of no use")]))).collect() == []


# 12
def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", low)


def brute_resample(docs, target, order=1, buckets=10000, least=20, percent=10):
    def feats(text):
        w = tokens(text)
        return [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]

    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(map(place, feats(text)))
    for text in target:
        t.update(map(place, feats(text)))
    total, goal = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (total + buckets) / ((s[b] + 1.0) * (goal + buckets)))) for b in s}
    rows = []
    for i, text in docs:
        weight = sum(gain[place(f)] for f in feats(text))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(feats(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(tokens(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place_, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = place_ + 1
    return collections.Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize(("order", "frequent"), [(1, 100_000), (1, 20), (1, 1), (2, 40)])
def test_resampling(spark, order, frequent):
    rng = random.Random(order * frequent)
    pool = ["the", "The", "of", "état", "ÉTAT", "x1", "42", "ß", "漢字", *words_of(200, rng=rng), "long" * 100]
    weights = [30, 10, 20] + [1] * (len(pool) - 3)
    docs = [(i, " ".join(rng.choices(pool, weights, k=rng.randint(1, 60))) + "!-_") for i in range(120)]
    docs += [(None, docs[0][1]), (7, docs[7][1]), (7, docs[7][1]), (200, None), (201, ""), (202, "..."), (203, " ".join(["the"] * 3000)), (204, " ".join(["long" * 100] * 50))]
    target = [" ".join(rng.choices(pool[:40], k=30)) for _ in range(20)] + [None, ""]
    given = frame(spark, [(i, t, 1, "w", 2, 3, 4, "k") for i, t in docs], ODD).repartition(5)
    got = resampling.resample(given, frame(spark, [(i, t) for i, t in enumerate(target)]), percent=30, order=order, frequent=frequent).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_resample(docs, target, order, percent=30)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, sum(r["rank"] is not None for r in got) + 1))


def test_resampling_of_nothing(spark):
    some = frame(spark, [(1, "a b c")])
    assert resampling.resample(frame(spark, []), some).collect() == []
    assert [tuple(r) for r in resampling.resample(some, frame(spark, [])).collect()] == list(brute_resample([(1, "a b c")], []))


# 13
MARKED = "x" * 60 + "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1." + "y" * 70
PAGES = [
    (1, "http://a.example/b?c#d", MARKED), (2, None, None), (3, "u v\r\nX: y", MARKED), (None, "q", "z" * 200), (None, "q", "z" * 200), (4, "http://a/", "z" * 200), (4, "http://a/", "z" * 200),
    (5, "h", "WARC/1.WARC/1."), (6, "h", ""), (7, "h", "short"), (8, "h", "short"), (9, "", "é" * 50), (10, "x", "é" * 50), (11, "x", "é" * 49 + "a"), (12, "x", "\r\n\r\n" * 30), (13, "x", "big " * 300_000),
]


def brute_pages(pages, least=100):
    first = {}
    for i, u, t in pages:
        first.setdefault(t or "", []).append((i is None, i, u))
    out = []
    for i, _, t in pages:
        data = (t or "").encode()
        origin = min(first[t or ""], key=lambda x: (x[0], x[1] or 0))[1]
        again = len(data) >= least and i != origin
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", origin if again else None))
    return collections.Counter(out)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archive_round_trip(spark, compression):
    pages = spark.createDataFrame([(*p, 1, "x", True) for p in PAGES], "page_id long, url string, html string, id int, name string, first boolean").repartition(3)
    path = shared_folder(spark) + "/archive"
    warc.write(pages, path, compression=compression, records_per_file=9)
    assert collections.Counter(tuple(r) for r in warc.pages_of(spark, path).collect()) == brute_pages(PAGES)


def test_plain_archives_are_split(spark, tmp_path):
    rng = random.Random(3)
    pages = [(i, f"http://s/{i}", "".join(rng.choice("WARC/1.\r\n0 x") for _ in range(rng.randint(0, 900)))) for i in range(300)]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), str(tmp_path / "a"), compression="none")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert collections.Counter(tuple(r) for r in warc.pages_of(spark, str(tmp_path / "a")).collect()) == brute_pages(pages)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def foreign(kind, name, block, *fields):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *fields, f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    """A member for each record, links in either direction and over a record between, binary payloads, records by themselves."""
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n\xff\xfe\x00binary"
    parts = [
        foreign("warcinfo", "<i>", b"software: x\r\n", "Content-Type: application/warc-fields"),
        foreign("request", "<q1>", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http;msgtype=request"),
        foreign("response", "<r1>", http, "warc-concurrent-to: <q1>", "Content-Type: application/http;msgtype=response", "WARC-Target-URI: http://x/"),
        foreign("metadata", "<m1>", b"a: b\r\n", "WARC-Concurrent-To: <q1>"),
        foreign("resource", "<r2>", b"\x00" * 9, "WARC-Concurrent-To: <q2>", "WARC-Concurrent-To: <m2>"),
        foreign("request", "<q2>", b"GET /2 HTTP/1.1\r\n\r\n", "Content-Type: application/http"),
        foreign("metadata", "<m2>", b"", "WARC-Concurrent-To: <r2>"),
        b"WARC/1.0 is mentioned\r\n\r\n",
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "y.warc").write_bytes(foreign("request", "<q3>", b"GET /3 HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <lost>"))
    found = {r["capture"]: r for r in warc.captures(warc.records(spark, str(tmp_path))).collect()}
    assert set(found) == {"<i>", "<r1>", "<r2>", "<lost>"}
    one = found["<r1>"]
    assert (one["request"]["record_id"], one["metadata"]["record_id"]) == ("<q1>", "<m1>")
    assert bytes(one["response"]["payload"]) == b"\xff\xfe\x00binary" and one["response"]["http"].startswith("HTTP/1.1 200") and one["response"]["uri"] == "http://x/"
    two = found["<r2>"]
    assert (two["request"]["record_id"], two["metadata"]["record_id"], bytes(two["response"]["payload"])) == ("<q2>", "<m2>", b"\x00" * 9)
    assert found["<lost>"]["response"] is None and found["<lost>"]["request"]["record_id"] == "<q3>"


def test_empty_archive(spark):
    path = shared_folder(spark) + "/archive"
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.pages_of(spark, path).collect() == []


# other operators called on tables of any columns
def test_clashing_columns_of_the_classifier(spark):
    rng = random.Random(9)
    good = [(i, "The house stands by the river, and we walked there on Monday. " * rng.randint(1, 3)) for i in range(40)]
    bad = [(100 + i, " ".join(rng.choice(["$$", "buy", "##", "click", "|"]) for _ in range(40))) for i in range(40)]
    docs = frame(spark, [(i, t, 1, 2, 3, "x") for i, t in good + bad + good[:5]], "doc_id long, text string, __id int, __p int, __u int, __text string")
    net = pulearn.train(docs, docs.where("doc_id < 20").select("doc_id"), docs.select("doc_id"))
    rows = pulearn.score(docs, net).collect()
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == 85 and min(by_id[i] for i in range(40)) > max(by_id[100 + i] for i in range(40))
    assert all(by_id[r["doc_id"]] == r["score"] for r in rows)  # rows that repeat are scored alike


# lookup
def test_lookup_of_hot_keys(spark):
    keys = ["hot"] * 5000 + [f"k{i}" for i in range(800)] + [None, "unknown"]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "found long, key string")
    counts = collections.Counter(k for k in keys if k and k != "unknown")
    table = spark.createDataFrame([(k, n, f"v-{k}") for k, n in counts.items()], "key string, n long, other string")
    got = lookup(rows, table, "key", "n")
    assert got.columns == ["found", "key", "other"]
    assert {tuple(r) for r in got.collect()} == {(i, k, f"v-{k}" if k in counts else None) for i, k in enumerate(keys)}
    assert rows.join(F.broadcast(table), "key", "left").count() == got.count()
