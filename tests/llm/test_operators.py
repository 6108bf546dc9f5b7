"""The ten operators on small tables against brute force, with nulls, empties, long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docblocks.llm import bpe, components, fertility, grammar, lattice, lines, pulearn, ring, setsketch, spaced, suffixes
from docblocks.llm.bytesets import Words, chunks, gram_hashes, prefix_sums, span_hashes
from docblocks.llm.tables import shared_folder, vocabulary

RNG = random.Random(11)
VOCABULARY = ["the", "of", "and", *("".join(RNG.choice("abcdeioruxyz") for _ in range(RNG.randint(2, 9))) for _ in range(400))]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


BASE = prose(120)
PASSAGE = prose(60)


def near(text, every):
    return " ".join(f"changed{i}" if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


#: id, text, and columns whose names operators use inside.
DOCS = [
    (0, BASE), (1, BASE), (2, near(BASE, 60)), (3, near(BASE, 15)), (4, None), (5, ""), (6, " \n\t "), (7, "um dois"), (8, "um dois"),
    (9, prose(40) + "\n" + PASSAGE + "\n" + prose(30)), (10, prose(25) + "\n" + PASSAGE), (11, "ação 'tis WE'RE   x  " + "=" * 300), (12, prose(5000)),
    (13, "\n".join(["linha repetida de cinco palavras aqui"] * 3)), (14, near(near(BASE, 60), 40)), (None, BASE), (16, "a" * 450), (0, BASE),
]
COLUMNS = "doc_id long, text string, lang string, n_words int, shard int, sig string, window string, kept boolean"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, 1, 2, "s", "w", True) for i, t in DOCS], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def tokens(text):
    return (text or "").encode().lower().split()


# 8


def test_bpe_is_tiktoken(spark, docs, empty):
    import public_tokenizers
    import tiktoken

    path = vocabulary("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    out = bpe.decode(bpe.encode(docs, path), path).collect()
    assert len(out) == len(DOCS)
    texts = collections.Counter((i, t) for i, t in DOCS)
    seen = collections.Counter()
    for row in out:
        text = bytes(row["decoded"]).decode()
        seen[row["doc_id"], text] += 1
        ids = np.frombuffer(row["ids"], "<u4").tolist()
        assert ids == library.encode_ordinary(text)
        begins = np.cumsum([0, *(len(library.decode_single_token_bytes(t)) for t in ids)])[:-1]
        assert np.frombuffer(row["offsets"], "<u4").tolist() == begins.tolist()
    assert seen == collections.Counter({(i, t or ""): n for (i, t), n in texts.items() if t is not None} | {(4, ""): 1})
    assert bpe.encode(empty, path).count() == 0


def test_slices_at_odd_places():
    import public_tokenizers
    import regex

    parts = ["'s", "'re", "'", "''", " ", "  ", "\n", "a", "re", "é", "字", "1", "²", "!", "　", "S"]
    texts = ["".join(RNG.choice(parts) for _ in range(RNG.randint(0, 12))) for _ in range(3000)]
    for first, end, data, offsets in chunks(pa.array(texts), 500):
        starts = bpe.slice_starts(data, offsets)
        expected = [offsets[i] + len(t[: m.start()].encode()) for i, t in enumerate(texts[first:end]) for m in regex.finditer(public_tokenizers.PATTERN, t)]
        assert starts.tolist() == expected


# 10


def test_counts_of_the_rules(docs, empty):
    path = vocabulary("piece_bpe_32k.model")

    def brute(text):
        words = (text or "").encode().split()
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        filled = [x for x in (text or "").split("\n") if x.encode().split()]
        return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(filled) - len(set(filled)), len(covered)

    judged = fertility.judge(docs, path)
    assert judged.columns[: len(docs.columns)] == docs.columns
    rows = judged.collect()
    assert len(rows) == len(DOCS)
    for row in rows:
        m = row["measures"]
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == brute(row["text"])
        assert row["base_failed"] == (m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"])
        assert not (row["base_failed"] and row["kept_"])
    assert fertility.filter_documents(empty, path).columns == empty.columns


def test_bands_reject_noise(spark):
    english = "It was a bright cold day in April and the clocks were striking thirteen while the people of the town walked home from work in the rain. " * 1
    rows = [(0, english + "They spoke about the weather, the price of bread and the long summer that nobody expected to end.", "en"), (1, " ".join(f"{w}$$$ ### |" for w in english.split()), "en"), (2, "這是一個關於城市與河流的故事 人們在河邊散步 " * 3, None)]
    path = vocabulary("piece_bpe_32k.model")
    kept = {r["doc_id"]: r["measures"] for r in fertility.judge(spark.createDataFrame(rows, "doc_id int, text string, lang string"), path).collect()}
    assert kept[1]["chars_per_token"] < kept[0]["chars_per_token"]
    assert fertility.judge(spark.createDataFrame(rows, "doc_id int, text string, lang string"), path).where("kept and doc_id = 0").count() == 1


# 9


def brute_lines(rows, least):
    """Windows as defined, first occurrences, extension both ways."""
    keys, order = {}, []
    for i, t in rows:
        if (i, t) not in keys:
            full = [x.encode().split() and b" ".join([x.encode().strip(b" \t\n\x0b\x0c\r")]) for x in (t or "").split("\n") if x.encode().split()]
            keys[i, t] = full
            order.append((i, t))
    order.sort(key=lambda k: (k[0] is not None, k[0] or 0))
    seen, gone = {}, collections.defaultdict(set)
    for k in order:
        full = keys[k]
        for a in range(len(full)):
            n, b = 0, a
            while b < len(full) and n < least:
                n += len(full[b].split())
                b += 1
            if n < least:
                continue
            window = tuple(full[a:b])
            if window not in seen:
                seen[window] = (k, a)
                continue
            (j, p), q = seen[window], a
            other = keys[j]
            while q > 0 and p > 0 and full[q - 1] == other[p - 1]:
                p, q = p - 1, q - 1
            d = seen[window][1] - a
            e = b
            while e < len(full) and e + d < len(other) and full[e] == other[e + d]:
                e += 1
            gone[k] |= set(range(q, e))
    return {k: len(v) for k, v in gone.items() if v}


def test_line_runs(spark, docs, empty):
    rng = random.Random(3)
    pool = [prose(n, rng) for n in (1, 2, 3, 6, 8, 12)]
    rows = [*((i, t) for i, t in DOCS if i is not None), *((100 + i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(60))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = lines.dedup(frame).collect()
    assert len(out) == len(rows)
    expected = brute_lines(rows, lines.MIN_WORDS)
    removed = collections.defaultdict(set)
    for r in out:
        removed[r["doc_id"]].add(r["n_lines_removed"])
    assert {k: v for k, v in removed.items() if v != {0}} == {i: {n} for (i, _), n in expected.items()}
    assert lines.dedup(docs).columns == [*docs.columns, "n_lines", "n_lines_removed"]
    assert lines.dedup(empty).count() == 0


def test_first_copy_of_every_line_stays(spark):
    rows = [(1, f"a b c d e f\n{PASSAGE}\ncauda"), (2, f"x\n{PASSAGE}\ncauda\nfim"), (3, PASSAGE)]
    out = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[0][1], 2: "x\nfim", 3: ""}


# 2


def shingle_set(text, k=5):
    w = tokens(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = collections.defaultdict(list)
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)].append(key)
    return sorted((str(key), len(sets[i]), min(least[find(i)], default=None)) for i, (key, _) in enumerate(rows))


def test_near_duplicates(spark, docs, empty):
    rng = random.Random(5)
    rows = list(DOCS)
    for g in range(3):
        base = prose(150, rng).split()
        for i in range(70):  # around the threshold
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = f"w{rng.random()}"
            rows.append((1000 * (g + 1) + i, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in setsketch.groups(frame).collect())
    assert got == brute_components(rows)
    assert setsketch.groups(docs).columns == ["doc_id", "n_shingles", "component_id"]
    assert setsketch.groups(empty).count() == 0


def test_one_row_of_each_component_stays(spark, docs, empty):
    """Repeats under one id, null ids, one id over two texts: rows are told apart by id and text."""
    other = prose(80)
    rows = [*DOCS, (30, BASE), (30, other), (None, BASE), (31, BASE.upper()), (31, BASE.upper()), (None, None), (None, ""), (None, prose(90))]
    component = {int(i): c for i, _, c in brute_components([(i, t) for i, (_, t) in enumerate(rows)])}
    expected = collections.Counter()
    for members in [[i for i in range(len(rows)) if component[i] == c] for c in sorted(set(component.values()))]:
        if not tokens(rows[members[0]][1]):
            expected.update(rows[i] for i in members)
            continue
        least = min((rows[i][0] is None, rows[i][0] or 0) for i in members)
        same = [rows[i] for i in members if (rows[i][0] is None, rows[i][0] or 0) == least]
        expected[same[0][0]] += 1
    frame = spark.createDataFrame([(i, t, "h", 1, True) for i, t in rows], "doc_id long, text string, h1 string, best_ int, id_ boolean").repartition(3)
    out = setsketch.deduplicate(frame)
    assert out.columns == frame.columns
    got = collections.Counter()
    for r in out.collect():
        got[(r["doc_id"], r["text"]) if not tokens(r["text"]) else r["doc_id"]] += 1
    assert got == expected
    assert setsketch.deduplicate(empty).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    sets = [np.concatenate([common, a]), np.concatenate([common, b]), np.concatenate([common, a, b])]
    regs = setsketch.registers(np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1])
    assert (setsketch.merge(regs[0], regs[1]) == regs[2]).all()
    j, ok = setsketch.estimate(regs[:1], regs[1:2], np.array([900.0]), np.array([900.0]), 0.75)
    assert abs(j[0] - 0.8) < 0.2 and ok[0]
    other = setsketch.registers(rng.integers(0, 2**63, 900, dtype=np.uint64), np.array([0]))
    assert not setsketch.estimate(regs[:1], other, np.array([900.0]), np.array([900.0]), 0.75)[1][0]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(frame, shared_folder(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


# 3


def test_repeated_bytes(spark, docs, empty):
    rng = random.Random(9)
    rows = [(i, t) for i, t in DOCS if i is not None]
    piece = [prose(60, rng) for _ in range(4)]
    for i in range(25):
        cut = rng.randint(0, 120)
        rows.append((200 + i, prose(rng.randint(0, 40), rng) + rng.choice(piece)[cut : cut + rng.randint(150, 330)] + prose(rng.randint(0, 40), rng) + rng.choice(["", rng.choice(piece)])))
    raw = [(t or "").encode() for _, t in rows]
    count = collections.Counter(b[x : x + 200] for b in raw for x in range(len(b) - 199))
    expected = []
    for (i, _), b in zip(rows, raw, strict=True):
        hit = np.zeros(len(b) + 1, dtype=int)
        for x in range(len(b) - 199):
            if count[b[x : x + 200]] > 1:
                hit[x] += 1
                hit[x + 200] -= 1
        covered = np.cumsum(hit)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~covered])
        expected.append((i, len(b), int(covered.sum()), int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    out = suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["runs"]), r["kept_sha256"]) for r in out) == sorted(expected)
    assert suffixes.dedup(empty).count() == 0
    assert suffixes.dedup(docs).count() == len(DOCS)


def test_levels_stay_few():
    family = suffixes.SuffixLevels(16)
    packer = suffixes.Entries(16)
    rng = np.random.default_rng(2)
    for _ in range(40):
        sides = [pa.array([rng.bytes(int(rng.integers(0, 17))) for _ in range(10)], pa.binary()) for _ in range(2)]
        family.add(packer.pack(rng.integers(0, 5, 10), *sides))
    assert len(family.levels) <= 7 and sum(len(x) for x, _ in family.levels) == 400
    for level, _ in family.levels:
        keys = [r.tobytes() for r in level]
        assert keys == sorted(keys)


# 4


def test_ring(docs, empty):
    out = ring.shard(docs, 5).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in DOCS)
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by[s]) for s in range(5)]
    assert max(sizes) - min(sizes) <= 1
    assert sorted((r["size"], r["text_crc32"]) for r in out) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in DOCS)
    assert ring.shard(empty, 5).count() == 0


def test_runs_follow_the_ring():
    counts = {c: 3 for c in range(0, 1 << ring.ring_bits(24), 257)}
    runs = ring.plan_runs(counts, 7, 16)
    total = sum(counts.values())
    assert [r[2] for r in runs] == sorted(r[2] for r in runs)
    ends = [r[2] for r in runs[1:]] + [total]
    loads = collections.Counter()
    for r, end in zip(runs, ends, strict=True):
        assert r[4] == loads[r[3]]
        loads[r[3]] += end - r[2]
    assert sorted(loads.values()) == sorted(ring.capacities(total, 7))


def brute_ring(ids, shards, slack=0.0):
    """Keys one by one in ring order, each to the first shard with room clockwise from its place: (home, shard) of every id."""
    bits = ring.ring_bits(shards)
    nodes = ring.virtual_nodes(shards)
    room = ring.capacities(len(ids), shards, slack)
    out = {}
    for place, i in sorted(ids):
        cell = place >> (62 - bits)
        at = next((k for k, (c, _) in enumerate(nodes) if c >= cell), 0)
        home = nodes[at][1]
        while not room[nodes[at % len(nodes)][1]]:
            at += 1
        room[nodes[at % len(nodes)][1]] -= 1
        out[i] = (home, nodes[at % len(nodes)][1])
    return out


@pytest.mark.parametrize("shards, slack", [(5, 0.0), (24, 0.0), (24, 0.25), (200, 0.5)])
def test_the_ring_is_walked_key_by_key(spark, shards, slack):
    frame = spark.range(3000).selectExpr("id as doc_id", "cast(id as string) as text", "1 as shard", "2 as slot", "3 as __cell").repartition(3)
    places = [(r[0], r[1]) for r in frame.select(F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string")), 2), "doc_id").collect()]
    expected = brute_ring(places, shards, slack)
    out = {r["doc_id"]: (r["home_shard"], r["shard"]) for r in ring.shard(frame, shards, slack=slack).collect()}
    assert out == expected
    loads = collections.Counter(s for _, s in out.values())
    assert max(loads.values()) <= math.ceil((1 + slack) * 3000 / shards)


def test_one_more_shard_moves_little(spark):
    """With slack, what moves when a shard joins is near its own share; without, the bound itself moves rows."""
    frame = spark.range(20000).selectExpr("id as doc_id", "'' as text").repartition(3)
    moved = {}
    for slack in (0.25, 1.0):
        before, after = ({r["doc_id"]: r["shard"] for r in ring.shard(frame, n, slack=slack).collect()} for n in (24, 25))
        moved[slack] = sum(before[i] != after[i] for i in before) / len(before)
    assert 1 / 25 * 0.6 < moved[1.0] < 0.08 and moved[1.0] <= moved[0.25] < 0.25


def test_one_hot_key_is_spread(spark):
    rows = spark.range(300).selectExpr("cast(1 as long) as doc_id", "cast(id as string) as text")
    assert sorted(r["count"] for r in ring.shard(rows, 7).groupBy("shard").count().collect()) == [42, 43, 43, 43, 43, 43, 43]


# 5


def test_lattice_sums_all_segmentations():
    pieces = lattice.Pieces(vocabulary("piece_bpe_32k.model"))
    logp = lattice.log_p(pieces, None, 0.25)
    words = [b"there", b"xqz", "ação".encode(), b"a", b"z" * 150]

    def brute(word):
        data = np.frombuffer(word, dtype=np.uint8)
        sums = prefix_sums(data)
        a = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - lattice.LONGEST), j):
                if i // lattice.STRETCH == (j - 1) // lattice.STRETCH:
                    at = pieces.find(span_hashes(sums, np.array([i]), np.array([j])))[0]
                    a[j] += a[i] * math.exp(logp[at]) if at >= 0 else 0.0
        return math.log(a[-1]) if a[-1] > 0 else -math.inf

    got = lattice.word_log_probs(pieces, logp, words)
    for word, value in zip(words[:4], got, strict=False):
        assert value == pytest.approx(brute(word))
    assert np.isfinite(got).all()
    uses = lattice.expected_uses(pieces, logp, [b"there"], np.array([2.0]))
    assert 2.0 <= uses.sum() <= 10.0


def test_lattice_leaves_no_segmentation_out(monkeypatch):
    """Long pieces and long words against a sum over every span, in one stretch and in many."""
    pieces = lattice.Pieces(vocabulary("piece_bpe_32k.model"))
    logp = lattice.log_p(pieces, None, 0.25)
    words = [b"international", b"misrepresentations", b"reconfigurationimplementation", "população".encode() * 12, b"https://a.example/" + b"implementation" * 12, "自然言語処理".encode() * 9]

    def spans(word):
        n = len(word)
        i, j = np.triu_indices(n + 1, 1)
        at = pieces.find(span_hashes(prefix_sums(np.frombuffer(word, dtype=np.uint8)), i, j))
        into = [[] for _ in range(n + 1)]
        for x, y, k in zip(i[at >= 0], j[at >= 0], at[at >= 0], strict=True):
            into[y].append((x, k))
        return into

    def brute(word):
        into, n = spans(word), len(word)
        a, z, uses = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf), np.zeros(pieces.size)
        a[0] = z[n] = 0.0
        for y in range(1, n + 1):
            for x, k in into[y]:
                a[y] = np.logaddexp(a[y], a[x] + logp[k])
        for y in range(n, 0, -1):
            for x, k in into[y]:
                z[x] = np.logaddexp(z[x], z[y] + logp[k])
        for y in range(1, n + 1):
            for x, k in into[y]:
                uses[k] += math.exp(a[x] + logp[k] + z[y] - a[n])
        return a[n], uses

    want = [brute(w) for w in words]
    counts = np.arange(1.0, len(words) + 1)
    for stretch in (None, 7, 30, 64):
        if stretch:
            monkeypatch.setattr(lattice, "STRETCH", stretch)
        assert lattice.word_log_probs(pieces, logp, words) == pytest.approx([w[0] for w in want])
        assert np.allclose(lattice.expected_uses(pieces, logp, words, counts), sum(n * w[1] for n, w in zip(counts, want, strict=True)))


def test_scores_of_texts(docs, empty):
    path = vocabulary("piece_bpe_32k.model")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    out = lattice.score(docs, learn, path).collect()
    count = collections.Counter()
    for i, t in DOCS:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            count.update([*tokens(t), None])
    total, kinds = sum(count.values()), len(count)
    base = sorted((str(i), round(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in [*tokens(t), None]), 6), len(tokens(t)) + 1) for i, t in DOCS)
    assert sorted((str(r["doc_id"]), round(r["base_score"], 6), r["n_tokens"]) for r in out) == base
    assert all(r["train_tokens"] == total and r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    assert lattice.score(empty, learn, path).count() == 0


def test_the_lattice_scores_seen_words(spark):
    """A word of the training texts gets its lattice marginal, from piece weights by token counts, and not its own count."""
    path = vocabulary("piece_bpe_32k.model")
    texts = [(0, "there there there there xqzzy"), (1, "there"), (2, "xqzzy"), (3, "xqzzyy")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lattice.score(rows, F.col("doc_id") == 0, path).collect()}
    pieces, uses, stop = lattice.Pieces(path), None, 0.25
    seen, n = [b"there", b"xqzzy"], np.array([4.0, 1.0])
    for _ in range(2):
        uses = lattice.expected_uses(pieces, lattice.log_p(pieces, uses, stop), seen, n)
        stop = 5 / (5 + uses.sum())
    marginal = lattice.word_log_probs(pieces, lattice.log_p(pieces, uses, stop), [b"there", b"xqzzy", b"xqzzyy"])
    want = (marginal + math.log(stop) + math.log(5 / 6) + math.log(1 / 6)) / math.log(10)
    assert [got[1], got[2], got[3]] == pytest.approx(list(want))


def test_long_unseen_words_stay_in_log_space(spark):
    """Twice the bytes of an unseen word are about twice the score, without a floor; so for training texts without words."""
    long = {1: "qzx7" * 900, 2: "qzx7" * 1800}
    texts = [(0, prose(400)), *long.items()]
    for known in (texts, [(0, ""), *texts[1:]]):
        rows = spark.createDataFrame(known, "doc_id long, text string")
        got = {r["doc_id"]: r["score"] for r in lattice.score(rows, F.col("doc_id") == 0, vocabulary("piece_bpe_32k.model")).collect()}
        assert got[1] < -3000
        assert got[2] / got[1] == pytest.approx(2, rel=0.02)
        assert all(map(math.isfinite, got.values()))


# 7


def test_leaks(spark, docs, empty):
    rng = random.Random(8)
    items = [(i, prose(rng.randint(14, 50), rng)) for i in range(20)] + [(20, None), (21, ""), (22, "too short")]
    rows = [*DOCS]
    for i, text in items[:20]:
        words = text.split()
        for k in range(0, len(words), 9):
            words[k] = "Other"
        rows.append((500 + i, prose(rng.randint(0, 3000), rng) + " " + " ".join(words).upper() + ", " + prose(10, rng)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in spaced.overlaps(frame, bench).collect()}
    assert found == {(500 + i, i) for i in range(20)}
    kept = {r["doc_id"] for r in spaced.decontaminate(frame, bench).collect()}
    assert kept == {i for i, _ in DOCS}
    assert spaced.decontaminate(docs, bench).columns == docs.columns
    assert spaced.overlaps(empty, bench).count() == 0 and spaced.overlaps(docs, empty.selectExpr("doc_id as item_id", "text")).count() == 0


def brute_leaks(rows, items):
    """Every placing of every item along every text, no masks: (row, item) where enough words of a window agree."""
    split = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    found = set()
    for r, (_, text) in enumerate(rows):
        words = split(text)
        for item, it in items:
            theirs = split(it)
            n = min(len(theirs), spaced.WINDOW)
            for start in range(-len(theirs) + 1, len(words)) if theirs else ():
                same = [0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(theirs)]
                if any(sum(same[i : i + n]) >= math.ceil(n * spaced.SHARE) for i in range(len(theirs) - n + 1)):
                    found.add((r, item))
                    break
    return found


def test_short_items_are_found_with_every_tolerated_substitution(spark):
    """Items of 1 to 16 words, each with random substitutions up to the tolerated number and one more."""
    rng = random.Random(21)
    letters = [f"w{i}" for i in range(4000)]
    items, rows = [], []
    for n in [*range(1, 17), 20]:
        for _ in range(6):
            words = rng.sample(letters, n)
            items.append((len(items), " ".join(words)))
            spare = min(n, 16) - math.ceil(min(n, 16) * spaced.SHARE)
            for wrong in (0, spare, spare, spare + 1):
                changed = [f"x{rng.random()}".replace(".", "") if i in rng.sample(range(n), min(wrong, n)) else w for i, w in enumerate(words)]
                rows.append((len(rows), " ".join([*(f"p{rng.randint(0, 99)}" for _ in range(rng.randint(0, 9))), *changed, "q"])))
    assert all(spaced.masks_for(n) for n in range(1, 17))
    found = {(r["doc_id"], r["item_id"]) for r in spaced.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == brute_leaks(rows, items)


def test_leaking_rows_go_by_id_and_text(spark):
    """A null id doesn't keep a leak, and rows that share an id with a leak stay; repeats are judged alike; long texts and clashing names work."""
    item = prose(30)
    long = prose(400_000)
    rows = [(None, item), (None, "clean text of no interest"), (1, item), (1, "another clean text"), (1, item), (2, long + " " + item), (3, long), (4, None), (5, "")]
    frame = spark.createDataFrame([(i, t, 1, "a", "b", 2) for i, t in rows], "doc_id long, text string, __pos int, key string, held string, __item int")
    bench = spark.createDataFrame([(0, item), (1, item)], "item_id long, text string")
    kept = spaced.decontaminate(frame, bench)
    assert kept.columns == frame.columns
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:20]) for r in kept.collect()) == sorted([("None", "clean text of no inte"[:20]), ("1", "another clean text"), ("3", long[:20]), ("4", ""), ("5", "")])


# 1 and 6


def test_quality_learns_from_positives(spark, empty):
    rng = random.Random(4)
    rows = [(i, prose(rng.randint(20, 200), rng) if i % 4 else " ".join(f"{w}$$$ ###" for w in prose(rng.randint(20, 90), rng).split())) for i in range(800)]
    frame = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    positives = frame.where("doc_id % 4 != 0 and doc_id < 400")
    net = pulearn.train(frame, positives, frame)
    assert 0.6 < net.prior < 0.9
    out = {r["doc_id"]: r["score"] for r in pulearn.score(frame, net).collect()}
    held = [i for i in range(400, 800)]
    assert pulearn.auc(np.array([i % 4 != 0 for i in held]), np.array([out[i] for i in held])) > 0.97
    assert out[900] == out[901] and 0 <= out[900] <= 1
    assert pulearn.train(frame, positives.limit(0), frame) is None
    assert pulearn.score(empty, None).count() == 0


def test_grammar_weighs_clauses(spark, empty):
    def raw(text):
        return [grammar.raw_scores(d, o, grammar.Lexicon())[0] for _, _, d, o in chunks(pa.array([text]))][0]

    # targets on both sides, copulas and determiners make frames; a word by itself is none
    assert raw("you are an idiot") > raw("this one is stupid") > raw("an idiot") > raw("idiot") == raw("idiotic") == raw("a calm day") == 0
    assert raw("idiot that you are") == raw("you idiot") == pytest.approx(1.3)
    # a threat needs an object, on either side; a subject is none
    assert raw("I will kill you") > raw("they kill time") == raw("you people beat the odds") == raw("kill. you") == 0
    assert raw("ich werde dich töten") == raw("kill them all") == pytest.approx(1.3)
    # negation in reach, reported speech and quotation over the whole clause
    assert raw("you are an idiot") > raw("you are not an idiot") > 0 and raw("you are not here and, as all of us know, an idiot") == raw("an idiot")
    for quoted in ("they said you are an idiot", "you are an idiot, she told us", '"you are an idiot"', "\u201cyou are an idiot\u201d", "\u00abyou are an idiot\u00bb"):
        assert 0 < raw(quoted) < raw("you are an idiot"), quoted
    assert raw('"as is" you are an idiot') == raw("you are an idiot")
    # without a frame, only further insults of the text count
    assert raw("idiot! another clause. stupid") == pytest.approx(2 * grammar.UNFRAMED)
    texts = ["you are an idiot", "", "idiot", "kill. you", '"', "you"]
    at = np.cumsum([0, *map(len, texts)])
    together = grammar.raw_scores(np.frombuffer("".join(texts).encode(), np.uint8), at, grammar.Lexicon())
    assert together.tolist() == [raw(t) for t in texts]


def test_toxicity_learns_stems(spark, empty):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        words = prose(rng.randint(30, 90), rng).split()
        if i % 8 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "zorgu" + rng.choice(["ab", "ed", "ix", "or"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 8 == 0)))
    frame = spark.createDataFrame([*rows, (1000, None)], "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = grammar.train(frame, table.where("doc_id < 600"))
    out = {r["doc_id"]: r["score"] for r in grammar.score(frame, lexicon).collect()}
    wrong = [i for i in range(600, 900) if (out[i] >= 0.3) != (i % 8 == 0)]
    assert not wrong and out[1000] < 0.3
    assert grammar.score(empty, lexicon).count() == 0


def test_spans_hash_alike_wherever_they_stand():
    data = np.frombuffer(b"one two one  two\x00one", dtype=np.uint8)
    words = Words(data, np.array([0, 16, 20]))
    got = [words.data[a:b].tobytes() for a, b in zip(words.starts, words.ends, strict=True)]
    h = words.hashes()
    assert got == [b"one", b"two", b"one", b"two", b"\x00one"] and h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3
    assert gram_hashes(h, 2)[0] == gram_hashes(h, 2)[2]


def test_only_very_common_grams_are_split_between_ranges(spark):
    """A gram's windows are counted over all ranges only where more entries than one range should take have it."""
    rng = random.Random(3)
    rows = [(i, -i, False, g, bytearray(rng.randbytes(136)), bytearray(rng.randbytes(136))) for i, g in enumerate([7] * 400 + list(range(100, 200)) * 2)]
    entries = spark.createDataFrame(rows, "ctx long, ctx2 long, multi boolean, gram long, before binary, after binary")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shared = lambda whole: {r[0] for r in suffixes._scan(entries, whole).where("border is not null").groupBy("border").count().where("count > 1").collect()}
        assert shared(1000) == set()
        assert shared(300) == {7}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
