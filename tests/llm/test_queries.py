"""Every opN_ query and every stage of the pipeline, called as registered, on a small folder of tables, against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as contract
from docblocks.llm import bpe, fertility, lines, spaced
from docblocks.llm.tables import vocabulary

from .test_operators import brute_components, brute_leaks, brute_lines, prose

ENGLISH = "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so said what up its about into than them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years where much your way down should because long each just state those people mr how too little".split()


def text_of(n, rng):
    return " ".join(rng.choice(ENGLISH) if rng.random() < 0.7 else rng.choice(ENGLISH) + rng.choice(["ing", "er", "ly", "ness"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(77)
    base, passage = text_of(90, rng), text_of(60, rng)
    items = [(i, text_of(rng.randint(16, 40), rng)) for i in range(6)]
    rows = [(i, text_of(rng.randint(40, 160), rng), "en", 1) for i in range(120)]
    rows += [(200, base, "en", 1), (201, base, "en", 1), (202, base + " end", "en", 1), (203, None, None, None), (204, "", "en", 0), (205, "too short", "en", 1), (None, text_of(50, rng), "en", 1), (200, text_of(45, rng), "en", 1)]
    rows += [(210 + k, f"{text_of(40, rng)}\n{passage}\n{text_of(30, rng)}", "en", 1) for k in range(3)]
    rows += [(220 + i, f"{text_of(50, rng)} {t} {text_of(30, rng)}", "en", 1) for i, t in items]
    rows += [(230 + k, "\n".join([text_of(30, rng), " ".join(["same"] * 60)]), "en", 1) for k in range(3)]
    rows += [(240 + k, f"{text_of(30, rng)} you are a worthless idiot and {text_of(10, rng)} pathetic loser", "en", 1) for k in range(40)]
    rows += [(300 + k, " ".join(f"{w}$$ ## |" for w in text_of(40, rng).split()), "en", 1) for k in range(40)]
    rng.shuffle(rows)
    where = tmp_path_factory.mktemp("tables")
    docs = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "lang": [r[2] for r in rows], "source": ["s"] * len(rows), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())})
    pq.write_table(docs, f"{where}/documents.parquet")
    marked = [(r[0], int(r[0] < 300), int(240 <= r[0] < 280)) for r in rows if r[0] is not None]
    pq.write_table(pa.table({"doc_id": pa.array([m[0] for m in marked], pa.int64()), "quality": pa.array([m[1] for m in marked], pa.int32()), "toxic": pa.array([m[2] for m in marked], pa.int32())}), f"{where}/labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": [t for _, t in items]}), f"{where}/benchmark.parquet")
    return str(where), [(r[0], r[1]) for r in rows], items


def result(spark, folder, number):
    name = next(n for n in contract.queries() if n.startswith(f"op{number}_"))
    frame = contract.queries()[name](spark, folder[0])
    return dict(frame.dtypes), frame.collect()


def held(i, n, rest):
    return i is not None and zlib.crc32(str(i).encode()) % n == rest


@pytest.mark.parametrize(("number", "least", "label"), [(1, 0.7, lambda i: i < 300), (6, 0.3, lambda i: 240 <= i < 280)])
def test_classifiers(spark, folder, number, least, label):
    kinds, rows = result(spark, folder, number)
    assert kinds["held_out"] == "boolean" and kinds["score"] == "double" and kinds["predicted"] == "int"
    assert len(rows) == len(folder[1])
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least) and r["held_out"] == held(r["doc_id"], 4, 2)
    judged = [(label(r["doc_id"]), r["predicted"] == 1) for r in rows if r["held_out"] and r["doc_id"] not in (203, 204, 205)]
    assert sum(a == b for a, b in judged) >= 0.9 * len(judged)


def test_near_duplicates(spark, folder):
    _, rows = result(spark, folder, 2)
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in rows) == brute_components(folder[1])
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in rows)


def test_shards(spark, folder):
    kinds, rows = result(spark, folder, 4)
    loads = collections.Counter(r["shard"] for r in rows)
    assert set(loads) <= set(range(24)) and max(loads.values()) - min(loads.get(s, 0) for s in range(24)) <= 1
    texts = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in folder[1])
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    for s in loads:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(loads[s]))
    assert kinds["grown_shard"] == "int" and {r["law"] for r in rows} == {"rows"}


def words(text):
    return (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()


def test_language_model(spark, folder):
    _, rows = result(spark, folder, 5)
    train = [(i, t) for i, t in folder[1] if i is not None and zlib.crc32(str(i).encode()) % 10 != 0]
    counts = collections.Counter(w for _, t in train for w in words(t))
    counts[None] = len(train)  # the ends
    n, v = sum(counts.values()), len(counts)
    expected = collections.Counter()
    for i, t in folder[1]:
        tokens = [*words(t), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        expected[i, held(i, 10, 0), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == expected
    # a probability of the whole text: more words are less likely, and equal texts score alike
    assert all(r["score"] < 0 for r in rows)
    by_text = collections.defaultdict(set)
    for r in rows:
        if r["doc_id"] in (200, 201) and r["n_tokens"] == 91:
            by_text["base"].add(round(r["score"], 9))
    assert len(by_text["base"]) == 1


def repeated(rows, span=200):
    raw = [(t or "").encode() for _, t in rows]
    count = collections.Counter(b[x : x + span] for b in raw for x in range(len(b) - span + 1))
    for (i, _), b in zip(rows, raw, strict=True):
        hit = np.zeros(len(b) + 1, dtype=int)
        for x in range(len(b) - span + 1):
            if count[b[x : x + span]] > 1:
                hit[x] += 1
                hit[x + span] -= 1
        covered = np.cumsum(hit)[:-1] > 0
        yield i, len(b), int(covered.sum()), int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~covered])).hexdigest()


def test_repeated_bytes(spark, folder):
    _, rows = result(spark, folder, 3)
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == collections.Counter(repeated(folder[1]))


def test_repeats_across_ranges(spark, folder, tmp_path):
    """A common passage with many neighbours fills several ranges, so that its gram is split between them."""
    rng = random.Random(5)
    middle = prose(14, rng)[:90]
    rows = [(i, prose(18, rng)[: rng.randint(60, 110)] + rng.choice([" a b ", " c d ", " e f "]) * rng.randint(0, 3) + middle + rng.choice([" x y ", " z w "]) * rng.randint(0, 3) + prose(18, rng)[: rng.randint(60, 110)]) for i in range(160)]
    shared = [prose(16, rng)[:80] for _ in range(5)]
    rows += [(500 + i, rng.choice(shared) + middle + rng.choice(shared)) for i in range(60)]
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]}), f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = contract.queries()["op3_suffix_levels"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found) == collections.Counter(repeated(rows))


def test_leaks(spark, folder):
    _, rows = result(spark, folder, 7)
    ids = [i for i, _ in folder[1]]
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(ids[k], item) for k, item in brute_leaks(folder[1], folder[2])}


def test_tokens(spark, folder):
    import public_tokenizers
    import tiktoken

    path = vocabulary("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    expected = collections.Counter()
    for i, t in folder[1]:
        ids = library.encode_ordinary(t or "")
        expected[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    _, rows = result(spark, folder, 8)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == expected


def test_line_repeats(spark, folder):
    _, rows = result(spark, folder, 9)
    gone = brute_lines(folder[1], lines.MIN_WORDS)
    expected = collections.Counter((i, gone.get((i, t), 0)) for i, t in folder[1])
    assert collections.Counter((r["doc_id"], r["n_removed"]) for r in rows) == expected


def verdict(text, lang, model, bands=fertility.BANDS):
    """The rules of one text by their words: (the five counts, base rule failed, kept)."""
    raw = (text or "").encode().split()
    windows = collections.Counter(tuple(raw[i : i + 8]) for i in range(len(raw) - 7))
    repeat = {i + k for i in range(len(raw) - 7) if windows[tuple(raw[i : i + 8])] > 1 for k in range(8)}
    full = [x for x in (text or "").split("\n") if x.encode().split()]
    counts = (len(raw), sum(len(w.decode()) for w in raw), sum((text or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(repeat))
    failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
    ids = [t for w in raw for t in model.encode(w.decode())]
    n = max(len(ids), 1)
    share = np.array(list(collections.Counter(ids).values())) / n
    entropy = float(-(share * np.log2(share)).sum()) if ids else 0.0
    band = bands[lang if lang in bands else "latin" if any(c.isalpha() for c in text or "") else "*"]
    length = min(math.log2(n), fertility.SATURATED)
    least = band.curve[0] + band.curve[1] * length + band.curve[2] * length**2 - band.slack
    fits = band.chars_per_token[0] <= counts[1] / n <= band.chars_per_token[1] and sum(model.is_byte(t) for t in ids) / n <= band.byte_share and entropy >= least
    return *counts, failed, not failed and fits


def test_rules(spark, folder):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    langs = {203: None}
    expected = collections.Counter((i, *verdict(t, langs.get(i, "en"), model)) for i, t in folder[1])
    _, rows = result(spark, folder, 10)
    got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in rows)
    assert got == expected
    assert any(r["kept"] for r in rows) and any(not r["kept"] and not r["base_failed"] for r in rows)


# the pipeline


def staged(spark, folder):
    """Each stage's name with what it got and gave, as run() chains them."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder[0])
        before = docs.collect()
        docs = spark.createDataFrame(out.collect(), out.schema)
        yield name, before, docs


def test_pipeline_by_stages(spark, folder):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    final = None
    for name, before, after in staged(spark, folder):
        rows = after.collect()
        texts = [(r["doc_id"], r["text"]) for r in before]
        if name != "encoding":
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            got = collections.Counter((r["doc_id"], r["text"]) for r in rows)
        if name == "quality rules":
            assert got == collections.Counter((r["doc_id"], r["text"]) for r in before if verdict(r["text"], r["lang"], model)[-1])
        elif name == "line dedup":
            gone = brute_lines(texts, lines.MIN_WORDS)
            left = {r["doc_id"]: len(r["text"].split("\n")) for r in rows}
            for i, t in texts:
                total = len([x for x in t.split("\n") if x.encode().split()])
                if gone.get((i, t), 0) < total and list(ids for ids, _ in texts).count(i) == 1:
                    assert left[i] == len(t.split("\n")) - gone.get((i, t), 0)
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        elif name == "near dedup":
            classes = collections.defaultdict(list)
            for k, _, c in brute_components([(k, t) for k, (_, t) in enumerate(texts)]):
                classes[c].append(texts[int(k)])
            assert got == collections.Counter(min(members, key=lambda m: (m[0] is None, m[0] or 0)) for members in classes.values())
        elif name == "decontamination":
            bad = {k for k, _ in brute_leaks(texts, folder[2])}
            assert bad and got == collections.Counter(t for k, t in enumerate(texts) if k not in bad)
        else:
            assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in texts)
            digests = collections.Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts)
            assert collections.Counter((r["doc_id"], r["decoded_sha256"]) for r in rows) == digests
        final = rows
    import corpus_pipeline

    whole = corpus_pipeline.run(spark, folder[0]).collect()
    assert collections.Counter((r["doc_id"], r["ids_sha256"]) for r in whole) == collections.Counter((r["doc_id"], r["ids_sha256"]) for r in final)


def test_stages_take_odd_inputs(spark, folder):
    """Empty tables, nulls in any column, repeated rows, long texts and columns of the operators' own names."""
    import corpus_pipeline

    rng = random.Random(2)
    long = "\n".join(text_of(12, rng) for _ in range(12_000))
    schema = "doc_id long, text string, lang string, source string, n_chars long, measures int, kept boolean, n_lines int, runs string, k1 long, id_ int, best_ int, key int, held int, score double"
    extra = (1, True, 2, "r", 3, 4, 5, 6, 7, 0.5)
    good = text_of(60, rng)
    rows = [(None, None, None, None, None, *extra), (None, good, None, None, None, *extra), (1, good, "en", "s", 5, *extra), (1, good, "en", "s", 5, *extra), (2, "", "en", None, 0, *extra), (3, long, "en", "s", None, *extra)]
    for table in (rows, []):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, spark.createDataFrame(table, schema), folder[0])
            assert dict(out.dtypes).keys() == dict(spark.createDataFrame([], schema).dtypes).keys(), name
            kept = out.collect()
            assert (len(kept) > 0) == bool(table), name
        assert corpus_pipeline.encoding(spark, spark.createDataFrame(table, schema), folder[0]).count() == len(table)
    assert spaced.decontaminate(spark.createDataFrame(rows, schema), spark.createDataFrame([], "item_id long, text string")).count() == len(rows)
