"""Near-duplicates, exact repeats, decontamination and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from millrace.llm import decontam, lang_id, packing, simhash, suffix_dedup
from millrace.llm.common import remainder, written
from millrace.llm.tokens import vocabulary
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from test_text_operators import documents, held, masked

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def print_of(text):
    w = (text or "").encode().lower().split()
    shingles = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in shingles) > len(shingles))


def groups(prints):
    """Component names by all pairs: prints is a list of (doc_id, fingerprint)."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    names = {}
    for i, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            names[find(i)] = min(doc_id, names.get(find(i), doc_id))
    return [names.get(find(i)) for i in range(len(prints))]


def test_simhash_groups(spark):
    random.seed(2)
    base = [random.choice("abcdefgh") + str(random.randrange(300)) for _ in range(400)]
    texts = [None, "", " \n", "one", "one two", "One TWO", "é x y z w", "x" * 100_000]
    for _ in range(40):
        copy = list(base)
        for _ in range(random.randrange(3)):
            copy[random.randrange(400)] = "changed"
        texts.append(" ".join(copy))
    docs = documents(spark, texts)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = [(d, print_of(t)) for d, t in rows]
    want = Counter((d, f"{p:016x}", c) for (d, p), c in zip(prints, groups(prints), strict=True))
    assert Counter(tuple(r) for r in simhash.simhash_groups(docs).collect()) == want
    assert simhash.simhash_groups(docs.filter("false")).count() == 0


def wide_pairs(texts):
    """All pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by comparing all."""
    sets = []
    for t in texts:
        w = (t or "").translate(ASCII).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or (0.8 <= len(sets[i]) / max(1, len(sets[j])) <= 1.25 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))]


def joined(n, pairs):
    """The smallest member of each one's component."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def edited(rng, words, share):
    out = list(words)
    for _ in range(max(1, int(share * len(out)))):
        i, what = rng.randrange(len(out)), rng.random()
        out[i : i + 1] = [] if what < 0.3 else [out[i], "new" + str(rng.randrange(99))] if what < 0.6 else ["changed" + str(rng.randrange(99))]
    return out


@pytest.mark.parametrize("limit", [512, 6])
def test_near_duplicates_against_all_pairs(spark, limit):
    rng = random.Random(12)
    line = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(n)]
    passage, texts = line(60), [None, "", "  ", "one", "One", "a b c d", "a b c d e", "x" * 50_000]
    for n in (30, 80, 200, 500):
        for _ in range(12):
            own = line(n)
            texts += [" ".join(own), *(" ".join(edited(rng, own, rng.choice((0.005, 0.01, 0.02, 0.04)))) for _ in range(3))]
    texts += [" ".join(passage + line(50)) for _ in range(25)]
    crowd = line(300)
    texts += [" ".join(edited(rng, crowd, 0.005)) for _ in range(30)]
    docs = documents(spark, texts).filter("doc_id IS NOT NULL")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, limit).collect()}
    pairs = wide_pairs(texts)
    assert len(got) == len(texts) and len(pairs) > 400
    # no two documents are brought together that similarity doesn't connect
    whole, groups_of = joined(len(texts), pairs), {}
    for d, c in got.items():
        groups_of.setdefault(c, []).append(d)
    assert all(c == min(ds) and len({whole[d] for d in ds}) == 1 for c, ds in groups_of.items())
    assert sum(got[i] == got[j] for i, j in pairs) >= (0.97 if limit > 100 else 0.9) * len(pairs)
    kept = simhash.representatives(documents(spark, texts))
    assert kept.columns == docs.columns
    if limit > 100:
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter({None: 1, **{c: 1 for c in groups_of}})
    assert simhash.near_duplicates(docs.filter("false")).count() == 0


@pytest.mark.parametrize("limit", [512, 6])
def test_near_duplicates_lose_no_link(spark, limit):
    rng = random.Random(21)
    line = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(n)]
    texts = []
    for _ in range(300):
        own = line(104)
        # 89 of 111 shingles are shared: 0.802; and just under it, 88 of 112
        texts += [" ".join(own), " ".join(own[:93] + line(11)), " ".join(own[12:] + line(12))]
    # a crowd in which each is like the next ones only, with a line that all of them and others hold
    long, notice = line(300), line(30)
    texts += [" ".join(notice + long[4 * i : 4 * i + 90]) for i in range(50)]
    texts += [" ".join(notice + line(40)) for _ in range(20)]
    docs = documents(spark, texts).filter("doc_id IS NOT NULL")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, limit).collect()}
    pairs = wide_pairs(texts)
    assert len(pairs) > 390
    assert got == dict(enumerate(joined(len(texts), pairs)))


@pytest.mark.parametrize("limit", [512, 6])
def test_a_pair_that_shares_many_shingles_is_reported_once(spark, limit, monkeypatch):
    rng, made, whole = random.Random(31), [], simhash.pairs_apart
    base = [rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(300)]
    texts = [" ".join(edited(rng, base, 0.01)) for _ in range(30)]

    def counted(rows):
        made.append(written(whole(rows), "pairs"))
        return made[-1]

    monkeypatch.setattr(simhash, "likely", lambda rows: [])  # leaves all links to the exact step
    monkeypatch.setattr(simhash, "pairs_apart", counted)
    out = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), limit).collect()
    pairs = wide_pairs(texts)
    assert [c for _, c in sorted(tuple(r) for r in out)] == joined(len(texts), pairs)
    assert made[0].distinct().count() >= len(pairs) > 200
    assert made[0].count() <= 1.2 * made[0].distinct().count()


def test_parity_bitmaps_pass_every_similar_pair():
    rng = np.random.default_rng(5)
    sets = []
    for n in (1, 5, 63, 64, 65, 130, 1000, 20_000):
        own = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        sets += [own, *(np.union1d(own[: len(own) - cut], rng.integers(0, 2**63, more, dtype=np.uint64)) for cut, more in ((n // 9, n // 9), (n // 5, 0), (0, n // 4), (n // 3, n // 3)))]
    a, b = np.triu_indices(len(sets), 1)
    some = simhash.sized(np.array([len(s) for s in sets]), a, b)
    a, b = a[some], b[some]
    like = np.array([simhash.jaccard(sets[i], sets[j]) >= 0.8 for i, j in zip(a, b, strict=True)])
    passed = simhash.possible(np.array([len(s) for s in sets]), [simhash.parity(s) for s in sets], a, b)
    assert like.sum() > 20 and passed[like].all() and not passed.all()


def test_near_duplicates_of_the_test_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    place = {r["doc_id"]: i for i, r in enumerate(rows)}
    got = {place[r["doc_id"]]: place[r["component_id"]] for r in simhash.near_duplicates(docs).collect()}
    pairs = [(i, j) for i, j in wide_pairs([r["text"] for r in rows])]
    texts = [" ".join((r["text"] or "").translate(ASCII).encode().decode().split()) for r in rows]
    unlike = [(i, j) for i, j in pairs if texts[i] != texts[j]]
    assert unlike and sum(got[i] == got[j] for i, j in unlike) >= 0.9 * len(unlike)
    assert all(got[i] == got[j] for i, j in pairs if texts[i] == texts[j])
    whole = joined(len(rows), pairs)
    assert all(whole[i] == whole[c] for i, c in got.items())


def test_links_hold_when_shards_are_dealt_anew(spark):
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    values = {int(c) for c in centre}
    for c in centre:
        for _ in range(60):
            v = int(c)
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                v ^= 1 << int(b)
            values.add(v)
    values |= {0, 1, 3, 7, 2**64 - 1}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "node long")
    names = dict(zip(signed, groups([(v, v % (1 << 64)) for v in signed]), strict=True))
    for limit in (2, 10, 4096):
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, limit)).collect()}
        assert {v: roots.get(v, v) for v in signed} == names, limit


def test_bk_tree_finds_every_link():
    rng = np.random.default_rng(8)
    values = np.unique(rng.integers(0, 2**12, 900, dtype=np.uint64))
    rng.shuffle(values)
    shard = np.sort(rng.integers(0, 3, len(values)))
    a, b = simhash.tree_links(values, shard, 3, 64)
    got = {(int(max(x, y)), int(min(x, y))) for x, y in zip(a, b, strict=True)}
    assert len(got) == len(a)
    assert got == {(i, j) for i in range(len(values)) for j in range(i) if shard[i] == shard[j] and int(values[i] ^ values[j]).bit_count() <= 3}


def brute_removal(texts, length=400):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i] += 1
                hit[i + length] -= 1
        gone = np.cumsum(hit)[:-1] > 0
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def repeats(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    passage, other = text(700), text(430)
    out = [None, "", "short", passage, passage, passage[:399], "a" * 1200, "ab" * 500, text(3000)]
    out += [text(rng.randrange(300)) + passage[rng.randrange(200) :] + text(50) for _ in range(12)]
    out += [text(20) + other + text(rng.randrange(600)) + passage[: rng.randrange(450, 700)] for _ in range(8)]
    edited = text(2500)
    for _ in range(6):
        i = rng.randrange(2400)
        out.append(edited[:i] + text(rng.randrange(4)) + edited[i + 1 :])
    return out


@pytest.mark.parametrize("limit", [3, 8192])
def test_suffix_dedup(spark, limit, monkeypatch):
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (limit,))
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", limit)
    texts = repeats(limit)
    docs = documents(spark, texts)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    want = Counter((d, *x) for (d, _), x in zip(rows, brute_removal([t for _, t in rows]), strict=True))
    assert Counter(tuple(r) for r in suffix_dedup.deduplicated(docs).collect()) == want
    kept = {r["doc_id"]: r for r in suffix_dedup.deduplicated(docs, with_text=True).collect()}
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in kept.values())
    assert suffix_dedup.deduplicated(docs.filter("false")).count() == 0


def brute_passages(rows, n=51):
    """Of (doc_id, text) rows: the words in strings of n words that another row has too."""
    split = [re.findall(r"[^ \t-\r]+", t or "") for _, t in rows]
    seen = {}
    for k, w in enumerate(split):
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), set()).add(k)
    return [len({j for i in range(len(w) - n + 1) if len(seen[tuple(w[i : i + n])]) > 1 for j in range(i, i + n)}) for w in split]


@pytest.mark.parametrize("limit", [3, 8192])
def test_passages_of_over_50_words(spark, limit, monkeypatch):
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (limit,))
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", limit)
    monkeypatch.setattr(suffix_dedup, "PASSAGES_AT_ONCE", 200)
    rng = random.Random(limit)
    some = lambda n: [rng.choice("abcdefgé") + str(rng.randrange(30)) for _ in range(n)]
    passage, other = some(55), some(140)
    put = lambda *parts: rng.choice((" ", "\n", " \t "))[:3].join(w for part in parts for w in part)
    rows = [(1, None), (2, ""), (3, put(some(60))), (4, put(passage[:50], some(30))), (5, put(passage[:51])), (6, put(other, some(9), other))]
    rows += [(7, put(some(80))), (None, put(some(70)))] * 2  # rows that occur twice
    rows += [(20, "x " * 300), (21, "x " * 60 + "y"), (22, "z " * 400), (23, put(["w" * 9000], passage, some(3)))]
    rows += [(100 + i, put(some(rng.randrange(90)), passage, some(rng.randrange(90)))) for i in range(15)]
    rows += [(200 + i, put(some(9), other[rng.randrange(50) : rng.randrange(90, 140)], some(40), passage[rng.randrange(3) :])) for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.deduplicated(docs, passages=True)
    plain = suffix_dedup.deduplicated(docs)
    assert got.columns == [*plain.columns, "n_passage_words"]
    got = got.collect()
    want = brute_passages(rows)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_passage_words"]) for r in got) == Counter((d, len((t or "").encode()), n) for (d, t), n in zip(rows, want, strict=True))
    assert Counter(tuple(r)[:5] for r in got) == Counter(map(tuple, plain.collect()))
    # passages too short for the bytes' rule, and others
    short = {r["doc_id"] for r in got if r["n_passage_words"] >= 51 and not r["n_removed"]}
    assert short and {r["doc_id"]: r["n_passage_words"] for r in got if r["doc_id"] in (2, 3, 4, 22)} == {2: 0, 3: 0, 4: 0, 22: 0}
    assert suffix_dedup.deduplicated(docs.filter("false"), passages=True).count() == 0


def test_suffix_array():
    rng = random.Random(4)
    for _ in range(1500):
        t = [rng.randrange(rng.choice((1, 2, 3, 9))) for _ in range(rng.randrange(30))]
        order = suffix_dedup.suffix_array(t)
        assert order == sorted(range(len(t)), key=lambda i: t[i:])
        lcp, rank = suffix_dedup.common_prefixes(t, order)
        for r in range(1, len(t)):
            a, b = t[order[r - 1] :], t[order[r] :]
            assert lcp[r] == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def brute_hits(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate(ASCII))
    windows = {}
    for name, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).update([] if name is None else [str(name)])
    out = []
    for t in texts:
        w, hit, names = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    names |= found
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("room", [500_000, 40])
def test_decontamination(spark, room, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", room)
    rng = random.Random(3)
    line = lambda n: " ".join(rng.choice(["the", "of", "Cat", "dog", "x1", "é", "q-r"]) + str(rng.randrange(20)) for _ in range(n))
    items = [(i, line(n)) for i, n in enumerate([30, 12, 10, 9, 4, 1, 14])] + [(7, None), (8, "?!"), (9, "the the the the the the the the the the the"), (1, "again under a known id"), (0, None)]
    items[6] = (6, items[0][1])
    items += [(None, "an item that has no id"), (None, items[1][1])]
    texts = [None, "", "...", line(500), "the " * 40, items[3][1], items[5][1].upper()]
    texts += [f"{line(5)} {items[i][1]}, {line(7)}! {items[0][1][20:]}" for i in range(6)]
    texts += [" ".join(items[0][1].split()[5:14]), " ".join(items[0][1].split()[5:15]), "z" * 60_000, "here is an item that has no id, and more"]
    docs = documents(spark, texts)
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, n_words string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = Counter((d, *x) for (d, _), x in zip(rows, brute_hits([t for _, t in rows], items), strict=True))
    out = decontam.contamination(docs, bench)
    assert Counter(tuple(r) for r in out.drop("n_near_items").collect()) == want
    bad = {k[0] for k in want if k[5]}
    assert {r["doc_id"] for r in decontam.clean(docs.filter("doc_id is not null"), bench).collect()} == {d for d, _ in rows if d is not None} - bad
    assert decontam.contamination(docs.filter("false"), bench).count() == 0
    assert decontam.contamination(docs, bench.filter("false")).filter("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta y gamma z z delta"), (2, "alpha " + "x " * 60 + "beta gamma delta"), (3, "alpha beta gamma delta")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "delta gamma alpha beta")], "item_id string, text string")
    out = {r["doc_id"]: (r["items"], r["near_items"]) for r in decontam.hits(docs, items).collect()}
    assert out == {1: ([], ["i"]), 2: ([], []), 3: ([], ["i"])}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    model = lang_id.train(docs.filter(remainder(F.col("doc_id"), 4) != 2))
    known = {r["doc_id"] for r in lang_id.predict(docs, model).collect() if r["lang_pred"] != "und" and not r["ambiguous"]}
    rows = [r for r in rows if r["doc_id"] in known]
    # one document of each group of similar texts; whether the groups are right is tested above
    alike = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs.join(spark.createDataFrame([(d,) for d in known], "doc_id long"), "doc_id")).collect()}
    whole = joined(len(rows), wide_pairs([r["text"] for r in rows]))
    assert all(whole[i] == whole[j] for i in range(len(rows)) for j in range(i) if alike[rows[i]["doc_id"]] == alike[rows[j]["doc_id"]])
    rows = [r for r in rows if r["doc_id"] == alike[r["doc_id"]]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r, h in zip(rows, brute_hits([r["text"] for r in rows], items), strict=True) if not h[4]]
    encode = Tokenizer.from_file(vocabulary("word_bpe_49k.json")).encode
    want = Counter()
    for r in rows:
        n = len(encode(masked(r["text"] or ""), add_special_tokens=False).ids) + 1
        for k, i in enumerate(range(0, n, packing.CAPACITY)):
            want[r["doc_id"], k, i, min(packing.CAPACITY, n - i)] += 1
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in out) == want
    total = sum(r["length"] for r in out)
    assert held(out, packing.CAPACITY) <= -(-total // packing.CAPACITY) + 1


def test_stages_take_empty_tables_and_clashing_columns(spark):
    docs = documents(spark, [None, "", "the cat sat on the mat with that dog and this bird", "the cat sat on the mat with that dog and this bird"])
    for table in (docs, docs.filter("false")):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            columns, now = now.columns, stage(spark, now, SF)
            assert now.columns == columns or name == "packing"
        assert now.count() >= 0


@pytest.mark.parametrize("room", [500_000, 15])
def test_proximity_does_not_depend_on_the_segments(spark, room, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", room)
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    replaced = passage.replace("beta", "new")
    texts = [passage, replaced, "some other words", "x " * 3000 + replaced, "x alpha beta gamma delta epsilon", "zeta eta theta iota kappa x", "alpha beta gamma delta " + "x " * 60 + "epsilon zeta eta theta iota kappa", "new new beta", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([("i", passage), ("j", "other words that never come up in any of these"), ("k", "red green blue")], "item_id string, text string")
    for parts in (1, 3, 40):
        out = {r["doc_id"]: r["near_items"] for r in decontam.hits(docs.repartition(parts, "doc_id") if parts > 1 else docs.coalesce(1), items).collect()}
        assert out == {i: ["i"] if i in (0, 1, 3) else [] for i in range(len(texts))}, parts
