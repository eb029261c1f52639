"""LM scores, token files, packing, language, quality, licenses and secrets against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import common, lang_id, license_scan, lm_score, packing, quality, secret_scan, simple8b
from millrace.llm.common import remainder
from millrace.llm.tokens import Ids, vocabulary
from pyspark.sql import functions as F
from tokenizers import Tokenizer

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = ["a  b", "  x", " ", "\n", "a \n b", "x\n\ny  ", "don't we'll I'M", "naïve café ﬁ Ⅷ ²³ µm ªº", "日本語 テキスト, mixed ok", "a b c", "tab\there", "\x1c a\x1f", "é é x", "<|endoftext|> a <|startoftext|>b", "ΣΑΣ σας ΟΔΟΣ x", "٣ 12 ½ a1b2", "\r\n x\r", "a' s 's", "İstanbul ßẞ", "x ́y", "🎉🎉 party! 👨‍👩‍👧", "a \x85 b\xa0c", "﻿bom"]
TEXTS = [None, "", "   ", "one", "The cat sat on the mat. The cat sat on the mat.", "x" * 50_000, "the of and to in " * 4000, "Same text here, twice.", "Same text here, twice.", *ODD]


def documents(spark, texts=TEXTS):
    """Rows with a null doc_id, a repeated row, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", 0, "c") for i, t in enumerate(texts)]
    rows += [(None, "a null id", None, 0, "c"), rows[-1]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row long, word string")


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_token_ids_are_exact():
    random.seed(5)
    mixed = ["".join(random.choice(["a", "B", " ", "\n", "é", "1", ".", "'s", "\t", "ʼ", "ß", "  ", "語", "Ω", "-"]) for _ in range(40)) for _ in range(400)]
    mixed += ["".join(random.choice(["a", "Bc", " ", "\n", "é", "1", ".", "'s", "'", " x", "**", "É,", "µ", "\0", "<|endoftext|>"]) for _ in range(random.randrange(30))) for _ in range(400)]
    for name, kind in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        ids, library = Ids(vocabulary(name), kind), Tokenizer.from_file(vocabulary(name))
        for text in [t for t in TEXTS if t] + mixed:
            assert np.frombuffer(ids.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:60]
        flat, counts = Ids(vocabulary(name), kind).encode_all([*TEXTS, *mixed], 7)
        for text, n, end in zip([*TEXTS, *mixed], counts.tolist(), np.cumsum(counts).tolist(), strict=True):
            assert flat[end - n : end].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 7], text[:60]
        assert end == len(flat) and Ids(vocabulary(name), kind).encode_all([], 7)[0].size == 0
        plain = Ids(vocabulary(name), kind, special_as_text=True)
        library.encode_special_tokens = True
        for text in ("a <|endoftext|> b", "<|startoftext|>x"):
            assert np.frombuffer(plain.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("high", [1, 2, 17, 300, 60_000, 2**31, 2**60, 2**63])
def test_simple8b_round_trip(high):
    rng = np.random.default_rng(high % 1000)
    for n in (0, 1, 59, 60, 61, 255, 256, 257, 5000):
        ids = rng.integers(0, high, n, dtype=np.uint64)
        ids[rng.random(n) < 0.5] %= 7
        stream = simple8b.pack(ids)
        assert (simple8b.unpack(stream) == ids).all()
        if n == 5000:
            assert (simple8b.unpack(stream, 3, 5) == ids[768:1280]).all()
    with pytest.raises(ValueError):
        simple8b.unpack(b"nope" + bytes(40))


def test_simple8b_files(spark):
    docs = documents(spark)
    out = sorted(simple8b.encode_and_read_back(docs, vocabulary("byte_bpe_50k.json")).collect(), key=lambda r: r["start"])
    encode = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")).encode
    want = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for row, (doc_id, text) in zip(out, want, strict=True):
        ids = [*encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(row) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert simple8b.encode_and_read_back(docs.filter("false"), vocabulary("byte_bpe_50k.json")).count() == 0


def held(pieces, capacity):
    of = {}
    for r in pieces:
        of.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in of.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(of)


def test_packing(spark):
    docs = documents(spark)
    path = vocabulary("word_bpe_49k.json")
    rows = packing.packed(docs, path, 64).collect()
    encode = Tokenizer.from_file(path).encode
    want = Counter()
    for r in docs.collect():
        ids = [*encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k, i in enumerate(range(0, len(ids), 64)):
            want[r["doc_id"], k, i, len(ids[i : i + 64]), zlib.crc32(np.array(ids[i : i + 64], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    total = sum(r["length"] for r in rows)
    assert held(rows, 64) <= -(-total // 64) + 1
    assert packing.packed(docs.filter("false"), path).count() == 0


def test_packing_plan_is_whole_and_tight():
    rng = np.random.default_rng(2)
    for n in (0, 1, 40, 3000):
        lengths = np.clip(rng.lognormal(4, 1, n).astype(int), 1, 512)
        demand = np.bincount(lengths, minlength=513)
        plan = packing.solve(demand, 512)
        assert (sum((c * k for c, k in plan), np.zeros(513, np.int64)) == demand).all()
        assert all(c @ np.arange(513) <= 512 for c, _ in plan)
        assert sum(k for _, k in plan) <= max(-(-int(lengths.sum()) // 512), int((lengths > 256).sum())) * 1.01 + 1
    demand = np.array([0, 0, 5, 7, 3, 0, 0, 0, 0, 0, 0])
    rows, times = packing.fractional(demand, 10)
    assert (rows @ np.arange(11) <= 10).all() and ((rows * times[:, None]).sum(0) <= demand + 1e-6).all() and (rows * times[:, None]).sum() > 14


def lm_tokens(text):
    return [w.encode() for w in SPACE.findall((text or "").translate(ASCII))] + [b""]


def test_lm_scores(spark, monkeypatch):
    random.seed(1)
    words = {"a": ["le", "la", "un", "chat", "Noir"], "b": ["the", "cat", "sat", "Dog", "ran"]}
    texts = [" ".join(random.choice(words[random.choice("ab") if i % 9 == 0 else "ab"[i % 2]]) + (str(random.randrange(40)) if random.random() < 0.2 else "") for _ in range(30)) for i in range(200)]
    docs = documents(spark, [*texts, *TEXTS]).withColumn("held_out", remainder(F.col("doc_id"), 5) == 1)
    monkeypatch.setattr(lm_score, "HEAD", 12)
    monkeypatch.setattr(lm_score, "SEEDS", 4)
    monkeypatch.setattr(lm_score, "CLASSES", 3)
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 900)
    model, table = lm_score.train(docs.filter("not held_out"))
    rows = docs.collect()
    train = [lm_tokens(r["text"]) for r in rows if not r["held_out"]]
    n = Counter(t for toks in train for t in toks)
    total, kinds = sum(n.values()), len(n)
    rare = {bytes(r["word"]): (r["n"], r["class"]) for r in table.collect()}
    assert len(model.head) == 13 and {w: model.counts[i] for w, i in model.head.items()} | {w: c for w, (c, _) in rare.items()} == n and not rare.keys() & model.head.keys()
    own = {w: int(model.class_of[i]) for w, i in model.head.items()} | {w: c for w, (_, c) in rare.items()}
    assert own[b""] == 0 and all(c >= 2 for w, c in own.items() if w)
    history = lambda w: own[w] if w in model.head else lm_score.REST
    size = len(model.transition)
    seen, mass, members = np.zeros((size, size)), Counter(), Counter()
    for w, c in n.items():
        mass[own[w]] += c
        members[own[w]] += 1
    for toks in train:
        for a, b in zip([b"", *toks], toks, strict=False):
            seen[history(a), own[b]] += 1
    share = np.where(np.arange(size) == lm_score.REST, 0, seen.sum(0) + 0.5)
    chance = (seen + lm_score.BACK_OFF * share / share.sum()) / (seen.sum(1, keepdims=True) + lm_score.BACK_OFF)
    assert np.allclose(10**model.transition, chance) and np.allclose(chance.sum(1), 1)
    # each word outside the head is where it raises the likelihood of the classes around it most
    every = np.zeros((size, size))
    for toks in train:
        for a, b in zip([b"", *toks], toks, strict=False):
            every[history(a), history(b)] += 1
    x = lambda v: v * math.log(v) if v > 0 else 0.0
    around = {w: (Counter(), Counter()) for w in rare}
    for toks in train:
        for a, b, c in zip([b"", *toks], toks, [*toks[1:], b""], strict=False):
            if b in rare:
                around[b][0][history(a)] += 1
                around[b][1][history(c)] += 1
    for w, (left, right) in around.items():
        gains = []
        for c in range(2, size):
            gain = sum(x(every[h, c] + k) - x(every[h, c]) for h, k in left.items()) + sum(x(every[c, h] + k) - x(every[c, h]) for h, k in right.items())
            row, column = every[c].sum(), every[:, c].sum()
            gains.append(gain - x(row + right.total()) + x(row) - x(column + left.total()) + x(column))
        assert gains[own[w] - 2] >= max(gains) - 1e-6, w
    got, want = Counter(), Counter()
    for r in lm_score.score(docs, model, table).collect():
        got[r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)] += 1
    emission = lambda w, c: (n[w] + 0.5) / (mass[c] + 0.5 * (members[c] + 1))
    for r in rows:
        toks = lm_tokens(r["text"])
        base = sum(math.log10((n[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in toks)
        score, before = 0.0, b""
        for w in toks:
            p = chance[history(before)]
            score += math.log10(p[own[w]] * emission(w, own[w]) if w in n else sum(p[c] * emission(w, c) for c in range(size)))
            before = w
        want[r["doc_id"], r["held_out"], len(toks), sum(n[w] > 0 for w in toks), total, round(base, 6), round(score, 6)] += 1
    assert got == want
    empty_model, empty_table = lm_score.train(docs.filter("false"))
    assert (empty_model.total, empty_model.distinct) == (0, 0)
    assert lm_score.score(docs, empty_model, empty_table).filter("score < 0").count() == docs.count()
    assert lm_score.score(docs.filter("false"), model, table).count() == 0


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(0)
    true = np.arange(40) % 4
    pairs = rng.poisson(np.where((true[:, None] + 1) % 4 == true[None, :], 30, 0.3))
    of = lm_score.exchange(pairs, 0, 5, 10)
    groups = [set(np.flatnonzero(of == c)) for c in set(of[1:])]
    assert all(len({int(true[u]) for u in g}) == 1 for g in groups)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = remainder(F.col("doc_id"), 4) == 2
    model = lang_id.train(docs.filter(~held))
    out = lang_id.predict(docs, model, held).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.filter("lang_pred = lang").count() >= 0.95 * out.count()
    odd = by_id(lang_id.predict(documents(spark, [None, "", "123 !?", "le la les des que"]), model))
    assert [odd[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and odd[3]["lang_pred"] != "und" and odd[0]["score"] == 0.0
    assert lang_id.train(docs.filter("false")) is None
    assert {r["lang_pred"] for r in lang_id.predict(docs.limit(3), None).collect()} == {"und"}
    one = lang_id.train(docs.filter("lang = 'en'"))
    assert {r["lang_pred"] for r in lang_id.predict(docs.limit(5), one).collect()} <= {"en", "und"}
    kept = lang_id.accepted(documents(spark, [None, "123", "the cat and the dog of that this"]), model)
    assert kept.columns == ["doc_id", "text", "lang", "row", "word"] and kept.filter("text is null or text = '123'").count() == 0


@pytest.mark.parametrize("k", [2, 3, 5, 9, 30])
def test_codewords_differ(k):
    code = lang_id.codewords(k)
    assert len({tuple(r) for r in code}) == k and (abs(code.sum(0)) < k).all()


def test_quality(spark):
    random.seed(4)
    long = " ".join(random.choice("alpha beta gamma delta".split()) for _ in range(300))
    noise = "".join(random.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") + (" " if i % 7 == 0 else "") for i in range(3000))
    texts = [*TEXTS, long, "a b c a b c\n\na b c\n a\n", "#$ %& |<>*", noise]
    docs = documents(spark, texts)
    for r in quality.assess(docs).collect():
        t = texts[r["doc_id"]] if r["doc_id"] is not None else "a null id"
        t = t or ""
        w = SPACE.findall(t)
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        rep = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if SPACE.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), failed)
        assert not (failed and r["kept"])
    assert by_id(quality.assess(docs))[len(texts) - 1]["reason"] == "incompressible"
    assert quality.verdict(5000, 50.0, 0, 1) == "repetitive" and quality.verdict(5000, 2.0, 1, 2) == "chunks" and quality.verdict(5000, 2.0, 0, 2) is None
    assert quality.assess(docs.filter("false")).count() == 0


SECRETS = ["password = hunter22 and token:abc then api-key", 'API_KEY="a.b/c=d+e" secret: tokenly', "password=token:abcdef Secret='x12345'", "AKIA" + "Z9" * 10 + "x AKIA12", "0123456789abcdef01234567 deadbeef", "é日🎉 passwd: 🎉 passwd:longenough password=password=longenough", "key 9fXq2LmZ7RtB4wKc8VyD3nHs end", "see 123e4567-e89b-12d3-a456-426614174000 and /usr/local/share/python3/site", "tokentoken::abcdefg token=abcdef", "AKIA" + "Z9" * 10 + "/9fXq2LmZ7RtB4wKc8VyD3nHsQpa", "deadbeefdeadbeefdeadbeef+9fXq2LmZ7RtB4wKc8VyD3nHs=0123456789abcdef01234567 é", "ab/" * 20_000 + "1", "aB3" * 30 + "é " + "".join(chr(43 + 7 * i * i % 80) for i in range(400))]


def secret_spans(t):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def entropy(candidate, w=20):
    return max((-sum(n / w * math.log2(n / w) for n in Counter(candidate[i : i + w]).values()) for i in range(len(candidate) - w + 1)), default=0.0)


def entropy_spans(t, base):
    """The added spans, by plain windows over what the base spans leave."""
    out, left = [], list(t)
    for s, _, e in base:
        left[s:e] = " " * (e - s)
    for m in re.finditer(secret_scan.CANDIDATE, "".join(left)):
        c = m[0]
        if not re.search("[0-9]", c) or not re.search("[A-Za-z]", c) or any(re.search(p, c) for p in secret_scan.ALLOWED):
            continue
        kind = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", c) else "mixed" if re.search("[a-z]", c) and re.search("[A-Z]", c) else "single"
        if entropy(c) >= secret_scan.THRESHOLDS[kind]:
            out.append((m.start(), 3, m.end()))
    return out


def masked(t):
    base = secret_spans(t)
    out, at = "", 0
    for s, _, e in sorted(base + entropy_spans(t, base)):
        if s >= at:
            out += t[at:s] + secret_scan.MASK
        at = max(at, e)
    return out + t[at:]


def test_secrets(spark):
    texts = [*TEXTS, *SECRETS]
    docs = documents(spark, texts)
    listed = lambda spans: ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    out = by_id(secret_scan.report(docs))
    for i, t in enumerate(texts):
        base = secret_spans(t or "")
        assert out[i]["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest(), t
        assert out[i]["spans"] == listed(sorted(base + entropy_spans(t or "", base))), t
        assert [out[i][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == x for _, x, _ in base) for k in range(3)]
    assert out[texts.index(SECRETS[6])]["n_entropy"] == 1 and out[texts.index(SECRETS[7])]["n_entropy"] == 0
    red = secret_scan.redacted(docs)
    assert red.columns == docs.columns
    for r in red.collect():
        if r["doc_id"] is not None:
            t = texts[r["doc_id"]]
            assert r["text"] == (masked(t) if t is not None else None)
    assert out[texts.index(SECRETS[9])]["n_entropy"] == out[texts.index(SECRETS[10])]["n_entropy"] == 1
    plan = secret_scan.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    assert secret_scan.report(docs.filter("false")).count() == 0


def test_secrets_in_very_long_candidates(spark):
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    key = "".join(rng.choice(letters) for _ in range(300_000))
    texts = [f"é {key} end", "x" * 400_000, "ab/" * 100_000 + "1", "z1" * 150_000, " é ".join("%024x" % rng.getrandbits(96) for _ in range(20_000))]
    out = by_id(secret_scan.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [out[i]["spans"] for i in range(4)] == [f"entropy:2:{len(key) + 2}", "", "", ""]
    assert out[4]["n_hex"] == 20_000 and out[4]["spans"] == ",".join(f"hex:{27 * i}:{27 * i + 24}" for i in range(20_000))


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 700])
def test_running_sums_go_over_blocks(spark, n):
    values = [(7 * i) % 11 - 3 for i in range(n)]
    row = spark.createDataFrame([(values,)], "x array<int>").select(secret_scan.running(F.col("x"), secret_scan.plus, F.lit(0)).alias("sums"), secret_scan.running(F.col("x"), F.greatest, F.lit(0)).alias("most")).first()
    assert row["sums"] == [sum(values[:i]) for i in range(n + 1)] and row["most"] == [max([0, *values[:i]]) for i in range(n + 1)]


def test_licenses(spark):
    texts = [*TEXTS, "MIT License MIT license, apache-License", "Licensed under the Apache License, Version 2.0", "the GNU General Public License v3 é", "SPDX-License-Identifier: BSD-3-Clause", "CC BY", "CC-BY-SA 4.0 license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit licenses, commit license"]
    docs = documents(spark, texts)
    out = by_id(license_scan.scan(docs))
    for i, t in enumerate(texts):
        w = WORD.findall((t or "").translate(ASCII))
        at, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    at.append(k)
                    labels.add(label)
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))), t
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    n = len(TEXTS)
    assert out[n + 1]["labels"] == "apache,apache-2.0" and "gpl-3.0" in out[n + 2]["labels"] and "bsd" in out[n + 3]["labels"] and "mit" in out[n + 6]["labels"]
    assert "cc-by-sa" in out[n + 5]["labels"]
    assert len(license_scan.RULES) > 300 and len({r.regex for r in license_scan.RULES}) > 300
    assert all(re.compile(r.regex) for r in license_scan.RULES)
    plan = license_scan.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    assert license_scan.scan(docs.filter("false")).count() == 0


def matching(pattern, rng):
    """A random string that a rule's regex matches, without the spaces around it."""

    def one(tree):
        out = ""
        for op, arg in tree:
            kind = str(op)
            if kind == "LITERAL":
                out += chr(arg)
            elif kind == "NOT_LITERAL":
                out += "q"
            elif kind == "IN":
                low, high = (arg[0][1], arg[-1][1]) if str(arg[0][0]) == "LITERAL" else arg[0][1]
                out += chr(rng.choice((low, high)))
            elif kind == "BRANCH":
                out += one(rng.choice(arg[1]))
            elif kind == "SUBPATTERN":
                out += one(arg[3])
            elif kind == "MAX_REPEAT":
                out += "".join(one(arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
            else:
                assert kind == "ASSERT", kind
        return out

    text = one(re._parser.parse(pattern))
    assert re.search(pattern, f"{text} ")
    return text.strip()


def test_license_gate_holds_for_every_rule(spark):
    rng = random.Random(7)
    for rule in license_scan.RULES:
        for _ in range(60):
            assert re.search(license_scan.GATE, f" {matching(rule.regex, rng)} "), rule
    texts = {"released under Apache 2.0": "apache-2.0", "distributed under the terms of the MPL 2.0": "mpl-2.0", "Artistic 2.0": "artistic-2.0", "EPL 1.0": "epl-1.0", "EUPL 1.2": "eupl-1.2", "All rights reserved.": "all-rights-reserved", "Neither the name of X nor the names of its contributors may be used to endorse": "bsd-3-clause", "All advertising materials mentioning features or use of this software must display": "bsd-4-clause"}
    for before in ("", "public license "):
        docs = spark.createDataFrame([(i, before + t) for i, t in enumerate(texts)], "doc_id long, text string")
        out = by_id(license_scan.scan(docs))
        assert [label in out[i]["labels"].split(",") for i, label in enumerate(texts.values())] == [True] * len(texts), before


def all_detections(text):
    """(start, words, label) by all rules without gate or keywords, suppressed by comparing spans: a match counts among words that no rule before it has."""
    words, out = WORD.findall(text.translate(ASCII)), []
    taken = [False] * len(words)
    for rule in license_scan.RULES:
        shown = [license_scan.TAKEN if t else w for w, t in zip(words, taken, strict=True)]
        for m in re.finditer(rule.regex, f" {' '.join(shown)} "):
            start, n = f" {' '.join(shown)} "[: m.start()].count(" "), m[0].count(" ")
            out.append((start, n, rule.label))
            taken[start : start + n] = [True] * n
    return out


def test_license_keywords_lose_no_rule(spark):
    rng = random.Random(9)
    for rule in license_scan.RULES:
        for _ in range(60):
            text = f" {matching(rule.regex, rng)} "
            assert any(f" {k} " in text for k in rule.keywords), (rule, text)
    told = {"Licensed under the Creative Commons Attribution 4.0 International License": "cc-by", "Creative Commons Attribution Share Alike 4.0": "cc-by-sa-4.0", "under the Creative Commons Zero license": "cc0", "Creative Commons Attribution NonCommercial 3.0": "cc-by-nc-3.0", "Creative Commons Attribution No Derivatives 2.5": "cc-by-nd-2.5", "Expat License": "mit", "Do what the fuck you want to public license, version 2": "wtfpl-2.0", "Open Data Commons Attribution License": "odc-by", "SPDX-License-Identifier: ECL-2.0": "ecl", "SPDX-License-Identifier: GFDL-1.3-or-later": "gfdl", "SPDX-License-Identifier: IJG": "ijg"}
    made = [matching(rule.regex, rng) for rule in license_scan.RULES]
    mixed = [" ".join(rng.choices([*made, "some", "words", "the", "license", "gpl", "version 2", "under the"], k=rng.randrange(2, 9))) for _ in range(150)]
    texts = [*told, *made, *mixed]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out, spans = by_id(license_scan.scan(docs)), by_id(license_scan.detected(docs))
    for i, text in enumerate(texts):
        want = all_detections(text)
        assert [(d["start"], d["n_words"], d["label"]) for d in spans[i]["detections"]] == want, text
        line = f" {' '.join(WORD.findall(text.translate(ASCII)))} "
        labels = {x for *_, x in want} | {label for phrase, label in license_scan.PHRASES.items() if f" {phrase} " in line}
        assert labels == set(filter(None, out[i]["labels"].split(","))), text
        assert any(x == told.get(text, x) or x.startswith(told.get(text, x) + "-") for x in labels), (text, labels)


def test_license_priority_holds_whichever_match_begins_first(spark):
    texts = ["licensed under the MPL 2.0", "GNU GPL version 3 license", "under the Apache License 2.0 or the MIT license"]
    out = by_id(license_scan.detected(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    labels = [[(d["start"], d["label"]) for d in out[i]["detections"]] for i in range(len(texts))]
    assert labels == [[(3, "mpl-2.0")], [(0, "gpl-3.0")], [(2, "apache-2.0"), (8, "mit")]]


def test_licenses_in_a_very_long_text(spark):
    n = 4000
    docs = spark.createDataFrame([(1, "some words, MIT License. GPL v2! " * n + "x " * 200_000)], "doc_id long, text string")
    r = license_scan.scan(docs).first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["labels"]) == (6 * n + 200_000, n, 2, 6 * (n - 1) + 2, "gpl-2.0,mit")
    assert len(license_scan.detected(docs).first()["detections"]) == 2 * n


def test_quality_judges_chunks_by_their_own_band(spark):
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    known = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choices(known, k=n))
    noise = lambda n: "".join(rng.choice(letters) + (" " if i % 76 == 75 else "") for i in range(n))
    # lines of one form with running numbers: no three words repeat, yet a chunk compresses over six times
    lines = lambda n: "".join(f"the-same-long-line-over-and-over-again-with-nothing-new-in-it-but-a-number {i}\n" for i in range(n))
    texts = [prose(6000), prose(2000) + " " + noise(14_000), prose(4000)[:16_384] + " " + lines(130), (prose(1000)[:4096] + noise(2000))[:5900]]
    out = by_id(quality.assess(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert out[0]["reason"] is None and out[0]["chunks_outside"] == 0
    assert [out[i]["reason"] for i in (1, 2, 3)] == ["chunks"] * 3


def test_a_shared_folder_is_asked_for_off_one_machine(spark):
    assert common.one_machine("local[4]") and common.one_machine("local") and not any(map(common.one_machine, ("local-cluster[3,2,3000]", "spark://a:7077", "yarn", "")))

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Context:
        applicationId = "x"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session())
    held = common.written(spark.range(3), "dropped")
    assert held.count() == 3
    common.dropped(held)
    assert not list(Path(held.written_to.removeprefix("file://")).parent.glob("dropped-*"))


def test_wide_rows_go_to_python_in_small_batches(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('x', 10000)").alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    found = [tuple(r) for r in common.written(docs.mapInArrow(sizes, "rows long, bytes long"), "sizes").collect()]
    assert sum(n for n, _ in found) == 4000
    assert max(n for _, n in found) <= common.CHUNK_BYTES + 20_000
    assert spark.conf.get(limit) == before
